"""One representation against many variables, each on its own complete rows.

All variables share the representation, so most of what a variable's ridge needs is shared: its cross products are the
fold's total minus those of the rows that the variable lacks, or the sum over those that have it, whichever are fewer. Only these
minorities are routed by (variable, fold, part) before any outer product is made, and a task holds one matrix at a
time. Products of the representation with all variables come from one pass: a row's vector meets all its variables at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators import linear
from panelforge.operators.lineage import cut
from panelforge.operators.vectors import matrix

#: Rows of one variable and fold that make a matrix in one task.
PART = 1 << 20
#: Bytes of sums that a task holds before they go out, and up to which the list of variables is broadcast.
HELD, SMALL = 64 << 20, 16 << 20


def _products(variable_kind: pa.DataType, fold_kind: pa.DataType, fold: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(variable, fold, sums)``: per variable and fold the sums of y (1, x) and of y^2 over this task's rows."""
    total: dict[tuple, np.ndarray] = {}
    size = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], variable_kind), pa.array([k[1] for k in total], fold_kind), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["variable", "fold", "sums"])

    for batch in batches:
        x = matrix(batch["_x"])
        if not len(x):
            continue
        x = np.column_stack([np.ones(len(x)), x])
        observed = batch["observed"]
        of = np.repeat(np.arange(len(x)), np.diff(observed.offsets.to_numpy()))
        flat = observed.flatten()
        y, yy = (pc.struct_field(flat, c).to_numpy(zero_copy_only=False) for c in ("y", "yy"))
        names = pc.struct_field(flat, "variable").dictionary_encode()
        code, names = names.indices.to_numpy(), names.dictionary.to_pylist()
        folds = batch[fold].to_pylist()
        for f in sorted(set(folds)):
            rows = np.array([v == f for v in folds])
            at = rows[of]
            dense, square = np.zeros((len(x), len(names))), np.zeros(len(names))
            np.add.at(dense, (of[at], code[at]), y[at])
            np.add.at(square, code[at], yy[at])
            both = np.vstack([x[rows].T @ dense[rows], square])
            for c in np.unique(code[at]).tolist():
                key = names[c], f
                if key in total:
                    total[key] += both[:, c]
                else:
                    total[key] = both[:, c].copy()
                    size += both.shape[0] * 8
            if size > HELD:
                yield out()
                total.clear()
                size = 0
    if total:
        yield out()


def sorted_grams(keys: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(keys, gram)`` of rows ``(keys, _x, _w)`` sorted by key: one Gram matrix of (1, x) is held, and goes out when its key ends."""
    held: list = []

    def out() -> pa.RecordBatch:
        first, gram = held
        return pa.RecordBatch.from_arrays([*first.columns, pa.array([gram.tobytes()], pa.binary())], [*keys, "gram"])

    for batch in batches:
        n = len(batch)
        if not n:
            continue
        new = np.zeros(n, bool)
        for c in keys:
            v = batch[c]
            new[1:] |= pc.not_equal(v[1:], v[:-1]).to_numpy(zero_copy_only=False)
        starts = np.append(0, np.flatnonzero(new))
        x = matrix(batch["_x"])
        x = np.column_stack([np.ones(n), x])
        w = batch["_w"].to_numpy(zero_copy_only=False)
        for a, b in zip(starts, np.append(starts[1:], n)):
            first = batch.select(keys).slice(a, 1)
            gram = (x[a:b] * w[a:b, None]).T @ x[a:b]
            if held and held[0].equals(first):
                held[1] += gram
            else:
                if held:
                    yield out()
                held = [first, gram]
    if held:
        yield out()


def screen(long: DataFrame, vectors: DataFrame, variable: str, row: str, value: str, vector: str, fold: str, alpha: float = 50.0, least: int = 150) -> DataFrame:
    """``(variable, n, r2)``: a ridge of each variable on a representation, out of fold, from variables with at least ``least`` rows.

    ``vectors`` has a row, its fold and its vector once; rows with a null or incomplete vector are left out. ``long`` has a row for each value of a
    variable (nulls are missing; repeated ones count as often). A variable's systems are solved where its sums meet. A variable that
    doesn't vary has a null r2; no rows give no rows.
    """
    spark = long.sparkSession
    x = cut(linear.design(vectors, vector, keep=[row, fold]).drop("_w"))
    totals = linear.grams(x.withColumn("_w", F.lit(1.0)), fold)
    kind = dict(long.dtypes)[variable]
    schema = f"{variable} {kind}, n long, r2 double"
    if not totals:
        return spark.createDataFrame([], schema)
    number = F.col(value).cast("double")
    observed = long.where(number.isNotNull() & ~F.isnan(number)).groupBy(F.col(row), F.col(variable).alias("variable"))
    observed = observed.agg(F.sum(number).alias("y"), F.sum(number * number).alias("yy"), F.count("*").cast("double").alias("times"))
    observed = observed.groupBy(row).agg(F.collect_list(F.struct("variable", "y", "yy", "times")).alias("observed"))
    held = cut(x.join(observed, row, "left"))
    rows = sum(g[0, 0] for g in totals.values())
    counted = held.select(F.explode("observed").alias("o")).groupBy("o.variable").agg(F.count("*").alias("have"), F.max("o.times").alias("times"))
    lacking = (F.col("have") > rows / 2) & (F.col("times") == 1)
    counted = counted.select("variable", lacking.alias("lacking"), F.ceil(F.when(lacking, rows - F.col("have")).otherwise(F.col("have")) / PART).alias("parts"))
    modes = cut(counted.withColumn("parts", F.greatest("parts", F.lit(1)).cast("int")))
    near = F.broadcast(modes) if modes.count() * 64 <= SMALL else modes
    have = held.select(row, fold, "_x", F.explode("observed").alias("o")).select(row, fold, "_x", "o.variable", F.col("o.times").alias("_w")).join(near.where("not lacking"), "variable")
    # rows without a variable: those of all that are mostly there, but for the row's own
    every = modes.where("lacking").agg(F.sort_array(F.collect_set("variable")).alias("_every"))
    own = F.coalesce(F.transform("observed", lambda o: o["variable"]), F.expr(f"cast(array() as array<{kind}>)"))
    lack = held.crossJoin(F.broadcast(every)).select(row, fold, "_x", F.explode(F.array_except("_every", own)).alias("variable"), F.lit(1.0).alias("_w")).join(near.where("lacking"), "variable")
    keys = ["variable", "fold", "part"]
    routed = have.unionByName(lack).select("variable", F.col(fold).alias("fold"), F.pmod(F.xxhash64(row), F.col("parts")).cast("int").alias("part"), "lacking", "_x", "_w")
    kinds = f"variable {kind}, fold {dict(x.dtypes)[fold]}"
    routed = routed.repartition(*keys).sortWithinPartitions(*keys)
    grams = routed.mapInArrow(partial(sorted_grams, [*keys, "lacking"]), f"{kinds}, part int, lacking boolean, gram binary")
    one = next(iter(held.select("observed", fold).limit(0).toArrow().schema.field("observed").type.value_type))
    made = held.where("observed is not null").mapInArrow(partial(_products, one.type, held.select(fold).limit(0).toArrow().schema.field(fold).type, fold), f"{kinds}, sums binary")

    def added(table: pa.Table) -> pa.Table:
        return pa.table({"variable": table["variable"][:1], "fold": table["fold"][:1], "sums": pa.array([linear._added(table["sums"]).tobytes()], pa.binary())})

    made = made.groupBy("variable", "fold").applyInArrow(added, f"{kinds}, sums binary")
    both = grams.select("variable", "fold", "lacking", "gram", F.lit(None).cast("binary").alias("sums")).unionByName(made.join(near.select("variable", "lacking"), "variable").select("variable", "fold", "lacking", F.lit(None).cast("binary").alias("gram"), "sums"))
    given = spark.sparkContext.broadcast(totals)

    def solved(table: pa.Table) -> pa.Table:
        return _solved(given.value, variable, alpha, least, table)

    return both.groupBy("variable").applyInArrow(solved, schema)


def _solved(totals: dict[object, np.ndarray], variable: str, alpha: float, least: int, table: pa.Table) -> pa.Table:
    """The out-of-fold R2 of one variable, from its matrices and sums."""
    lacking = table["lacking"][0].as_py()
    size = next(iter(totals.values())).shape[0]
    minority: dict[object, np.ndarray] = {}
    sums: dict[object, np.ndarray] = {}
    for f, gram, part in zip(table["fold"].to_pylist(), table["gram"], table["sums"]):
        if gram.is_valid:
            minority[f] = minority.get(f, 0) + np.frombuffer(gram.as_buffer()).reshape(size, size)
        else:
            sums[f] = np.frombuffer(part.as_buffer())
    folds = []
    for f, s in sorted(sums.items()):
        own = np.zeros((size + 1, size + 1))
        own[:-1, :-1] = totals[f] - minority.get(f, 0) if lacking else minority[f]
        own[-1, :-1] = own[:-1, -1] = s[:size]
        own[-1, -1] = s[size]
        folds.append(own)
    n = int(round(sum(g[0, 0] for g in folds)))
    if n < least or len(folds) < 2:
        return pa.table({variable: table["variable"][:0], "n": pa.array([], pa.int64()), "r2": pa.array([], pa.float64())})
    total, rss = sum(folds), 0.0
    spread = linear.moments_of(total, 0)[2][-1, -1] * n
    for own in folds:
        v = np.append(-linear.ridge(total - own, size - 1, alpha)[:, 0], 1.0)
        rss += v @ own @ v
    return pa.table({variable: table["variable"][:1], "n": pa.array([n]), "r2": pa.array([float(1 - rss / spread) if spread > 1e-12 * max(total[-1, -1], 1e-300) else None], pa.float64())})

"""Mixing sources to target weights: temperature, bisection, budgeted block permutations.

A source's weight is its token share to the power of an exponent in [0, 1], normalised. The exponent
is the smallest that keeps repetition within a limit, or the larger one at which the weights' entropy
falls to a target; each is found by bisection on the table of sources. The weights are realised by
blocks: a source's documents are hashed into blocks, each pass over it takes the blocks in an order of
its own, and the last pass ends with the block that fills the source's budget. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.llm.store import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
REPEATS, ENTROPY, SEED = 4.0, 0.95, 17
#: Blocks of a source, at least, and tokens of a block beyond that.
BLOCKS, BLOCK = 64, 1_000_000
STEPS, AT_ONCE = 24, 6
SMALL = 8 << 20


def _weights(sources: DataFrame, exponent: float) -> DataFrame:
    """``sources`` with the unnormalised weight; the logarithm keeps tiny shares apart."""
    return sources.withColumn("w", F.exp(F.lit(float(exponent)) * (F.log("tokens") - F.log("total"))))


def _states(sources: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """For each exponent, in one job: entropy as a share of the largest possible, and passes over the most repeated source per pass over the least."""
    tried = sources.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(exponents)], "_i int, _x double")
    w = sources.crossJoin(F.broadcast(tried)).withColumn("w", F.exp(F.col("_x") * (F.log("tokens") - F.log("total"))))
    per = F.col("w") / F.col("tokens")
    rows = w.groupBy("_i").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.log("w")).alias("wl"), F.max(per).alias("hi"), F.min(per).alias("lo"), F.count("*").alias("n")).orderBy("_i").collect()
    return [((math.log(r.z) - r.wl / r.z) / math.log(r.n) if r.n > 1 else 1.0, r.hi / r.lo) for r in rows]


def exponent_for(sources: DataFrame, repeats: float | None = REPEATS, entropy: float | None = ENTROPY) -> float:
    """Bisect the exponent, ``AT_ONCE`` halvings a job: within ``repeats`` passes of the least passed source, and entropy down to its target."""
    found = 0.0
    # the exponent grows until this holds: few enough repeats, or an entropy no higher than asked for
    for place, limit in ((1, repeats), (0, entropy)):
        if limit is None or _states(sources, [found])[0][place] <= limit:
            continue
        low, high = found, 1.0
        for _ in range(STEPS // AT_ONCE):
            grid = [low + (high - low) * i / (1 << AT_ONCE) for i in range(1, 1 << AT_ONCE)]
            holds = [s[place] <= limit for s in _states(sources, grid)]
            first = holds.index(True) if True in holds else len(grid)
            low, high = ([low, *grid][first], [*grid, high][first])
        found = high
    return found


def _order(*columns: Column, seed: int) -> Column:
    return F.xxhash64(*columns, F.lit(seed))


def mix_sources(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text", repeats: float | None = REPEATS, entropy: float | None = ENTROPY, budget: int | None = None, seed: int = SEED) -> DataFrame:
    """A row for each time a document is taken: the document's columns in ``row``, and how.

    Columns: ``row`` (struct), ``n_tokens``, ``weight`` (the source's), ``epoch`` (pass over the source,
    from 0), ``block`` (the block's place in that pass). ``budget`` is in tokens; by default it is the
    smallest at which every source is passed once in whole, so no document is left out. A null source
    is a source of its own. Documents without words (null or empty texts) have 0 tokens and go with
    their block; a source without tokens has weight 0 and is passed once. Repeated rows are documents
    of their own. With no rows the result is empty.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct(*docs.columns).alias("row")).withColumn("n_tokens", F.coalesce(F.regexp_count(F.col(f"row.{text}").cast("string"), F.lit(WORD)), F.lit(0)).cast("long"))
    rows = rows.withColumn("_source", F.coalesce(F.concat(F.lit("="), F.col(f"row.{source}").cast("string")), F.lit("null")))
    whole = checkpointed(rows.groupBy("_source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")))
    total = whole.agg(F.sum("tokens")).first()[0] or 0
    sources = checkpointed(whole.where("tokens > 0").withColumn("total", F.lit(float(max(total, 1)))))
    exponent = exponent_for(sources, repeats, entropy) if total else 1.0
    weighed = _weights(sources, exponent)
    z, least = weighed.agg(F.sum("w"), F.min(F.col("w") / F.col("tokens"))).first()
    # passes over a source = budget * weight / its tokens
    scale = (1.0 / least if budget is None else budget / z) if total else 1.0
    weighed = weighed.select("_source", (F.col("w") / F.lit(z or 1.0)).alias("weight"), F.bround(F.col("w") * F.lit(scale) / F.col("tokens"), 9).alias("passes"))
    plan = whole.join(weighed, "_source", "left").select(
        "_source", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("passes", F.lit(1.0)).alias("passes"), "tokens",
        F.greatest(F.lit(BLOCKS), F.ceil(F.col("tokens") / BLOCK)).cast("int").alias("_blocks"),
    )
    plan = checkpointed(plan)
    few = plan.agg(F.sum(F.octet_length("_source") + 48)).first()[0] or 0
    near = (lambda x: F.broadcast(x)) if few <= SMALL else (lambda x: x)
    rows = rows.join(near(plan.select("_source", "_blocks")), "_source")
    rows = rows.withColumn("_block", F.pmod(_order(F.col(f"row.{doc_id}"), seed=seed), F.col("_blocks")).cast("int"))

    blocks = rows.groupBy("_source", "_block").agg(F.sum("n_tokens").alias("block_tokens"))
    blocks = blocks.join(near(plan), "_source").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("passes") - 1, F.lit(0)).cast("int"))))
    turn = Window.partitionBy("_source", "epoch").orderBy(_order(F.col("_source"), F.col("_block"), F.col("epoch"), seed=seed), "_block")
    before = F.coalesce(F.sum("block_tokens").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = (F.col("passes") - F.col("epoch")) * F.col("tokens")
    blocks = blocks.select("_source", "_block", "epoch", "weight", F.row_number().over(turn).alias("block"), (F.col("passes") - F.col("epoch") >= 1).alias("full"), (before < left).alias("within"))
    taken = checkpointed(blocks.where("full or within").groupBy("_source", "_block", "weight").agg(F.sort_array(F.collect_list(F.struct("epoch", "block"))).alias("turns")))
    size = taken.agg(F.sum(F.octet_length("_source") + 48 + 16 * F.size("turns"))).first()[0] or 0
    out = rows.join(F.broadcast(taken) if size <= SMALL else taken, ["_source", "_block"])
    return out.select("row", "n_tokens", "weight", F.inline("turns"))

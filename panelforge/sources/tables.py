"""Sources and sinks: typed tables, nested label files, file inventories, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

VISITS = T.StructType([T.StructField("entity", T.LongType()), T.StructField("visit", T.StringType()), T.StructField("t", T.DoubleType()), T.StructField("measure", T.StringType()), T.StructField("value", T.DoubleType())])
LABELS = "map<string, struct<scans: map<string, struct<weeks: double, scan_date: string, items: array<struct<path: string, type: string, spacing: double, confidence: double>>>>>>"


def read_visits(spark: SparkSession, path: str, visits: Sequence[str] | None = None, schema: T.StructType = VISITS) -> DataFrame:
    """A long visit table from CSV; unknown visits are left out."""
    df = spark.read.schema(schema).csv(path, header=True, nanValue="NaN")
    return df.where(F.col("visit").isin(list(visits))) if visits else df


def read_embeddings(spark: SparkSession, path: str, layer: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Vectors with their metadata; ``layer`` is a partition of the table, so others aren't read."""
    df = spark.read.parquet(path)
    df = df.where(F.col("layer") == layer) if layer is not None else df
    return df.select(*columns) if columns else df


def write_by(df: DataFrame, path: str, *columns: str, kind: str = "parquet") -> None:
    """Write one folder per value of ``columns``: few files for a small value, more for one whose rows pass the advisory size of a partition."""
    df.hint("rebalance", *columns).write.mode("overwrite").partitionBy(*columns).format(kind).save(path)


#: Rows for a task that sorts them.
ROWS = 1 << 19


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Partitions of about ``ROWS`` rows, at least the session's number: what a task sorts then doesn't grow with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))


def flatten_labels(df: DataFrame, column: str = "json", order: str = "order", partitions: int | None = None) -> DataFrame:
    """One row per labelled item of nested JSON; of equal (entity, scan, type, index) the last in order wins.

    ``partitions``: tasks that the items are dealt out to, where the session's number would make one task's too many.
    """
    x = df.select(order, F.explode(F.from_json(column, LABELS)).alias("entity", "p"))
    x = x.select(order, "entity", F.explode("p.scans").alias("scan", "s"))
    x = x.select(order, "entity", "scan", "s.weeks", "s.scan_date", F.posexplode("s.items").alias("index", "item"))
    x = x.select(order, "entity", "scan", "weeks", "scan_date", "index", "item.*")
    if partitions is not None:
        x = x.repartition(partitions, "entity", "scan", "type", "index")
    last = Window.partitionBy("entity", "scan", "type", "index").orderBy(F.desc(order))
    return x.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", order)


def discover_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, length, folder, subfolder, file`` of every file below ``path``, without reading contents."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length")
    return path_parts(df, "path")


def path_parts(df: DataFrame, path: str) -> DataFrame:
    parts = F.split(path, "/")
    return df.withColumns({"file": F.element_at(parts, -1), "subfolder": F.try_element_at(parts, F.lit(-2)), "folder": F.try_element_at(parts, F.lit(-3))})


def frame_manifest(frames: DataFrame, rejects: DataFrame, roots: dict[str, str], datasets: Sequence[str], key: str = "frame") -> DataFrame:
    """Frames of the wanted datasets with a numeric entity id, not rejected, and their full path.

    Raises if a wanted dataset has no root, so no path is null.
    """
    lost = [d for d in datasets if d not in roots]
    if lost:
        raise ValueError(f"no root for {lost}")
    where = F.create_map(*[F.lit(x) for d in datasets for x in (d, roots[d])])
    df = frames.where(F.col("dataset").isin(list(datasets))).withColumn("entity", F.col("entity").cast("string").try_cast("long")).where("entity is not null")
    return df.join(rejects.select(key), key, "left_anti").withColumn("path", F.concat_ws("/", where[F.col("dataset")], F.col("name")))


def resolve_extension(manifest: DataFrame, inventory: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    """Give each dataset the suffix under which most of its files exist, and keep the files that do."""
    tried = manifest.withColumn("suffix", F.explode(F.array(*map(F.lit, suffixes)))).withColumn("file", F.concat("path", "suffix"))
    tried = tried.join(inventory.select(F.col("path").alias("file")).distinct(), "file", "left_semi")
    best = Window.partitionBy("dataset").orderBy(F.desc("n"), "suffix")
    chosen = tried.groupBy("dataset", "suffix").agg(F.count("*").alias("n")).withColumn("_n", F.row_number().over(best)).where("_n = 1").select("dataset", "suffix")
    return tried.join(chosen, ["dataset", "suffix"])


def not_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Resumable extraction: what the sink doesn't hold yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")

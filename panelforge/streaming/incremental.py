"""Structured Streaming forms of the incremental jobs, each with a batch twin that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def deduplicated(stream: DataFrame, time: str, key: str, late: str = "2 days") -> DataFrame:
    """Ingest with resume: each key once within the watermark (the sink's checkpoint remembers progress)."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def drift(df: DataFrame, time: str, group: str, value: str, width: str = "5 days", late: str | None = "2 days", least: int = 20) -> DataFrame:
    """Tumbling-window mean per group with at least ``least`` rows; a stream if ``df`` is one."""
    df = df.withWatermark(time, late) if df.isStreaming and late else df
    g = df.groupBy(F.window(time, width).alias("w"), group).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return g.where(F.col("n") >= least).select(F.col("w.start").alias("start"), group, "mean", "n")


def running_sums(df: DataFrame, group: str, value: str) -> DataFrame:
    """Count, sum and sum of squares per group (update mode as a stream)."""
    v = F.col(value)
    return df.groupBy(group).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss"))


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write everything there is and stop; started again, it goes on after what it has done."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Totals of so many micro-batches stay: the last one, and the one before it for a batch that is run again.
KEPT = 2


def _epochs(spark: SparkSession, path: str) -> list[int]:
    """The micro-batches whose totals are there in whole (a folder without its _SUCCESS mark doesn't count)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return []
    names = [f.getPath() for f in store.listStatus(folder) if f.getPath().getName().startswith("epoch=")]
    return sorted(int(n.getName()[6:]) for n in names if store.exists(spark._jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS")))


def _forget(spark: SparkSession, path: str, epochs: list[int]) -> None:
    for e in epochs:
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/epoch={e}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def merge_sums(stream: DataFrame, group: str, value: str, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Running sums per group in a table that doesn't grow with the micro-batches.

    A batch adds its sums to the totals of the last batch before it and writes them as its own; older ones than
    ``KEPT`` go. A batch that is run again starts from the same totals and writes the same.
    """

    def save(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        sums = running_sums(batch, group, value)
        before = [e for e in _epochs(spark, path) if e < epoch]
        if before:
            sums = merged_sums(sums.unionByName(spark.read.schema(sums.schema).parquet(f"{path}/epoch={before[-1]}")), group)
        sums.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        _forget(spark, path, [e for e in _epochs(spark, path) if e <= epoch][:-KEPT])

    writer = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def merged_sums(parts: DataFrame, group: str) -> DataFrame:
    return parts.groupBy(group).agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")])


def latest_sums(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The totals after the last whole micro-batch (no rows before the first)."""
    epochs = _epochs(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/epoch={epochs[-1]}") if epochs else spark.createDataFrame([], schema)


def drift_to_table(stream: DataFrame, time: str, group: str, value: str, path: str, checkpoint: str, width: str = "5 days", late: str = "2 days") -> StreamingQuery:
    """The monitor in update mode: each micro-batch writes the windows it changed. Rows later than the watermark are left out."""

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    g = drift(stream, time, group, value, width, late, least=1)
    return g.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_drift(parts: DataFrame, group: str, least: int = 20) -> DataFrame:
    """The last state of each window of at least ``least`` rows."""
    last = parts.groupBy("start", group).agg(F.max_by(F.struct("mean", "n"), "epoch").alias("x"))
    return last.select("start", group, "x.mean", "x.n").where(F.col("n") >= least)

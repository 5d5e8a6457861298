"""Cutting lineage and putting working files in the folder that all machines share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where it is unset and all runs on this machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once; later steps read it from the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Shuffles of a query are removed when it ends, not when the driver happens to collect garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` as Parquet and read from there: what a loop's rounds hand on. Its shuffles go once it is written.

    Its size is that of its files. A checkpoint carries on the estimate of its plan, which joins multiply: in a loop the number itself grows
    without bound (millions of digits after some fifteen rounds) and fills the driver.
    """
    conf = df.sparkSession.conf
    before = conf.get(CLEAN, "false")
    conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEAN, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Remove a table that ``stored`` wrote, once nothing reads it any more."""
    old = spark._jvm.org.apache.hadoop.fs.Path(path)
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

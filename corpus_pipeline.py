"""From raw documents to a training mix: language ID, near and substring dedup, decontamination, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.llm.decontaminate import leaks
from panelforge.llm.language_id import identify
from panelforge.llm.ngram_jaccard import jaccard_components
from panelforge.llm.source_mixing import mix_sources
from panelforge.llm.store import checkpointed, written
from panelforge.llm.substring import without_repeats

#: A language below this calibrated probability counts as unknown.
CERTAIN = 0.5
#: Bytes up to which a list of ids is broadcast.
SMALL = 32 << 20

#: SQL can't express the learned and the hashed stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def _without(docs: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """``docs`` without the listed ids; the list is broadcast up to a checked size."""
    ids = checkpointed(ids)
    return docs.join(F.broadcast(ids) if ids.count() * 16 <= SMALL else ids, on, "left_anti")


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; texts without a letter go, and those of no certain language."""
    return identify(docs).where((F.col("lang_pred") != "und") & (F.col("score") >= CERTAIN)).select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id; of rows with equal id and text one.

    Rows of one id with different texts are documents of their own; a text without words has no group.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("key"))
    found = written(jaccard_components(docs).select("doc_id", "key", "component"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    groups = found.where("component is not null").groupBy("component").agg(least, F.count("*").alias("n")).where("n > 1")
    gone = found.join(groups, "component").where("key <> first.key").select("key").distinct()
    out = _without(rows, gone, "key")
    again = checkpointed(found.groupBy("key").count().where("count > 1").select("key"))
    if again.isEmpty():
        return out.select("row.*")
    turn = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("row")))
    once = out.join(again, "key", "left_semi").withColumn("turn", turn).where("turn = 1")
    return _without(out, again, "key").select("row.*").unionByName(once.select("row.*"))


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without the words of repeated passages; other texts stay as they are."""
    found = without_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    new = {"text": text.alias("text"), "n_chars": F.length(text).cast("long").alias("n_chars")}
    return found.select(*[new.get(c, F.col(f"row.`{c}`").alias(c)) for c in docs.columns])


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, re-parameterised ones included."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("doc_id", "text").alias("key"), "text")
    found = leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id="key")
    return _without(rows, found.select(F.col("doc_id").alias("key")).distinct(), "key").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: a row for each time a document is taken, with its pass and block."""
    return mix_sources(docs).select("row.doc_id", "row.source", "row.lang", "row.text", "n_tokens", "weight", "epoch", "block")


STAGES = [
    ("language_id", by_language),
    ("ngram_jaccard", one_of_each_group),
    ("substring_dedup", without_passages),
    ("decontamination", without_benchmark),
    ("source_mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = written(docs) if i + 1 < len(STAGES) else docs
    return docs

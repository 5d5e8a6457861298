"""Workloads end to end, from tables to result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions import clean
from panelforge.operators import aggregate, lineage, linear, panel, resample, vectors, windows


def entity_panel(visits: DataFrame, outcomes: DataFrame, slots: Sequence[int], measures: Sequence[str]) -> DataFrame:
    """W1: cells, slopes and coverage per entity, with outcomes. One shuffle by entity serves all of it."""
    names = [f"{s}:{m}" for s in slots for m in measures]
    cell = F.concat(F.col("visit").cast("string"), F.lit(":"), "measure")
    aggs = [F.avg(F.when(cell == n, F.col("value"))).alias(n.replace(":", "_")) for n in names]
    aggs += [F.regr_slope(F.when((F.col("measure") == m) & F.col("value").isNotNull(), F.col("value")), F.col("t")).alias(f"slope_{m}") for m in measures]
    wide = visits.groupBy("entity").agg(*aggs, F.count("value").alias("observed"))
    share = sum(F.col(n.replace(":", "_")).isNotNull().cast("double") for n in names) / len(names)
    return wide.withColumn("coverage", share).join(outcomes, "entity", "left")


def clock_lag(frames: DataFrame, features: str | Sequence[str], target: str, entity: str, outcomes: DataFrame, low: float, high: float, folds: int = 5, alpha: float = 50.0) -> DataFrame:
    """W2: valid targets, grouped-CV ridge, lag per entity, debiased, with the outcome group."""
    f = frames.where(clean.within(F.col(target), low, high))
    f = f.withColumn("fold", linear.hashed_fold(entity, folds))
    p = linear.cross_validated(f, features, target, alpha=alpha).predict(f).withColumn("lag", F.col("pred") - F.col(target))
    e = p.groupBy(entity).agg(F.avg("lag").alias("lag"), F.count("*").alias("n"), F.avg(target).alias("time"))
    return windows.debiased(e, "lag", "time").join(outcomes, entity, "left")


def code_effects(codes: DataFrame, scores: DataFrame, replicates: int = 100, seed: int = 0, known: Sequence[int] | None = None) -> DataFrame:
    """W3: code shares per entity (0 for codes that an entity lacks), CLR, rank correlation with a score, permutation p, adjusted over codes.

    ``known``: the codes of the codebook; without it, those that occur.
    """
    s = windows.clr(vectors.code_shares(codes, "entity", "frame", "code", known), "entity", "share")
    x = s.join(scores, "entity").select("entity", "code", "clr", "score")
    x = windows.ranked(windows.ranked(x, "clr", "ra", ["code"]), "score", "rb", ["code"])
    x = lineage.cut(x.where("ra is not null and rb is not null"))
    observed = x.groupBy("code").agg(F.corr("ra", "rb").alias("effect"), F.count("*").alias("n"))
    null = resample.permuted(x, "entity", "rb", replicates, ["code"], seed).groupBy("code", "replicate").agg(F.abs(F.corr("ra", "rb_perm")).alias("null"))
    p = null.join(observed, "code").groupBy("code", "effect", "n").agg(((1 + F.count_if(F.col("null") >= F.abs("effect") - 1e-9)) / (1.0 + replicates)).alias("p"))
    return windows.adjust_p(p, method="by")


def file_catalogue(files: DataFrame, labels: DataFrame) -> DataFrame:
    """W4: ids, dates and keys from paths, labels by path, duplicates flagged."""
    x = files.withColumn("entity", clean.resolved_id(F.col("folder"), F.col("pid"), F.col("name"))).withColumn("study_date", clean.study_date(F.col("header"), F.col("file"), F.col("folder"))).withColumn("key", clean.frame_key(F.col("file")))
    x = x.join(labels, "id", "left")
    return panel.duplicate_flag(x, ["entity", "study_date", "key"], ["id"])


def registry_screen(long: DataFrame, target: DataFrame, column: str, raw: str, row: str, least: int = 50) -> DataFrame:
    """W5: parse each column by its own rule, correlate with a target, adjust over columns (normal tail)."""
    x = clean.parse_numbers(long, column, raw).join(target, row)
    g = x.where("value is not null").groupBy(column).agg(F.corr("value", "target").alias("r"), F.count("*").alias("n"), F.stddev_pop("value").alias("sd")).where((F.col("n") >= least) & (F.col("sd") > 0))
    # two-sided p of Fisher's z by the logistic approximation of the normal tail
    z = F.abs(F.atanh(F.greatest(F.least("r", F.lit(0.999999)), F.lit(-0.999999)))) * F.sqrt(F.col("n") - 3)
    g = g.withColumn("p", 2 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z)))
    return windows.adjust_p(g.drop("sd"))


def icc_report(df: DataFrame, entity: str, value: str) -> DataFrame:
    return aggregate.icc(df, entity, value)

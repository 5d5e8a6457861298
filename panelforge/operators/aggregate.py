"""Aggregates over entities, strata and outcome groups; everything from sums that combine map-side."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.operators.windows import running


def trimmed_mean(df: DataFrame, key: str, value: str, share: float = 0.2, least: int = 3) -> DataFrame:
    """Mean without the lowest and highest ``share`` of rows; the plain mean below ``least`` rows."""
    w = Window.partitionBy(key)
    x = df.where(F.col(value).isNotNull()).withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(value)))
    cut = F.floor(F.col("_n") * share)
    keep = (F.col("_n") < least) | ((F.col("_r") > cut) & (F.col("_r") <= F.col("_n") - cut))
    return x.where(keep).groupBy(key).agg(F.avg(value).alias("trimmed"))


def inverse_variance_mean(df: DataFrame, key: str, value: str, variance: str) -> DataFrame:
    w = F.when(F.col(variance) > 0, 1 / F.col(variance))
    return df.where(w.isNotNull() & F.col(value).isNotNull()).groupBy(key).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("mean"), F.count("*").alias("n"))


def weighted_mean(df: DataFrame, key: str, value: str, weight: Column) -> DataFrame:
    """Weighted mean; the plain mean where the weights sum to nothing."""
    x = df.withColumn("_w", weight)
    return x.groupBy(key).agg(F.when(F.sum("_w") > 0, F.sum(F.col("_w") * F.col(value)) / F.nullif(F.sum("_w"), F.lit(0.0))).otherwise(F.avg(value)).alias("mean"))


def slopes(df: DataFrame, keys: Sequence[str], time: str, value: str, least: int = 2) -> DataFrame:
    """OLS slope on time, with the number of points; null when time doesn't vary or points are few."""
    ok = F.col(value).isNotNull() & F.col(time).isNotNull()
    g = df.where(ok).groupBy(*keys).agg(F.regr_slope(value, time).alias("slope"), F.count("*").alias("points"), F.avg(value).alias("mean"), F.stddev_samp(time).alias("time_sd"))
    return g.withColumn("slope", F.when((F.col("points") >= least) & (F.col("time_sd") > 0), F.col("slope")))


def residual_slope(df: DataFrame, key: str, time: str, a: str, b: str) -> DataFrame:
    """Within entity: slope over time of what is left of ``a`` after its regression on ``b``."""
    ok = F.col(time).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()
    g = df.where(ok).groupBy(key).agg(F.covar_pop(time, a).alias("ta"), F.covar_pop(time, b).alias("tb"), F.covar_pop(a, b).alias("ab"), F.var_pop(b).alias("bb"), F.var_pop(time).alias("tt"), F.count("*").alias("n"))
    return g.where("n >= 3 and bb > 1e-12 and tt > 1e-12").select(key, ((F.col("ta") - F.col("ab") / F.col("bb") * F.col("tb")) / F.col("tt")).alias("slope"))


def eta_squared(df: DataFrame, group: str, value: str, more_than: int = 0) -> DataFrame:
    """Share of variance between groups of more than ``more_than`` rows."""
    g = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")).where(F.col("n") > more_than)
    t = g.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("mm"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = F.col("mm") - F.col("n") * F.col("g") * F.col("g")
    return t.select((between / (between + F.col("within"))).alias("eta2"), "n")


def icc(df: DataFrame, key: str, value: str, ks: Sequence[int] = (1, 2, 4), least: int = 2) -> DataFrame:
    """One-way random-effects ICC with unbalanced k0, and Spearman-Brown reliability of a mean of k."""
    g = df.where(F.col(value).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")).where(F.col("n") >= least)
    t = g.agg(F.count("*").alias("a"), F.sum("n").alias("N"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * F.col("m")).alias("nm"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nmm"), F.sum(F.col("n") * F.col("v")).alias("ssw"))
    k0 = (F.col("N") - F.col("nn") / F.col("N")) / (F.col("a") - 1)
    msb = (F.col("nmm") - F.col("nm") * F.col("nm") / F.col("N")) / (F.col("a") - 1)
    msw = F.col("ssw") / (F.col("N") - F.col("a"))
    t = t.select("a", "N", k0.alias("k0"), ((msb - msw) / (msb + (k0 - 1) * msw)).alias("icc"))
    return t.select("a", "N", "k0", "icc", *[(k * F.col("icc") / (1 + (k - 1) * F.col("icc"))).alias(f"rel_{k}") for k in ks])


def code_position(codes: DataFrame, code: str, place: str, places: int, least: int = 20) -> DataFrame:
    """Per code its rows, the sum of their places, and how concentrated it is over ``places`` places (1: in one, 0: even)."""
    c = codes.groupBy(code, place).agg(F.count("*").alias("_c"))
    t = c.groupBy(code).agg(F.sum("_c").alias("n"), F.sum(F.col("_c") * F.col(place)).alias(f"{place}_sum")).where(F.col("n") >= least)
    p = F.col("_c") / F.col("n")
    return c.join(t, code).groupBy(code).agg(F.first("n").alias("n"), F.first(f"{place}_sum").alias(f"{place}_sum"), (1 + F.sum(p * F.ln(p)) / F.ln(F.lit(float(places)))).alias("concentration"))


def activation(df: DataFrame, row: str, vector: str, share: float = 0.75) -> DataFrame:
    """Centre and dispersion of a row's |activation| over places, and how many places reach its ``share`` quantile."""
    x = df.select(row, F.posexplode(vector).alias("_k", "_v")).withColumn("_a", F.abs(F.col("_v").cast("double")))
    c = x.groupBy(row).agg((F.sum(F.col("_a") * F.col("_k")) / F.sum("_a")).alias("centre"), F.sum("_a").alias("_m"), F.percentile("_a", F.lit(share)).alias("_q"))
    gap = F.col("_k") - F.col("centre")
    return x.join(c, row).groupBy(row).agg(F.first("centre").alias("centre"), F.sqrt(F.sum(F.col("_a") * gap * gap) / F.first("_m")).alias("dispersion"), F.count_if(F.col("_a") >= F.col("_q")).alias("top"))


def position_histogram(df: DataFrame, row: str, vector: str, share: float = 0.75) -> DataFrame:
    """``(place, rows, top)``: by place in how many rows it is, and in how many its |activation| reaches the row's ``share`` quantile."""
    x = df.select(row, F.posexplode(vector).alias("place", "_v")).withColumn("_a", F.abs(F.col("_v").cast("double")))
    q = x.groupBy(row).agg(F.percentile("_a", F.lit(share)).alias("_q"))  # of one row's places
    return x.join(q, row).groupBy("place").agg(F.count("*").alias("rows"), F.count_if(F.col("_a") >= F.col("_q")).alias("top"))


def shared_variance(long: DataFrame, by: Sequence[str], stream: str, value: str) -> DataFrame:
    """Variance of the streams' mean over all variance, and the 1 / streams that independent streams give."""
    s = long.groupBy(*by).agg(F.avg(value).alias("_m")).agg(F.var_pop("_m").alias("_s"))
    t = long.agg(F.var_pop(value).alias("_t"), F.count_distinct(stream).alias("_e"))
    return s.crossJoin(t).select((F.col("_s") / F.col("_t")).alias("shared"), (1.0 / F.col("_e")).alias("floor"))


def bimodality(df: DataFrame, by: Sequence[str], value: str, least: int = 8) -> DataFrame:
    """(skew^2 + 1) / (kurtosis + 3 (n-1)^2 / ((n-2)(n-3))), population moments, from ``least`` rows."""
    g = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.skewness(value).alias("s"), F.kurtosis(value).alias("k")).where(F.col("n") >= least)
    n = F.col("n")
    return g.select(*by, "n", ((F.col("s") * F.col("s") + 1) / (F.col("k") + 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3)))).alias("bimodality"))


def auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank AUC of ``score`` for ``label`` (1 against 0), with Mann-Whitney's U; ties count half; nulls go.

    Rows are first reduced to counts by score; those are summed up by ranges.
    """
    c = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("_p"), F.sum(1 - F.col(label).cast("long")).alias("_q"))
    x = running(c, score, ["_q"], by=by)
    u = F.sum(F.col("_p") * (F.col("_q_upto") - F.col("_q") / 2.0))
    t = (F.col("_p") + F.col("_q")).cast("double")  # cubes of counts pass 64 bits
    g = x.groupBy(*by).agg(u.alias("u"), F.sum("_p").alias("n1"), F.sum("_q").alias("n0"), F.sum(t * t * t - t).alias("ties"))
    return g.select(*by, (F.col("u") / F.nullif(F.col("n1") * F.col("n0"), F.lit(0))).alias("auc"), "u", "ties", "n1", "n0")


def normal_p(z: Column) -> Column:
    """Two-sided p of a normal deviate: the series of erf near zero, the continued fraction of erfc in the tail (about 1e-9)."""
    x = F.abs(z) / math.sqrt(2)
    near = F.least(x, F.lit(2.0))
    steps = F.sequence(F.lit(1), F.lit(40))
    first = F.struct(near.alias("term"), near.alias("total"))

    def added(s: Column, k: Column) -> Column:
        term = -s["term"] * near * near / k
        return F.struct(term.alias("term"), (s["total"] + term / (2 * k + 1)).alias("total"))

    series = F.aggregate(steps, first, added)["total"]
    deep = F.aggregate(F.reverse(steps), F.lit(0.0), lambda acc, k: (k / 2.0) / (x + acc))
    return F.when(x < 2, 1 - 2 / math.sqrt(math.pi) * series).otherwise(F.exp(-x * x) / (math.sqrt(math.pi) * (x + deep)))


# Coefficients of Lanczos' approximation of the gamma function (g = 7, nine terms).
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for positive numbers."""
    z = F.when(x < 0.5, x).otherwise(x - 1)  # below one half: gamma(x) = gamma(x + 1) / x
    t = z + len(LANCZOS) - 1.5
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + c / (z + i)
    up = 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.ln(t) - t + F.ln(total)
    return F.when(x < 0.5, up - F.ln(x)).otherwise(up)


#: Terms of the series and of the continued fraction; both need about the square root of the degrees of freedom.
TERMS = 400


def chi_square_p(chi2: Column, df: Column) -> Column:
    """Upper tail of the chi-square distribution: the regularised incomplete gamma function, by its series below the mean and by its continued fraction above."""
    s, x = df.cast("double") / 2, chi2.cast("double") / 2
    scale = F.exp(s * F.ln(x) - x - log_gamma(s))
    steps = F.sequence(F.lit(1), F.lit(TERMS))
    first = F.struct((1 / s).alias("term"), (1 / s).alias("total"))

    def added(acc: Column, k: Column) -> Column:
        term = acc["term"] * F.least(x, s + 1) / (s + k)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    lower = scale * F.aggregate(steps, first, added)["total"]
    above = F.greatest(x, s + 1)
    deep = F.aggregate(F.reverse(steps), F.lit(0.0), lambda acc, k: k * (k - s) / (above + 2 * k + 1 - s - acc))
    upper = scale / (above + 1 - s - deep)
    return F.when((x <= 0) | (df <= 0), F.lit(1.0)).when(x < s + 1, 1 - lower).otherwise(upper)


def kolmogorov_p(distance: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic two-sided p of the two-sample Kolmogorov-Smirnov distance: its alternating series, or near zero the theta form."""
    lam = distance * F.sqrt(n1.cast("double") * n2 / (n1 + n2))
    safe = F.greatest(lam, F.lit(1e-3))
    steps = F.sequence(F.lit(1), F.lit(50))
    tail = 2 * F.aggregate(steps, F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * safe * safe))
    odd = F.aggregate(steps, F.lit(0.0), lambda acc, k: acc + F.exp(-F.pow(2.0 * k - 1, F.lit(2.0)) * (math.pi**2 / 8) / (safe * safe)))
    return F.when(lam < 1e-3, 1.0).when(lam < 1, 1 - math.sqrt(2 * math.pi) / safe * odd).otherwise(tail)


def mann_whitney(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """U of ``label`` 1 against 0, its tie-corrected normal deviate (with continuity correction) and two-sided p."""
    g = auc(df, label, score, by)
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    sd = F.sqrt(n1 * n0 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    gap = F.col("u") - n1 * n0 / 2
    z = F.sign(gap) * F.greatest(F.abs(gap) - 0.5, F.lit(0.0)) / F.nullif(sd, F.lit(0.0))
    return g.select(*by, "u", "auc", z.alias("z"), "n1", "n0").withColumn("p", normal_p(F.col("z")))


def kruskal(df: DataFrame, group: str, rank: str) -> DataFrame:
    """Tie-corrected H from ranks (``rank`` holds average ranks), with the degrees of freedom and the p of the chi-square tail."""
    g = df.groupBy(group).agg(F.sum(rank).alias("r"), F.count(rank).alias("n")).agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("x"), F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("groups"))
    t, n = F.col("t").cast("double"), F.col("n").cast("double")  # cubes of counts pass 64 bits from 2,097,152 rows on
    ties = df.groupBy(rank).agg(F.count("*").alias("t")).agg(F.sum(t * t * t - t).alias("ties"))
    return g.crossJoin(F.broadcast(ties)).select(((12.0 / (n * (n + 1)) * F.col("x") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))).alias("h"), "n", (F.col("groups") - 1).alias("df")).withColumn("p", chi_square_p(F.col("h"), F.col("df")))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square of a table of counts (of two by two with Yates' correction beside it), degrees of freedom and p."""
    c = df.groupBy(a, b).agg(F.count("*").alias("o"))
    rows, cols, total = c.groupBy(a).agg(F.sum("o").alias("ra")), c.groupBy(b).agg(F.sum("o").alias("cb")), c.agg(F.sum("o").alias("t"))
    grid = rows.crossJoin(cols).crossJoin(total).join(c, [a, b], "left").withColumn("e", F.col("ra") * F.col("cb") / F.col("t"))
    gap = F.abs(F.coalesce("o", F.lit(0)) - F.col("e"))
    less = F.greatest(gap - 0.5, F.lit(0.0))
    x = grid.agg(F.sum(gap * gap / F.col("e")).alias("chi2"), F.sum(less * less / F.col("e")).alias("_y"), ((F.count_distinct(a) - 1) * (F.count_distinct(b) - 1)).alias("df"))
    x = x.withColumn("yates", F.when(F.col("df") == 1, F.col("_y"))).withColumn("p", chi_square_p(F.coalesce("yates", "chi2"), F.col("df")))
    return x.select("chi2", "df", "yates", "p")


def ks_distance(df: DataFrame, group: str, first: str, second: str, value: str) -> DataFrame:
    """Largest distance between two groups' distribution functions, over distinct values summed up by ranges, and its asymptotic p."""
    c = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count_if(F.col(group) == first).alias("a"), F.count_if(F.col(group) == second).alias("b"))
    t = c.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    x = running(c, value, ["a", "b"]).crossJoin(F.broadcast(t))
    x = x.agg(F.max(F.abs(F.col("a_upto") / F.col("na") - F.col("b_upto") / F.col("nb"))).alias("ks"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return x.select("ks", kolmogorov_p(F.col("ks"), F.col("na"), F.col("nb")).alias("p"))


def random_effects(df: DataFrame, by: Sequence[str], effect: str, variance: str) -> DataFrame:
    """DerSimonian-Laird pooling of effects."""
    w = 1 / F.col(variance)
    g = df.groupBy(*by).agg(F.sum(w).alias("w"), F.sum(w * F.col(effect)).alias("we"), F.sum(w * F.col(effect) * F.col(effect)).alias("wee"), F.sum(w * w).alias("ww"), F.count("*").alias("k"))
    q = F.col("wee") - F.col("we") * F.col("we") / F.col("w")
    tau = F.greatest(F.lit(0.0), (q - (F.col("k") - 1)) / F.nullif(F.col("w") - F.col("ww") / F.col("w"), F.lit(0.0)))
    g = g.select(*by, "k", q.alias("q"), F.coalesce(tau, F.lit(0.0)).alias("tau2"))
    v = 1 / (F.col(variance) + F.col("tau2"))
    pooled = df.join(g, list(by)).groupBy(*by).agg((F.sum(v * F.col(effect)) / F.sum(v)).alias("pooled"), F.sqrt(1 / F.sum(v)).alias("se"))
    return g.join(pooled, list(by))

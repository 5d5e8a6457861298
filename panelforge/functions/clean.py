"""Scalar rules for messy identifiers, dates, numbers and flags, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing_as_null(x: Column) -> Column:
    """NaN means missing: it becomes null before any aggregate sees it."""
    return F.when(~F.isnan(x), x)


def entity_number(text: Column, pattern: str = r"(?i)IMP[ACT]*\s*(\d+)") -> Column:
    """The first number after the study prefix, else null."""
    return F.regexp_extract(text, pattern, 1).try_cast("long")


def normalized_id(text: Column) -> Column:
    """``IMP_%04d`` of an IMP id's digits; other ids stay."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(F.upper(text).startswith("IMP") & (digits != ""), F.format_string("IMP_%04d", digits.try_cast("long"))).otherwise(text)


def resolved_id(folder: Column, patient_id: Column, patient_name: Column) -> Column:
    """Number from the id, else the name, as ``IMP%04d``; else by the folder: ``NHC_<digits>``, suffixes stripped."""
    number = F.coalesce(entity_number(patient_id), entity_number(patient_name))
    bare = F.regexp_replace(folder, "(_ok|_SI|_NO)$", "")
    return F.when(number.isNotNull(), F.format_string("IMP%04d", number)).when(bare.rlike(r"^\d+$"), F.concat(F.lit("NHC_"), bare)).otherwise(bare)


def study_date(header: Column, filename: Column, folder: Column) -> Column:
    """Header date, else the file name's leading eight digits, else the folder."""
    head = F.when(F.trim(header) != "", header)
    return F.coalesce(head, F.when(filename.rlike(r"^\d{8}\."), F.substring(filename, 1, 8)), folder)


def frame_key(filename: Column) -> Column:
    """A frame's name without ``.png``, debug suffixes and numeric prefixes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(filename, r"\.png$", ""), r"_(debug|overlay|mask)$", ""), r"^\d+_(NHC_\d+_)?", "")


def european(raw: Column, comma_only: bool = True) -> Column:
    """A European decimal: comma to point, dots of thousands removed unless ``comma_only``."""
    text = F.trim(raw)
    return F.regexp_replace(text if comma_only else F.regexp_replace(text, r"\.", ""), ",", ".").try_cast("double")


def parse_numbers(long: DataFrame, column: str, raw: str, mode: str = "comma") -> DataFrame:
    """``value`` for each row of a long table (column, raw), by one decision per column.

    ``comma``: take comma decimals if that recovers over 1.5 times the values of a plain parse.
    ``dots``: keep the plain parse if over half is finite, else strip dots too if 30 % look European.
    """
    plain = F.trim(F.col(raw)).try_cast("double")
    other = european(F.col(raw), mode == "comma")
    looks = F.col(raw).rlike(r"^\s*-?\d{1,3}(\.\d{3})*,\d+\s*$|^\s*-?\d+,\d+\s*$")
    filled = F.count(F.col(raw))
    use = (F.count(other) > 1.5 * F.count(plain)) if mode == "comma" else ((F.count(plain) <= 0.5 * filled) & (F.count_if(looks) >= 0.3 * filled))
    rule = long.groupBy(column).agg(use.alias("_european"))
    return long.join(rule, column).withColumn("value", F.when(F.col("_european"), other).otherwise(plain)).drop("_european")


def yes_no(x: Column) -> Column:
    """yes/si/true/1 to 1, no/false/0 to 0, other numbers by sign, else null."""
    word = F.lower(F.trim(x))
    number = word.try_cast("double")
    return F.when(word.isin("yes", "si", "sí", "true", "y"), 1).when(word.isin("no", "false", "n"), 0).when(number.isNotNull(), (number > 0).cast("int"))


def dating_anchor(primary: Column, fallback: Column, ok: int = 14, far: int = 60) -> tuple[Column, Column, Column, Column]:
    """Anchor date, its source, days between both dates, and a flag."""
    gap = F.date_diff(primary, fallback)
    flag = F.when(gap.isNull(), "single").when(F.abs(gap) > far, f">{far}d").when(F.abs(gap) > ok, f">{ok}d").otherwise("ok")
    return F.coalesce(primary, fallback), F.when(primary.isNotNull(), "primary").when(fallback.isNotNull(), "fallback"), gap, flag


def weeks_between(date: Column, anchor: Column) -> Column:
    return F.date_diff(date, anchor) / 7.0


def within(x: Column, low: float, high: float) -> Column:
    return x.between(low, high)


def unless_sentinel(x: Column, limit: float) -> Column:
    """Values below ``limit`` are sentinels: null."""
    return F.when(x >= limit, x)


def scaled_clock(t: Column, low: float = 6.0, span: float = 36.0) -> Column:
    return (t - low) / span


def unscaled_clock(x: Column, low: float = 6.0, span: float = 36.0) -> Column:
    return x * span + low


# The four-parameter growth reference (log10 weight, centimetres).
GROWTH = {"one": 1.3596, "hc": 0.0064, "ac": 0.0424, "fl": 0.174, "bpd_ac": 0.00061, "ac_fl": -0.00386}


def growth_reference(bpd: Column, hc: Column, ac: Column, fl: Column) -> Column:
    g = GROWTH
    return F.pow(F.lit(10.0), g["one"] + g["hc"] * hc + g["ac"] * ac + g["fl"] * fl + g["bpd_ac"] * bpd * ac + g["ac_fl"] * ac * fl)


def first_match(text: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The label of the first pattern that matches; order decides."""
    out = F.lit(default)
    for pattern, label in reversed(rules):
        out = F.when(text.rlike(pattern), label).otherwise(out)
    return out


def outcome_group(percentile: Column, low: float = 10, high: float = 90) -> Column:
    return F.when(percentile < low, "SGA").when(percentile > high, "LGA").when(percentile.isNotNull(), "AGA")


def all_observed(*xs: Column) -> Column:
    out = F.lit(True)
    for x in xs:
        out = out & x.isNotNull()
    return out


def missing_count(*xs: Column) -> Column:
    return sum((x.isNull().cast("int") for x in xs), F.lit(0))


def right_closed_bin(x: Column, edges: Sequence[float]) -> Column:
    """Index of the bin (edge, next edge] that holds x; null outside."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        out = F.when((x > edges[i]) & (x <= edges[i + 1]), i).otherwise(out)
    return out


def spline_basis(x: Column, knots: Sequence[Column], degree: int = 3) -> list[Column]:
    return [x, *(F.pow(F.greatest(x - k, F.lit(0.0)), F.lit(float(degree))) for k in knots)]

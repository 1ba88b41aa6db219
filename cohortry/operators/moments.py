"""Quantiles, moment tests, simple regression and shares of a total."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.nullrules import column, divide
from cohortry.functions.tails import student_point, student_two_sided
from cohortry.operators.joins import natural_join
from cohortry.operators.running import Run, clean, cut_ranges, running, settle


def _value_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    v = F.col(value).cast("double")
    return (df.filter(v.isNotNull() & ~F.isnan(v)).select(*by, v.alias("_v"))
            .groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n")))


def quantiles_by(df: DataFrame, by: list[str], value: str, probs: dict[str, float],
                 buckets: int | None = None) -> DataFrame:
    """Exact interpolated quantiles per group, also for groups of any size.

    ``probs`` maps output names to probabilities. The built-in exact percentile
    keeps a group's values in one task; this ranks distinct values instead.
    """
    counts, buckets = settle(_value_counts(df, by, value), by, buckets)
    return _quantiles(counts, by, probs, buckets)


def _quantiles(counts: DataFrame, by: list[str], probs: dict[str, float], buckets: int) -> DataFrame:
    cut = cut_ranges(counts, by, "_v", buckets, used=["_n"])
    ranked = clean(running(cut, "_v", [Run("_upto", "_n", total="_all")]))
    picks, outs = [], []
    for name, prob in probs.items():
        place = (F.col("_all") - 1) * F.lit(float(prob))
        for side, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            here = (F.col("_upto") > at) & (F.col("_upto") - F.col("_n") <= at)
            picks.append(F.max(F.when(here, F.col("_v"))).alias(f"_{name}_{side}"))
        picks.append(F.max(place - F.floor(place)).alias(f"_{name}_part"))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        outs.append((lo + F.col(f"_{name}_part") * (hi - lo)).alias(name))
    grouped = ranked.groupBy(*by) if by else ranked.groupBy()
    return grouped.agg(F.max("_all").alias("n"), *picks).select(*by, "n", *outs)


def median_split(df: DataFrame, x: str, out: str = "above_median",
                 by: list[str] = ()) -> DataFrame:
    """Mark rows above the exact median; missing values stay unmarked."""
    by = list(by)
    middle = quantiles_by(df, by, x, {"_median": 0.5}).select(*by, "_median")
    if by:
        return natural_join(df, middle, "left", by).withColumn(
            out, F.col(x) > F.col("_median")).drop("_median")
    return df.withColumn("_median", middle.scalar()).withColumn(
        out, F.col(x) > F.col("_median")).drop("_median")


def box_stats_by(df: DataFrame, by: list[str], value: str,
                 buckets: int | None = None) -> DataFrame:
    """Quartiles, 1.5-IQR whiskers and the number of outliers per group."""
    counts, buckets = settle(_value_counts(df, by, value), by, buckets)
    boxes = _quantiles(counts, by, {"q1": 0.25, "median": 0.5, "q3": 0.75}, buckets)
    if by:
        both = natural_join(counts, boxes, "inner", by)
    else:
        packed = boxes.select(F.struct(*boxes.columns).alias("_box"))
        both = counts.withColumn("_box", packed.scalar()).select("_v", "_n", "_box.*")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("_v") >= F.col("q1") - reach) & (F.col("_v") <= F.col("q3") + reach)
    keys = [*by, "n", "q1", "median", "q3"]
    return both.groupBy(*keys).agg(
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.sum(F.when(inside, F.lit(0)).otherwise(F.col("_n"))).alias("n_outliers"))


def welch_t_by(df: DataFrame, by: list[str], group: str, value: str, levels: tuple) -> DataFrame:
    """Welch's unequal-variance t-test per panel, first level minus second."""
    picks = []
    for i, level in enumerate(levels, 1):
        v = F.when(column(group) == F.lit(level), F.col(value).cast("double"))
        picks += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"mean{i}"),
                  F.var_samp(v).alias(f"_var{i}")]
    sums = df.groupBy(*by).agg(*picks)
    s1, s2 = divide("_var1", "n1"), divide("_var2", "n2")
    out = (
        sums.filter("n1 > 0 and n2 > 0")
        .withColumn("statistic", F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt(s1 + s2)))
        .withColumn("dof", F.try_divide(
            (s1 + s2) * (s1 + s2),
            F.try_divide(s1 * s1, F.col("n1") - 1) + F.try_divide(s2 * s2, F.col("n2") - 1))))
    return out.select(*by, "n1", "n2", "mean1", "mean2", "statistic", "dof",
                      student_two_sided("statistic", "dof").alias("p_value"))


def ols_by(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Straight-line fit of y on x per panel."""
    return df.groupBy(*by).agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def line_band(df: DataFrame, by: list[str], x: str, y: str, points: int = 80, level: float = 0.95) -> DataFrame:
    """The straight-line fit of y on x per panel at ``points`` places from the smallest to the largest x, with its confidence band.

    One aggregate per panel; the places are made from it. Panels of fewer than three pairs have no
    band, and those without spread in x no fit.
    """
    known = F.col(x).isNotNull() & F.col(y).isNotNull()
    sums = df.groupBy(*by).agg(
        F.regr_count(y, x).alias("n"), F.regr_avgx(y, x).alias("_mx"), F.regr_avgy(y, x).alias("_my"), F.regr_sxx(y, x).alias("_sxx"),
        F.regr_sxy(y, x).alias("_sxy"), F.regr_syy(y, x).alias("_syy"),
        F.min(F.when(known, F.col(x))).cast("double").alias("_low"), F.max(F.when(known, F.col(x))).cast("double").alias("_high"))
    dof = F.when(F.col("n") > 2, F.col("n") - 2)
    slope = F.when(F.col("_sxx") > 0, F.try_divide("_sxy", "_sxx"))
    left = F.greatest(F.col("_syy") - slope * F.col("_sxy"), F.lit(0.0))
    fits = (sums.filter("n > 0").withColumn("_slope", slope).withColumn("_error", F.sqrt(left / dof))
            .withColumn("_t", student_point(F.lit(1 - level), dof.cast("double"))))
    places = fits.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn(
        "x", F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_k") / max(points - 1, 1))
    gap = F.col("x") - F.col("_mx")
    fit = F.col("_my") + F.col("_slope") * gap
    half = F.col("_t") * F.col("_error") * F.sqrt(1 / F.col("n") + F.try_divide(gap * gap, F.col("_sxx")))
    return places.select(*by, "n", F.col("_k").alias("place"), "x", fit.alias("fit"), (fit - half).alias("low"), (fit + half).alias("high"))


def slice_positions(categories: DataFrame, name: str, size: str) -> DataFrame:
    """Share, percent label and label position of each slice of a whole.

    ``categories`` is a finished summary: one row per category of a chart.
    """
    ordered = Window.orderBy("share", name)
    whole = categories.agg(F.sum(size).alias("total"))
    shares = categories.withColumn("total", whole.scalar()).withColumn(
        "share", divide(size, "total"))
    stacked = F.sum(F.col("share") * 100).over(ordered.rowsBetween(0, Window.unboundedFollowing))
    half = F.col("share") * 50
    return (
        shares.withColumn("stacked", stacked)
        .withColumn("position", half + F.coalesce(F.lead("stacked", 1).over(ordered), F.lit(0.0)))
        .withColumn("label", F.format_string("%.1f%%", F.col("share") * 100)))

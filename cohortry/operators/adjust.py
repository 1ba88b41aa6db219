"""False-discovery correction and its follow-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.nullrules import column
from cohortry.operators.joins import natural_join
from cohortry.operators.running import Run, clean, cut_ranges, running, settle


def p_adjust_bh(df: DataFrame, p: str = "p_value", out: str = "p_adj",
                by: list[str] = (), buckets: int | None = None) -> DataFrame:
    """Benjamini-Hochberg over all rows, or over each ``by`` panel.

    The tests are staged once. Distinct p-values with counts carry the ranks, as
    tied p-values share their adjusted value. Missing p-values stay missing and
    do not count.
    """
    by = list(by)
    tests, buckets = settle(df, by, buckets)
    counts = tests.filter(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count(F.lit(1)).alias("_n"))
    cut = cut_ranges(counts, by, p, buckets, used=["_n"])
    ranked = running(cut, p, [Run("_upto", "_n", total="_tests")])
    scaled = ranked.withColumn("_scaled", F.col(p) * F.col("_tests") / F.col("_upto"))
    lowest = running(scaled, p, [Run("_low", "_scaled", how="min", reverse=True)])
    adjusted = clean(lowest).select(*by, p, F.least(F.col("_low"), F.lit(1.0)).alias(out))
    return natural_join(tests, adjusted, "left", [*by, p])


def significant(df: DataFrame, p: str = "p_adj", alpha: float = 0.05) -> DataFrame:
    return df.filter(F.col(p) < alpha)


def significant_rows(rows: DataFrame, tests: DataFrame, p: str = "p_adj",
                     alpha: float = 0.05) -> DataFrame:
    """The rows that belong to a significant test, with its columns."""
    return natural_join(rows, significant(tests, p, alpha), "inner")


def stars(p) -> Column:
    """Conventional star label of a p-value."""
    p = column(p)
    return (F.when(p <= 0.0001, "****").when(p <= 0.001, "***").when(p <= 0.01, "**")
            .when(p <= 0.05, "*").when(p.isNotNull(), "ns"))

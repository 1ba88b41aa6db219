"""Survival and mixed-model studies of per-unit burden."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.nullrules import divide
from cohortry.operators.joins import natural_join
from cohortry.operators.mixed import random_intercept
from cohortry.operators.moments import median_split
from cohortry.operators.survival import cox_ph, kaplan_meier, log_rank
from cohortry.plans.profiles import profile
from cohortry.session import staged

ENDS = {"dfs": ("dfs_time", "cens_dfs"), "os": ("os_time", "cens_os")}


def _events_and_pairs(df: DataFrame, unit: list[str], neoantigenic: str) -> DataFrame:
    """Distinct events and pairs (``combine``) per unit, all and neoantigenic ones; a missing item counts as one.

    A pair is an event with an allele, so it lies in one event. Rows are dealt by unit and event once,
    and all counts of an event are made where they lie; only sums per unit move after that. As several
    aggregates then share a task, there are as many tasks as shuffle partitions, not fewer large ones.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    test = F.coalesce(F.expr(neoantigenic), F.lit(False)).alias("_neo")
    dealt = df.select(*unit, "event", "combine", test).repartition(parts, *unit, "event")
    pairs = dealt.groupBy(*unit, "event", "combine").agg(F.bool_or("_neo").alias("_neo"))
    known, neo = F.col("combine").isNotNull(), F.col("_neo")
    events = pairs.groupBy(*unit, "event").agg(
        F.bool_or(neo).alias("_neo"), F.count_if(known).alias("_pairs"), F.count_if(known & neo).alias("_neo_pairs"),
        F.bool_or(~known).alias("_missing"), F.bool_or(~known & neo).alias("_neo_missing"))
    return events.groupBy(*unit).agg(
        F.count(F.lit(1)).alias("total_event"), F.count_if(neo).alias("neo_event"),
        # A missing pair has no event of its own: it is one item of the unit.
        (F.sum("_pairs") + F.bool_or("_missing").cast("long")).alias("total_combine"),
        (F.sum("_neo_pairs") + F.bool_or("_neo_missing").cast("long")).alias("neo_burden"))


def burden_table(df: DataFrame, survival: DataFrame, neoantigenic: str, unit: str = "patient") -> DataFrame:
    """Burden, neoantigen burden and its share per unit, with the unit's follow-up, staged: a split reads it several times."""
    counts = _events_and_pairs(df, [unit], neoantigenic)
    table = counts.select(unit, "total_event", "neo_event", divide("neo_event", "total_event").alias("neo_share"), "total_combine", "neo_burden")
    return staged(natural_join(table, survival), "burden")


def present_burden(df: DataFrame, survival: DataFrame, unit: list[str], item: str, test: str, share: bool = False) -> DataFrame:
    """Distinct items that meet ``test`` per unit as ``x``, or their share of the unit's items, with the follow-up, staged.

    Units without such an item are absent, so they do not move the median.
    """
    if share:
        table = profile(df, unit, item, {"n_all": None, "n_item": test}, shares={"x": ("n_item", "n_all")})
    else:
        table = profile(df.filter(test), unit, item, {"x": None})
    return staged(natural_join(table.filter("x is not null").select(*unit, "x"), survival), "burden")


def scored_burden(df: DataFrame, survival: DataFrame, unit: list[str], neoantigenic: str) -> DataFrame:
    """Events, pairs and neoantigens of the units that have a neoantigen, with the follow-up, staged."""
    counts = _events_and_pairs(df, unit, neoantigenic).filter("neo_burden > 0")
    return staged(natural_join(counts.select(*unit, "total_event", "total_combine", "neo_burden"), survival), "burden")


def hazards(table: DataFrame, covariates: list[str], end: str = "os") -> DataFrame:
    """One proportional-hazards fit per covariate."""
    return cox_ph(table, *ENDS[end], covariates)


def split_curves(table: DataFrame, x: str, end: str = "os", by: list[str] = ()) -> DataFrame:
    """Survival curves of the units above and not above the median of ``x``."""
    return kaplan_meier(median_split(table, x), *ENDS[end], [*by, "above_median"])


def split_test(table: DataFrame, x: str, end: str = "os", by: list[str] = ()) -> DataFrame:
    """Log-rank test of the median split, for the whole table or per ``by`` group."""
    return log_rank(median_split(table, x), *ENDS[end], "above_median", by=list(by), levels=[False, True])


def split_table(table: DataFrame, x: str, row: str) -> DataFrame:
    """Units per ``row`` value and side of the median."""
    return median_split(table, x).groupBy(row, "above_median").agg(F.count(F.lit(1)).alias("n"))


def class_model(units: DataFrame, measure: str, group: str = "tumour", reference: str = "cold") -> DataFrame:
    """Mixed model of a measure on immune class with a random intercept per tumour."""
    rows = units.filter(F.col("immune").isNotNull() & F.col(group).isNotNull()).withColumn(
        "is_other", (F.col("immune") != F.lit(reference)).cast("double"))
    return random_intercept(rows, measure, "is_other", group)

"""Per-unit summaries and the comparisons drawn from them.

A :class:`Study` states a comparison: which rows, which unit is summarised, which
measures, and between which levels. Every measure of a study comes from one pass
over the rows: rows reduce to (unit, item) first, with one flag per condition,
so several distinct counts cost one shuffle and no row expansion.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.nullrules import divide, n_distinct
from cohortry.operators.adjust import p_adjust_bh, stars
from cohortry.operators.grouped import keep_groups
from cohortry.operators.joins import natural_join
from cohortry.operators.moments import box_stats_by, ols_by
from cohortry.operators.ranks import kruskal_by, rank_sum_by, signed_rank_by, spearman_by


def _condition(test: str | Column | None) -> Column:
    if test is None:
        return F.lit(True)
    return F.coalesce(F.expr(test) if isinstance(test, str) else test, F.lit(False))


def profile(df: DataFrame, unit: list[str], item: str, counts: dict | None = None,
            means: dict | None = None, shares: dict | None = None,
            zero: tuple = ()) -> DataFrame:
    """One row per unit.

    ``counts``: name -> condition (None for all rows); distinct items that meet it.
    ``means``: name -> (column, condition); missing if one value is missing.
    ``shares``: name -> (count name, count name).
    A count of none and its shares are missing, unless named in ``zero``.
    """
    counts, means, shares = counts or {}, means or {}, shares or {}
    first = [F.bool_or(_condition(test)).alias(f"_c_{n}") for n, test in counts.items()]
    for n, (col, test) in means.items():
        value = F.when(_condition(test), F.col(col).cast("double"))
        first += [F.sum(value).alias(f"_s_{n}"), F.count(value).alias(f"_k_{n}"),
                  F.count(F.when(_condition(test), F.lit(1))).alias(f"_r_{n}")]
    cells = df.groupBy(*unit, item).agg(*first)
    second = [F.count_if(F.col(f"_c_{n}")).alias(f"_c_{n}") for n in counts]
    second += [F.sum(f"_{k}_{n}").alias(f"_{k}_{n}") for n in means for k in "skr"]
    units = cells.groupBy(*unit).agg(*second)
    columns = []
    for n in counts:
        c = F.col(f"_c_{n}")
        columns.append((c if n in zero else F.when(c > 0, c)).alias(n))
    for n in means:
        mean = F.when(F.col(f"_r_{n}") == F.col(f"_k_{n}"), divide(f"_s_{n}", f"_k_{n}"))
        columns.append((F.coalesce(mean, F.lit(0.0)) if n in zero else mean).alias(n))
    for n, (top, bottom) in shares.items():
        share = divide(f"_c_{top}", f"_c_{bottom}")
        columns.append((share if n in zero else F.when(F.col(f"_c_{top}") > 0, share)).alias(n))
    return units.select(*unit, *columns)


def stack(df: DataFrame, ids: list[str], metrics: list[str], name: str = "metric",
          value: str = "value") -> DataFrame:
    return df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        ids, metrics, name, value)


@dataclass(frozen=True)
class Study:
    """A comparison of measures between the levels of ``group``.

    ``within = (key, column)`` keeps the keys that show more than one value of
    the column, ``then`` filters the rows after that. Without measures the
    ``values`` columns are compared row by row (distinct rows of the unit).
    ``pair`` makes it a paired test, ``levels = None`` a test over all levels.
    """

    unit: tuple
    group: str
    levels: tuple | None
    where: str | None = None
    within: tuple | None = None
    then: str | None = None
    item: str = "event"
    counts: dict = field(default_factory=dict)
    means: dict = field(default_factory=dict)
    shares: dict = field(default_factory=dict)
    zero: tuple = ()
    values: tuple = ()
    facets: tuple = ()
    pair: str | None = None

    @property
    def metrics(self) -> list[str]:
        return [*self.values] if self.values else [*self.counts, *self.means, *self.shares]


def study_rows(df: DataFrame, study: Study) -> DataFrame:
    if study.where:
        df = df.filter(study.where)
    if study.within:
        key, column = study.within
        df = keep_groups(df, [key], n_distinct(column), lambda n: n > 1)
    return df.filter(study.then) if study.then else df


def study_units(df: DataFrame, study: Study) -> DataFrame:
    """The table a box plot of the study would show."""
    rows = study_rows(df, study)
    if study.values:
        return rows.select(*study.unit, *study.values).distinct()
    return profile(rows, list(study.unit), study.item, study.counts, study.means,
                   study.shares, study.zero)


def run_study(df: DataFrame, study: Study) -> DataFrame:
    """One test per measure (and facet)."""
    ids = list(dict.fromkeys([*study.facets, study.group, *([study.pair] if study.pair else [])]))
    long = stack(study_units(df, study), ids, study.metrics)
    by = ["metric", *study.facets]
    if study.levels is None:
        return kruskal_by(long, by, study.group, "value")
    if study.pair:
        return signed_rank_by(long, by, study.pair, study.group, "value", study.levels)
    return rank_sum_by(long, by, study.group, "value", study.levels)


def study_boxes(df: DataFrame, study: Study) -> DataFrame:
    ids = [*study.facets, study.group]
    return box_stats_by(stack(study_units(df, study), ids, study.metrics), ["metric", *ids], "value")


def with_stars(tests: DataFrame) -> DataFrame:
    return tests.withColumn("stars", stars("p_value"))


def correlate(units: DataFrame, other: DataFrame | None, metrics: list[str], value: str,
              by: list[str] = (), on: list[str] | None = None, adjust: bool = False) -> DataFrame:
    """Rank correlation of each measure with ``value``, per measure and ``by``.

    ``other`` is joined on its columns in common with the units. ``adjust`` adds
    the false-discovery correction within each measure.
    """
    by = list(by)
    both = units if other is None else natural_join(units, other, "inner", on)
    long = stack(both, [*by, value], metrics, value="x")
    tests = spearman_by(long, ["metric", *by], "x", value)
    return p_adjust_bh(tests, by=["metric"]) if adjust else tests


def fit_lines(units: DataFrame, other: DataFrame | None, metrics: list[str], value: str,
              by: list[str] = (), on: list[str] | None = None) -> DataFrame:
    """Straight-line fit of ``value`` on each measure."""
    by = list(by)
    both = units if other is None else natural_join(units, other, "inner", on)
    long = stack(both, [*by, value], metrics, value="x")
    return ols_by(long, ["metric", *by], "x", value)

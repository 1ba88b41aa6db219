"""Midranks and the rank tests built on them.

Rows are first reduced to distinct values with counts; ranks come from running
counts (see :mod:`cohortry.operators.running`). P-values are asymptotic. With ``exact``,
panels without ties (and, where pairs are tested, without zero differences) have exact ones, see
:mod:`cohortry.functions.exact`; ``method`` names what was used. That is meant for small
panels: the work for a panel of sizes m and n grows with the square of m*n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.nullrules import column, divide
from cohortry.functions.exact import rank_sum_exact, signed_rank_exact, spearman_exact
from cohortry.functions.tails import chi_square_tail, normal_two_sided, student_two_sided
from cohortry.operators.running import KEY, Run, clean, cut_ranges, panel, running, settle


def _midrank(n: str = "n", upto: str = "upto") -> Column:
    return F.col(upto) - (F.col(n) - 1) / 2


def _cube_excess(n: str = "n") -> Column:
    c = F.col(n).cast("double")
    return c * c * c - c


def midranks(counts: DataFrame, by: list[str], value: str, n: str = "n",
             buckets: int | None = None, used: list[str] = ()) -> DataFrame:
    """Add ``midrank`` and the panel size ``n_panel`` to distinct values with counts."""
    counts, buckets = settle(counts, by, buckets)
    cut = cut_ranges(counts, by, value, buckets, used=[n, *used])
    ranked = running(cut, value, [Run("upto", n, total="n_panel")])
    return clean(ranked.withColumn("midrank", _midrank(n)).drop("upto"))


def _known(df: DataFrame, *values: str) -> DataFrame:
    """Drop missing values. Values are compared to 12 significant digits, so that averages
    which differ only by the order of their summation tie, in any unit."""
    for v in values:
        df = df.withColumn(v, significant_digits(F.col(v).cast("double"))).filter(
            F.col(v).isNotNull() & ~F.isnan(v))
    return df


def significant_digits(v: Column, digits: int = 12) -> Column:
    """A double to so many significant digits; the smallest and infinite numbers stay."""
    size = F.abs(v)
    power = F.pow(F.lit(10.0), F.floor(F.log10(size)).cast("double"))
    return F.when((size > 1e-290) & (size < 1e290), F.round(v / power, digits - 1) * power).otherwise(v)


def _p_value(exact: bool, untied: Column, counted: Column, approximate: Column, name: str, form: str) -> list[Column]:
    """The columns ``p_value`` and ``method`` of a test."""
    if not exact:
        return [approximate.alias("p_value"), F.lit(f"{name}, {form}").alias("method")]
    untied = F.coalesce(untied, F.lit(False))
    return [F.when(untied, counted).otherwise(approximate).alias("p_value"),
            F.when(untied, F.lit(f"{name}, exact")).otherwise(F.lit(f"{name}, {form}")).alias("method")]


def _only(condition: Column, *columns: str) -> list[Column]:
    """The columns where ``condition`` holds: a function in Python sees all rows, also those that a CASE leaves out."""
    return [F.when(condition, F.col(c)) for c in columns]


def rank_sum_by(df: DataFrame, by: list[str], group: str, value: str, levels: tuple,
                buckets: int | None = None, exact: bool = False) -> DataFrame:
    """Two-sample rank-sum test per panel.

    ``levels`` are the two values of ``group``; ``statistic`` counts the pairs in
    which the first is larger. Normal approximation with tie and continuity
    correction.
    """
    first, second = levels
    rows = df.filter(column(group).isin(first, second)).select(
        *by, column(group).alias("_g"), F.col(value).alias("_v"))
    counts = (
        _known(rows, "_v").groupBy(*by, "_v")
        .agg(F.count_if(F.col("_g") == F.lit(first)).alias("n1"),
             F.count_if(F.col("_g") == F.lit(second)).alias("n2"))
        .withColumn("n", F.col("n1") + F.col("n2"))
    )
    ranked = midranks(counts, by, "_v", buckets=buckets)
    sums = ranked.groupBy(*by).agg(
        F.sum("n1").alias("n1"), F.sum("n2").alias("n2"),
        F.sum(F.col("n1") * F.col("midrank")).alias("_rank_sum"),
        F.sum(_cube_excess()).alias("_ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    gap = F.col("statistic") - n1 * n2 / 2
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.coalesce(divide("_ties", n * (n - 1)), F.lit(0.0))))
    out = (
        sums.filter("n1 > 0 and n2 > 0")
        .withColumn("statistic", F.col("_rank_sum") - n1 * (n1 + 1) / 2)
        .withColumn("z", F.try_divide(gap - F.signum(gap) * 0.5, spread))
    )
    untied = F.col("_ties") == 0
    counted = rank_sum_exact(*_only(untied, "statistic", "n1", "n2")) if exact else None
    return out.select(*by, "n1", "n2", "statistic", "z",
                      *_p_value(exact, untied, counted, normal_two_sided("z"), "rank-sum", "normal"))


def kruskal_by(df: DataFrame, by: list[str], group: str, value: str,
               buckets: int | None = None) -> DataFrame:
    """Kruskal-Wallis test per panel over all levels of ``group``."""
    rows = df.filter(column(group).isNotNull()).select(
        *by, column(group).alias("_g"), F.col(value).alias("_v"))
    cells, buckets = settle(
        _known(rows, "_v").groupBy(*by, "_v", "_g").agg(F.count(F.lit(1)).alias("n")), by, buckets)
    values = cells.groupBy(*by, "_v").agg(F.sum("n").alias("n"))
    ranked = (
        midranks(values, by, "_v", buckets=buckets)
        .select(panel(by).alias(KEY), "_v", "midrank", F.col("n").alias("_tied")))
    levels = (
        cells.withColumn(KEY, panel(by)).join(ranked, [KEY, "_v"])
        .groupBy(*by, "_g")
        .agg(F.sum("n").alias("n"),
             F.sum(F.col("n") * F.col("midrank")).alias("_r"),
             F.sum(F.col("n") * (F.col("_tied").cast("double") * F.col("_tied") - 1)).alias("_ties")))
    sums = levels.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_levels"), F.sum("n").alias("n"),
        F.sum(F.col("_r") * F.col("_r") / F.col("n")).alias("_r2"),
        F.sum("_ties").alias("_ties"))
    n = F.col("n").cast("double")
    raw = 12 / (n * (n + 1)) * (F.col("_r2") - n * (n + 1) * (n + 1) / 4)
    out = (
        sums.filter("n_levels > 1")
        .withColumn("statistic", F.try_divide(raw, 1 - F.col("_ties") / (n * n * n - n)))
        .withColumn("dof", F.col("n_levels") - 1))
    return out.select(*by, "n_levels", "n", "statistic", "dof",
                      chi_square_tail("statistic", "dof").alias("p_value"),
                      F.lit("Kruskal-Wallis").alias("method"))


def spearman_by(df: DataFrame, by: list[str], x: str, y: str,
                buckets: int | None = None, exact: bool = False) -> DataFrame:
    """Rank correlation per panel, with the t approximation for its p-value.

    With ``exact``, panels without ties of up to nine pairs count all orders, and larger ones take
    the Edgeworth series of the sum of squared rank gaps.
    """
    rows = df.select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
    cells, buckets = settle(
        _known(rows, "_x", "_y").groupBy(*by, "_x", "_y").agg(F.count(F.lit(1)).alias("n")), by, buckets)
    cells = cells.withColumn(KEY, panel(by))

    def ranks(v: str, out: str) -> DataFrame:
        values = cells.groupBy(*by, v).agg(F.sum("n").alias("n"))
        ranked = midranks(values, by, v, buckets=buckets)
        centred = F.col("midrank") - (F.col("n_panel") + 1) / 2
        return ranked.select(panel(by).alias(KEY), v, centred.alias(out), F.col("n").alias(f"{out}_tied"))

    both = cells.join(ranks("_x", "_rx"), [KEY, "_x"]).join(ranks("_y", "_ry"), [KEY, "_y"])
    w, rx, ry = F.col("n"), F.col("_rx"), F.col("_ry")
    sums = both.groupBy(*by).agg(
        F.sum("n").alias("n"), F.max(F.greatest("_rx_tied", "_ry_tied")).alias("_tied"), F.sum(w * rx * ry).alias("_sxy"),
        F.sum(w * rx * rx).alias("_sxx"), F.sum(w * ry * ry).alias("_syy"))
    rho, dof = F.col("rho"), F.col("n") - 2
    out = (
        sums.withColumn("rho", F.try_divide("_sxy", F.sqrt("_sxx") * F.sqrt("_syy")))
        .withColumn("_t", F.when(dof > 0, F.try_divide(
            rho * F.sqrt(dof.cast("double")), F.sqrt(1 - F.least(rho * rho, F.lit(1.0))))))
        .withColumn("_dof", F.when(dof > 0, dof))
        .withColumn("_tail", student_two_sided("_t", "_dof")))
    exact_line = (F.abs(rho) >= 1) & (dof > 0)
    untied = (F.col("_tied") == 1) & rho.isNotNull()
    counted = spearman_exact(*_only(untied, "rho", "n")) if exact else None
    return out.select(*by, "n", "rho", *_p_value(
        exact, untied, counted, F.when(exact_line, F.lit(0.0)).otherwise(F.col("_tail")), "Spearman", "t"))


def signed_rank_by(df: DataFrame, by: list[str], pair_id: str, group: str, value: str,
                   levels: tuple, buckets: int | None = None, exact: bool = False) -> DataFrame:
    """Paired signed-rank test per panel of first level minus second.

    Several values of one pair and level are averaged. ``n_dropped`` counts the
    pairs that lack a partner. Without any known value there is no result row, also
    where ``by`` is empty.
    """
    first, second = levels
    rows = df.filter(column(group).isin(first, second)).select(
        *by, F.col(pair_id).alias("_pair"), column(group).alias("_g"), F.col(value).alias("_v"))
    pairs = (
        _known(rows, "_v").groupBy(*by, "_pair")
        .agg(F.avg(F.when(F.col("_g") == F.lit(first), F.col("_v"))).alias("_a"),
             F.avg(F.when(F.col("_g") == F.lit(second), F.col("_v"))).alias("_b"))
        .withColumn("_d", significant_digits(F.col("_a")) - significant_digits(F.col("_b")))
        .withColumn("_d", significant_digits(F.col("_d")))
        .withColumn("_size", F.coalesce(F.abs("_d"), F.lit(0.0)))
    )
    # Half pairs and zero differences share the size 0, which gets no rank.
    counts = pairs.groupBy(*by, "_size").agg(
        F.count_if(F.col("_d") > 0).alias("n_up"), F.count_if(F.col("_d") < 0).alias("n_down"),
        F.count_if(F.col("_d") == 0).alias("n_zero"), F.count_if(F.col("_d").isNull()).alias("n_half"),
    ).withColumn("n", F.col("n_up") + F.col("n_down"))
    ranked = midranks(counts, by, "_size", buckets=buckets, used=["n_zero", "n_half"])
    sums = ranked.groupBy(*by).agg(
        F.sum("n").alias("n_pairs"), F.sum("n_zero").alias("n_zero"),
        F.sum("n_half").alias("n_dropped"),
        F.sum(F.col("n_up") * F.col("midrank")).cast("double").alias("statistic"),
        F.sum(_cube_excess()).alias("_ties")).filter("n_pairs is not null")
    n = F.col("n_pairs").cast("double")
    gap = F.col("statistic") - n * (n + 1) / 4
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48)
    out = sums.withColumn("z", F.try_divide(gap - F.signum(gap) * 0.5, spread))
    untied = (F.col("_ties") == 0) & (F.col("n_zero") == 0) & (F.col("n_pairs") > 0)
    counted = signed_rank_exact(*_only(untied, "statistic", "n_pairs")) if exact else None
    return out.select(*by, "n_pairs", "n_zero", "n_dropped", "statistic", "z",
                      *_p_value(exact, untied, counted, normal_two_sided("z"), "signed-rank", "normal"))


__all__ = ["midranks", "rank_sum_by", "kruskal_by", "spearman_by", "signed_rank_by"]

"""Running totals, minima and ranks over panels of any size.

A window over one panel would put a panel that holds most rows into a single
task. Here every panel of more than ``ROWS_PER_RANGE`` rows is cut into value
ranges at its own approximate quantiles, as many as its row count asks for, and the
rows are dealt out by (panel, range). The window runs inside one range, and the sums
of the earlier ranges are added afterwards. The cut points only balance the work:
any cut points give the same, exact result.

Callers reduce their rows to distinct values first, so ties are one row. Where
no reduced panel is large, :func:`settle` finds that one range per panel will do and
the plan is a plain window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.session import staged

#: Rows of a panel that one window task gets, about.
ROWS_PER_RANGE = 1_000_000
KEY, BUCKET = "_panel", "_range"


@dataclass(frozen=True)
class Run:
    """One running column. ``total`` names the panel-wide result, if wanted."""

    out: str
    value: str
    how: str = "sum"
    reverse: bool = False
    total: str | None = None


def settle(df: DataFrame, by: list[str], buckets: int | None = None) -> tuple[DataFrame, int]:
    """Stage a reduced frame and count the ranges its largest panel needs.

    The source is then read once, however often the ranks refer to the frame. A
    given number of ``buckets`` is kept and nothing is staged.
    """
    if buckets is not None:
        return df, buckets
    df = staged(df)
    largest = df.count()
    if largest > ROWS_PER_RANGE and by:
        largest = df.groupBy(*by).count().agg(F.max("count")).first()[0]
    return df, -(-largest // ROWS_PER_RANGE)


def panel(by: list[str]) -> Column:
    # A struct compares equal field by field with missing values equal, so the
    # joins below stay ordinary equality joins.
    return F.struct(*by) if by else F.lit(0)


def cut_ranges(df: DataFrame, by: list[str], order: str, buckets: int,
               used: list[str] = ()) -> DataFrame:
    """Add the panel key and, with more than one range, the range of each row.

    A panel gets a range per ``ROWS_PER_RANGE`` rows, at most ``buckets``. ``used`` lists
    the counts the later steps read. Reading them here as well keeps the upstream exchange
    of every branch identical, so Spark runs it once and reuses it.
    """
    keyed = df.withColumn(KEY, panel(by))
    if buckets < 2:
        return keyed
    source = keyed
    for name in used:
        source = source.filter(F.col(name) >= 0)
    shares = [i / buckets for i in range(1, buckets)]
    edges = F.percentile_approx(F.col(order).cast("double"), shares, 20 * buckets)
    points = source.groupBy(KEY).agg(edges.alias("_all"), F.ceil(F.count(F.lit(1)) / ROWS_PER_RANGE).alias("_parts"))
    # Every n-th cut point, so that smaller panels have fewer; the first level of the search
    # below takes every _step-th of those.
    some = F.transform(F.sequence(F.lit(1), F.col("_parts") - 1),
                       lambda i: F.element_at("_all", F.greatest(F.lit(1), F.floor(i * buckets / F.col("_parts"))).cast("int")))
    points = points.filter((F.col("_parts") > 1) & (F.size("_all") == buckets - 1)).withColumn(
        "_parts", F.least("_parts", F.lit(buckets))).select(KEY, some.alias("_cuts"))
    points = points.withColumn("_step", F.ceil(F.sqrt(F.size("_cuts"))).cast("int")).withColumn(
        "_steps", F.transform(F.sequence(F.lit(1), F.ceil(F.size("_cuts") / F.col("_step")).cast("int")),
                              lambda i: F.element_at("_cuts", F.least(i * F.col("_step"), F.size("_cuts")))))
    # Two numbers per ROWS_PER_RANGE rows: a millionth of the frame, and only large panels have any.
    keyed = keyed.join(F.broadcast(points), KEY, "left")
    value = F.col(order)
    passed = F.size(F.filter("_steps", lambda cut: cut < value))
    near = F.slice("_cuts", passed * F.col("_step") + 1, F.col("_step"))
    place = F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(F.least(
        F.size("_cuts"), passed * F.col("_step") + F.size(F.filter(near, lambda cut: cut < value))))
    # Without this exchange the steps below could reuse one on the panel alone, which does not part its ranges.
    return keyed.withColumn(BUCKET, place).drop("_cuts", "_step", "_steps").repartition(KEY, BUCKET)


_FOLD = {"sum": F.sum, "min": F.min, "max": F.max}


def _merge(how: str, near: Column, far: Column) -> Column:
    if how == "sum":
        return near + F.coalesce(far, F.lit(0))
    return F.least(near, far) if how == "min" else F.greatest(near, far)


def _ordered(keys: list[str], order: str, reverse: bool):
    return Window.partitionBy(*keys).orderBy(
        F.col(order).desc() if reverse else F.col(order).asc())


def running(df: DataFrame, order: str, runs: list[Run]) -> DataFrame:
    """Add running columns to a frame from :func:`cut_ranges`.

    Each includes the rows that tie on ``order``.
    """
    if BUCKET not in df.columns:
        whole = Window.partitionBy(KEY)
        return df.select(
            "*", *[_FOLD[r.how](r.value).over(_ordered([KEY], order, r.reverse)).alias(r.out) for r in runs],
            *[_FOLD[r.how](r.value).over(whole).alias(r.total) for r in runs if r.total])
    blocks = df.groupBy(KEY, BUCKET).agg(
        *[_FOLD[r.how](r.value).alias(f"_block_{r.out}") for r in runs])
    earlier = []
    for r in runs:
        block = _FOLD[r.how](f"_block_{r.out}")
        before = _ordered([KEY], BUCKET, r.reverse).rowsBetween(Window.unboundedPreceding, -1)
        earlier.append(block.over(before).alias(f"_far_{r.out}"))
        if r.total:
            earlier.append(block.over(Window.partitionBy(KEY)).alias(r.total))
    inner = df.select("*", *[
        _FOLD[r.how](r.value).over(_ordered([KEY, BUCKET], order, r.reverse)).alias(f"_near_{r.out}")
        for r in runs])
    joined = inner.join(blocks.select(KEY, BUCKET, *earlier), [KEY, BUCKET])
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[_merge(r.how, F.col(f"_near_{r.out}"), F.col(f"_far_{r.out}")).alias(r.out) for r in runs],
        *[F.col(r.total) for r in runs if r.total])


def clean(df: DataFrame) -> DataFrame:
    return df.drop(KEY, BUCKET)

"""Group statistics on rows, group filters and shares.

A statistic over a group is always an aggregate joined back, never a window over
the group key: the aggregate combines map-side, so a key that holds a large part
of the rows does not end up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.nullrules import divide, n_distinct, n_distinct_where
from cohortry.operators.joins import keep_matching, natural_join


def add_group_stats(df: DataFrame, *specs: tuple[list[str], dict[str, Column]]) -> DataFrame:
    """Add statistics of one or several groupings to every row.

    Each spec is ``(keys, {name: aggregate})``. All statistics of one key set come
    from one aggregate. An empty key list means the whole frame.
    """
    out = df
    for keys, stats in specs:
        columns = [stat.alias(name) for name, stat in stats.items()]
        if keys:
            out = natural_join(out, df.groupBy(*keys).agg(*columns), "left", list(keys))
        else:
            whole = df.agg(*columns)
            packed = whole.select(F.struct(*whole.columns).alias("_whole"))
            out = out.withColumn("_whole", packed.scalar())
            out = out.select("*", *[F.col(f"_whole.{n}").alias(n) for n in stats]).drop("_whole")
    return out


def distinct_levels(df: DataFrame, levels: dict[str, list[str]], items: list[str],
                    count_null: bool = False) -> DataFrame:
    """Distinct values of each item per key, at several key sets, from one read of ``df``.

    ``levels`` maps a name to its keys, none for the whole frame. Each row of the result has its
    ``level``, the keys (null where the level has no such key) and ``n_<item>``. Distinct (key, item) pairs of all
    levels go through one exchange that combines map-side, and no key holds its rows in one
    task: pairs are dealt by key and item. Pairs that several levels share are made once.
    A level has no row where the frame has none. ``count_null`` counts a missing item as a value.
    """
    keys = list(dict.fromkeys(k for of in levels.values() for k in of))
    columns = list(dict.fromkeys([*keys, *items]))
    uses: dict[frozenset, list[tuple[str, str]]] = {}
    for level, of in levels.items():
        for item in items:
            uses.setdefault(frozenset([*of, item]), []).append((level, item))
    pairs = df.groupingSets([[c for c in columns if c in chosen] for chosen in uses], *columns).agg(
        F.grouping_id().alias("_set"))
    # The id has a bit for each column that the set lacks, the first column's highest.
    mark = None
    for chosen, told in uses.items():
        number = sum((c not in chosen) << (len(columns) - 1 - i) for i, c in enumerate(columns))
        these = F.array(*[F.struct(F.lit(level).alias("level"), F.lit(item).alias("item")) for level, item in told])
        mark = F.when(F.col("_set") == number, these) if mark is None else mark.when(F.col("_set") == number, these)
    marked = pairs.withColumn("_use", F.explode(mark))
    level, counts = F.col("_use.level"), []
    for item in items:
        seen = F.col("_use.item") == item
        counts.append(F.count_if(seen if count_null else seen & F.col(item).isNotNull()).alias(f"n_{item}"))
    own = [F.when(level.isin([name for name, of in levels.items() if k in of]), F.col(k)).alias(k) for k in keys]
    return marked.groupBy(level.alias("level"), *own).agg(*counts)


def keep_groups(df: DataFrame, keys: list[str], stat: Column, test, keep: str | None = None):
    """Rows of the groups whose statistic passes ``test(column)``.

    ``keep`` names the statistic to leave on the rows.
    """
    name = keep or "_stat"
    groups = df.groupBy(*keys).agg(stat.alias(name)).filter(test(F.col(name)))
    if keep:
        return natural_join(df, groups, "inner", list(keys))
    return keep_matching(df, groups, list(keys))


def having(df: DataFrame, keys: list[str], stats: dict[str, Column], test: Column) -> DataFrame:
    """The groups, with their statistics, that pass ``test``."""
    return df.groupBy(*keys).agg(*[s.alias(n) for n, s in stats.items()]).filter(test)


def conditional_share(df: DataFrame, by: list[str], item: str, where: Column, *,
                      share_of: list[str] | None = None, out: str = "share",
                      count_null: bool = True, extra: dict[str, Column] | None = None,
                      row_weighted: bool = False) -> DataFrame:
    """Distinct ``item`` under a condition over distinct ``item`` before it.

    ``share_of`` is the coarser key of the denominator. Groups in which no row
    meets the condition are absent. ``extra`` are further aggregates of the rows
    that meet it. ``row_weighted`` repeats each result once per such row.
    """
    extra = extra or {}
    condition = F.coalesce(where, F.lit(False))
    n_rows = F.count(F.when(condition, F.lit(1))).alias("_rows")
    top = n_distinct_where(condition, item, count_null).alias("n_item")
    if share_of is None or list(share_of) == list(by):
        cells = df.groupBy(*by).agg(
            top, n_distinct(item, count_null).alias("n_all"), n_rows,
            *[c.alias(n) for n, c in extra.items()]).filter("_rows > 0")
    else:
        fine = df.filter(condition).groupBy(*by).agg(
            n_distinct(item, count_null).alias("n_item"),
            *[c.alias(n) for n, c in extra.items()])
        whole = df.groupBy(*share_of).agg(n_distinct(item, count_null).alias("n_all"))
        cells = natural_join(fine, whole, "inner", list(share_of))
    cells = cells.withColumn(out, divide("n_item", "n_all")).select(
        *by, "n_item", "n_all", out, *extra)
    if row_weighted:
        return natural_join(df.filter(condition).select(*by), cells, "inner", list(by))
    return cells


def parent_share(df: DataFrame, fine: list[str], coarse: list[str], item: str, *,
                 out: str = "share", count_null: bool = True,
                 denominator: float | None = None) -> DataFrame:
    """Distinct ``item`` per fine key over distinct ``item`` per coarse key.

    A given ``denominator`` replaces the coarse count.
    """
    keys = list(dict.fromkeys([*fine, *coarse, item]))
    seen = df.select(*keys).distinct()
    cells = seen.groupBy(*fine).agg(n_distinct(item, count_null).alias("n_item"))
    if denominator is not None:
        return cells.withColumn(out, F.col("n_item") / F.lit(float(denominator)))
    if coarse:
        whole = seen.groupBy(*coarse).agg(n_distinct(item, count_null).alias("n_all"))
        cells = natural_join(cells, whole, "inner", list(coarse))
    else:
        whole = seen.agg(n_distinct(item, count_null).alias("n_all"))
        cells = cells.withColumn("n_all", whole.scalar())
    return cells.withColumn(out, divide("n_item", "n_all"))


def two_stage_mean(df: DataFrame, first: list[str], second: list[str],
                   stats: dict[str, Column]) -> DataFrame:
    """Statistics per ``first`` key, then their plain mean per ``second`` key."""
    inner = df.groupBy(*first).agg(*[s.alias(n) for n, s in stats.items()])
    return inner.groupBy(*second).agg(*[F.avg(n).alias(n) for n in stats])


def pick_where(df: DataFrame, keys: list[str], value: str, condition: Column,
               out: str) -> DataFrame:
    """Put the group's value from the row that meets ``condition`` on every row."""
    return add_group_stats(df, (keys, {out: F.max(F.when(condition, F.col(value)))}))


def any_true(c) -> Column:
    return F.bool_or(c)

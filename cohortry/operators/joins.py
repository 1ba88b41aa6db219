"""Joins on all common columns in which missing keys match each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most heavy keys that one sketch reports, and the keys it counts for each of them: with 20 its
#: error is about a fifth of the smallest heavy key.
MOST_KEYS, TRACKED = 10_000, 20


def _null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    match = reduce(lambda a, b: a & b,
                   [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(renamed, match, how)


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner",
                 on: list[str] | None = None) -> DataFrame:
    """Inner or left join on the shared columns; a missing key equals a missing key."""
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join: {how}")
    on = on or [c for c in left.columns if c in right.columns]
    if not on:
        raise ValueError("the frames share no column")
    extra = [c for c in right.columns if c not in on]
    return _null_safe(left, right, on, how).select(*left.columns, *extra)


def keep_matching(df: DataFrame, keys: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``keys``; never multiplies rows."""
    on = on or keys.columns
    return _null_safe(df, keys.select(*on), on, "left_semi")


def drop_matching(df: DataFrame, keys: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Rows of ``df`` whose key does not occur in ``keys``."""
    on = on or keys.columns
    return _null_safe(df, keys.select(*on), on, "left_anti")


def flag_matching(df: DataFrame, keys: DataFrame, out: str,
                  on: list[str] | None = None) -> DataFrame:
    """Add a boolean: does the row's key occur in ``keys``?"""
    on = on or keys.columns
    marked = keys.select(*on).distinct().withColumn(out, F.lit(True))
    return natural_join(df, marked, "left", on).withColumn(
        out, F.coalesce(F.col(out), F.lit(False)))


def heavy_keys(df: DataFrame, on: list[str], parts: int) -> DataFrame:
    """Keys with more than one row in ``parts`` of the frame, as hashes, and the pieces each should have.

    Found in one pass by a frequent-items sketch, so counts are near, not exact; they only balance
    work. There are fewer than ``parts`` such keys, which bounds the frame.
    """
    k = min(parts, MOST_KEYS)
    found = df.select(F.xxhash64(*on).alias("_hash")).agg(
        F.expr(f"approx_top_k(_hash, {k}, {TRACKED * k})").alias("_top"), F.count(F.lit(1)).alias("_all")).first()
    least = found["_all"] / k
    rows = [(top["item"], -(-int(top["count"]) // max(int(least), 1))) for top in found["_top"] or [] if top["count"] > least]
    return df.sparkSession.createDataFrame(rows, "_heavy bigint, _pieces int")


def heavy_join(left: DataFrame, right: DataFrame, how: str = "inner", on: list[str] | None = None,
               parts: int | None = None) -> DataFrame:
    """:func:`natural_join` for a left side of which a few keys hold a large share.

    The rows of a heavy key are dealt to as many pieces as its share of ``parts`` (the session's
    shuffle partitions unless given), and the rows of that key on the right are copied to each piece: fewer
    than twice ``parts`` copies of keys in all. A missing key can be heavy as well. The piece comes from
    a hash of the whole left row, so that a task run again after a lost executor deals as before;
    wholly equal rows therefore stay together and are better reduced to counts first.
    The left side is read twice, the first time for its key only.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join: {how}")
    on = on or [c for c in left.columns if c in right.columns]
    if not on:
        raise ValueError("the frames share no column")
    parts = parts or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = heavy_keys(left, on, parts)

    def marked(df):  # fewer than ``parts`` rows are broadcast
        return df.withColumn("_hash", F.xxhash64(*on)).join(F.broadcast(heavy), F.col("_hash") == F.col("_heavy"), "left")

    pieces = F.coalesce("_pieces", F.lit(1))
    dealt = marked(left).withColumn("_piece", F.pmod(F.xxhash64(*left.columns), pieces).cast("int")).select(*left.columns, "_piece")
    copied = marked(right).withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1))).select(*right.columns, "_piece")
    return natural_join(dealt, copied, how, [*on, "_piece"]).drop("_piece")


def merge_on(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on a row-name column, which is never missing."""
    return left.join(right, key)


def common_values(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def only_first(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)

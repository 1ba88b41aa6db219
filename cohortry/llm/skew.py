"""Joins on keys of which a few may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of all rows on, so there are at most ``HOT_KEYS`` hot keys.
HOT_KEYS = 1000
#: Parts into which the rows of a hot key are dealt.
PARTS = 64


def split_join(left: DataFrame, right: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``key``, null matching null.

    ``right`` has one row per key and should be staged, as it is read three times; ``count``
    is its column with the rows of ``left`` that have the key. Keys with a thousandth of all
    rows are hot. At most ``HOT_KEYS`` can be, and only those are broadcast: their rows in
    ``left`` are dealt to ``PARTS`` parts and their rows in ``right`` are repeated for each.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    least = max(total // HOT_KEYS, 1)
    hot = right.filter(F.col(count) > least).select(F.col(key).alias("_hot_key"), F.lit(True).alias("_hot"))
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(PARTS)).cast("int")
    dealt = left.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hot_key")), "left")
    dealt = dealt.withColumn("_part", F.when(F.col("_hot"), part).otherwise(F.lit(0))).drop("_hot", "_hot_key")
    parts = F.when(F.col(count) > least, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    found = right.withColumnRenamed(key, "_found_key").withColumn("_found_part", F.explode(parts))
    same = F.col(key).eqNullSafe(F.col("_found_key")) & (F.col("_part") == F.col("_found_part"))
    return dealt.join(found, same, how).drop("_part", "_found_key", "_found_part")

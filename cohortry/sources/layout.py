"""Tables laid out by key once, so that later joins and group statistics on the key move no rows.

The rows of ordinary keys lie in Parquet files bucketed and sorted by the key. Two tables with the same
keys and bucket count join bucket by bucket, and grouping by the key stays inside a bucket.

A bucket is read by one task, so a key that holds a large share of the rows must not lie in one. Such
heavy keys are found by the sketch of :func:`heavy_keys` and their rows lie apart, unbucketed, as do rows
with a missing key, which a bucketed join could not match. These spread rows join by :func:`heavy_join`, and
group with map-side aggregation. As a key is either in buckets or spread, the two results are put side by side.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.operators.joins import heavy_join, heavy_keys


@dataclass(frozen=True)
class KeyedTable:
    """``bucketed`` and ``spread`` rows of one table; a key's rows are all in one of the two."""

    bucketed: DataFrame
    spread: DataFrame
    keys: tuple[str, ...]
    buckets: int

    def rows(self) -> DataFrame:
        return self.bucketed.unionByName(self.spread)

    def each(self, change: Callable[[DataFrame], DataFrame]) -> KeyedTable:
        """Both parts under a change of rows or columns that leaves the keys as they are."""
        return KeyedTable(change(self.bucketed), change(self.spread), self.keys, self.buckets)

    def group(self, *by: str, **measures: Column) -> DataFrame:
        """Group statistics by the keys and ``by``.

        Bucketed rows are not moved, unless distinct values of more than one column are counted: Spark then
        expands the rows and exchanges them, so ask for such counts one by one where the table is large.
        """
        names = [*self.keys, *by]
        aggregates = [c.alias(n) for n, c in measures.items()]
        return self.bucketed.groupBy(*names).agg(*aggregates).unionByName(self.spread.groupBy(*names).agg(*aggregates))

    def distinct(self) -> KeyedTable:
        """Each row once; equal bucketed rows meet in their bucket."""
        bucketed = self.bucketed.groupBy(*self.bucketed.columns).agg(F.lit(True).alias("_one")).drop("_one")
        return KeyedTable(bucketed, self.spread.distinct(), self.keys, self.buckets)

    def join(self, right: KeyedTable, how: str = "inner") -> KeyedTable:
        """Inner or left join on the keys with a table laid out alike; a missing key equals a missing key.

        ``right`` must be an index (:func:`write_index`): all its rows with a key lie in buckets, and only
        those with a missing key are spread.
        """
        if how not in ("inner", "left"):
            raise ValueError(f"unsupported join: {how}")
        if (self.keys, self.buckets) != (right.keys, right.buckets):
            raise ValueError("the tables are laid out differently")
        keys = list(self.keys)
        # Bucketed keys are never missing; plain equality is what a bucketed join is planned from.
        bucketed = self.bucketed.join(right.bucketed, keys, how)
        spread = heavy_join(self.spread, right.rows(), how, keys)
        return KeyedTable(bucketed, spread.select(bucketed.columns), self.keys, self.buckets)


def _missing(keys: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [F.col(f"`{k}`").isNull() for k in keys])


def _table(spark: SparkSession, path: str, schema: T.StructType, keys: tuple[str, ...], buckets: int) -> DataFrame:
    """Bucketed files under a table name of this session."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    by = ", ".join(f"`{k}`" for k in keys)
    name = f"keyed_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS "
              f"LOCATION '{path}'")
    return spark.table(name)


def _write(df: DataFrame, path: str, keys: tuple[str, ...], buckets: int, heavy: DataFrame | None) -> None:
    # The hash of the exchange is that of the buckets, so every task writes one file.
    apart = _missing(keys)
    if heavy is not None:  # fewer keys than buckets are broadcast
        df = df.withColumn("_hash", F.xxhash64(*keys)).join(F.broadcast(heavy), F.col("_hash") == F.col("_heavy"), "left")
        apart = apart | F.col("_heavy").isNotNull()
    names = [c for c in df.columns if c not in ("_hash", "_heavy", "_pieces")]
    table = f"keyed_{uuid.uuid4().hex}"
    df.filter(~apart).select(*names).repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option(
        "path", f"{path}/bucketed").saveAsTable(table)
    df.sparkSession.sql(f"DROP TABLE {table}")  # the name alone; the files are external and stay
    df.filter(apart).select(*names).write.parquet(f"{path}/spread")


def write_keyed(df: DataFrame, path: str, keys: list[str], buckets: int) -> KeyedTable:
    """Lay a table out by key below ``path`` on shared storage.

    A key with more than one row in ``buckets`` is heavy. Rows of heavy and of missing keys are spread.
    The frame is read three times: for its keys, and for either part.
    """
    keys = tuple(keys)
    heavy = heavy_keys(df.filter(~_missing(keys)), list(keys), buckets)
    _write(df, path, keys, buckets, heavy)
    return open_keyed(df.sparkSession, path, list(keys), buckets)


def write_index(df: DataFrame, path: str, keys: list[str], buckets: int) -> KeyedTable:
    """Lay out a table with few rows per key, to be joined to one that :func:`write_keyed` wrote."""
    _write(df, path, tuple(keys), buckets, None)
    return open_keyed(df.sparkSession, path, keys, buckets)


def open_keyed(spark: SparkSession, path: str, keys: list[str], buckets: int) -> KeyedTable:
    """A table written earlier, by this session or another; ``keys`` and ``buckets`` as it was written with."""
    spread = spark.read.parquet(f"{path}/spread")
    return KeyedTable(_table(spark, f"{path}/bucketed", spread.schema, tuple(keys), buckets), spread, tuple(keys), buckets)

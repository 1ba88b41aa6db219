"""A key, and a missing key, that each hold a third of all rows; joins forced to
shuffle and to split skewed partitions."""

import brute
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortry.functions.nullrules import n_distinct
from cohortry.operators import grouped, running
from cohortry.operators.ranks import rank_sum_by
from cohortry.plans.profiles import profile

CONF = {"spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB"}


@pytest.fixture
def shuffled(spark):
    before = {k: spark.conf.get(k, None) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(11)
    n = 9000
    key = np.where(np.arange(n) % 3 == 0, "hot", np.where(np.arange(n) % 3 == 1, None, [f"k{i % 50}" for i in range(n)]))
    return pd.DataFrame({"k": key, "item": rng.integers(0, 700, n), "v": rng.integers(0, 90, n).astype(float),
                         "g": rng.choice(["a", "b"], n)})


def test_group_statistics_and_shares(shuffled, table):
    df = shuffled.createDataFrame(table)
    want = table.groupby("k", dropna=False).agg(n=("item", "nunique"), mean=("v", "mean"))
    got = grouped.add_group_stats(df, (["k"], {"n": n_distinct("item"), "mean": F.avg("v")})).toPandas()
    assert len(got) == len(table)
    per_key = got.groupby("k", dropna=False).agg(n=("n", "max"), low=("n", "min"), mean=("mean", "max"))
    assert (per_key.n == want.n).all() and (per_key.low == want.n).all()
    assert np.allclose(per_key["mean"], want["mean"])
    share = grouped.conditional_share(df, ["k"], "item", F.col("v") > 80).toPandas().set_index("k")
    top = table[table.v > 80].groupby("k", dropna=False).item.nunique()
    assert (share.n_item.sort_index() == top.sort_index()).all()
    units = profile(df, ["k"], "item", {"n": None, "high": "v > 80"}, {"mean": ("v", None)}).toPandas().set_index("k")
    assert (units.n.sort_index() == want.n.sort_index()).all()
    assert (units.high.dropna().sort_index() == top.sort_index()).all()
    assert np.allclose(units["mean"].sort_index(), want["mean"].sort_index())


def test_ranks_of_a_hot_panel(shuffled, table, monkeypatch):
    monkeypatch.setattr(running, "ROWS_PER_RANGE", 40)
    df = shuffled.createDataFrame(table).withColumn("v", F.col("v") + F.col("item") / 1000)
    values = table.v + table["item"] / 1000
    for r in rank_sum_by(df, ["k"], "g", "v", ("a", "b")).collect():
        mine = table.k.isna() if r.k is None else table.k == r.k
        a, b = values[mine & (table.g == "a")].to_numpy(), values[mine & (table.g == "b")].to_numpy()
        w, z, p = brute.rank_sum(a.round(11), b.round(11))
        assert (r.statistic, r.z, r.p_value) == pytest.approx((w, z, p))


def test_a_hot_panel_is_spread_over_tasks(shuffled, monkeypatch):
    """Nine tenths of the rows are in one panel; its ranges must not meet in one task."""
    monkeypatch.setattr(running, "ROWS_PER_RANGE", 500)
    before = {k: shuffled.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    shuffled.conf.set("spark.sql.shuffle.partitions", "8")
    shuffled.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = shuffled.range(20_000).selectExpr("IF(id % 10 = 0, 'k' || id % 7, 'hot') AS k", "CAST(id AS double) AS v", "1L AS n")
        counts, ranges = running.settle(df, ["k"])
        assert ranges == 36
        cut = running.cut_ranges(counts, ["k"], "v", ranges, used=["n"])
        out = running.running(cut, "v", [running.Run("upto", "n", total="all")]).withColumn("task", F.spark_partition_id())
        rows = out.filter("k = 'hot'").groupBy("task").agg(F.count("*").alias("rows"), F.max("all").alias("all")).collect()
        assert len(rows) >= 7 and max(r.rows for r in rows) < 18_000 / 2 and {r["all"] for r in rows} == {18_000}
        small = out.filter("k <> 'hot'").groupBy("k").agg(F.countDistinct(running.BUCKET).alias("ranges")).collect()
        assert {r.ranges for r in small} == {1}
    finally:
        for k, v in before.items():
            shuffled.conf.set(k, v)

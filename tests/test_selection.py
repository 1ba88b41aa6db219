"""Selection by digits, distinct counts at several levels, and joins with heavy keys."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from cohortry.operators import grouped, joins, moments, selection

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bits_order_as_doubles_and_come_back(spark):
    rng = np.random.default_rng(3)
    special = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308,
               float("inf"), float("-inf"), 1.0, np.nextafter(1, 0), np.nextafter(1, 2), 8.0, np.nextafter(8, 0), 1e-310, 3e-320]
    exponents = rng.integers(-1074, 1023, 3000)
    values = special + [float(np.ldexp(m, int(e))) for m, e in zip(rng.uniform(-2, 2, 3000), exponents)]
    df = spark.createDataFrame([(float(v),) for v in values], "v double").withColumn("key", selection.ordered_bits(F.col("v")))
    rows = df.withColumn("back", selection.from_ordered_bits(F.col("key"))).collect()
    assert all(r.back == r.v for r in rows)
    want = [int(np.float64(abs(r.v)).view(np.int64)) * (-1 if r.v < 0 else 1) for r in rows]
    assert [r.key for r in rows] == want


@pytest.fixture(scope="module")
def panels():
    rng = np.random.default_rng(5)
    n = 6000
    key = [("hot", None, f"k{i % 40}")[i % 3] for i in range(n)]
    value = np.where(np.arange(n) % 5 == 0, rng.integers(-3, 4, n), rng.normal(size=n) * 10.0 ** rng.integers(-8, 9, n))
    rows = [(k, None if i % 17 == 0 else float("nan") if i % 19 == 0 else float(v)) for i, (k, v) in enumerate(zip(key, value))]
    return [*rows, ("nothing", None), ("one", 4.5)]


def known(rows):
    out = {}
    for k, v in rows:
        if v is not None and not np.isnan(v):
            out.setdefault(k, []).append(v)
    return out


def test_quantiles_of_panels(spark, panels):
    df = spark.createDataFrame(panels, "k string, v double")
    probs = {"low": 0.0, "a": 0.1, "median": 0.5, "q": 0.977, "high": 1.0}
    got = {r.k: r for r in selection.selected_quantiles(df, ["k"], "v", probs).collect()}
    want = known(panels)
    assert set(got) == set(want)
    for k, values in want.items():
        assert got[k].n == len(values)
        for name, prob in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(values, prob), rel=1e-12), (k, name)
    whole = selection.selected_quantiles(df, [], "v", {"median": 0.5}).first()
    assert whole["median"] == np.median([v for vs in want.values() for v in vs])


def test_boxes_as_by_ranks(spark, panels):
    df = spark.createDataFrame(panels, "k string, v double")
    names = ["k", "n", "q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers"]
    got = selection.selected_boxes(df, ["k"], "v").select(names).toPandas().sort_values("k").reset_index(drop=True)
    want = moments.box_stats_by(df, ["k"], "v").select(names).toPandas().sort_values("k").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_infinite_values_and_empty_tables(spark):
    inf = float("inf")
    df = spark.createDataFrame([("a", inf), ("a", inf), ("a", 1.0), ("b", -inf), ("b", inf)], "k string, v double")
    got = {r.k: r for r in selection.selected_quantiles(df, ["k"], "v", {"median": 0.5, "low": 0.0, "part": 0.25}).collect()}
    assert (got["a"]["median"], got["a"]["low"], got["a"]["part"]) == (inf, 1.0, inf)
    assert (got["b"]["median"], got["b"]["low"]) == (None, -inf)
    none = df.limit(0)
    assert selection.selected_quantiles(none, ["k"], "v", {"median": 0.5}).count() == 0
    assert selection.selected_boxes(none, ["k"], "v").count() == 0


def test_no_sort_on_the_value(spark, panels, monkeypatch):
    plans, write = [], selection.staged
    monkeypatch.setattr(selection, "staged", lambda df: (plans.append(plan(df)), write(df))[1])
    df = spark.createDataFrame(panels, "k string, v double")
    plans.append(plan(selection.selected_boxes(df, ["k"], "v")))
    sorts = [line for text in plans for line in text.splitlines() if re.search(r"\bSort \[", line)]
    assert len(plans) > 4 and not any(re.search(r"\b(v|_key)#", line) for line in sorts)


def test_distinct_levels(spark):
    rng = np.random.default_rng(8)
    rows = [(("x", "y", None)[int(rng.integers(3))], int(rng.integers(6)), None if rng.random() < .1 else f"s{rng.integers(60)}",
             int(rng.integers(30))) for _ in range(900)]
    frame = pd.DataFrame(rows, columns=["a", "b", "s", "e"])
    df = spark.createDataFrame(rows, "a string, b int, s string, e int")
    levels = {"a": ["a"], "ab": ["a", "b"], "s": ["s"], "all": []}
    got = grouped.distinct_levels(df, levels, ["s", "e"]).collect()
    for level, keys in levels.items():
        parts = frame.groupby(keys, dropna=False) if keys else [((), frame)]
        mine = {tuple(r[k] for k in keys): (r.n_s, r.n_e) for r in got if r.level == level}
        want = {tuple(None if pd.isna(x) else x for x in key): (part.s.nunique(), part.e.nunique()) for key, part in parts}
        assert mine == want, level
    counted = grouped.distinct_levels(df, {"all": []}, ["s"], count_null=True).first()
    assert counted.n_s == frame.s.nunique() + 1
    assert grouped.distinct_levels(df.limit(0), levels, ["s"]).count() == 0


@pytest.mark.parametrize("name", ["d17_cohort_profile", "d49_event_sets", "w3_sequential_groups"])
def test_base_is_read_once(spark, monkeypatch, name):
    from catalog import basics
    plans, write = [], basics.staged
    monkeypatch.setattr(basics, "staged", lambda df: (plans.append(plan(df)), write(df))[1])
    plans.append(plan(entry_point.queries()[name](spark, DATA)))
    assert sum(len(re.findall(r"FileScan parquet[^\n]*l_partkey", text)) for text in plans) == 1


@pytest.fixture
def skewless(spark):
    """No broadcast of the right side, no splitting or merging by the engine."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_heavy_key_is_dealt(skewless):
    """Half of the rows on one key, a sixth without a key."""
    n = 24_000
    left = skewless.range(n).select(
        F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 400).cast("int").alias("k"), F.col("id").alias("row"))
    right = skewless.range(300).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("v"), F.lit(1).alias("copy")).unionByName(
        skewless.createDataFrame([(None, -1, 1), (7, 71, 2)], "k int, v bigint, copy int"))
    for how in ("inner", "left"):
        spread = joins.heavy_join(left, right, how)
        plain = joins.natural_join(left, right, how)
        assert spread.columns == plain.columns
        assert sorted(map(str, spread.collect())) == sorted(map(str, plain.collect()))
        sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
        whole = [r["count"] for r in plain.groupBy(F.spark_partition_id()).count().collect()]
        assert max(whole) > sum(whole) / 2
        assert len(sizes) >= 12 and max(sizes) < sum(sizes) / 4


def test_heavy_join_without_rows_or_heavy_keys(spark):
    left = spark.createDataFrame([(i, f"r{i}") for i in range(50)], "k int, a string")
    right = spark.createDataFrame([(3, "x"), (3, "y"), (60, "z")], "k int, b string")
    for how in ("inner", "left"):
        assert sorted(map(str, joins.heavy_join(left, right, how).collect())) == sorted(map(str, joins.natural_join(left, right, how).collect()))
        assert joins.heavy_join(left.limit(0), right, how).count() == 0
    assert joins.heavy_join(left, right.limit(0)).count() == 0
    with pytest.raises(ValueError):
        joins.heavy_join(left, right, "outer")
    with pytest.raises(ValueError):
        joins.heavy_join(left, right.select("b"))

"""Tables laid out by key: whole results, no exchange on the key, heavy and missing keys spread."""

import pytest
from pyspark.sql import functions as F

from cohortry.operators.joins import natural_join
from cohortry.plans import ingest
from cohortry.sources.layout import open_keyed, write_index, write_keyed

BUCKETS = 8


@pytest.fixture
def merged(spark):
    """Joins shuffle where they can not do without."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def rows_of(df):
    return sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def events(spark):
    # A third of the rows has one key, a third has none.
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id") % 200).cast("long")
    return spark.range(3000).select(key.alias("sample"), (F.col("id") % 11).alias("event"), F.lit(1).alias("one"))


@pytest.fixture
def index(spark):
    ids = [(i, f"p{i % 5}") for i in range(0, 150)] + [(None, "none"), (3, "again")]
    return spark.createDataFrame(ids, "sample long, patient string")


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_and_group(merged, tmp_path, events, index, how):
    left = write_keyed(events, f"{tmp_path}/e", ["sample"], BUCKETS)
    right = write_index(index, f"{tmp_path}/i", ["sample"], BUCKETS)
    joined = left.join(right, how)
    plain = natural_join(events, index, how)
    assert rows_of(joined.rows()) == rows_of(plain)
    assert "Exchange" not in plan_of(joined.bucketed)
    grouped = joined.group("patient", n=F.count("*"), kinds=F.count_distinct("event"))
    assert rows_of(grouped) == rows_of(plain.groupBy("sample", "patient").agg(
        F.count("*").alias("n"), F.count_distinct("event").alias("kinds")))
    assert "Exchange" not in plan_of(joined.bucketed.groupBy("sample", "patient").agg(F.count_distinct("event")))
    assert rows_of(joined.distinct().rows()) == rows_of(plain.distinct())
    assert "Exchange" not in plan_of(joined.distinct().bucketed)


def test_heavy_and_missing_keys_are_spread(spark, tmp_path, events):
    left = write_keyed(events, f"{tmp_path}/e", ["sample"], BUCKETS)
    assert {r.sample for r in left.spread.select("sample").distinct().collect()} == {7, None}
    assert left.bucketed.count() + left.spread.count() == 3000
    assert left.bucketed.groupBy(F.input_file_name()).count().count() <= BUCKETS
    again = open_keyed(spark, f"{tmp_path}/e", ["sample"], BUCKETS)
    assert rows_of(again.rows()) == rows_of(events)


def test_two_keys_and_empty_tables(merged, tmp_path, events, index):
    two = events.withColumn("sample", F.when(F.col("event") < 9, F.col("sample")))
    left = write_keyed(two, f"{tmp_path}/e", ["sample", "event"], 4)
    right = write_index(two.distinct().withColumn("seen", F.lit(True)).drop("one"), f"{tmp_path}/i", ["sample", "event"], 4)
    assert rows_of(left.join(right).rows()) == rows_of(natural_join(two, right.rows()))
    none = write_keyed(events.limit(0), f"{tmp_path}/n", ["sample"], BUCKETS)
    empty = write_index(index.limit(0), f"{tmp_path}/x", ["sample"], BUCKETS)
    full = write_index(index, f"{tmp_path}/f", ["sample"], BUCKETS)
    assert none.join(full).rows().count() == 0 and none.group(n=F.count("*")).count() == 0
    all_left = write_keyed(events, f"{tmp_path}/a", ["sample"], BUCKETS).join(empty, "left").rows()
    assert all_left.count() == 3000 and all_left.filter("patient is not null").count() == 0


def test_layouts_must_agree(spark, tmp_path, events, index):
    left = write_keyed(events, f"{tmp_path}/e", ["sample"], BUCKETS)
    other = write_index(index, f"{tmp_path}/i", ["sample"], 4)
    with pytest.raises(ValueError, match="laid out"):
        left.join(other)
    with pytest.raises(ValueError, match="unsupported"):
        left.join(left, "outer")


def test_attached_samples_are_not_moved(merged, tmp_path, events, index):
    known = write_keyed(events.withColumn("mut_type", F.lit("A>G")), f"{tmp_path}/e", ["sample"], BUCKETS)
    once = index.dropDuplicates(["sample"])
    samples = write_index(once, f"{tmp_path}/s", ["sample"], BUCKETS)
    classes = once.select("sample", F.lit("hot").alias("immune")).filter("sample < 40")
    immune = write_index(classes, f"{tmp_path}/i", ["sample"], BUCKETS)
    got = ingest.attach_samples_keyed(known, samples, immune)
    assert "Exchange" not in plan_of(got.bucketed)
    assert rows_of(got.rows()) == rows_of(ingest.attach_samples(known.rows(), once, classes))

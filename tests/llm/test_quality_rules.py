"""Held-out accuracy, and compiled rules against reading the trees."""

from cohortry.llm import quality_rules, registry
from cohortry.llm.text_stats import STATISTICS, statistics

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    registry.load()
    rows = registry.QUERIES["op6_quality_rules"](spark, DATA).collect()
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    out = [r for r in rows if r.held_out and r.doc_id in quality]
    assert len(out) > 50 and sum(r.predicted == quality[r.doc_id] for r in out) / len(out) > 0.95


def test_paths_and_compiled_score(spark):
    tree = """DecisionTreeClassificationModel: depth=2
  If (feature 0 <= 2.5)
   If (feature 2 <= 0.5)
    Predict: 0.0
   Else (feature 2 > 0.5)
    Predict: 1.0
  Else (feature 0 > 2.5)
   If (feature 0 <= 9.0)
    Predict: 1.0
   Else (feature 0 > 9.0)
    Predict: 0.0
"""
    rules = quality_rules.paths(tree, ["a", "b", "c"])
    assert rules == {(("a", None, 2.5),), (("a", None, 2.5), ("c", None, 0.5)), (("a", None, 2.5), ("c", 0.5, None)),
                     (("a", 2.5, None),), (("a", 2.5, 9.0),), (("a", 9.0, None),)}
    model = quality_rules.RuleModel([((("a", 2.5, 9.0),), 2.0), ((("a", None, 2.5), ("c", 0.5, None)), -1.0)], 0.0)
    df = spark.createDataFrame([(3.0, 0.0), (1.0, 1.0), (1.0, 0.0)], "a double, c double")
    got = [round(r.s, 6) for r in df.select(model.score(lambda n: df[n]).alias("s")).collect()]
    assert got == [0.880797, 0.268941, 0.5]


def test_statistics():
    assert statistics("") == [0.0] * len(STATISTICS) == statistics(" \n ")
    got = dict(zip(STATISTICS, statistics("AB cd cd | 12.\nAB cd"), strict=True))
    assert got["n_words"] == 7 and got["bar_share"] == 1 / 7 and got["distinct_share"] == 4 / 7
    assert got["upper_share"] == 4 / 10 and got["n_lines"] == 2 and got["same_word_share"] == 1 / 7


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "some words", 5), (3, "a " * 50_000, 5), (3, "b", 5)],
                                 "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_rules.classify(docs, none).collect()
    assert len(got) == 5 and {r.score for r in got} == {0.5} and "text" not in quality_rules.classify(docs, none).columns
    one = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "doc_id long, quality int")
    assert {r.predicted for r in quality_rules.classify(docs, one).collect()} == {1}
    assert quality_rules.classify(docs.limit(0), one).count() == 0

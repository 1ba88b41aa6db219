import hashlib
import itertools
import math
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.functions import exact, keyed, tails
from cohortry.functions.digest import digests
from cohortry.operators.adjust import p_adjust_bh, significant, stars
from cohortry.operators.contingency import chisq_by
from cohortry.operators.mixed import random_effects, random_intercept, residual_summary
from cohortry.operators.moments import (
    box_stats_by, line_band, median_split, ols_by, quantiles_by, slice_positions, welch_t_by)
from cohortry.operators import permute as permute_module
from cohortry.operators.permute import in_order, permutation_null, permute_label
from cohortry.operators.ranks import kruskal_by, rank_sum_by, signed_rank_by, spearman_by
from cohortry.operators import running as running_module
from cohortry.operators.running import Run, clean, cut_ranges, running
from cohortry.operators.survival import concordance, cox_ph, kaplan_meier, log_rank, median_survival, risk_table
from cohortry.operators.reshape import wide_from_long
from cohortry.plans.association import heat_matrix

BUCKETS = [None, 7]


@pytest.fixture(autouse=True)
def small_ranges(request, monkeypatch):
    """Panels of a few dozen rows are cut up where a test asks for ranges."""
    if getattr(request.node, "callspec", None) and request.node.callspec.params.get("buckets"):
        monkeypatch.setattr(running_module, "ROWS_PER_RANGE", 20)


def panels(seed=1):
    """One panel that holds most rows, a small one and one with a missing key."""
    rng = np.random.default_rng(seed)
    rows = []
    for name, n in (("hot", 300), ("small", 12), (None, 25)):
        for i in range(n):
            rows.append((name, i, str(rng.choice(["a", "b", "c"])),
                         float(rng.integers(0, 30)), round(float(rng.normal()), 1)))
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(panels(), "k string, i int, g string, x double, y double")


def test_tails_known_values():
    # Printed values of standard statistical tables.
    q = tails.upper_gamma(np.array([0.5, 1.0, 5.0, 50.0]), np.array([3.841458821 / 2, 2.0, 4.0, 60.0]))
    assert q[0] == pytest.approx(0.05, abs=1e-9)
    assert q[1] == pytest.approx(math.exp(-2), abs=1e-14)
    assert q[2] == pytest.approx(sum(math.exp(-4) * 4 ** k / math.factorial(k) for k in range(5)))
    assert q[3] == pytest.approx(sum(math.exp(-60 + k * math.log(60) - math.lgamma(k + 1))
                                     for k in range(50)), rel=1e-10)

    def student(t, d):
        return tails.beta_share(np.array([d / 2]), np.array([0.5]), np.array([d / (d + t * t)]))[0]
    assert student(2.2281388520, 10) == pytest.approx(0.05, abs=1e-9)
    assert student(12.7062047364, 1) == pytest.approx(0.05, abs=1e-9)
    assert student(0.0, 7) == pytest.approx(1.0)
    assert student(1.959963985, 1e7) == pytest.approx(0.05, abs=1e-6)


@pytest.mark.parametrize("buckets", [1, 7, 64])
def test_running_matches_plain_sums(frame, buckets, monkeypatch):
    monkeypatch.setattr(running_module, "ROWS_PER_RANGE", 3)
    counts = frame.groupBy("k", "x").agg(F.count("*").alias("n"))
    cut = cut_ranges(counts, ["k"], "x", buckets, used=["n"])
    got = clean(running(cut, "x", [Run("up", "n", total="all"), Run("down", "n", reverse=True),
                                   Run("low", "n", how="min", reverse=True)])).collect()
    for r in got:
        mine = [s for s in got if s.k == r.k]
        assert r.up == sum(s.n for s in mine if s.x <= r.x)
        assert r.down == sum(s.n for s in mine if s.x >= r.x)
        assert r.low == min(s.n for s in mine if s.x >= r.x)
        assert r.all == sum(s.n for s in mine)
    assert len(got) == counts.count()


@pytest.mark.parametrize("buckets", BUCKETS)
def test_rank_sum(frame, buckets):
    rows = panels()
    got = {r.k: r for r in rank_sum_by(frame, ["k"], "g", "x", ("a", "b"), buckets).collect()}
    assert set(got) == {"hot", "small", None}
    for k, r in got.items():
        a = [x for n, _, g, x, _ in rows if n == k and g == "a"]
        b = [x for n, _, g, x, _ in rows if n == k and g == "b"]
        w, z, p = brute.rank_sum(a, b)
        assert (r.n1, r.n2) == (len(a), len(b))
        assert (r.statistic, r.z, r.p_value) == pytest.approx((w, z, p))


def test_rank_sum_empty_group_and_constant(spark):
    df = spark.createDataFrame(
        [("one", "a", 1.0), ("flat", "a", 2.0), ("flat", "b", 2.0)], "k string, g string, v double")
    got = rank_sum_by(df, ["k"], "g", "v", ("a", "b")).collect()
    assert [(r.k, r.z, r.p_value) for r in got] == [("flat", None, None)]


@pytest.mark.parametrize("buckets", BUCKETS)
def test_kruskal(frame, buckets):
    rows = panels()
    for r in kruskal_by(frame, ["k"], "g", "x", buckets).collect():
        groups = [[x for n, _, g, x, _ in rows if n == r.k and g == v] for v in "abc"]
        groups = [g for g in groups if g]
        assert r.statistic == pytest.approx(brute.kruskal(groups))
        assert r.dof == len(groups) - 1


def test_kruskal_of_two_groups_is_squared_rank_sum(frame):
    two = frame.filter("g != 'c' and k = 'hot'")
    h = kruskal_by(two, [], "g", "x").first()
    rows = panels()
    a = [x for n, _, g, x, _ in rows if n == "hot" and g == "a"]
    b = [x for n, _, g, x, _ in rows if n == "hot" and g == "b"]
    n1, n2, n = len(a), len(b), len(a) + len(b)
    w = brute.rank_sum(a, b)[0]
    var = n1 * n2 / 12 * (n + 1 - brute.tie_sum(a + b) / (n * (n - 1)))
    assert h.statistic == pytest.approx((w - n1 * n2 / 2) ** 2 / var)


@pytest.mark.parametrize("buckets", BUCKETS)
def test_spearman(frame, buckets):
    rows = panels()
    for r in spearman_by(frame, ["k"], "x", "y", buckets).collect():
        x = brute.midranks([v[3] for v in rows if v[0] == r.k])
        y = brute.midranks([v[4] for v in rows if v[0] == r.k])
        assert r.rho == pytest.approx(np.corrcoef(x, y)[0, 1])
        t = r.rho * math.sqrt((r.n - 2) / (1 - r.rho ** 2))
        d = r.n - 2
        tail = tails.beta_share(np.array([d / 2]), np.array([0.5]), np.array([d / (d + t * t)]))[0]
        assert r.p_value == pytest.approx(tail)


def test_spearman_degenerate(spark):
    df = spark.createDataFrame([("line", float(i), float(2 * i)) for i in range(5)]
                               + [("flat", 1.0, float(i)) for i in range(5)],
                               "k string, x double, y double")
    got = {r.k: (r.rho, r.p_value) for r in spearman_by(df, ["k"], "x", "y").collect()}
    assert got["line"] == (pytest.approx(1.0), pytest.approx(0.0, abs=1e-9))
    assert got["flat"] == (None, None)


def test_signed_rank_of_no_rows(spark):
    none = spark.createDataFrame([], "k string, i int, g string, v double")
    assert signed_rank_by(none, [], "i", "g", "v", ("t", "n")).count() == 0
    assert signed_rank_by(none, ["k"], "i", "g", "v", ("t", "n")).count() == 0


def test_signed_rank(spark):
    rng = np.random.default_rng(4)
    rows, d = [], []
    for i in range(60):
        a, b = float(rng.integers(0, 9)), float(rng.integers(0, 9))
        rows += [("p", i, "t", a), ("p", i, "n", b)]
        d.append(a - b)
    rows += [("p", 99, "t", 3.0), ("q", 1, "t", 1.0), ("q", 1, "n", 1.0)]
    df = spark.createDataFrame(rows, "k string, i int, g string, v double")
    got = {r.k: r for r in signed_rank_by(df, ["k"], "i", "g", "v", ("t", "n")).collect()}
    v, z = brute.signed_rank(d)
    assert (got["p"].statistic, got["p"].z) == pytest.approx((v, z))
    assert got["p"].n_dropped == 1 and got["p"].n_zero == d.count(0.0)
    assert got["q"].n_pairs == 0 and got["q"].p_value is None


TABLES = {
    "three": [(10, 20), (30, 5), (7, 9)],
    "two": [(10, 20), (30, 5)],
    "close": [(10, 10), (10, 11)],
    "one": [(10, 20)],
    "parts": [(1.5, 2.5), (0.25, 4.0), (3.0, 0.5)],
}


def test_chi_square(spark):
    rows = [(k, float(a), float(b)) for k, t in TABLES.items() for a, b in t]
    rows += [("empty column", 1.0, 0.0), ("empty column", 2.0, 0.0), ("empty column", 3.0, 0.0),
             ("empty row", 1.0, 2.0), ("empty row", 0.0, 0.0), ("empty row", 3.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, a double, b double")
    got = {r.k: r for r in chisq_by(df, ["k"], "a", "b").collect()}
    swapped = {r.k: r for r in chisq_by(df, ["k"], "b", "a").collect()}
    for k, t in TABLES.items():
        assert got[k].statistic == pytest.approx(brute.chi_square(t), abs=1e-9)
        assert swapped[k].statistic == pytest.approx(got[k].statistic, abs=1e-9)
        assert got[k].dof == max(1, len(t) - 1)
    assert got["empty column"].statistic is None and got["empty row"].p_value is None


@pytest.mark.parametrize("buckets", BUCKETS)
def test_bh(spark, buckets):
    rng = np.random.default_rng(2)
    p = [round(float(x), 2) for x in rng.random(80)] + [0.01, 0.01, None, 1.0, 1.0]
    df = spark.createDataFrame(list(enumerate(p)), "i int, p double")
    got = {r.i: r.q for r in p_adjust_bh(df, "p", "q", buckets=buckets).collect()}
    for i, q in enumerate(brute.bh(p)):
        assert got[i] == (None if q is None else pytest.approx(q))
    assert all(got[i] >= p[i] for i in got if p[i] is not None)


def test_bh_small_table_and_stars(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.02), ("d", 0.5), ("e", None)],
                               "k string, p_value double")
    got = {r.k: r.p_adj for r in p_adjust_bh(df).collect()}
    assert got == {"a": pytest.approx(0.08 / 3), "b": pytest.approx(0.08 / 3),
                   "c": pytest.approx(0.08 / 3), "d": pytest.approx(0.5), "e": None}
    assert significant(p_adjust_bh(df)).count() == 3
    marks = [r[0] for r in spark.createDataFrame(
        [(0.00005,), (0.0005,), (0.005,), (0.05,), (0.06,), (None,)], "p double").select(stars("p")).collect()]
    assert marks == ["****", "***", "**", "*", "ns", None]


@pytest.mark.parametrize("buckets", BUCKETS)
def test_quantiles_and_boxes(frame, buckets):
    rows = panels()
    probs = {"q1": 0.25, "mid": 0.5, "high": 0.9}
    for r in quantiles_by(frame, ["k"], "y", probs, buckets).collect():
        v = [x[4] for x in rows if x[0] == r.k]
        assert [r[n] for n in probs] == pytest.approx(list(np.quantile(v, list(probs.values()))))
    for r in box_stats_by(frame, ["k"], "y", buckets).collect():
        v = np.array([x[4] for x in rows if x[0] == r.k])
        reach = 1.5 * (r.q3 - r.q1)
        inside = v[(v >= r.q1 - reach) & (v <= r.q3 + reach)]
        assert (r.whisker_low, r.whisker_high) == (inside.min(), inside.max())
        assert r.n_outliers == len(v) - len(inside)


def test_median_split(frame):
    rows = panels()
    middle = np.median([r[3] for r in rows])
    got = median_split(frame, "x").collect()
    assert all(r.above_median == (r.x > middle) for r in got)
    by = median_split(frame, "x", by=["k"]).collect()
    for k in ("hot", None):
        middle = np.median([r[3] for r in rows if r[0] == k])
        assert all(r.above_median == (r.x > middle) for r in by if r.k == k)


def test_welch_and_line(frame):
    rows = panels()
    r = welch_t_by(frame.filter("k = 'hot'"), [], "g", "y", ("a", "b")).first()
    a = np.array([v[4] for v in rows if v[0] == "hot" and v[2] == "a"])
    b = np.array([v[4] for v in rows if v[0] == "hot" and v[2] == "b"])
    s1, s2 = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
    assert r.statistic == pytest.approx((a.mean() - b.mean()) / math.sqrt(s1 + s2))
    assert r.dof == pytest.approx((s1 + s2) ** 2 / (s1 ** 2 / (len(a) - 1) + s2 ** 2 / (len(b) - 1)))
    for r in ols_by(frame, ["k"], "x", "y").collect():
        slope, start = np.polyfit([v[3] for v in rows if v[0] == r.k], [v[4] for v in rows if v[0] == r.k], 1)
        assert (r.slope, r.intercept) == pytest.approx((slope, start))


def test_slices(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3)], "c string, n int")
    got = {r.c: (r.share, r.stacked, r.position, r.label) for r in slice_positions(df, "c", "n").collect()}
    assert got == {"a": (0.25, 100.0, 87.5, "25.0%"), "b": (0.75, 75.0, 37.5, "75.0%")}


def survival_rows(seed=5, n=120):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n).round(2)
    time = np.ceil(rng.exponential(10 / np.exp(0.7 * x)))
    died = (rng.random(n) < 0.7).astype(int)
    g = np.where(rng.random(n) < 0.4, "a", np.where(rng.random(n) < 0.5, "b", "c"))
    return time, died, x, g


@pytest.mark.parametrize("buckets", BUCKETS)
def test_kaplan_meier_and_log_rank(spark, buckets):
    time, died, _, g = survival_rows()
    df = spark.createDataFrame(list(zip(time.tolist(), died.tolist(), g.tolist())),
                               "t double, d int, g string")
    curve = kaplan_meier(df, "t", "d", ["g"], buckets).collect()
    for level in "abc":
        want = brute.kaplan_meier(time[g == level], died[g == level])
        got = sorted((r for r in curve if r.g == level), key=lambda r: r.time)
        assert [(r.time, r.n_risk, r.n_event) for r in got] == [w[:3] for w in want]
        assert [r.survival for r in got] == pytest.approx([w[3] for w in want])
        assert all(x.survival >= y.survival for x, y in zip(got, got[1:]))
    r = log_rank(df, "t", "d", "g", buckets=buckets).first()
    assert r.statistic == pytest.approx(brute.log_rank(time, died, g, list("abc")))
    assert r.dof == 2
    two = log_rank(df.filter("g != 'c'"), "t", "d", "g", levels=["a", "b"]).first()
    keep = g != "c"
    assert two.statistic == pytest.approx(brute.log_rank(time[keep], died[keep], g[keep], ["a", "b"]))
    per = log_rank(df.withColumn("s", F.lit(None).cast("string")), "t", "d", "g", by=["s"]).first()
    assert per.statistic == pytest.approx(r.statistic)


def test_last_subject_dies(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 0), (2.0, 1), (3.0, 1)], "t double, d int")
    got = sorted(kaplan_meier(df, "t", "d").collect(), key=lambda r: r.time)
    assert [r.survival for r in got] == pytest.approx([0.75, 0.5, 0.0])
    assert got[-1].std_err is None


@pytest.mark.parametrize("spread", [False, True])
def test_cox(spark, monkeypatch, spread):
    from cohortry.operators import survival
    if spread:
        monkeypatch.setattr(survival, "DEATHS_PER_BLOCK", 3)
        monkeypatch.setattr(survival, "SPREAD_DEATHS", 0)
    time, died, x, _ = survival_rows()
    other = (x * 100 + 5000).round(0)
    df = spark.createDataFrame(
        list(zip(time.tolist(), died.tolist(), x.tolist(), other.tolist(), [1.0] * len(x))),
        "t double, d int, x double, z double, flat double")
    got = {r.covariate: r for r in cox_ph(df, "t", "d", ["x", "z", "flat"]).collect()}
    best = brute.maximum(lambda b: brute.efron(b, time, died, x), -3, 3)
    assert got["x"].coef == pytest.approx(best, abs=1e-6) and got["x"].converged
    assert got["x"].loglik == pytest.approx(brute.efron(best, time, died, x))
    h = 1e-4
    curve = (2 * brute.efron(best, time, died, x) - brute.efron(best + h, time, died, x)
             - brute.efron(best - h, time, died, x)) / h ** 2
    assert got["x"].std_err == pytest.approx(1 / math.sqrt(curve), rel=1e-4)
    assert got["z"].coef == pytest.approx(best / 100, abs=1e-6)
    assert got["flat"].coef is None and not got["flat"].converged


def test_random_intercept_against_dense_likelihood(spark):
    rng = np.random.default_rng(8)
    g = rng.integers(0, 25, 150)
    x = rng.integers(0, 2, 150).astype(float)
    y = 3 + 0.8 * x + rng.normal(size=25)[g] * 1.2 + rng.normal(size=150)
    df = spark.createDataFrame(list(zip(y.tolist(), x.tolist(), g.tolist())), "y double, x double, g long")
    got = {r.term: r for r in random_intercept(df, "y", "x", "g").collect()}
    best = brute.maximum(lambda v: brute.reml(v, y, x, g)[0], -5, 5)
    _, b, se, sigma2 = brute.reml(best, y, x, g)
    assert all(r.converged for r in got.values())
    assert got["intercept"].estimate == pytest.approx(b[0], abs=1e-5)
    assert got["x"].estimate == pytest.approx(b[1], abs=1e-5)
    assert (got["intercept"].std_err, got["x"].std_err) == pytest.approx(tuple(se), abs=1e-5)
    assert got["x"].sigma == pytest.approx(math.sqrt(sigma2), abs=1e-5)
    assert 20 < got["intercept"].dof < 40 and 100 < got["x"].dof < 149


def test_random_intercept_balanced_closed_form(spark):
    # Balanced one-way layout: the intercept's df is the number of groups less one.
    rng = np.random.default_rng(3)
    g = np.repeat(np.arange(10), 6)
    x = np.tile([0.0, 1.0, 0.0, 1.0, 0.0, 1.0], 10)
    y = rng.normal(size=10)[g] * 3 + x + rng.normal(size=60)
    df = spark.createDataFrame(list(zip(y.tolist(), x.tolist(), g.tolist())), "y double, x double, g long")
    r = {r.term: r for r in random_intercept(df, "y", "x", "g").collect()}["x"]
    inside = y - np.array([y[g == k].mean() for k in g])
    slope = inside @ (x - 0.5) / ((x - 0.5) @ (x - 0.5))
    rest = ((inside - slope * (x - 0.5)) ** 2).sum() / (60 - 10 - 1)
    assert r.estimate == pytest.approx(slope, abs=1e-6)
    assert r.sigma == pytest.approx(math.sqrt(rest), abs=1e-4)
    assert r.dof == pytest.approx(49, rel=1e-3)


def test_random_intercept_without_group_variance(spark):
    df = spark.createDataFrame([(float(i % 5), float(i % 2), i // 10) for i in range(100)],
                               "y double, x double, g long")
    r = random_intercept(df, "y", "x", "g").first()
    assert r.singular and r.converged and r.group_sd == 0.0


def test_permutation_keeps_labels_and_is_a_shuffle(spark):
    df = spark.createDataFrame([(i, "ABC"[i % 3], i % 7) for i in range(500)], "id long, lab string, u long")
    got = permute_label(df, "id", "lab", 5, carry=["id"]).collect()
    assert len(got) == 2500
    for rep in range(1, 6):
        mine = {r.id: r.lab for r in got if r.rep == rep}
        assert sorted(mine.values()) == sorted("ABC"[i % 3] for i in range(500))
    assert {r.id: r.lab for r in got if r.rep == 1} != {r.id: r.lab for r in got if r.rep == 2}
    again = permute_label(df.repartition(13), "id", "lab", 5, carry=["id"]).collect()
    assert sorted(again) == sorted(got)
    null = permutation_null(df.withColumn("cell", F.lit(1)), "id", "lab", ["cell"], "u", reps=9)
    assert {r.lab: r.null_median for r in null.collect()} == {"A": 7.0, "B": 7.0, "C": 7.0}


def test_keyed_permutations():
    for n in (1, 2, 3, 7, 50, 1000):
        for key in keyed.round_keys(5, 20):
            assert sorted(keyed.permuted(np.arange(n), n, key).tolist()) == list(range(n))
    # Every row visits every place about as often.
    keys = keyed.round_keys(9, 4000)
    visits = np.zeros((6, 6))
    for key in keys:
        visits[np.arange(6), keyed.permuted(np.arange(6), 6, key)] += 1
    assert np.abs(visits / 4000 - 1 / 6).max() < 0.03


def test_replicates_move_no_rows(spark):
    df = spark.range(3000).selectExpr("id", "CAST(id % 5 AS string) AS lab", "id % 11 AS u", "id % 3 AS cell")
    plan = permute_label(df, "id", "lab", 50, carry=["cell"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan and "Window" not in plan
    null = {(r.cell, r.lab): r.null_median for r in permutation_null(df, "id", "lab", ["cell"], "u", reps=130).collect()}
    shuffled = permute_label(df, "id", "lab", 130, carry=["cell", "u"]).groupBy("rep", "cell", "lab").agg(
        F.count_distinct("u").alias("n")).groupBy("cell", "lab").agg(F.median("n").alias("m"))
    assert null == {(r.cell, r.lab): r.m for r in shuffled.collect()} and len(null) == 15


def test_units_are_counted_where_they_lie(spark):
    df = spark.range(4000).selectExpr("id", "CAST(id % 5 AS string) AS lab", "IF(id % 4 >= 2, 1, IF(id % 2 = 0, NULL, id % 3)) AS cell",
                                      "IF(id % 4 < 2, id % 1999, -1) AS u")
    for rows, heavy in ((df.filter("u >= 0"), False), (df, True)):  # with all rows, one unit of one cell has half of them
        null = permutation_null(rows, "id", "lab", ["cell"], "u", reps=70)
        assert ("_w0" in null._jdf.queryExecution().analyzed().toString()) == heavy  # only its replicates move as bits
        got = {(r.cell, r.lab): r.null_median for r in null.collect()}
        shuffled = permute_label(rows, "id", "lab", 70, carry=["cell", "u"]).groupBy("rep", "cell", "lab").agg(
            F.count_distinct("u").alias("n")).groupBy("cell", "lab").agg(F.median("n").alias("m"))
        assert got == {(r.cell, r.lab): r.m for r in shuffled.collect()} and len(got) == 20


def test_permutation_of_odd_labels(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "a", None), (3, "a", "x")], "id long, lab string, u string")
    got = permute_label(df, "id", "lab", 4, carry=["u"]).collect()
    assert len(got) == 12 and sum(r.lab is None for r in got) == 4
    assert permute_label(df.limit(0), "id", "lab", 4).count() == 0
    assert permutation_null(df.limit(0), "id", "lab", [], "u", reps=4).count() == 0


def test_digests_of_many_texts():
    rng = np.random.default_rng(4)
    texts = [rng.bytes(n) for n in range(130)]
    leads = [b"", b"123|7", b"123|100|", b"y" * 55, b"z" * 56, b"w" * 200]
    first, second = digests(leads, texts)
    for i, lead in enumerate(leads):
        for k, text in enumerate(texts):
            assert int(first[i, k]) << 64 | int(second[i, k]) == int(hashlib.md5(lead + text).hexdigest(), 16)
    assert digests([b"a"], [])[0].shape == (1, 0)
    assert in_order(np.array([5, 2, 5, 1], np.uint64), np.array([9, 0, 3, 0], np.uint64)).tolist() == [3, 1, 2, 0]


@pytest.mark.parametrize("size", [None, 4000])
def test_ranked_labels(spark, monkeypatch, size):
    if size:  # some sixty slots, in many of which a replicate has no row
        monkeypatch.setattr(permute_module, "BYTES_PER_SLOT", size)
    rows = [(f"sample {i} é" if i else None, None if i % 7 == 0 else f"allele{i % 5}", "x" * (i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, lab string, `a.b` string").repartition(5)

    def ranks(rep):
        return sorted(rows, key=lambda r: hashlib.md5("|".join(["9", str(rep)] + [r[0]] * (r[0] is not None)).encode()).digest())
    named = [r[1] for r in ranks(0)]
    want = {(rep, r[0], r[2], lab) for rep in range(1, 13) for r, lab in zip(ranks(rep), named)}
    out = permute_label(df.withColumnRenamed("a.b", "c"), "id", "lab", 12, seed=9, carry=["id", "c"], ranked=True)
    assert out.columns == ["rep", "id", "c", "lab"] and out.schema["rep"].dataType.simpleString() == "int"
    got = [tuple(r) for r in out.collect()]
    assert len(got) == 3600 and set(got) == want
    assert permute_label(df, "id", "lab", 0, carry=["id"], ranked=True).count() == 0
    assert permute_label(df.limit(0), "id", "lab", 4, carry=["id"], ranked=True).columns == ["rep", "id", "lab"]


def test_ranked_labels_carry_times_of_any_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.range(40).selectExpr("id", "timestamp_seconds(id * 86400) AS ts", "CAST(id % 3 AS decimal(10, 2)) AS lab")
        got = permute_label(df, "id", "lab", 3, carry=["id", "ts"], ranked=True).collect()
        assert len(got) == 120 and {(r.id, r.ts) for r in got} == {(r.id, r.ts) for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_every_order_of_few_rows_is_as_likely(spark):
    df = spark.createDataFrame([(i, "ABCDE"[i]) for i in range(5)], "id long, lab string")
    orders = {}
    for r in permute_label(df, "id", "lab", 6000, carry=["id"], ranked=True).collect():
        orders.setdefault(r.rep, [None] * 5)[r.id] = r.lab
    seen = Counter(map(tuple, orders.values()))
    assert sum(seen.values()) == 6000
    assert sum((seen[o] - 50) ** 2 / 50 for o in itertools.permutations("ABCDE")) < 200  # 119 on average; 660 for the keyed networks


@pytest.mark.parametrize("buckets", BUCKETS)
def test_risk_table_and_median(spark, buckets):
    rows = [("a", t, e) for t, e in ((1, 1), (2, 0), (3, 1), (4, 1), (6, 0), (8, 1))] + [("b", 2, 0), ("b", 9, 0)]
    rows += [("c", t, 1) for t in (1, 2, 3, 4)]
    df = spark.createDataFrame([(k, float(t), e) for k, t, e in rows], "k string, t double, e int")
    table = {(r.k, r.time): r for r in risk_table(df, "t", "e", [0, 3, 3.5, 20], ["k"], buckets).collect()}
    assert len(table) == 12
    for (k, t), r in table.items():
        mine = [x for x in rows if x[0] == k]
        alive = 1.0
        for u in sorted({x[1] for x in mine if x[1] <= t}):
            alive *= 1 - sum(x[1] == u and x[2] for x in mine) / sum(x[1] >= u for x in mine)
        assert r.n_risk == sum(x[1] >= t for x in mine) and r.events_so_far == sum(x[1] <= t and x[2] for x in mine)
        assert r.survival == pytest.approx(alive)
    medians = {r.k: r for r in median_survival(df, "t", "e", ["k"], buckets).collect()}
    assert medians["a"].median == 4 and medians["b"].median is None and medians["c"].median == 2.5
    assert medians["c"].median_low == 1 and medians["a"].n == 6 and medians["a"].n_event == 4
    assert median_survival(df.limit(0), "t", "e").count() == 0 and risk_table(df.limit(0), "t", "e", [1.0]).count() == 0


def test_effects_of_balanced_groups(spark):
    rng = np.random.default_rng(6)
    rows = [(f"g{g}", float(x), float(1 + 0.5 * x + shift + rng.normal())) for g, shift in enumerate(rng.normal(0, 3, 8)) for x in range(5)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0)], "g string, x double, y double")
    fit = {r.term: r for r in random_intercept(df, "y", "x", "g").collect()}
    ratio = (fit["x"].group_sd / fit["x"].sigma) ** 2
    effects = {r.g: r.effect for r in random_effects(df, "y", "x", "g").collect()}
    residuals = []
    for g in effects:
        gaps = [y - fit["intercept"].estimate - fit["x"].estimate * x for k, x, y in rows if k == g]
        assert effects[g] == pytest.approx(ratio * sum(gaps) / (1 + ratio * 5), rel=1e-6)
        residuals += [(v - effects[g]) / fit["x"].sigma for v in gaps]
    row = residual_summary(df, "y", "x", "g").first()
    assert (row.n, row.n_groups) == (40, 8)
    assert [row.lowest, row.q1, row.median, row.q3, row.highest] == pytest.approx(np.quantile(residuals, [0, 0.25, 0.5, 0.75, 1]), abs=1e-6)
    x = np.array([[1.0, v] for _, v, _ in rows])
    same = np.array([[a[0] == b[0] for b in rows] for a in rows])
    v = fit["x"].sigma ** 2 * (np.eye(40) + ratio * same)
    inside = x.T @ np.linalg.inv(v) @ x
    beta = np.linalg.solve(inside, x.T @ np.linalg.inv(v) @ np.array([r[2] for r in rows]))
    rest = np.array([r[2] for r in rows]) - x @ beta
    want = 38 * math.log(2 * math.pi) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(inside)[1] + rest @ np.linalg.inv(v) @ rest
    cov = np.linalg.inv(inside)
    assert row.reml_criterion == pytest.approx(want, rel=1e-8)
    assert row.fixed_correlation == pytest.approx(cov[0, 1] / math.sqrt(cov[0, 0] * cov[1, 1]), rel=1e-6)
    assert residual_summary(df.limit(0), "y", "x", "g").count() == 0 and random_effects(df.limit(0), "y", "x", "g").count() == 0


def test_points_of_the_t_distribution():
    tail, dof = np.array([0.05, 0.05, 0.05, 0.05, 0.9, 1e-9]), np.array([1.0, 2.0, 10.0, 1e6, 3.0, 5.0])
    got = tails.student_points(tail, dof)
    assert got[:4] == pytest.approx([12.706204736432095, 4.302652729911275, 2.228138851964939, 1.959966], rel=1e-6)
    assert tails.student_tails(got, dof) == pytest.approx(tail, rel=1e-9)


def test_line_band(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=40)
    y = 2 * x + rng.normal(size=40)
    rows = [("a", float(a), float(b)) for a, b in zip(x, y)] + [("a", None, 1.0), ("two", 0.0, 1.0), ("two", 1.0, 3.0), ("flat", 1.0, 1.0), ("flat", 1.0, 2.0)]
    got = line_band(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y", points=5).orderBy("place").collect()
    slope, intercept = np.polyfit(x, y, 1)
    error = math.sqrt(((y - slope * x - intercept) ** 2).sum() / 38)
    for r, at in zip([r for r in got if r.k == "a"], np.linspace(x.min(), x.max(), 5), strict=True):
        half = 2.024394163911969 * error * math.sqrt(1 / 40 + (at - x.mean()) ** 2 / ((x - x.mean()) ** 2).sum())
        assert (r.x, r.fit, r.high - r.fit, r.fit - r.low) == pytest.approx((at, intercept + slope * at, half, half))
    assert [(r.fit, r.low) for r in got if r.k == "two"][0] == (1.0, None)
    assert all(r.fit is None and r.low is None for r in got if r.k == "flat")


def test_matrix_finds_its_columns(spark):
    cells = spark.createDataFrame([("e1", "A*01", 0.5), ("e2", "A*01", 0.25), ("e2", "new*allele", 1.0)], "event string, allele string, share double")
    wide = heat_matrix(cells, "share")
    assert wide.columns == ["event", "A*01", "new*allele"]
    assert sorted(map(tuple, wide.collect())) == [("e1", 0.5, 0.0), ("e2", 0.25, 1.0)]
    with pytest.raises(ValueError):
        wide_from_long(cells, ["event"], "allele", "share", most=1)


def test_concordance_broadcasts_no_cells(spark):
    df = spark.range(300).selectExpr("id % 17 AS t", "id % 2 AS e", "id * 0.5D AS x")
    plan = concordance(df, "t", "e", ["x"])._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("buckets", BUCKETS)
def test_concordance_against_all_pairs(spark, buckets):
    rng = np.random.default_rng(3)
    rows = [(float(rng.integers(1, 12)), int(rng.integers(2)), float(rng.integers(0, 6)), float(rng.normal())) for _ in range(70)]
    rows += [(5.0, 1, None, 0.1), (None, 1, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "t double, e int, x double, y double")
    got = {r.covariate: r for r in concordance(df, "t", "e", ["x", "y"], buckets).collect()}
    for name, k in (("x", 2), ("y", 3)):
        known = [r for r in rows if r[0] is not None and r[k] is not None]
        pairs = [(i, j, np.sign(a[k] - b[k])) for i, a in enumerate(known) for j, b in enumerate(known)
                 if a[1] == 1 and (a[0] < b[0] or (a[0] == b[0] and b[1] == 0))]
        signs = np.array([s for _, _, s in pairs])
        share = np.mean((signs + 1) / 2)
        good, n = np.zeros(len(known)), np.zeros(len(known))
        for i, j, s in pairs:
            for at in (i, j):
                good[at] += (s + 1) / 2
                n[at] += 1
        row = got[name]
        assert (row.n_concordant, row.n_discordant, row.n_tied) == ((signs > 0).sum(), (signs < 0).sum(), (signs == 0).sum())
        assert row.concordance == pytest.approx(share)
        assert row.std_err == pytest.approx(math.sqrt(((good - share * n) ** 2).sum()) / len(pairs))
    assert concordance(df.limit(0), "t", "e", ["x"]).count() == 0


def test_exact_nulls_against_all_arrangements():
    for m, n in ((1, 1), (2, 5), (4, 3), (5, 5)):
        ranks_ = [sum(c) - m * (m - 1) // 2 for c in itertools.combinations(range(m + n), m)]
        want = [np.mean(np.array(ranks_) <= u) for u in range(m * n + 1)]
        assert exact.rank_sum_null(m, n) == pytest.approx(want) and exact.rank_sum_null(n, m) == pytest.approx(want)
    for n in range(1, 9):
        sums = np.array([sum(c) for k in range(n + 1) for c in itertools.combinations(range(1, n + 1), k)])
        assert exact.signed_rank_null(n) == pytest.approx([np.mean(sums <= v) for v in range(n * (n + 1) // 2 + 1)])
    for n in range(2, 9):
        gaps = np.array([sum((i - r) ** 2 for i, r in enumerate(p)) for p in itertools.permutations(range(n))])
        for d in np.unique(gaps):
            rho = 1 - 6 * d / (n ** 3 - n)
            want = min(1, 2 * min(np.mean(gaps <= d), np.mean(gaps >= d)))
            assert exact.spearman_two_sided(rho, n) == pytest.approx(want)
    # The series is close to the count where both are known.
    for d in range(0, 240, 6):
        rho = 1 - d / 120
        near = 2 * (exact.spearman_series(d, 9, False) if d > 120 else exact.spearman_series(d + 2, 9, True))
        assert min(1, near) == pytest.approx(exact.spearman_two_sided(rho, 9), abs=6e-3)


def test_exact_tests_of_panels(spark):
    values = [("one", "a", v) for v in (1.0, 5.0, 9.0)] + [("one", "b", v) for v in (2.0, 3.0, 4.0, 8.0)]
    values += [("tied", "a", 1.0), ("tied", "b", 1.0), ("tied", "b", 2.0)]
    df = spark.createDataFrame(values, "k string, g string, v double")
    got = {r.k: r for r in rank_sum_by(df, ["k"], "g", "v", ("a", "b"), exact=True).collect()}
    assert got["one"].method == "rank-sum, exact" and got["one"].p_value == pytest.approx(2 * 14 / 35, abs=0.06)
    arrangements = [sum(c) for c in itertools.combinations(range(1, 8), 3)]
    observed = 1 + 5 + 7
    want = 2 * min(np.mean([a <= observed for a in arrangements]), np.mean([a >= observed for a in arrangements]))
    assert got["one"].p_value == pytest.approx(min(1, want)) and got["tied"].method == "rank-sum, normal"
    pairs = spark.createDataFrame([(i, g, v) for i in range(6) for g, v in (("a", i * 1.5), ("b", 3.0 + i * i / 7))], "i long, g string, v double")
    row = signed_rank_by(pairs, [], "i", "g", "v", ("a", "b"), exact=True).first()
    assert row.method == "signed-rank, exact" and 0 < row.p_value <= 1
    line = spark.createDataFrame([(float(i), float(i * i % 11)) for i in range(6)], "x double, y double")
    assert spearman_by(line, [], "x", "y", exact=True).first().method == "Spearman, exact"


def test_tails_reach_the_normal_limit():
    for d in (1e5, 1e6, 1e9, 1e12):
        for t in (0.0, 0.3, 2.0, 6.0):
            normal = math.erfc(t / math.sqrt(2))
            # First term of the expansion around the normal tail, and nothing beyond it at this size.
            want = normal + 2 * math.exp(-t * t / 2) / math.sqrt(2 * math.pi) * (t ** 3 + t) / (4 * d)
            assert tails.student_tails(np.array([t]), np.array([d]))[0] == pytest.approx(want, rel=max(1e-9, 300 / d ** 2 * 1e3))
        for z in (-1.0, 0.0, 1.0, 5.0):
            x = d + z * math.sqrt(2 * d)
            normal = 0.5 * math.erfc(z / math.sqrt(2))
            want = normal + math.exp(-z * z / 2) / math.sqrt(2 * math.pi) * (z * z - 1) * math.sqrt(8 / d) / 6
            assert tails.upper_gamma(np.array([d / 2]), np.array([x / 2]))[0] == pytest.approx(want, rel=max(1e-9, 3000 / d))


def test_both_forms_of_the_tails_agree(monkeypatch):
    t, d = np.array([0.1, 1.0, 3.0, 8.0]), np.full(4, 60_000.0)
    a, x = np.full(5, 60_000.0), 60_000.0 + np.array([-900.0, -200.0, 1.0, 300.0, 2000.0])
    far = tails.student_tails(t, d), tails.upper_gamma(a, x)
    monkeypatch.setattr(tails, "_FAR", 1e9)
    assert np.allclose(tails.student_tails(t, d), far[0], rtol=1e-8)
    assert np.allclose(tails.upper_gamma(a, x), far[1], rtol=1e-8)


def test_rank_tests_do_not_depend_on_the_unit(spark):
    rng = np.random.default_rng(9)
    values, groups = rng.permutation(60) + 1.0, rng.choice(["a", "b"], 60)
    found = set()
    for unit in (1.0, 1e-13, 1e13):
        df = spark.createDataFrame([(float(v * unit), str(g)) for v, g in zip(values, groups)], "v double, g string")
        found.add(rank_sum_by(df, [], "g", "v", ("a", "b")).first().statistic)
    assert len(found) == 1


def test_log_rank_of_many_levels(spark):
    rows = [(f"level{i % 51:02d}", float(i % 37 + 1), i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, time double, event int")
    got = log_rank(df, "time", "event", "g").first()
    assert got.dof == 50 and 0 <= got.p_value <= 1

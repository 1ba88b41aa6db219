"""Rounding of registered results: small probabilities keep their digits, on both engines."""

import pytest

from catalog.registry import tidy
from catalog.sqlkit import chi_tail, rp, t_tail
from cohortry.functions.tails import chi_square_tail, student_two_sided


def test_small_probabilities(spark):
    df = spark.createDataFrame([(1.23456789e-12, 2.0000004, None), (0.25, 1e-9, 0.0)], "p_value double, x double, p_adj double")
    assert [tuple(r) for r in tidy(df).collect()] == [(1.23457e-12, 2.0, None), (0.25, 0.0, 0.0)]


def test_tails_agree_far_out(spark):
    duckdb = pytest.importorskip("duckdb")
    chi = [(x, d) for d in (1.0, 2.0, 3.0, 24.0, 300.0) for x in (0.1, d, d + 15 * d ** 0.5, 60 + 2 * d, 500.0 + d)]
    t = [(v, d) for d in (1.0, 2.0, 7.0, 60.0, 1000.0, 49_000.0) for v in (0.2, 2.0, 3.4, 9.0, 25.0)]
    for rows, ours, theirs in ((chi, chi_square_tail, chi_tail), (t, student_two_sided, t_tail)):
        got = tidy(spark.createDataFrame(rows, "x double, d double").select("x", "d", ours("x", "d").alias("p_value"))).collect()
        values = ", ".join(f"({x!r}::DOUBLE, {d!r}::DOUBLE)" for x, d in rows)
        want = duckdb.sql(f"SELECT x, d, {rp('p')} FROM (SELECT *, {theirs('x', 'd')} AS p FROM (VALUES {values}) v(x, d))").fetchall()
        assert len(got) == len(want)
        for row, (x, d, p) in zip(sorted(map(tuple, got)), sorted(want), strict=True):
            assert row[0] == pytest.approx(x, abs=1e-5) and row[1] == d and row[2] == pytest.approx(p, rel=2e-5, abs=1e-300), (x, d)
            assert row[2] > 0 or p < 1e-300

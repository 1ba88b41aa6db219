"""A few registered queries against their SQL twins on the smallest data, and the
same answer under different numbers of shuffle partitions."""

import hashlib
import os
from collections import Counter

import pytest

import __spark_entry__ as entry_point

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
SAMPLE = ["d4_recurrent_events", "d11_patient_feature", "d23_gene_allele_association", "d34_feature_level_paired",
          "d37_loh_by_locus", "d42_within_tumour", "d54_log_rank_by_neoantigens_os", "t6_kruskal", "t12_cox",
          "t17_permute_label", "d51_regulator_correlation"]


def text(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(f"{r[i]:.6f}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def test_names_agree():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert len(entry_point.queries()) > 200


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, duck, name):
    sql = entry_point.oracle_sql().get(name)
    if sql is None:
        pytest.skip("no SQL twin")
    df = entry_point.queries()[name](spark, DATA)
    cur = duck.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert text(df.collect(), df.columns) == text(cur.fetchall(), names)


@pytest.mark.parametrize("name", ["t6_kruskal", "d23_gene_allele_association", "t17_permute_label"])
def test_partition_count_does_not_matter(spark, name):
    seen = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "7", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = entry_point.queries()[name](spark, DATA)
            seen.append(text(df.collect(), df.columns))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]


def test_ranges_give_the_plain_answer(spark, monkeypatch):
    """Forces the many-range plan on the registered queries."""
    from cohortry.operators import running
    plain = {}
    for name in ("t4_spearman", "t6_kruskal", "t7_signed_rank", "t13_kaplan_meier", "t14_log_rank", "t19_box_statistics", "t12_cox"):
        df = entry_point.queries()[name](spark, DATA)
        plain[name] = text(df.collect(), df.columns)
    monkeypatch.setattr(running, "ROWS_PER_RANGE", 40)
    for name, want in plain.items():
        df = entry_point.queries()[name](spark, DATA)
        assert text(df.collect(), df.columns) == want, name


def test_each_replicate_ranks_the_rows_anew(spark):
    from catalog.statistics import shuffle_rows
    rows = shuffle_rows(spark, DATA).select("row_id", "gene", "allele").collect()

    def ranks(rep):
        return sorted(rows, key=lambda r: hashlib.md5(f"123|{rep}|{r.row_id}".encode()).digest())
    labels = ranks(0)
    want = Counter((rep, r.gene, of.allele) for rep in range(1, 101) for r, of in zip(ranks(rep), labels))
    got = {(r.rep, r.gene, r.allele): r.n for r in entry_point.queries()["t17_permute_label"](spark, DATA).collect()}
    assert got == want and sum(got.values()) == 100 * len(rows)


def test_entry(spark):
    assert entry_point.entry(spark).columns


def test_lines_do_not_move_for_the_suppliers(spark):
    """Each small table is joined by its own size, also in the plan that no finished stage has changed."""
    from catalog.cohort import observations
    plan = observations(spark, DATA, "event", "combine")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") == 3 and "SortMergeJoin" not in plan

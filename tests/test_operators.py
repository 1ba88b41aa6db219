import pytest
from pyspark.sql import functions as F

from cohortry.functions import nullrules as nr
from cohortry.operators import grouped, joins, reshape
from cohortry.plans import association, ingest, labels, outcome, profiles
from cohortry.sources import schemas, tables


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=str)


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(
        [("a", 1, 1.0), ("a", None, 2.0), ("a", 1, None), ("b", None, 3.0), (None, 2, 4.0), (None, 2, 5.0)],
        "k string, x int, v double")


def test_null_rules(small):
    got = {r.k: r for r in small.groupBy("k").agg(
        nr.n_distinct("x").alias("n"), nr.n_distinct("x", False).alias("known"),
        nr.strict_mean("v").alias("strict")).collect()}
    assert [(got[k].n, got[k].known) for k in ("a", "b", None)] == [(2, 1), (1, 0), (1, 1)]
    assert (got["a"].strict, got["b"].strict, got[None].strict) == (None, 3.0, 4.5)
    assert small.filter("k = 'none'").agg(nr.n_distinct("x").alias("n")).first().n == 0
    text = small.select(nr.paste0("k", F.lit("-"), "x").alias("p"), nr.str_c("k", "x").alias("s"),
                        nr.in_set("x", [1]).alias("i"), nr.in_set("x", [1, None]).alias("j"),
                        nr.matches("k", "^a").alias("m"), nr.divide("v", F.lit(0)).alias("z"),
                        nr.log10_positive(F.lit(0.0)).alias("l"), nr.as_number("k").alias("c"))
    got = text.collect()
    assert [r.p for r in got] == ["a-1", "a-NA", "a-1", "b-NA", "NA-2", "NA-2"]
    assert [r.s for r in got] == ["a1", None, "a1", None, None, None]
    assert [r.i for r in got] == [True, False, True, False, False, False]
    assert [r.j for r in got] == [True, True, True, True, False, False]
    assert [r.m for r in got] == [True, True, True, False, False, False]
    assert all(r.z is None and r.l is None and r.c is None for r in got)


def test_natural_join_matches_missing_keys(spark, small):
    other = spark.createDataFrame([("a", 1, "one"), (None, 2, "two"), ("b", None, "three")], "k string, x int, w string")
    got = rows(joins.natural_join(small, other), "k", "x", "w")
    assert got == sorted([("a", 1, "one"), ("a", 1, "one"), ("b", None, "three"), (None, 2, "two"), (None, 2, "two")], key=str)
    left = joins.natural_join(small, other, "left")
    assert left.count() == 6 and left.filter("w is null").count() == 1
    with pytest.raises(ValueError):
        joins.natural_join(small, spark.createDataFrame([(1,)], "other int"))
    keys = other.select("k").filter("k is null or k = 'b'")
    assert joins.keep_matching(small, keys).count() == 3
    assert joins.drop_matching(small, keys).count() == 3
    doubled = keys.unionAll(keys)
    assert joins.keep_matching(small, doubled).count() == 3
    assert rows(joins.flag_matching(small, doubled, "hit").groupBy("hit").count()) == [(False, 3), (True, 3)]


def test_group_statistics(small):
    got = grouped.add_group_stats(small, (["k"], {"n": nr.n_distinct("x")}), ([], {"all_": F.count("*")}))
    assert rows(got, "k", "n", "all_") == sorted(
        [("a", 2, 6)] * 3 + [("b", 1, 6)] + [(None, 1, 6)] * 2, key=str)
    kept = grouped.keep_groups(small, ["k"], nr.n_distinct("x"), lambda n: n > 1)
    assert kept.columns == small.columns and kept.count() == 3
    assert grouped.keep_groups(small, ["k"], F.count("*"), lambda n: n == 2, keep="n").collect()[0].n == 2


def test_shares(spark):
    df = spark.createDataFrame([("p", "u", 1, True), ("p", "u", 2, False), ("p", "w", 1, True), ("p", "w", 1, True),
                                ("q", "u", 3, False)], "a string, b string, item int, good boolean")
    same = grouped.conditional_share(df, ["a"], "item", F.col("good"))
    assert rows(same) == [("p", 1, 2, 0.5)]
    finer = grouped.conditional_share(df, ["a", "b"], "item", F.col("good"), share_of=["a"])
    assert rows(finer) == [("p", "u", 1, 2, 0.5), ("p", "w", 1, 2, 0.5)]
    assert grouped.conditional_share(df, ["a"], "item", F.col("good"), row_weighted=True).count() == 3
    assert rows(grouped.parent_share(df, ["a", "b"], ["a"], "item")) == [
        ("p", "u", 2, 2, 1.0), ("p", "w", 1, 2, 0.5), ("q", "u", 1, 1, 1.0)]
    assert rows(grouped.parent_share(df, ["a"], [], "item"), "a", "n_all") == [("p", 3), ("q", 3)]


def test_profile_counts_as_separate_aggregates_do(spark):
    df = spark.createDataFrame([("s", 1, 1.0, "x"), ("s", 1, 3.0, "y"), ("s", 2, 2.0, "x"), ("s", None, 2.0, "x"),
                                ("t", 1, None, "y")], "u string, item int, v double, c string")
    got = {r.u: r for r in profiles.profile(
        df, ["u"], "item", {"all_": None, "x": "c = 'x'"}, {"mean": ("v", None), "mx": ("v", "c = 'x'")},
        {"share": ("x", "all_")}).collect()}
    assert (got["s"].all_, got["s"].x, got["s"].mean, got["s"].share) == (3, 3, 2.0, 1.0)
    assert got["s"].mx == pytest.approx(5 / 3)
    assert (got["t"].all_, got["t"].x, got["t"].mean, got["t"].mx, got["t"].share) == (1, None, None, None, None)
    zero = profiles.profile(df, ["u"], "item", {"all_": None, "x": "c = 'x'"}, shares={"share": ("x", "all_")},
                            zero=("x", "share"))
    assert rows(zero.filter("u = 't'")) == [("t", 1, 0, 0.0)]


def test_reshape(spark):
    df = spark.createDataFrame([("r1", "a", 1.0), ("r1", "b", 2.0), ("r2", "a", 3.0)], "r string, n string, v double")
    wide = reshape.wide_from_long(df, ["r"], "n", "v", fill=0.0)
    assert rows(wide) == [("r1", 1.0, 2.0), ("r2", 3.0, 0.0)]
    assert rows(reshape.long_from_wide(wide, ["r"], reshape.column_range(wide, "a", "b"), "n", "v").filter("v > 0")) == rows(df)
    assert rows(reshape.transpose(wide, "r", "n", ["r1", "r2"])) == [("a", 1.0, 3.0), ("b", 2.0, 0.0)]


def test_homozygous_and_purity(spark):
    hla = spark.createDataFrame([("p", "A", "allele_1", "x"), ("p", "A", "allele_2", "-"), ("q", "A", "allele_1", "y"),
                                 ("q", "A", "allele_2", "Not typed")], "patient string, locus string, slot string, allele string")
    full = ingest.fill_homozygous(hla)
    assert rows(full, "patient", "slot", "allele") == [
        ("p", "allele_1", "x"), ("p", "allele_2", "x"), ("q", "allele_1", "y"), ("q", "allele_2", "Not typed")]
    assert ingest.typed_alleles(full).count() == 3
    assert rows(ingest.common_alleles(full, 1), "allele") == [("x",), ("x",)]
    calls = spark.createDataFrame([("a.b", "OK", "0.5", "0.9"), ("c", "RERUN", "0.5", "0.9"), ("d", "RERUN_NOVEL", "NA", "0.7"),
                                   ("e", "FAIL", "0.1", "0.2"), ("f", "OK", "NA", "0.1")],
                                  "sample string, call string, purity_first string, purity_adjusted string")
    assert rows(ingest.resolve_purity(calls)) == [("a-b", 0.5), ("c", 0.9), ("d", 0.7), ("e", None), ("f", None)]


def test_type_resolution(spark):
    df = spark.createDataFrame([(1, "A>G"), (1, "A>G"), (1, "T>C"), (2, "C>T"), (3, "T>C"), (3, "A>G")], "event int, mut_type string")
    assert rows(ingest.type_conflicts(df)) == [(1, "A>G", 2, 2), (1, "T>C", 1, 2), (3, "A>G", 1, 2), (3, "T>C", 1, 2)]
    assert rows(ingest.resolve_types(df).distinct()) == [(1, "A>G"), (2, "C>T"), (3, "A>G")]
    wrong = spark.createDataFrame([(1, "T>C")], "event int, mut_type string")
    assert ingest.resolve_types(df, wrong).count() == 5


def test_labels(spark):
    df = spark.createDataFrame([("p", "e1", "tumour"), ("p", "e1", "normal"), ("p", "e2", "tumour"), ("p", "e3", "normal"),
                                ("q", "e1", "tumour")], "patient string, combine string, sample_type string")
    assert rows(labels.patient_features(df)) == [("p", "e1", "shared"), ("p", "e2", "tumour-specific"), ("p", "e3", "normal-specific")]
    events = labels.event_features(df.withColumnRenamed("combine", "event"))
    assert rows(events) == [("e1", "shared"), ("e2", "tumour-specific"), ("e3", None)]
    codes = spark.createDataFrame([(c, "e", "al") for c in ("SU_N1", "SU_T2", "SU_LN1", "BR_T1", "BP1", "MR1", None)],
                                  "sample_code string, event string, allele string")
    got = [(r.sample_type, r.status) for r in labels.sample_labels(codes).collect()]
    assert got == [("normal", None), ("tumour", "Primary"), ("tumour", "Primary"), ("tumour", "Meta_recur"),
                   ("tumour", "Meta_recur"), ("tumour", "Meta_recur"), ("tumour", None)]
    names = spark.createDataFrame([("hla_a_03_01",), ("hla_a_03",), (None,)], "a string")
    assert [r[0] for r in names.select(labels.canonical_allele("a")).collect()] == ["HLA-A*03:01", None, None]


def test_lost_copy(spark):
    df = spark.createDataFrame([("s", "hla_a_01_01", "hla_a_02_01", 0.2, 1.5, True), ("t", "hla_a_01_01", "hla_a_02_01", None, 1.0, True)],
                               "sample string, allele1 string, allele2 string, cn1 double, cn2 double, loh boolean")
    assert rows(labels.lost_alleles(df), "sample", "allele", "lost") == [("s", "HLA-A*01:01", True), ("s", "HLA-A*02:01", False)]


def test_majority_and_mixed_class(spark):
    df = spark.createDataFrame(
        [("p", "t1", "hot", "tumour"), ("p", "t2", "hot", "tumour"), ("p", "t3", "cold", "tumour"), ("p", None, None, "normal"),
         ("q", "t4", "hot", "tumour"), ("q", "t5", "cold", "tumour"), ("q", None, None, "normal"), ("r", "t6", "hot", "tumour")],
        "patient string, tumour string, immune string, sample_type string")
    assert rows(labels.majority_class(df)) == [("p", "hot")]
    mixed = labels.mixed_class(df).select("patient", "immune_patient").distinct()
    assert rows(mixed) == [("p", "mixed"), ("q", "mixed"), ("r", "hot")]


def test_bubbles_weighting(spark):
    df = spark.createDataFrame([("e", "a", "A>G", "L", "t1"), ("e", "a", "A>G", "L", "t1"), ("e", "b", "A>G", "L", "t2")],
                               "event string, allele string, mut_type string, locus string, tumour string")
    assert rows(association.bubbles(df), "allele", "proportion") == [("a", 0.5), ("b", 0.5)]
    assert rows(association.bubbles(df, row_weighted=True), "allele", "proportion") == [("a", pytest.approx(1 / 3)), ("b", pytest.approx(1 / 3))]


def test_readers(spark, tmp_path):
    path = str(tmp_path / "hla.csv")
    with open(path, "w") as f:
        f.write("patient,hla_type,allele,hla_allele_type\nP1,A,allele_1,HLA-A*01:01\nP1,A,allele_2,NA\n")
    got = tables.read_input(spark, path, "hla", sep=",")
    assert got.columns == ["patient", "locus", "slot", "allele"]
    assert rows(got, "slot", "allele") == [("allele_1", "HLA-A*01:01"), ("allele_2", None)]
    out = str(tmp_path / "t")
    tables.save_checkpoint(got, out, ["patient"])
    assert rows(tables.load_checkpoint(spark, out), "slot", "patient") == [("allele_1", "P1"), ("allele_2", "P1")]
    tables.write_text(got, str(tmp_path / "c"), "\t")
    back = tables.read_text(spark, str(tmp_path / "c"), "patient string, locus string, slot string, allele string", "\t")
    assert rows(back) == rows(got)
    for name in schemas.SCHEMAS:
        assert schemas.canonical(spark.createDataFrame([], schemas.schema_of(name)), name).columns
    flags = schemas.canonical(spark.createDataFrame([("TRUE", "NA")], "PASS_present string, PASS_homo_nt string"), "events")
    assert rows(flags) == [(True, None)]


def test_names_that_are_missing_or_not_listed(spark):
    df = spark.createDataFrame([("r1", "a", 1.0), ("r1", None, 2.0), ("r2", "z", 3.0)], "r string, n string, v double")
    assert reshape.wide_from_long(df, ["r"], "n", "v").columns == ["r", "NA", "a", "z"]
    assert reshape.wide_from_long(df, ["r"], "n", "v", ["a"], drop_unlisted=True).count() == 2
    with pytest.raises(Exception, match="unlisted name"):
        reshape.wide_from_long(df, ["r"], "n", "v", ["a", None]).collect()


def test_missing_input_column(spark, tmp_path):
    spark.createDataFrame([("P1", "A")], "patient string, hla_type string").write.parquet(f"{tmp_path}/hla")
    with pytest.raises(ValueError, match="lacks declared columns"):
        tables.read_input(spark, f"{tmp_path}/hla", "hla")


def test_significant_class_rows(spark):
    """Alleles of event 1 go with the class; those of event 2 are even."""
    rows = [(1, "A", f"a{hot}", f"s{hot}{i}", "hot" if hot else "cold", f"t{i}") for i in range(40) for hot in (0, 1)]
    rows += [(2, "A", f"a{i % 2}", f"s{hot}{i}", "hot" if hot else "cold", f"t{i}") for i in range(40) for hot in (0, 1)]
    rows += [(1, "A", "a0", "s9", None, "t9")]
    df = spark.createDataFrame(rows, "event int, locus string, allele string, sample string, immune string, tumour string")
    got = association.significant_class_rows(df)
    assert {r.event for r in got.select("event").distinct().collect()} == {1}
    assert got.count() == 80
    often = association.frequent_pairs(df.limit(0).unionByName(df.filter("tumour in ('t0', 't1', 't2')")), 3)
    assert often.count() == 0
    assert association.frequent_pairs(df, 3).select("event", "allele").distinct().count() == 4


def test_assembled_rows_are_distinct_before_the_joins(spark):
    events = spark.createDataFrame([(1, "s", "p"), (1, "s", "p"), (2, "r", None), (2, "r", None)], "event long, sample string, patient string")
    hla = spark.createDataFrame([("p", "a"), ("p", "a"), ("p", "b"), (None, "c")], "patient string, allele string")
    purity = spark.createDataFrame([("s", 0.5), ("s", 0.5), ("s", None)], "sample string, purity double")
    out = ingest.assemble(events, hla, purity)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [(1, "s", "p", a, q) for a in "ab" for q in (0.5, None)] + [(2, "r", None, "c", None)], key=str)
    assert not out._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")


def test_burden_is_counted_once(spark):
    df = spark.createDataFrame([("p", 1, "1_a", True), ("p", 1, "1_b", None), ("p", 2, "2_a", True), ("q", 1, "1_a", False), ("q", 1, "1_a", None)],
                               "patient string, event long, combine string, neo boolean")
    follow = spark.createDataFrame([("p", 5.0), ("q", 6.0)], "patient string, os_time double")
    table = outcome.burden_table(df, follow, "neo")
    assert rows(table, "patient", "total_event", "neo_event", "neo_share", "total_combine", "neo_burden", "os_time") == [
        ("p", 2, 2, 1.0, 3, 2, 5.0), ("q", 1, 0, 0.0, 1, 0, 6.0)]
    for made in (table, outcome.present_burden(df, follow, ["patient"], "event", "neo"), outcome.scored_burden(df, follow, ["patient"], "neo")):
        assert "Aggregate" not in made._jdf.queryExecution().sparkPlan().toString()  # a split reads the counts, not the rows


def test_rows_move_once_for_the_counts_of_a_unit(spark):
    df = spark.createDataFrame([("p", 1, "1_a", True), ("p", 1, "1_a", False), ("p", 1, None, True), ("p", 2, None, None), ("p", 2, "2_a", None),
                                ("p", None, None, None), (None, 1, "1_a", None)], "patient string, event long, combine string, neo boolean")
    made = outcome._events_and_pairs(df, ["patient"], "neo")
    # Once by unit and event, then their sums by unit.
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    assert sorted(map(tuple, made.collect()), key=str) == [("p", 3, 1, 3, 2), (None, 1, 0, 1, 0)]


def test_present_burden_leaves_out_empty_units(spark):
    df = spark.createDataFrame([("r1", 1, 10, True), ("r1", 1, 11, False), ("r2", 1, 10, False), ("r3", 2, 10, True), ("r4", 3, 10, True)],
                               "sample string, patient int, event int, neo boolean")
    follow = spark.createDataFrame([(1, 5.0), (2, 6.0)], "patient int, os_time double")
    unit = ["sample", "patient"]
    assert rows(outcome.present_burden(df, follow, unit, "event", "neo"), "sample", "x", "os_time") == [("r1", 1, 5.0), ("r3", 1, 6.0)]
    assert rows(outcome.present_burden(df, follow, unit, "event", "neo", share=True), "sample", "x") == [("r1", 0.5), ("r3", 1.0)]

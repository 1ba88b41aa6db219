"""Scans, shaping, filters, joins, aggregates, windows, sorting, sets and scalars."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.cohort import (ALLELES, CELL_TYPES, CELLS, EXPRESSION, LOH, OBS,
                            alleles, cell_scores, expression, lines, loh, observations, samples,
                            table, with_ctes)
from catalog.registry import query
from catalog.sqlkit import r6
from cohortry.functions import nullrules as nr
from cohortry.operators import grouped, joins, reshape, selection
from cohortry.session import new_folder, staged
from cohortry.sources import tables

BASE = with_ctes(OBS)


def scratch(spark, name: str) -> str:
    """A new folder on the session's shared checkpoint storage."""
    return f"{new_folder(spark, name)}/rows"


# --- sources and sinks ---------------------------------------------------------------

@query("s1_columnar_scan", f"""SELECT l_returnflag AS flag, count(*) AS n, {r6('avg(l_discount)')} AS level
FROM lineitem GROUP BY 1""")
def _(spark, d):
    return tables.read_columnar(spark, f"{d}/lineitem.parquet").groupBy(
        F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"), F.avg("l_discount").alias("level"))


CSV_SCHEMA = "sample bigint, patient bigint, immune string, purity double"
CSV_SQL = BASE + f"""SELECT immune, count(*) AS n, count(purity) AS n_purity, {r6('avg(purity)')} AS purity
FROM samples GROUP BY 1"""


def _csv_round_trip(spark, d, sep):
    path = scratch(spark, "text")
    tables.write_text(samples(spark, d).select("sample", "patient", "immune", "purity").fillna(
        "NA", ["immune"]), path, sep)
    back = tables.read_text(spark, path, CSV_SCHEMA, sep)
    return back.groupBy("immune").agg(F.count("*").alias("n"), F.count("purity").alias("n_purity"),
                                      F.avg("purity").alias("purity"))


@query("s2_csv_scan", CSV_SQL)
def _(spark, d):
    return _csv_round_trip(spark, d, ",")


@query("s3_delimited_scan", CSV_SQL)
def _(spark, d):
    return _csv_round_trip(spark, d, "\t")


@query("s4_table_load", BASE + f"SELECT call, count(*) AS n, {r6('avg(p)')} AS purity FROM ("
       "SELECT status AS call, purity AS p FROM samples) GROUP BY 1")
def _(spark, d):
    path = scratch(spark, "calls")
    purity = F.col("purity").cast("string")
    samples(spark, d).select(F.col("sample").cast("string").alias("Sample"), F.col("status").alias("ManualCall"),
                             purity.alias("ASCAT.purity"), purity.alias("Adjust_ASCAT.purity"), "immune").write.parquet(path)
    return tables.read_input(spark, path, "purity").groupBy("call").agg(
        F.count("*").alias("n"), F.avg(nr.as_number("purity_first")).alias("purity"))


CHECKPOINT_SQL = BASE + """SELECT locus, count(*) AS n, count(DISTINCT event) AS n_event, count(tumour) AS n_tumour
FROM obs GROUP BY 1"""


def _saved(spark, d, partition_by=()):
    path = scratch(spark, "table")
    tables.save_checkpoint(observations(spark, d, "locus", "event", "tumour"), path, partition_by)
    return tables.load_checkpoint(spark, path).groupBy("locus").agg(
        F.count("*").alias("n"), F.count_distinct("event").alias("n_event"),
        F.count("tumour").alias("n_tumour"))


@query("s5_checkpoint_read", CHECKPOINT_SQL)
def _(spark, d):
    return _saved(spark, d)


@query("s6_checkpoint_write", CHECKPOINT_SQL)
def _(spark, d):
    return _saved(spark, d, ["locus"])


@query("s7_csv_sink", BASE + """SELECT event, locus, count(DISTINCT tumour) AS n FROM obs
WHERE tumour IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    path = scratch(spark, "result")
    counts = (observations(spark, d, "event", "locus", "tumour").filter("tumour is not null")
              .groupBy("event", "locus").agg(F.count_distinct("tumour").alias("n")))
    tables.write_text(counts, path)
    return tables.read_text(spark, path, "event bigint, locus string, n bigint")


@query("s8_literal_table", BASE + f"""SELECT class, count(*) AS n, {r6('avg(level)')} AS level FROM obs
JOIN (VALUES ('A', 'one'), ('B', 'one'), ('C', 'one'), ('DRB1', 'two')) t(locus, class) USING (locus) GROUP BY 1""")
def _(spark, d):
    classes = tables.literal_table(spark, [("A", "one"), ("B", "one"), ("C", "one"), ("DRB1", "two")],
                                   "locus string, class string")
    return observations(spark, d, "locus", "level").join(classes, "locus").groupBy("class").agg(
        F.count("*").alias("n"), F.avg("level").alias("level"))


# --- projections and shape -----------------------------------------------------------

@query("p1_select", "SELECT DISTINCT l_orderkey AS sample, l_returnflag AS mut FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("sample"), F.col("l_returnflag").alias("mut")).distinct()


@query("p2_column_subset", f"SELECT p_brand, p_size, {r6('p_retailprice')} AS p_retailprice FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_brand", "p_size", "p_retailprice")


@query("p3_select_by_name", "SELECT n_name AS value, count(*) AS n FROM nation JOIN supplier "
       "ON n_nationkey = s_nationkey GROUP BY 1")
def _(spark, d):
    name = "n_name"
    both = table(spark, d, "nation").join(table(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"))
    return both.select(F.col(name).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


@query("p4_row_wise_column", BASE + f"""SELECT sample, event, var_count, {r6('level * coverage')} AS signal,
{r6('el / nullif(el_wt, 0)')} AS ratio FROM lines""")
def _(spark, d):
    return lines(spark, d).select(
        "sample", "event", "var_count", (F.col("level") * F.col("coverage")).alias("signal"),
        nr.divide("el", "el_wt").alias("ratio"))


@query("p5_drop_column", "SELECT r_name FROM region")
def _(spark, d):
    return table(spark, d, "region").drop("r_regionkey")


@query("p6_rename", "SELECT n_nationkey AS id, n_name AS allele, n_regionkey AS locus FROM nation")
def _(spark, d):
    return table(spark, d, "nation").withColumnsRenamed(
        {"n_nationkey": "id", "n_name": "allele", "n_regionkey": "locus"})


EXPR = with_ctes(EXPRESSION)


@query("p7_row_names", EXPR + f"""SELECT patient AS row_name, {r6('max(expression)')} AS top FROM expression
GROUP BY 1""")
def _(spark, d):
    return expression(spark, d).withColumnRenamed("patient", "row_name").groupBy("row_name").agg(
        F.max("expression").alias("top"))


@query("p8_transpose", with_ctes(CELLS) + "SELECT cell_type, " + ", ".join(
    f"{r6(f'max(CASE WHEN bin = {b} THEN s END)')} AS bin_{b}" for b in range(10)) +
    " FROM (SELECT cell_type, patient % 10 AS bin, avg(score) AS s FROM cells GROUP BY ALL) GROUP BY 1")
def _(spark, d):
    binned = cell_scores(spark, d).groupBy((F.col("patient") % 10).alias("bin"), "cell_type").agg(
        F.avg("score").alias("s"))
    wide = reshape.wide_from_long(
        binned.withColumn("bin", F.concat(F.lit("bin_"), F.col("bin").cast("string"))),
        ["bin"], "cell_type", "s")
    return reshape.transpose(wide, "bin", "cell_type")


@query("p9_long_to_wide", BASE + "SELECT event, " + ", ".join(
    f"coalesce(max(CASE WHEN allele = '{a}' THEN n END), 0) AS \"{a}\"" for a in ALLELES) +
    " FROM (SELECT event, allele, count(DISTINCT sample) AS n FROM obs GROUP BY ALL) GROUP BY 1")
def _(spark, d):
    cells = observations(spark, d, "event", "allele", "sample").groupBy("event", "allele").agg(
        F.count_distinct("sample").alias("n"))
    return reshape.wide_from_long(cells, ["event"], "allele", "n", fill=0)


@query("p10_wide_to_long", BASE + f"""SELECT sample, metric, {r6('value')} AS value FROM (
SELECT sample, avg(level) AS level, avg(CAST(coverage AS DOUBLE)) AS coverage, avg(ba) AS ba FROM lines GROUP BY 1)
UNPIVOT INCLUDE NULLS (value FOR metric IN (level, coverage, ba))""")
def _(spark, d):
    wide = lines(spark, d).groupBy("sample").agg(
        F.avg("level").alias("level"), F.avg("coverage").alias("coverage"), F.avg("ba").alias("ba"))
    return reshape.long_from_wide(wide, ["sample"], reshape.column_range(wide, "level", "ba"), "metric", "value")


@query("p11_preview_corner", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 5")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").orderBy("o_orderkey").limit(5)


# --- filters -------------------------------------------------------------------------

def _count_kept(df, *by):
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct("sample").alias("n_sample"))


def _kept_sql(where, by="mut_type", src="lines"):
    return BASE + f"SELECT {by}, count(*) AS n, count(DISTINCT sample) AS n_sample FROM {src} WHERE {where} GROUP BY {by}"


FILTERS = {
    "f1_conjunction": "effect = 'nonsynonymous' AND coverage > 30 AND el < 0.1",
    "f2_literal_equality": "effect <> 'synonymous' AND mut_type <> 'T>C'",
    "f3_threshold": "coverage > 60",
    "f4_column_comparison": "el_wt > el",
    "f5_disjunction": "mut_type = 'A>G' OR mut_type = 'C>T'",
    "f6_not_missing": "el IS NOT NULL",
    "f9_negated_compound": "NOT (mut_type = 'A>G' AND effect = 'synonymous')",
}
for _name, _where in FILTERS.items():
    query(_name, _kept_sql(_where))(
        lambda spark, d, where=_where: _count_kept(lines(spark, d).filter(where), "mut_type"))


@query("f7_membership", _kept_sql("event IN (SELECT event FROM lines WHERE el < 0.05 AND coverage > 90)"))
def _(spark, d):
    rows = lines(spark, d)
    wanted = rows.filter((F.col("el") < 0.05) & (F.col("coverage") > 90)).select("event").distinct()
    return _count_kept(joins.keep_matching(rows, wanted), "mut_type")


@query("f8_negative_membership", _kept_sql("event NOT IN (SELECT event FROM lines WHERE el < 0.05 AND coverage > 90)"))
def _(spark, d):
    rows = lines(spark, d)
    dropped = rows.filter((F.col("el") < 0.05) & (F.col("coverage") > 90)).select("event").distinct()
    return _count_kept(joins.drop_matching(rows, dropped), "mut_type")


@query("f10_regex", "SELECT p_brand, count(*) AS n FROM part WHERE regexp_matches(p_name, 'red|blue') "
       "AND contains(p_name, 'ring') GROUP BY 1")
def _(spark, d):
    return table(spark, d, "part").filter(
        nr.matches("p_name", "red|blue") & nr.contains_text("p_name", "ring")).groupBy("p_brand").agg(
        F.count("*").alias("n"))


@query("f11_prefix", BASE + "SELECT sample_code, count(*) AS n FROM samples WHERE starts_with(sample_code, 'SU_T') "
       "OR starts_with(sample_code, 'B') GROUP BY 1")
def _(spark, d):
    code = F.col("sample_code")
    return samples(spark, d).filter(code.startswith("SU_T") | code.startswith("B")).groupBy("sample_code").agg(
        F.count("*").alias("n"))


@query("f12_group_filter", BASE + """SELECT event, sample, tumour, nb_tumour FROM obs JOIN (
SELECT event, count(DISTINCT tumour) + max(CASE WHEN tumour IS NULL THEN 1 ELSE 0 END) AS nb_tumour FROM obs
GROUP BY 1 HAVING nb_tumour > 25) USING (event)""")
def _(spark, d):
    rows = observations(spark, d, "event", "sample", "tumour")
    return grouped.keep_groups(rows, ["event"], nr.n_distinct("tumour"), lambda n: n > 25, keep="nb_tumour")


@query("f13_having", BASE + "SELECT event, count(DISTINCT mut_type) AS n_types, count(*) AS n FROM lines GROUP BY 1 "
       "HAVING count(DISTINCT mut_type) > 2 AND count(*) > 30")
def _(spark, d):
    return grouped.having(lines(spark, d), ["event"], {"n_types": nr.n_distinct("mut_type"), "n": F.count("*")},
                          (F.col("n_types") > 2) & (F.col("n") > 30))


# --- joins ---------------------------------------------------------------------------

@query("j1_natural_inner", BASE + f"""SELECT l.immune, l.locus, n, {r6('mean')} AS mean FROM
(SELECT immune, locus, count(*) AS n FROM obs GROUP BY ALL) l JOIN
(SELECT immune, locus, avg(level) AS mean FROM obs WHERE coverage > 30 GROUP BY ALL) r
ON l.immune IS NOT DISTINCT FROM r.immune AND l.locus = r.locus""")
def _(spark, d):
    obs = observations(spark, d, "immune", "locus", "level", "coverage")
    left = obs.groupBy("immune", "locus").agg(F.count("*").alias("n"))
    right = obs.filter("coverage > 30").groupBy("immune", "locus").agg(F.avg("level").alias("mean"))
    return joins.natural_join(left, right)


@query("j2_natural_left", BASE + f"""SELECT l.tumour, n, {r6('mean')} AS mean FROM
(SELECT tumour, count(*) AS n FROM obs GROUP BY ALL) l LEFT JOIN
(SELECT tumour, avg(level) AS mean FROM obs WHERE coverage > 90 GROUP BY ALL) r
ON l.tumour IS NOT DISTINCT FROM r.tumour""")
def _(spark, d):
    obs = observations(spark, d, "tumour", "level", "coverage")
    left = obs.groupBy("tumour").agg(F.count("*").alias("n"))
    right = obs.filter("coverage > 90").groupBy("tumour").agg(F.avg("level").alias("mean"))
    return joins.natural_join(left, right, "left")


@query("j3_merge", with_ctes(OBS, CELLS) + f"""SELECT patient, cell_type, n, {r6('score')} AS score FROM
(SELECT patient, count(DISTINCT event) AS n FROM obs GROUP BY 1) JOIN cells USING (patient)""")
def _(spark, d):
    burden = observations(spark, d, "patient", "event").groupBy("patient").agg(F.count_distinct("event").alias("n"))
    return joins.natural_join(burden, cell_scores(spark, d))


@query("j4_merge_row_names", with_ctes(OBS, EXPRESSION) + f"""SELECT patient, n, {r6('expression')} AS expression FROM
(SELECT patient, count(DISTINCT event) AS n FROM obs WHERE mut_type = 'A>G' GROUP BY 1)
JOIN (SELECT patient, expression FROM expression WHERE gene = 'Brand#1') USING (patient)""")
def _(spark, d):
    counts = observations(spark, d, "patient", "event", "mut_type").filter("mut_type = 'A>G'").groupBy(
        "patient").agg(F.count_distinct("event").alias("n"))
    return joins.merge_on(counts, expression(spark, d).filter("gene = 'Brand#1'").drop("gene"), "patient")


@query("j5_semi_join", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey IN "
       "(SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def _(spark, d):
    keys = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.keep_matching(table(spark, d, "customer"), keys).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("j6_anti_join", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN "
       "(SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority < '3')")
def _(spark, d):
    keys = table(spark, d, "orders").filter("o_orderstatus = 'P' and o_orderpriority < '3'").select(
        F.col("o_custkey").alias("c_custkey"))
    return joins.drop_matching(table(spark, d, "customer"), keys).select("c_custkey", "c_mktsegment")


@query("j7_join_back_statistic", BASE + f"""SELECT event, sample, var_count, {r6('level - mean_level')} AS gap FROM lines
JOIN (SELECT event, avg(level) AS mean_level FROM lines GROUP BY 1) USING (event)""")
def _(spark, d):
    rows = grouped.add_group_stats(lines(spark, d), (["event"], {"mean_level": F.avg("level")}))
    return rows.select("event", "sample", "var_count", (F.col("level") - F.col("mean_level")).alias("gap"))


@query("j7_heavy_join_back", BASE + f"""SELECT event, sample, mut_type, var_count, {r6('level - mean_level')} AS gap FROM lines
JOIN (SELECT mut_type, avg(level) AS mean_level FROM lines GROUP BY 1) USING (mut_type)""")
def _(spark, d):
    rows = lines(spark, d)
    means = rows.groupBy("mut_type").agg(F.avg("level").alias("mean_level"))
    return joins.heavy_join(rows, means).select("event", "sample", "mut_type", "var_count", (F.col("level") - F.col("mean_level")).alias("gap"))


@query("j2_heavy_left", BASE + f"""SELECT o.tumour, o.sample, o.event, o.var_count, n, {r6('mean')} AS mean FROM obs o LEFT JOIN
(SELECT tumour, count(*) AS n, avg(level) AS mean FROM obs WHERE coverage > 90 GROUP BY ALL) r
ON o.tumour IS NOT DISTINCT FROM r.tumour""")
def _(spark, d):
    rows = observations(spark, d, "tumour", "sample", "event", "var_count")
    deep = observations(spark, d, "tumour", "level", "coverage").filter("coverage > 90")
    right = deep.groupBy("tumour").agg(F.count("*").alias("n"), F.avg("level").alias("mean"))
    return joins.heavy_join(rows, right, "left")


@query("j8_join_distinct", BASE + "SELECT DISTINCT patient, immune, mut_type FROM lines JOIN samples USING (sample)")
def _(spark, d):
    return joins.natural_join(lines(spark, d).select("sample", "mut_type"),
                              samples(spark, d).select("sample", "patient", "immune")).select(
        "patient", "immune", "mut_type").distinct()


# --- aggregates ----------------------------------------------------------------------

def _obs_query(name, sql, columns, fn):
    query(name, BASE + sql)(lambda spark, d: fn(observations(spark, d, *columns)))


_obs_query("a1_distinct_count", """SELECT allele, count(DISTINCT tumour) + max(CASE WHEN tumour IS NULL THEN 1 ELSE 0 END)
AS n_tumour, count(DISTINCT immune) AS n_class FROM obs GROUP BY 1""", ["allele", "tumour", "immune"],
           lambda o: o.groupBy("allele").agg(nr.n_distinct("tumour").alias("n_tumour"),
                                             nr.n_distinct("immune", False).alias("n_class")))
_obs_query("a2_distinct_scalar", "SELECT count(DISTINCT event) AS n_event, count(DISTINCT patient) AS n_patient FROM obs",
           ["event", "patient"], lambda o: o.agg(F.count_distinct("event").alias("n_event"),
                                                 F.count_distinct("patient").alias("n_patient")))
_obs_query("a3_count", "SELECT mut_type, count(*) AS n FROM obs GROUP BY 1", ["mut_type"],
           lambda o: o.groupBy("mut_type").agg(F.count("*").alias("n")))
_obs_query("a4_one_way_table", "SELECT allele, count(*) AS n FROM obs GROUP BY 1 HAVING count(*) > 20", ["allele"],
           lambda o: o.groupBy("allele").agg(F.count("*").alias("n")).filter("n > 20"))
_obs_query("a5_two_way_table", "SELECT sample_type, immune, count(*) AS n FROM obs GROUP BY ALL",
           ["sample_type", "immune"], lambda o: o.groupBy("sample_type", "immune").agg(F.count("*").alias("n")))
_obs_query("a6_strict_mean", f"""SELECT sample, {r6('avg(level)')} AS level,
{r6('CASE WHEN count(*) = count(el) THEN avg(el) END')} AS el FROM obs GROUP BY 1""", ["sample", "level", "el"],
           lambda o: o.groupBy("sample").agg(nr.strict_mean("level").alias("level"), nr.strict_mean("el").alias("el")))
_obs_query("a7_median", f"SELECT locus, count(el) AS n, {r6('median(el)')} AS median FROM obs GROUP BY 1", ["locus", "el"],
           lambda o: selection.selected_quantiles(o, ["locus"], "el", {"median": 0.5}))
_obs_query("a8_sum", f"""SELECT mut_type, {r6('sum(level)')} AS total, {r6('sum(level) / (SELECT sum(level) FROM obs)')}
AS share FROM obs GROUP BY 1""", ["mut_type", "level"],
           lambda o: grouped.add_group_stats(o.groupBy("mut_type").agg(F.sum("level").alias("total")),
                                             ([], {"_all": F.sum("total")})).select(
               "mut_type", "total", nr.divide("total", "_all").alias("share")))
_obs_query("a9_max", f"SELECT gene, {r6('max(ba)')} AS top, max(coverage) AS deepest FROM obs GROUP BY 1",
           ["gene", "ba", "coverage"],
           lambda o: o.groupBy("gene").agg(F.max("ba").alias("top"), F.max("coverage").alias("deepest")))
_obs_query("a10_any", "SELECT event, bool_or(in_normal) AS in_normal FROM obs GROUP BY 1", ["event", "in_normal"],
           lambda o: o.groupBy("event").agg(grouped.any_true("in_normal").alias("in_normal")))
_obs_query("a11_conditional_pick", f"""SELECT event, sample, var_count, {r6('first_level')} AS first_level FROM obs JOIN (
SELECT sample, max(CASE WHEN var_count = 1 THEN level END) AS first_level FROM obs GROUP BY 1) USING (sample)""",
           ["event", "sample", "var_count", "level"],
           lambda o: grouped.pick_where(o, ["sample"], "level", F.col("var_count") == 1, "first_level").drop("level"))
_obs_query("a12_distinct", "SELECT DISTINCT patient, tumour FROM obs", ["patient", "tumour"], lambda o: o.distinct())
_obs_query("a13_several_at_once", f"""SELECT sample, count(DISTINCT event) AS n_event, {r6('avg(level)')} AS level,
max(coverage) AS deepest FROM obs GROUP BY 1""", ["sample", "event", "level", "coverage"],
           lambda o: o.groupBy("sample").agg(F.count_distinct("event").alias("n_event"), F.avg("level").alias("level"),
                                             F.max("coverage").alias("deepest")))


def neo():
    return (F.col("effect") == "nonsynonymous") & (F.col("el") < 0.1)


_obs_query("a14_conditional_share", f"""SELECT sample, n_item, n_all, {r6('n_item / CAST(n_all AS DOUBLE)')} AS share FROM (
SELECT sample, count(DISTINCT CASE WHEN effect = 'nonsynonymous' AND el < 0.1 THEN event END) AS n_item,
count(DISTINCT event) AS n_all FROM obs GROUP BY 1) WHERE n_item > 0""", ["sample", "event", "effect", "el"],
           lambda o: grouped.conditional_share(o, ["sample"], "event", neo()))
_obs_query("a14_finer_numerator", f"""SELECT patient, mut_type, n_item, n_all, {r6('n_item / CAST(n_all AS DOUBLE)')} AS share
FROM (SELECT patient, mut_type, count(DISTINCT event) AS n_item FROM obs WHERE effect = 'nonsynonymous' AND el < 0.1
GROUP BY ALL) JOIN (SELECT patient, count(DISTINCT event) AS n_all FROM obs GROUP BY 1) USING (patient)""",
           ["patient", "mut_type", "event", "effect", "el"],
           lambda o: grouped.conditional_share(o, ["patient", "mut_type"], "event", neo(), share_of=["patient"]))
_obs_query("a14_row_weighted", f"""SELECT sample, n_item, n_all, {r6('n_item / CAST(n_all AS DOUBLE)')} AS share FROM (
SELECT sample, count(DISTINCT CASE WHEN effect = 'nonsynonymous' AND el < 0.1 THEN event END) AS n_item,
count(DISTINCT event) AS n_all FROM obs GROUP BY 1) JOIN obs USING (sample)
WHERE effect = 'nonsynonymous' AND el < 0.1""", ["sample", "event", "effect", "el"],
           lambda o: grouped.conditional_share(o, ["sample"], "event", neo(), row_weighted=True))
_obs_query("a15_parent_share", f"""SELECT event, allele, n_item, n_all, {r6('n_item / CAST(n_all AS DOUBLE)')} AS share FROM
(SELECT event, allele, count(DISTINCT sample) AS n_item FROM obs GROUP BY ALL) JOIN
(SELECT allele, count(DISTINCT sample) AS n_all FROM obs GROUP BY ALL) USING (allele)""", ["event", "allele", "sample"],
           lambda o: grouped.parent_share(o, ["event", "allele"], ["allele"], "sample"))
_obs_query("a16_constant_share", f"""SELECT event, count(DISTINCT tumour) AS n_item, {r6('count(DISTINCT tumour) / 354.0')}
AS share FROM obs WHERE tumour IS NOT NULL GROUP BY 1""", ["event", "tumour"],
           lambda o: grouped.parent_share(o.filter("tumour is not null"), ["event"], [], "tumour", denominator=354))
_obs_query("a17_two_stage_mean", f"""SELECT patient, sample_type, {r6('avg(n)')} AS n_event, {r6('avg(m)')} AS level FROM (
SELECT patient, sample, sample_type, count(DISTINCT event) AS n, avg(level) AS m FROM obs GROUP BY ALL) GROUP BY ALL""",
           ["patient", "sample", "sample_type", "event", "level"],
           lambda o: grouped.two_stage_mean(o, ["patient", "sample", "sample_type"], ["patient", "sample_type"],
                                            {"n_event": F.count_distinct("event"), "level": F.avg("level")}))


# --- statistics on rows --------------------------------------------------------------

_obs_query("w1_group_statistic", f"""SELECT sample, event, var_count, {r6('total')} AS total, {r6('mean')} AS mean, seen
FROM obs JOIN (SELECT event, sum(level) AS total, avg(level) AS mean, bool_or(in_normal) AS seen FROM obs GROUP BY 1)
USING (event)""", ["sample", "event", "var_count", "level", "in_normal"],
           lambda o: grouped.add_group_stats(o, (["event"], {
               "total": F.sum("level"), "mean": F.avg("level"), "seen": F.bool_or("in_normal")})).drop(
               "level", "in_normal"))
_obs_query("w2_group_distinct", """SELECT sample, event, var_count, nb FROM obs JOIN (SELECT event,
count(DISTINCT tumour) + max(CASE WHEN tumour IS NULL THEN 1 ELSE 0 END) AS nb FROM obs GROUP BY 1) USING (event)""",
           ["sample", "event", "var_count", "tumour"],
           lambda o: grouped.add_group_stats(o, (["event"], {"nb": nr.n_distinct("tumour")})).drop("tumour"))
_obs_query("w3_sequential_groups", """SELECT DISTINCT event, allele, locus, total, nb FROM obs
JOIN (SELECT allele, count(DISTINCT sample) AS total FROM obs GROUP BY 1) USING (allele)
JOIN (SELECT event, allele, locus, count(DISTINCT sample) AS nb FROM obs GROUP BY ALL) USING (event, allele, locus)""",
           ["event", "allele", "locus", "sample"], lambda o: _coarse_and_fine(o))


def _coarse_and_fine(o):
    counts = staged(grouped.distinct_levels(o, {"allele": ["allele"], "cell": ["event", "allele", "locus"]}, ["sample"]))
    fine = counts.filter("level = 'cell'").select("event", "allele", "locus", F.col("n_sample").alias("nb"))
    coarse = counts.filter("level = 'allele'").select("allele", F.col("n_sample").alias("total"))
    return joins.natural_join(fine, coarse, on=["allele"])


GENE_SIZES = "SELECT gene, count(*) AS n FROM obs GROUP BY 1"


def _gene_sizes(o):
    return o.groupBy("gene").agg(F.count("*").alias("n"))


_obs_query("w4_lead", f"SELECT gene, n, lead(n) OVER (ORDER BY n, gene) AS next_n FROM ({GENE_SIZES})", ["gene"],
           lambda o: _gene_sizes(o).withColumn("next_n", F.lead("n", 1).over(Window.orderBy("n", "gene"))))
_obs_query("w5_reverse_cumulative", f"""SELECT gene, n, CAST(sum(n) OVER (ORDER BY n DESC, gene DESC ROWS BETWEEN
UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS rest FROM ({GENE_SIZES})""", ["gene"],
           lambda o: _gene_sizes(o).withColumn("rest", F.sum("n").over(
               Window.orderBy("n", "gene").rowsBetween(0, Window.unboundedFollowing))))
_obs_query("w6_share_of_total", f"""SELECT gene, n, {r6('n / CAST(sum(n) OVER () AS DOUBLE)')} AS share
FROM ({GENE_SIZES})""", ["gene"],
           lambda o: grouped.add_group_stats(_gene_sizes(o), ([], {"_all": F.sum("n")})).select(
               "gene", "n", nr.divide("n", "_all").alias("share")))


# --- sorting and sets ----------------------------------------------------------------

_obs_query("o1_arrange", "SELECT patient, count(*) AS n FROM obs GROUP BY 1 ORDER BY 1", ["patient"],
           lambda o: o.groupBy("patient").agg(F.count("*").alias("n")).orderBy("patient"))
_obs_query("o2_arrange_desc", f"SELECT gene, {r6('avg(level)')} AS level FROM obs GROUP BY 1 ORDER BY 2 DESC",
           ["gene", "level"], lambda o: o.groupBy("gene").agg(F.avg("level").alias("level")).orderBy(F.desc("level")))
_obs_query("o3_sorted_table", "SELECT allele, count(*) AS n FROM obs GROUP BY 1 ORDER BY n DESC", ["allele"],
           lambda o: o.groupBy("allele").agg(F.count("*").alias("n")).orderBy(F.desc("n")))
_obs_query("o4_order_by_value", """SELECT histology, n, row_number() OVER (ORDER BY n, histology) AS place FROM (
SELECT histology, count(DISTINCT event) AS n FROM obs GROUP BY 1)""", ["histology", "event"],
           lambda o: o.groupBy("histology").agg(F.count_distinct("event").alias("n")).withColumn(
               "place", F.row_number().over(Window.orderBy("n", "histology")).cast("long")))


@query("u1_append_rows", BASE + """SELECT source, mut_type, count(*) AS n FROM (
SELECT 'hot' AS source, mut_type FROM obs WHERE immune = 'hot' UNION ALL
SELECT 'cold', mut_type FROM obs WHERE immune = 'cold') GROUP BY ALL""")
def _(spark, d):
    obs = observations(spark, d, "immune", "mut_type")
    parts = [obs.filter(F.col("immune") == c).select(F.lit(c).alias("source"), "mut_type") for c in ("hot", "cold")]
    return parts[0].unionByName(parts[1]).groupBy("source", "mut_type").agg(F.count("*").alias("n"))


def _sets(spark, d, test):
    obs = observations(spark, d, "event", "tumour", "immune", "coverage").filter("coverage > 80")
    return obs.filter(test).select("event")


@query("u2_intersect", BASE + """SELECT event FROM obs WHERE coverage > 80 AND immune = 'hot' INTERSECT
SELECT event FROM obs WHERE coverage > 80 AND immune = 'cold'""")
def _(spark, d):
    return joins.common_values(_sets(spark, d, "immune = 'hot'"), _sets(spark, d, "immune = 'cold'"))


@query("u3_setdiff", BASE + """SELECT event FROM obs WHERE coverage > 80 AND immune = 'cold' EXCEPT
SELECT event FROM obs WHERE coverage > 80 AND immune = 'hot'""")
def _(spark, d):
    return joins.only_first(_sets(spark, d, "immune = 'cold'"), _sets(spark, d, "immune = 'hot'"))


# --- scalars -------------------------------------------------------------------------

@query("x1_paste0", BASE + """SELECT sample, coalesce(CAST(patient AS VARCHAR), 'NA') || '_' || coalesce(tumour, 'NA')
AS label FROM samples""")
def _(spark, d):
    return samples(spark, d).select("sample", nr.paste0("patient", F.lit("_"), "tumour").alias("label"))


@query("x2_str_c", BASE + "SELECT sample, CAST(patient AS VARCHAR) || '_' || tumour AS label FROM samples")
def _(spark, d):
    return samples(spark, d).select("sample", nr.str_c("patient", F.lit("_"), "tumour").alias("label"))


@query("x3_replace_pattern", "SELECT s_suppkey, regexp_replace(s_name, '#0+', '-', 'g') AS name FROM supplier")
def _(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.regexp_replace("s_name", "#0+", "-").alias("name"))


@query("x4_substring", BASE + "SELECT s_suppkey, substr(allele, 1, 8) AS short, substr(allele, 1, 5) AS family FROM alleles")
def _(spark, d):
    return alleles(spark, d).select("s_suppkey", F.substring("allele", 1, 8).alias("short"),
                                    F.substring("allele", 1, 5).alias("family"))


@query("x5_canonical_allele", with_ctes(OBS, LOH) + """SELECT DISTINCT allele1, upper(p[1]) || '-' || upper(p[2]) || '*' ||
upper(p[3]) || ':' || upper(p[4]) AS allele FROM (SELECT allele1, string_split(allele1, '_') AS p FROM loh_raw)""")
def _(spark, d):
    from cohortry.plans.labels import canonical_allele
    return loh(spark, d).select("allele1", canonical_allele("allele1").alias("allele")).distinct()


@query("x6_if_else", BASE + """SELECT sample, CASE WHEN purity > 0.5 THEN 'high' WHEN purity IS NULL THEN NULL ELSE 'low' END
AS grade FROM samples""")
def _(spark, d):
    return samples(spark, d).select("sample", F.when(F.col("purity").isNull(), None).when(
        F.col("purity") > 0.5, "high").otherwise("low").alias("grade"))


@query("x7_case_when", BASE + """SELECT sample, CASE WHEN starts_with(sample_code, 'SU_T') THEN 'primary'
WHEN starts_with(sample_code, 'SU_LN') THEN 'node' WHEN starts_with(sample_code, 'B') THEN 'other' END AS kind FROM samples""")
def _(spark, d):
    code = F.col("sample_code")
    return samples(spark, d).select("sample", F.when(code.startswith("SU_T"), "primary").when(
        code.startswith("SU_LN"), "node").when(code.startswith("B"), "other").alias("kind"))


@query("x8_replace_missing", BASE + f"SELECT sample, coalesce(immune, 'none') AS immune, {r6('coalesce(purity, 0)')} "
       "AS purity FROM samples")
def _(spark, d):
    return samples(spark, d).select("sample", "immune", "purity").fillna("none", ["immune"]).fillna(0.0, ["purity"])


@query("x9_casts", f"SELECT event_id, {r6('TRY_CAST(regexp_extract(props, ' + chr(39) + '[0-9]+' + chr(39) + ') AS DOUBLE)')} "
       "AS k, CAST(user_id AS VARCHAR) AS who, TRY_CAST(event_type AS DOUBLE) AS nothing FROM events")
def _(spark, d):
    return table(spark, d, "events").select(
        "event_id", nr.as_number(F.regexp_extract("props", "[0-9]+", 0)).alias("k"),
        F.col("user_id").cast("string").alias("who"), nr.as_number("event_type").alias("nothing"))


@query("x10_logarithms", BASE + f"""SELECT sample, event, var_count, {r6('CASE WHEN level > 0 THEN log10(level) END')} AS l10,
{r6('CASE WHEN ba > 0 THEN log2(ba) END')} AS l2 FROM lines""")
def _(spark, d):
    return lines(spark, d).select("sample", "event", "var_count", nr.log10_positive("level").alias("l10"),
                                  nr.log2_positive("ba").alias("l2"))


@query("x11_round_percent", BASE + """SELECT mut_type, round(100.0 * n / total, 1) AS pct,
printf('%.1f%%', CAST(100.0 * n / total AS DOUBLE)) AS label FROM (
SELECT mut_type, count(*) AS n, sum(count(*)) OVER () AS total FROM lines GROUP BY 1)""")
def _(spark, d):
    sizes = lines(spark, d).groupBy("mut_type").agg(F.count("*").alias("n"))
    share = F.col("n") * 100.0 / F.col("_all")
    return grouped.add_group_stats(sizes, ([], {"_all": F.sum("n")})).select(
        "mut_type", F.round(share, 1).alias("pct"), F.format_string("%.1f%%", share).alias("label"))


@query("x12_arithmetic", BASE + f"""SELECT sample, event, var_count, {r6('level / nullif(el, 0)')} AS ratio,
coverage - var_count AS rest, {r6('level * 100 + 1')} AS scaled FROM lines""")
def _(spark, d):
    return lines(spark, d).select(
        "sample", "event", "var_count", nr.divide("level", "el").alias("ratio"),
        (F.col("coverage") - F.col("var_count")).alias("rest"), (F.col("level") * 100 + 1).alias("scaled"))



"""From input tables to labelled observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.cohort import CLASS_ONE, LOH, OBS, lines, loh, observations, samples, table, with_ctes
from catalog.registry import query
from catalog.sqlkit import r6
from cohortry.functions.nullrules import n_distinct
from cohortry.operators.grouped import add_group_stats, distinct_levels
from cohortry.operators.joins import natural_join
from cohortry.plans import ingest, labels
from cohortry.session import new_folder
from cohortry.sources import layout

BASE = with_ctes(OBS)

FEATURES = """
features AS (
  SELECT patient, combine, CASE WHEN bool_or(sample_type = 'tumour') AND bool_or(sample_type = 'normal') THEN 'shared'
    WHEN bool_or(sample_type = 'tumour') THEN 'tumour-specific' ELSE 'normal-specific' END AS feature
  FROM obs WHERE patient IN (SELECT patient FROM obs GROUP BY 1 HAVING count(DISTINCT sample_type) > 1)
  GROUP BY ALL)"""

EVENT_FEATURES = """
event_features AS (
  SELECT event, CASE WHEN bool_or(sample_type = 'tumour') AND bool_or(sample_type = 'normal') THEN 'shared'
    WHEN bool_or(sample_type = 'tumour') THEN 'tumour-specific' END AS feature2 FROM obs GROUP BY 1)"""

DE = """
de AS (SELECT p_brand AS gene, (avg(p_size) - 25) / 10 AS log_fc, (count(*) % 7) / 50.0::DOUBLE AS adj_p FROM part GROUP BY 1),
de_flag AS (SELECT gene, NOT (log_fc < -0.1 AND adj_p < 0.05) AS de_ok FROM de)"""


def de_results(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("gene")).agg(
        ((F.avg("p_size") - 25) / 10).alias("log_fc"), ((F.count("*") % 7) / F.lit(50.0)).alias("adj_p"))


# --- D1 - D10: clean and assemble ----------------------------------------------------

def purity_calls(spark, d):
    o = table(spark, d, "orders")
    rank = F.substring("o_orderpriority", 1, 1)
    call = (F.when(rank.isin("1", "2"), "OK").when(rank == "3", "RERUN").when(rank == "5", "RERUN_NOVEL")
            .otherwise("FAIL"))
    return o.select(
        F.concat(F.lit("S."), F.col("o_custkey").cast("string"), F.lit("."),
                 F.col("o_orderkey").cast("string")).alias("sample"),
        call.alias("call"),
        F.when(F.col("o_orderstatus") == "O", "NA").otherwise(
            F.round(F.col("o_totalprice") / 600000, 4).cast("string")).alias("purity_first"),
        F.round(F.col("o_totalprice") / 1200000, 4).cast("string").alias("purity_adjusted"))


@query("d1_resolve_purity", f"""SELECT 'S-' || o_custkey || '-' || o_orderkey AS sample, {r6('''CASE
WHEN o_orderpriority[1] IN ('1', '2') THEN CASE WHEN o_orderstatus <> 'O' THEN round(o_totalprice / 600000, 4) END
WHEN o_orderpriority[1] IN ('3', '5') THEN round(o_totalprice / 1200000, 4) END''')} AS purity FROM orders""")
def _(spark, d):
    return ingest.resolve_purity(purity_calls(spark, d))


@query("d2_attach_samples", BASE + "SELECT DISTINCT sample, event, mut_type, patient, tumour, immune FROM obs")
def _(spark, d):
    index = samples(spark, d).select("sample", "patient", "tumour")
    immune = samples(spark, d).select("sample", "immune").filter("immune is not null")
    return ingest.attach_samples(lines(spark, d).select("sample", "event", "mut_type"), index, immune)


def by_sample(spark, df, write=layout.write_index):
    """``df`` laid out by sample in a new folder of the shared storage."""
    return write(df, f"{new_folder(spark, 'keyed')}/table", ["sample"], int(spark.conf.get("spark.sql.shuffle.partitions")))


@query("d2_attach_samples_keyed", BASE + "SELECT DISTINCT sample, event, mut_type, patient, tumour, immune FROM obs")
def _(spark, d):
    index = by_sample(spark, samples(spark, d).select("sample", "patient", "tumour"))
    immune = by_sample(spark, samples(spark, d).select("sample", "immune").filter("immune is not null"))
    events = by_sample(spark, lines(spark, d).select("sample", "event", "mut_type"), layout.write_keyed)
    return ingest.attach_samples_keyed(events, index, immune).rows()


@query("s6_keyed_layout", BASE + """SELECT sample, count(*) AS n, count(DISTINCT event) AS n_event, count(DISTINCT mut_type) AS n_type
FROM lines GROUP BY 1""")
def _(spark, d):
    events = by_sample(spark, lines(spark, d).select("sample", "event", "mut_type"), layout.write_keyed)
    return events.group(n=F.count("*"), n_event=F.count_distinct("event"), n_type=F.count_distinct("mut_type"))


RAW = """raw AS (SELECT *, el > 0.02 AS pass_present, coverage >= 10 AS pass_homo,
CASE WHEN var_count = 7 THEN '*' ELSE mut_type END AS raw_type FROM obs)"""


def raw_events(spark, d, *more):
    obs = observations(spark, d, "event", "sample", "patient", "coverage", "el", "mut_type", "var_count", *more)
    return obs.select(
        "event", "sample", "patient", "coverage", "var_count", *more, (F.col("el") > 0.02).alias("pass_present"),
        (F.col("coverage") >= 10).alias("pass_homo"),
        F.when(F.col("var_count") == 7, "*").otherwise(F.col("mut_type")).alias("mut_type"))


GOOD = "coalesce(pass_present AND pass_homo AND raw_type <> '*', false)"


@query("d3_quality_filter", with_ctes(OBS, RAW) + f"SELECT event, sample, var_count, coverage, raw_type AS mut_type FROM raw WHERE {GOOD}")
def _(spark, d):
    return ingest.quality_filter(raw_events(spark, d)).select("event", "sample", "var_count", "coverage", "mut_type")


@query("d3_quality_scatter", with_ctes(OBS, RAW) + f"""SELECT var_count, coverage, pass_present, {GOOD} AS kept, count(*) AS n,
count(DISTINCT patient) AS n_patient FROM raw GROUP BY ALL""")
def _(spark, d):
    return raw_events(spark, d).groupBy(
        "var_count", "coverage", "pass_present", ingest.passes_quality().alias("kept")).agg(
        F.count("*").alias("n"), F.count_distinct("patient").alias("n_patient"))


@query("d4_recurrent_events", with_ctes(OBS, RAW) + f"""SELECT DISTINCT event, tumour, raw_type AS mut_type, nb_tumour FROM raw JOIN (
SELECT event, count(DISTINCT tumour) + max(CASE WHEN tumour IS NULL THEN 1 ELSE 0 END) AS nb_tumour FROM raw WHERE {GOOD}
GROUP BY 1) USING (event) WHERE nb_tumour > 10 AND {GOOD}""")
def _(spark, d):
    kept = ingest.quality_filter(raw_events(spark, d, "tumour")).select("event", "tumour", "mut_type")
    return ingest.recurrent_events(kept)


@query("d4_recurrence_counts", with_ctes(OBS, RAW) + f"""SELECT count(*) AS n_before, CAST(count_if(n > 10) AS BIGINT) AS n_after FROM (
SELECT event, count(DISTINCT tumour) + max(CASE WHEN tumour IS NULL THEN 1 ELSE 0 END) AS n FROM raw WHERE {GOOD} GROUP BY 1)""")
def _(spark, d):
    return ingest.recurrence_counts(ingest.quality_filter(raw_events(spark, d, "tumour")))


HLA = """hla AS (
  SELECT c_custkey AS patient, 'A' AS locus, 'allele_1' AS slot, CASE WHEN c_nationkey = 7 THEN 'Not typed'
    ELSE 'HLA-A*' || c_nationkey END AS allele FROM customer
  UNION ALL SELECT c_custkey, 'A', 'allele_2', CASE WHEN c_custkey % 3 = 0 THEN '-'
    ELSE 'HLA-A*' || (c_nationkey * 7 + c_custkey) % 40 END FROM customer),
filled AS (SELECT patient, locus, slot, CASE WHEN allele = '-' THEN max(CASE WHEN slot = 'allele_1' THEN allele END)
  OVER (PARTITION BY locus, patient) ELSE allele END AS allele FROM hla)"""


def hla(spark, d):
    c = table(spark, d, "customer")
    prefix = F.lit("HLA-A*")
    other = ((F.col("c_nationkey") * 7 + F.col("c_custkey")) % 40).cast("string")
    slots = [
        ("allele_1", F.when(F.col("c_nationkey") == 7, "Not typed").otherwise(
            F.concat(prefix, F.col("c_nationkey").cast("string")))),
        ("allele_2", F.when(F.col("c_custkey") % 3 == 0, "-").otherwise(F.concat(prefix, other)))]
    return c.select(F.col("c_custkey").alias("patient"), F.lit("A").alias("locus"), F.explode(F.array(*[
        F.struct(F.lit(s).alias("slot"), a.alias("allele")) for s, a in slots])).alias("s")).select(
        "patient", "locus", "s.slot", "s.allele")


@query("d5_fill_homozygous", f"WITH {HLA} SELECT patient, locus, slot, allele FROM filled")
def _(spark, d):
    return ingest.fill_homozygous(hla(spark, d))


@query("d6_common_alleles", f"""WITH {HLA} SELECT DISTINCT patient, locus, slot, allele FROM filled WHERE allele <> 'Not typed'
AND allele IN (SELECT allele FROM filled GROUP BY 1 HAVING count(*) > 20)""")
def _(spark, d):
    return ingest.typed_alleles(ingest.common_alleles(ingest.fill_homozygous(hla(spark, d))))


@query("d7_type_conflicts", BASE + """SELECT event, mut_type, n, n_types FROM (SELECT event, mut_type, count(*) AS n,
count(*) OVER (PARTITION BY event) AS n_types FROM lines GROUP BY event, mut_type) WHERE n_types > 1""")
def _(spark, d):
    return ingest.type_conflicts(lines(spark, d))


@query("d7_resolve_by_majority", BASE + """SELECT event, mut_type, count(*) AS n FROM lines JOIN (
SELECT event, mut_type FROM (SELECT event, mut_type, row_number() OVER (PARTITION BY event ORDER BY count(*) DESC, mut_type) AS r
FROM lines GROUP BY event, mut_type) WHERE r = 1) USING (event, mut_type) GROUP BY ALL""")
def _(spark, d):
    return ingest.resolve_types(lines(spark, d)).groupBy("event", "mut_type").agg(F.count("*").alias("n"))


@query("d7_resolve_by_list", BASE + """SELECT event, mut_type, count(*) AS n FROM lines
WHERE NOT (mut_type = 'A>G' AND event IN (SELECT p_partkey FROM part WHERE p_size > 40)) GROUP BY ALL""")
def _(spark, d):
    wrong = table(spark, d, "part").filter("p_size > 40").select(
        F.col("p_partkey").alias("event"), F.lit("A>G").alias("mut_type"))
    return ingest.resolve_types(lines(spark, d), wrong).groupBy("event", "mut_type").agg(F.count("*").alias("n"))


def binding_table(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(
        F.concat(F.lit("chr"), (F.col("l_suppkey") % 22 + 1).cast("string")).alias("chrom"),
        F.col("l_partkey").alias("pos"), F.col("l_returnflag").alias("ref"),
        F.when(F.col("l_linenumber") < 7, F.col("l_linestatus")).alias("alt"), F.col("l_tax").alias("el"),
        F.col("l_discount").alias("el_wt"), F.col("l_quantity").alias("ba"),
        F.concat(F.lit("HLA-"), (F.col("l_suppkey") % 9).cast("string")).alias("allele_key"))


@query("d8_event_key", """SELECT DISTINCT 'chr' || (l_suppkey % 22 + 1) || ':' || l_partkey || ':' || l_returnflag || ':' ||
CASE WHEN l_linenumber < 7 THEN l_linestatus ELSE 'NA' END AS event, l_tax AS el, l_discount AS el_wt, l_quantity AS ba,
'HLA-' || (l_suppkey % 9) AS allele_key FROM lineitem""")
def _(spark, d):
    return ingest.event_key(binding_table(spark, d))


D9_SQL = BASE + f"""SELECT event, sample, patient, locus, slot, allele, {r6('purity')} AS purity FROM (
SELECT DISTINCT event, sample, patient FROM obs) JOIN (SELECT DISTINCT c_custkey AS patient, 'A' AS locus, 'allele_1' AS slot,
CASE WHEN c_nationkey = 7 THEN 'Not typed' ELSE 'HLA-A*' || c_nationkey END AS allele FROM customer UNION ALL
SELECT DISTINCT c_custkey, 'A', 'allele_2', CASE WHEN c_custkey % 3 = 0 THEN '-' ELSE 'HLA-A*' || ((c_nationkey * 7 + c_custkey) % 40) END
FROM customer) USING (patient)
LEFT JOIN (SELECT sample, purity FROM samples) USING (sample)"""


@query("d9_assemble_keyed", D9_SQL)
def _(spark, d):
    events = by_sample(spark, observations(spark, d, "event", "sample", "patient"), layout.write_keyed)
    purity = by_sample(spark, samples(spark, d).select("sample", "purity"))
    return ingest.assemble_keyed(events, hla(spark, d), purity)


@query("d9_assemble", D9_SQL)
def _(spark, d):
    events = observations(spark, d, "event", "sample", "patient")
    return ingest.assemble(events, hla(spark, d), samples(spark, d).select("sample", "purity"))


@query("d10_sample_labels", BASE + "SELECT DISTINCT sample, sample_type, status, combine FROM obs")
def _(spark, d):
    rows = observations(spark, d, "event", "sample", "allele", "sample_code")
    return labels.sample_labels(rows).select("sample", "sample_type", "status", "combine").distinct()


# --- D11 - D18, D33, D36, D40: labels and checks -------------------------------------

@query("d11_patient_feature", with_ctes(OBS, FEATURES) + "SELECT patient, combine, feature FROM features")
def _(spark, d):
    return labels.patient_features(observations(spark, d, "patient", "combine", "sample_type"))


@query("d11_labelled_rows", with_ctes(OBS, FEATURES) + """SELECT feature, count(*) AS n, count(DISTINCT sample) AS n_sample
FROM obs LEFT JOIN features USING (patient, combine) GROUP BY 1""")
def _(spark, d):
    rows = observations(spark, d, "patient", "combine", "sample_type", "sample")
    return natural_join(rows, labels.patient_features(rows), "left").groupBy("feature").agg(
        F.count("*").alias("n"), F.count_distinct("sample").alias("n_sample"))


@query("d12_event_feature", with_ctes(OBS, EVENT_FEATURES) + "SELECT event, feature2 AS feature FROM event_features")
def _(spark, d):
    return labels.event_features(observations(spark, d, "event", "sample_type"))


NEO = "coalesce(effect = 'nonsynonymous' AND el < 0.1 AND el_wt > el AND coverage > 60, false)"


@query("d13_neoantigen_flag", BASE + f"""SELECT event, sample, var_count, neoantigenic, event IN (SELECT event FROM obs WHERE {NEO})
AS neo_event FROM (SELECT *, {NEO} AS neoantigenic FROM obs)""")
def _(spark, d):
    rows = observations(spark, d, "event", "sample", "var_count", "effect", "el", "el_wt", "coverage")
    return labels.mark_neoantigens(rows).select("event", "sample", "var_count", "neoantigenic", "neo_event")


@query("d15_class_one_scores", BASE + f"""SELECT event, sample, var_count, allele, {r6('b')} AS ba_mean FROM obs JOIN (
SELECT event, substr(allele, 1, 11) AS k, avg(ba) AS b FROM obs WHERE ba IS NOT NULL GROUP BY ALL) s
USING (event) WHERE substr(allele, 1, 11) = k AND locus IN ('A', 'B', 'C') AND effect = 'nonsynonymous'""")
def _(spark, d):
    obs = observations(spark, d, "event", "sample", "var_count", "locus", "allele", "effect")
    scores = observations(spark, d, "event", "allele", "ba").filter("ba is not null").groupBy(
        "event", F.substring("allele", 1, 11).alias("allele_key")).agg(F.avg("ba").alias("ba_mean"))
    return ingest.class_one(obs, scores, CLASS_ONE).select("event", "sample", "var_count", "allele", "ba_mean")


@query("d16_tumour_table", BASE + """SELECT r.event, r.allele, r.sample, r.tumour, r.mut_type, total_tumour, total_sample FROM (
SELECT DISTINCT event, allele, sample, tumour, mut_type FROM obs WHERE tumour IS NOT NULL AND effect = 'nonsynonymous') r JOIN (
SELECT allele, count(DISTINCT tumour) AS total_tumour, count(DISTINCT sample) AS total_sample FROM obs
WHERE tumour IS NOT NULL AND effect = 'nonsynonymous' GROUP BY 1) USING (allele)""")
def _(spark, d):
    rows = observations(spark, d, "event", "allele", "sample", "tumour", "mut_type", "effect")
    return ingest.tumour_table(rows, ["event", "allele", "sample", "tumour", "mut_type"])


@query("d17_cohort_profile", BASE + """SELECT 'patient' AS level, CAST(patient AS VARCHAR) AS unit, count(DISTINCT event) AS n_event,
count(DISTINCT tumour) AS n_tumour, count(DISTINCT sample) AS n_sample FROM obs WHERE tumour IS NOT NULL GROUP BY patient
UNION ALL SELECT 'tumour', tumour, count(DISTINCT event), count(DISTINCT tumour), count(DISTINCT sample) FROM obs
WHERE tumour IS NOT NULL GROUP BY tumour
UNION ALL SELECT 'class', immune, count(DISTINCT event), count(DISTINCT tumour), count(DISTINCT sample) FROM obs
WHERE tumour IS NOT NULL AND immune IS NOT NULL GROUP BY immune
UNION ALL SELECT 'cohort', NULL, count(DISTINCT event), count(DISTINCT tumour), count(DISTINCT sample) FROM obs
WHERE tumour IS NOT NULL""")
def _(spark, d):
    rows = observations(spark, d, "patient", "tumour", "sample", "immune", "event").filter("tumour is not null")
    levels = {"patient": ["patient"], "tumour": ["tumour"], "class": ["immune"], "cohort": []}
    counts = distinct_levels(rows, levels, ["event", "tumour", "sample"]).filter("level <> 'class' or immune is not null")
    unit = F.coalesce(F.col("patient").cast("string"), "tumour", "immune")  # a level fills its own key only
    return counts.select("level", unit.alias("unit"), "n_event", "n_tumour", "n_sample")


@query("d18_conflict_checks", BASE + """SELECT patient, n_types, n_class FROM (SELECT patient, count(DISTINCT sample_type) AS n_types,
count(DISTINCT immune) + max(CASE WHEN immune IS NULL THEN 1 ELSE 0 END) AS n_class FROM obs GROUP BY 1)
WHERE n_types > 1 AND n_class = 1""")
def _(spark, d):
    rows = observations(spark, d, "patient", "sample_type", "immune")
    return rows.groupBy("patient").agg(n_distinct("sample_type").alias("n_types"), n_distinct("immune").alias("n_class")
                                       ).filter("n_types > 1 and n_class = 1")


@query("d18_tumours_with_two_classes", BASE + """SELECT tumour, count(DISTINCT immune) AS n FROM obs
WHERE immune IS NOT NULL GROUP BY 1 HAVING count(DISTINCT immune) > 1""")
def _(spark, d):
    rows = observations(spark, d, "tumour", "immune").filter("immune is not null")
    return rows.groupBy("tumour").agg(F.count_distinct("immune").alias("n")).filter("n > 1")


@query("d33_expression_flag", with_ctes(OBS, DE) + """SELECT event, gene, de_ok, count(*) AS n FROM obs LEFT JOIN de_flag USING (gene)
GROUP BY ALL""")
def _(spark, d):
    flags = labels.downregulated(de_results(spark, d))
    return natural_join(observations(spark, d, "event", "gene"), flags, "left").groupBy("event", "gene", "de_ok").agg(
        F.count("*").alias("n"))


PREPARED = """prepared AS (SELECT DISTINCT sample, patient, tumour, locus, allele1, allele2, cn1, cn2, loh FROM loh_raw WHERE passed)"""


@query("d36_prepare_loh", with_ctes(OBS, LOH, PREPARED) + """SELECT event, obs.sample, obs.locus, loh, allele1, allele2 FROM obs
JOIN prepared p ON obs.sample = p.sample AND obs.patient = p.patient AND obs.tumour = p.tumour AND obs.locus = p.locus""")
def _(spark, d):
    rows = observations(spark, d, "event", "sample", "patient", "tumour", "locus")
    return natural_join(rows, labels.prepare_loh(loh(spark, d))).select(
        "event", "sample", "locus", "loh", "allele1", "allele2")


CANON = ("upper(string_split({0}, '_')[1]) || '-' || upper(string_split({0}, '_')[2]) || '*' || "
         "upper(string_split({0}, '_')[3]) || ':' || upper(string_split({0}, '_')[4])")
LOST = f"""lost AS (
  SELECT sample, patient, tumour, locus, loh, 'allele.1' AS slot, {CANON.format('allele1')} AS allele, cn1 < cn2 AS lost FROM prepared
  UNION ALL SELECT sample, patient, tumour, locus, loh, 'allele.2', {CANON.format('allele2')}, cn2 < cn1 FROM prepared)"""


@query("d40_lost_alleles", with_ctes(OBS, LOH, PREPARED, LOST) + """SELECT sample, tumour, locus, slot, allele, lost, n_tumour, n_sample FROM lost JOIN (
SELECT allele, lost, count(DISTINCT tumour) AS n_tumour, count(DISTINCT sample) AS n_sample FROM lost GROUP BY ALL) USING (allele, lost)""")
def _(spark, d):
    lost = labels.lost_alleles(labels.prepare_loh(loh(spark, d)))
    return add_group_stats(lost, (["allele", "lost"], {
        "n_tumour": F.count_distinct("tumour"), "n_sample": F.count_distinct("sample")})).select(
        "sample", "tumour", "locus", "slot", "allele", "lost", "n_tumour", "n_sample")


@query("d40_lost_alleles_only_loh", with_ctes(OBS, LOH, PREPARED, LOST) + "SELECT allele, lost, count(*) AS n FROM lost WHERE loh GROUP BY ALL")
def _(spark, d):
    return labels.lost_alleles(labels.prepare_loh(loh(spark, d)), only_loh=True).groupBy("allele", "lost").agg(
        F.count("*").alias("n"))

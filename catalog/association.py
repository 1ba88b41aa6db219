"""Associations of events with alleles and with immune class, and their displays."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.cohort import ALLELES, LOH, OBS, loh, observations, with_ctes, with_recursive_ctes
from catalog.ingest import NEO, PREPARED
from catalog.registry import query
from catalog.sqlkit import bh, box, chisq, chisq_raw, r6, rank_sum, signed_rank, tidy, welch
from catalog.statistics import SHUFFLE, shuffle_rows
from cohortry.operators import moments, ranks
from cohortry.operators.adjust import significant_rows
from cohortry.operators.grouped import parent_share
from cohortry.operators.joins import natural_join
from cohortry.plans import association, labels
from cohortry.plans.profiles import stack

BASE = with_ctes(OBS)
NONSYN = "tumour IS NOT NULL AND effect = 'nonsynonymous'"
ONE = "locus IN ('A', 'B', 'C')"


def tested(keys, sql):
    return tidy(bh(sql), [*keys, "n_rows", "dof"], ["statistic", "p_value", "p_adj"])


def nd(c):
    return f"count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)"


def hit_cells_sql(cell, whole, unit="tumour"):
    return (f"cells AS (SELECT {cell}, hit, total - hit AS miss FROM (SELECT {cell}, {nd(unit)} AS hit FROM obs GROUP BY ALL) "
            f"JOIN (SELECT {whole}, {nd(unit)} AS total FROM obs GROUP BY ALL) USING ({whole}))")


@query("d23_event_allele_association",
       with_ctes(OBS, hit_cells_sql("event, allele, locus", "allele")) + tested(
           ["event", "locus"], chisq_raw("cells", ["event", "locus"], "hit", "miss")))
def _(spark, d):
    return association.event_by_allele(observations(spark, d, "event", "allele", "locus", "tumour"))


@query("d23_gene_allele_association",
       with_ctes(OBS, hit_cells_sql("gene, allele, locus", "allele", "patient")) + tested(
           ["gene", "locus"], chisq_raw("cells", ["gene", "locus"], "hit", "miss")))
def _(spark, d):
    return association.event_by_allele(observations(spark, d, "gene", "allele", "locus", "patient"), "gene", "patient")


@query("d24_allele_event_association",
       with_ctes(OBS, hit_cells_sql("event, allele, locus, mut_type", "event")) + tested(
           ["allele", "mut_type"], chisq_raw("cells", ["allele", "mut_type"], "hit", "miss")))
def _(spark, d):
    return association.allele_by_event(observations(spark, d, "event", "allele", "locus", "mut_type", "tumour"))


PERMUTED = """null_cells AS (SELECT gene, allele, median(n) AS m FROM (SELECT rep, gene, allele, count(DISTINCT tumour) AS n
  FROM shuffled GROUP BY ALL) GROUP BY ALL),
seen AS (SELECT allele, locus, gene, count(DISTINCT tumour) AS n FROM base GROUP BY ALL),
cells AS (SELECT seen.*, coalesce(m, 0) AS m FROM seen LEFT JOIN null_cells USING (gene, allele))"""


@query("d25_permutation_association",
       with_recursive_ctes(OBS, *SHUFFLE, PERMUTED) + tested(["gene", "locus"], chisq_raw("cells", ["gene", "locus"], "n", "m")))
def _(spark, d):
    return association.permutation_association(shuffle_rows(spark, d), "row_id", event="gene", reps=100)


SEEN_ONE = f"""seen AS (SELECT allele, locus, gene, count(DISTINCT tumour) AS n FROM obs WHERE {NONSYN} AND {ONE} GROUP BY ALL)"""


@query("d25_permutation_association_wide_null",
       with_recursive_ctes(OBS, *SHUFFLE, PERMUTED.replace("seen AS (SELECT allele, locus, gene, count(DISTINCT tumour) AS n FROM base GROUP BY ALL)", SEEN_ONE))
       + tested(["gene", "locus"], chisq_raw("cells", ["gene", "locus"], "n", "m")))
def _(spark, d):
    """The null takes all effects and loci, the observed side nonsynonymous rows of class one."""
    seen = observations(spark, d, "gene", "locus", "allele", "tumour", "effect").filter(f"{NONSYN} and {ONE}")
    return association.permutation_association(seen, "row_id", event="gene", reps=100, null_cohort=shuffle_rows(spark, d))


def class_cells_sql(rows, unit="sample", group="immune", event="event"):
    return (f"cells AS (SELECT {event}, locus, allele, count(DISTINCT CASE WHEN {group} = 'cold' THEN {unit} END) AS cold, "
            f"count(DISTINCT CASE WHEN {group} = 'hot' THEN {unit} END) AS hot FROM {rows} WHERE {group} IS NOT NULL GROUP BY ALL)")


NONSYN_ROWS = f"rows_ AS (SELECT * FROM obs WHERE {NONSYN})"


def nonsyn(spark, d, *more):
    cols = dict.fromkeys(["event", "locus", "allele", "sample", "tumour", "immune", "effect", *more])
    return observations(spark, d, *cols).filter(NONSYN)


CLASS_TEST = chisq_raw("cells", ["event", "locus"], "cold", "hot")


@query("d26_class_association", with_ctes(OBS, NONSYN_ROWS, class_cells_sql("rows_")) + tested(["event", "locus"], CLASS_TEST))
def _(spark, d):
    return association.class_association(nonsyn(spark, d))


@query("d26_class_association_by_tumour",
       with_ctes(OBS, NONSYN_ROWS, class_cells_sql("rows_", "tumour")) + tested(["event", "locus"], CLASS_TEST))
def _(spark, d):
    return association.class_association(nonsyn(spark, d), unit="tumour")


@query("d26_significant_rows", with_ctes(OBS, NONSYN_ROWS, class_cells_sql("rows_")) +
       f"""SELECT event, locus, allele, immune, count(*) AS n FROM rows_ JOIN (SELECT event, locus FROM (
{bh(CLASS_TEST)}) WHERE p_adj < 0.05) USING (event, locus) GROUP BY ALL""")
def _(spark, d):
    rows = nonsyn(spark, d)
    hits = significant_rows(rows, association.class_association(rows).select("event", "locus", "p_adj"))
    return hits.groupBy("event", "locus", "allele", "immune").agg(F.count("*").alias("n"))


SHARES = """shares AS (SELECT event, locus, allele, immune, n / CAST(total AS DOUBLE) AS share FROM (
  SELECT event, locus, allele, immune, count(DISTINCT sample) AS n FROM obs WHERE immune IS NOT NULL GROUP BY ALL)
  JOIN (SELECT immune, count(DISTINCT sample) AS total FROM obs WHERE immune IS NOT NULL GROUP BY 1) USING (immune))"""
SHARE_CELLS = """cells AS (SELECT event, locus, allele, coalesce(max(CASE WHEN immune = 'cold' THEN share END), 0) AS cold,
  coalesce(max(CASE WHEN immune = 'hot' THEN share END), 0) AS hot FROM shares GROUP BY ALL)"""


@query("d26_share_association", with_ctes(OBS, SHARES, SHARE_CELLS) + tested(["locus"], chisq_raw("cells", ["locus"], "cold", "hot")))
def _(spark, d):
    return association.share_association(observations(spark, d, "event", "locus", "allele", "immune", "sample"))


@query("d26_class_share_comparison", with_ctes(OBS, SHARES) + rank_sum("shares", ["locus"], "immune", "share", ("'cold'", "'hot'")))
def _(spark, d):
    shares = association.class_shares(observations(spark, d, "event", "locus", "allele", "immune", "sample"),
                                      ["event", "locus", "allele"])
    return ranks.rank_sum_by(shares, ["locus"], "immune", "share", ("cold", "hot"))


COUNTS = f"""counts AS (SELECT event, allele, immune, count(DISTINCT tumour) AS n FROM obs
  WHERE {NONSYN} AND immune IS NOT NULL GROUP BY ALL)"""


@query("d26_class_count_comparison", with_ctes(OBS, COUNTS) + rank_sum("counts", [], "immune", "n", ("'cold'", "'hot'")))
def _(spark, d):
    counts = nonsyn(spark, d).filter("immune is not null").groupBy("event", "allele", "immune").agg(
        F.count_distinct("tumour").alias("n"))
    return ranks.rank_sum_by(counts, [], "immune", "n", ("cold", "hot"))


ASSIGNED = """assigned AS (SELECT patient, CASE WHEN cold > hot THEN 'cold' ELSE 'hot' END AS assigned FROM (
  SELECT patient, count(DISTINCT CASE WHEN immune = 'cold' THEN coalesce(tumour, '-') END) AS cold,
    count(DISTINCT CASE WHEN immune = 'hot' THEN coalesce(tumour, '-') END) AS hot FROM obs WHERE immune IS NOT NULL AND patient IN (
    SELECT patient FROM obs GROUP BY 1 HAVING count(DISTINCT sample_type) > 1) GROUP BY 1) WHERE cold <> hot),
rows_ AS (SELECT obs.*, assigned FROM obs JOIN assigned USING (patient) WHERE sample_type = 'normal')"""


def normals(spark, d):
    return association.normals_with_class(observations(
        spark, d, "event", "locus", "allele", "sample", "patient", "tumour", "immune", "sample_type"))


@query("d27_normal_class_association", with_ctes(OBS, ASSIGNED, class_cells_sql("rows_", group="assigned")) + tested(["event", "locus"], CLASS_TEST))
def _(spark, d):
    return association.class_association(normals(spark, d), group="assigned")


@query("d27_normal_class_counts", with_ctes(OBS, ASSIGNED, """counts AS (SELECT event, allele, immune, assigned,
count(DISTINCT sample) AS n FROM rows_ JOIN (SELECT event, allele FROM rows_ GROUP BY ALL HAVING count(DISTINCT assigned) > 1)
USING (event, allele) GROUP BY ALL)""") + rank_sum("counts", [], "assigned", "n", ("'cold'", "'hot'")))
def _(spark, d):
    rows = normals(spark, d)
    both = rows.groupBy("event", "allele").agg(F.count_distinct("assigned").alias("_n")).filter("_n > 1").drop("_n")
    counts = natural_join(rows, both).groupBy("event", "allele", "immune", "assigned").agg(F.count_distinct("sample").alias("n"))
    return ranks.rank_sum_by(counts, [], "assigned", "n", ("cold", "hot"))


def pair_shares_sql(unit):
    return (f"""both_ AS (SELECT event, allele FROM obs WHERE {NONSYN} AND immune IS NOT NULL GROUP BY ALL
  HAVING count(DISTINCT immune) > 1),
kept AS (SELECT obs.* FROM obs JOIN both_ USING (event, allele) WHERE {NONSYN} AND immune IS NOT NULL),
pairs AS (SELECT event, allele, locus, combine, immune, n_item, n_item / CAST(total AS DOUBLE) AS share FROM (
  SELECT event, allele, locus, combine, immune, count(DISTINCT {unit}) AS n_item FROM kept GROUP BY ALL)
  JOIN (SELECT allele, immune, count(DISTINCT {unit}) AS total FROM kept GROUP BY ALL) USING (allele, immune)),
long AS (SELECT combine, locus, immune, 'n_item' AS metric, CAST(n_item AS DOUBLE) AS value FROM pairs
  UNION ALL SELECT combine, locus, immune, 'share', share FROM pairs)""")


COLD_HOT = ("'cold'", "'hot'")
for _unit in ("tumour", "sample"):
    def _shares(spark, d, unit=_unit):
        return association.class_pair_shares(nonsyn(spark, d, "combine"), unit)

    query(f"d28_pair_shares_by_{_unit}", with_ctes(OBS, pair_shares_sql(_unit)) + f"""SELECT event, allele, locus, combine, immune,
n_item, {r6('share')} AS share FROM pairs""")(lambda spark, d, f=_shares: f(spark, d).drop("n_all"))
    query(f"d28_class_test_by_{_unit}", with_ctes(OBS, pair_shares_sql(_unit)) + rank_sum(
        "long", ["metric", "locus"], "immune", "value", COLD_HOT))(
        lambda spark, d, f=_shares: ranks.rank_sum_by(
            stack(f(spark, d), ["locus", "immune"], ["n_item", "share"]), ["metric", "locus"], "immune", "value", ("cold", "hot")))
    query(f"d28_paired_test_by_{_unit}", with_ctes(OBS, pair_shares_sql(_unit)) + signed_rank(
        "long", ["metric", "locus"], "combine", "immune", "value", COLD_HOT))(
        lambda spark, d, f=_shares: ranks.signed_rank_by(
            stack(f(spark, d), ["combine", "locus", "immune"], ["n_item", "share"]), ["metric", "locus"], "combine", "immune",
            "value", ("cold", "hot")))


@query("d28_cold_above_hot", with_ctes(OBS, pair_shares_sql("tumour")) + signed_rank(
    "(SELECT * FROM pairs WHERE combine IN (SELECT combine FROM pairs GROUP BY 1 HAVING max(CASE WHEN immune = 'cold' THEN share END) "
    "> max(CASE WHEN immune = 'hot' THEN share END)))", ["locus"], "combine", "immune", "share", COLD_HOT))
def _(spark, d):
    shares = association.class_pair_shares(nonsyn(spark, d, "combine"), "tumour")
    more = association.higher_in(shares, ["combine"], "cold", "hot")
    return ranks.signed_rank_by(more, ["locus"], "combine", "immune", "share", ("cold", "hot"))


STRONG = f"""strong AS (SELECT * FROM obs WHERE {NONSYN} AND immune IS NOT NULL AND el < 0.05),
frequent AS (SELECT strong.* FROM strong JOIN (SELECT event, allele FROM strong GROUP BY ALL HAVING count(DISTINCT tumour) > 2)
  USING (event, allele)),
shares AS (SELECT event, allele, combine, immune, n / CAST(total AS DOUBLE) AS share, n FROM (
  SELECT event, allele, combine, immune, count(DISTINCT tumour) AS n FROM frequent GROUP BY ALL)
  JOIN (SELECT allele, count(DISTINCT tumour) AS total FROM frequent GROUP BY 1) USING (allele))"""


def frequent_shares(spark, d):
    strong = nonsyn(spark, d, "combine", "el").filter("immune is not null and el < 0.05")
    often = strong.groupBy("event", "allele").agg(F.count_distinct("tumour").alias("_n")).filter("_n > 2").drop("_n")
    return parent_share(natural_join(strong, often), ["event", "allele", "combine", "immune"], ["allele"], "tumour")


@query("d29_frequent_pairs", with_ctes(OBS, STRONG) + f"SELECT event, allele, combine, immune, n AS n_item, {r6('share')} AS share FROM shares")
def _(spark, d):
    return frequent_shares(spark, d).drop("n_all")


@query("d29_frequent_pairs_test", with_ctes(OBS, STRONG) + signed_rank("shares", [], "combine", "immune", "share", COLD_HOT))
def _(spark, d):
    return ranks.signed_rank_by(frequent_shares(spark, d), [], "combine", "immune", "share", ("cold", "hot"))


def sig_ctes(rows):
    """Pairs of significant events: units per class, and their share of the allele's units."""
    return ["rows_ AS (SELECT * FROM obs WHERE " + NONSYN + ")", class_cells_sql("rows_"), f"""hits AS (SELECT event, locus FROM (
{bh(CLASS_TEST)}) WHERE p_adj < 0.05),
sig AS (SELECT rows_.* FROM rows_ JOIN hits USING (event, locus) WHERE immune IS NOT NULL AND el < 0.05),
kept AS ({rows}),
pairs AS (SELECT event, allele, combine, immune, n, n / CAST(total AS DOUBLE) AS share FROM (
  SELECT event, allele, combine, immune, count(DISTINCT tumour) AS n FROM kept GROUP BY ALL)
  JOIN (SELECT allele, count(DISTINCT tumour) AS total FROM kept GROUP BY 1) USING (allele))"""]


SIG = sig_ctes("SELECT * FROM sig")
SIG_FREQUENT = sig_ctes("SELECT sig.* FROM sig JOIN (SELECT event, allele FROM sig GROUP BY ALL HAVING count(DISTINCT tumour) > 3) USING (event, allele)")


def significant_strong(spark, d):
    return association.significant_class_rows(nonsyn(spark, d, "combine", "el")).filter("el < 0.05")


def pair_counts(rows):
    return parent_share(rows, ["event", "allele", "combine", "immune"], ["allele"], "tumour")


@query("d29_significant_pair_counts_test", with_ctes(OBS, *SIG) + signed_rank("pairs", [], "combine", "immune", "n", COLD_HOT))
def _(spark, d):
    return ranks.signed_rank_by(pair_counts(significant_strong(spark, d)), [], "combine", "immune", "n_item", ("cold", "hot"))


@query("d29_significant_pairs_higher_in_hot", with_ctes(OBS, *SIG) + f"""SELECT event, allele, combine, immune, {r6('share')} AS share FROM pairs
WHERE combine IN (SELECT combine FROM pairs GROUP BY 1 HAVING max(CASE WHEN immune = 'hot' THEN share END) > max(CASE WHEN immune = 'cold' THEN share END))""")
def _(spark, d):
    shares = pair_counts(significant_strong(spark, d)).drop("n_item", "n_all")
    return association.higher_in(shares, ["combine"], "hot", "cold")


@query("d29_significant_frequent_pairs_test", with_ctes(OBS, *SIG_FREQUENT) + signed_rank("pairs", [], "combine", "immune", "share", COLD_HOT))
def _(spark, d):
    often = association.frequent_pairs(significant_strong(spark, d), 3)
    return ranks.signed_rank_by(pair_counts(often), [], "combine", "immune", "share", ("cold", "hot"))


@query("d29_significant_neoantigens_per_class", with_ctes(OBS, *SIG) + "SELECT immune, count(DISTINCT combine) AS n FROM sig GROUP BY 1")
def _(spark, d):
    return significant_strong(spark, d).groupBy("immune").agg(F.count_distinct("combine").alias("n"))


@query("d29_neoantigens_per_class", BASE + f"""SELECT immune, count(DISTINCT combine) AS n FROM obs
WHERE {NONSYN} AND immune IS NOT NULL AND el < 0.05 GROUP BY 1""")
def _(spark, d):
    return nonsyn(spark, d, "combine", "el").filter("immune is not null and el < 0.05").groupBy("immune").agg(
        F.count_distinct("combine").alias("n"))


# --- displays ------------------------------------------------------------------------

def bubble_sql(weight):
    return BASE + f"""SELECT event, allele, mut_type, locus, nb_tumour, {r6(f'nb_tumour / CAST(sum({weight}) OVER (PARTITION BY event, locus) AS DOUBLE)')}
AS proportion FROM (SELECT event, allele, mut_type, locus, count(DISTINCT tumour) AS nb_tumour, count(*) AS n FROM obs
WHERE {NONSYN} GROUP BY ALL)"""


@query("d19_bubbles", bubble_sql("nb_tumour"))
def _(spark, d):
    return association.bubbles(nonsyn(spark, d, "mut_type"))


@query("d19_bubbles_row_weighted", bubble_sql("nb_tumour * n"))
def _(spark, d):
    return association.bubbles(nonsyn(spark, d, "mut_type"), row_weighted=True)


@query("d20_strong_binder_bubbles", BASE + f"""SELECT locus, event, allele, gene, count(DISTINCT tumour) AS nb_tumour FROM obs
WHERE {NONSYN} AND {ONE} AND el < 0.05 GROUP BY ALL""")
def _(spark, d):
    return association.cell_counts(nonsyn(spark, d, "gene", "el").filter(f"{ONE} and el < 0.05"), ["locus", "event", "allele", "gene"])


@query("d20_bubbles_by_flag_and_class", BASE + f"""SELECT event, allele, immune, neoantigenic, count(DISTINCT tumour) AS nb_tumour
FROM (SELECT *, {NEO} AS neoantigenic FROM obs) WHERE {NONSYN} AND {ONE} AND immune IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    rows = nonsyn(spark, d, "el", "el_wt", "coverage").filter(f"{ONE} and immune is not null")
    marked = rows.withColumn("neoantigenic", labels.neoantigen_test())
    return association.cell_counts(marked, ["event", "allele", "immune", "neoantigenic"])


#: The alleles of the given tables, for the SQL side; the Spark side finds its columns in the data.
HEAT = [a for a in ALLELES if "DRB1" not in a and "DQB1" not in a]


def heat_sql(unit, where, value):
    return BASE + "SELECT event, " + ", ".join(
        f"{r6('coalesce(max(CASE WHEN allele = ' + chr(39) + a + chr(39) + ' THEN v END), 0)')} AS \"{a}\"" for a in HEAT) + (
        f" FROM (SELECT event, allele, CAST({value} AS DOUBLE) AS v FROM (SELECT event, allele, count(DISTINCT {unit}) AS n FROM obs "
        f"WHERE {NONSYN} AND {ONE} AND {where} GROUP BY ALL) JOIN (SELECT allele, count(DISTINCT {unit}) AS total FROM obs "
        f"WHERE {NONSYN} AND {ONE} AND {where.replace(' AND immune = ' + chr(39) + 'hot' + chr(39), '')} GROUP BY ALL) USING (allele)) GROUP BY 1")


@query("d21_share_matrix", heat_sql("tumour", "true", "n / CAST(total AS DOUBLE)"))
def _(spark, d):
    shares = parent_share(nonsyn(spark, d).filter(ONE), ["event", "allele"], ["allele"], "tumour")
    return association.heat_matrix(shares, "share")


@query("d21_row_annotation", BASE + f"""SELECT event, count(DISTINCT tumour) AS nb_unit, bool_or(in_normal) AS in_normal FROM obs
WHERE {NONSYN} AND {ONE} GROUP BY 1""")
def _(spark, d):
    return association.event_annotation(nonsyn(spark, d, "in_normal").filter(ONE))


@query("d21_column_annotation", BASE + f"""SELECT allele, count(DISTINCT tumour) AS nb_unit, substr(allele, 1, 5) AS family FROM obs
WHERE {NONSYN} AND {ONE} GROUP BY 1""")
def _(spark, d):
    return association.allele_annotation(nonsyn(spark, d).filter(ONE))


HOT = "immune IS NOT NULL AND immune = 'hot'"


def class_cells(spark, d):
    rows = nonsyn(spark, d).filter(f"{ONE} and immune is not null")
    return parent_share(rows, ["event", "allele", "immune"], ["allele"], "sample")


@query("d22_hot_share_matrix", heat_sql("sample", HOT, "n / CAST(total AS DOUBLE)"))
def _(spark, d):
    return association.heat_matrix(class_cells(spark, d).filter("immune = 'hot'"), "share")


@query("d22_hot_count_matrix", heat_sql("sample", HOT, "n"))
def _(spark, d):
    hot = class_cells(spark, d).filter("immune = 'hot'").withColumn("n_item", F.col("n_item").cast("double"))
    return association.heat_matrix(hot, "n_item")


CLASS_LONG = f"""cells AS (SELECT event, allele, immune, n, n / CAST(total AS DOUBLE) AS share FROM (
  SELECT event, allele, immune, count(DISTINCT sample) AS n FROM obs WHERE {NONSYN} AND {ONE} AND immune IS NOT NULL GROUP BY ALL)
  JOIN (SELECT allele, count(DISTINCT sample) AS total FROM obs WHERE {NONSYN} AND {ONE} AND immune IS NOT NULL GROUP BY 1) USING (allele)),
long AS (SELECT 'share' AS metric, immune, share AS value FROM cells UNION ALL SELECT 'log_count', immune, log10(n) FROM cells)"""


def class_long(spark, d):
    return stack(class_cells(spark, d).withColumn("log_count", F.log10("n_item")), ["immune"], ["share", "log_count"])


@query("d22_class_t_test", with_ctes(OBS, CLASS_LONG) + welch("long", ["metric"], "immune", "value", COLD_HOT))
def _(spark, d):
    return moments.welch_t_by(class_long(spark, d), ["metric"], "immune", "value", ("cold", "hot"))


@query("d22_class_boxes", with_ctes(OBS, CLASS_LONG) + box("long", ["metric", "immune"], "value"))
def _(spark, d):
    return moments.box_stats_by(class_long(spark, d), ["metric", "immune"], "value")


@query("d38_loh_class_contingency", with_ctes(OBS, LOH, PREPARED, """cells AS (SELECT loh,
count(DISTINCT CASE WHEN immune = 'cold' THEN sample END) AS cold, count(DISTINCT CASE WHEN immune = 'hot' THEN sample END) AS hot
FROM prepared JOIN samples USING (sample) WHERE immune IS NOT NULL GROUP BY 1)""") + chisq("cells", [], "cold", "hot"))
def _(spark, d):
    rows = natural_join(labels.prepare_loh(loh(spark, d)), observations(spark, d, "sample", "immune").distinct())
    return association.class_contingency(rows, "loh", "sample")


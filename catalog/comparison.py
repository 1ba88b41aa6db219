"""Comparisons of per-unit summaries between groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.cohort import (CELLS, EXPRESSION, LOH, OBS, cell_scores, expression, loh, observations, samples,
                            with_ctes)
from catalog.ingest import DE, EVENT_FEATURES, FEATURES, LOST, NEO, PREPARED, de_results
from catalog.registry import query
from catalog.sqlkit import (bh, box, keys, kruskal, r6, rank_sum, signed_rank, spearman, spearman_raw, tidy, unpivot)
from cohortry.operators import grouped, joins, moments, ranks, reshape
from cohortry.operators.adjust import stars
from cohortry.operators.joins import natural_join
from cohortry.plans import labels, profiles
from cohortry.plans.profiles import Study

BASE = with_ctes(OBS)
NEO30 = "effect = 'nonsynonymous' AND el < 0.1 AND el_wt > el AND coverage > 30"
NEO60 = "effect = 'nonsynonymous' AND el < 0.1 AND el_wt > el AND coverage > 60"
COLD_HOT = ("cold", "hot")


# --- SQL of a study ------------------------------------------------------------------

def lit(v) -> str:
    return str(v).lower() if isinstance(v, bool) else f"'{v}'"


def profile_sql(src, unit, item, counts=None, means=None, shares=None, zero=()):
    counts, means, shares = counts or {}, means or {}, shares or {}

    def n(name):
        test = counts[name]
        return f"count(DISTINCT {item})" if test is None else f"count(DISTINCT CASE WHEN {test} THEN {item} END)"

    cols = []
    for name in counts:
        cols.append(f"{n(name) if name in zero else f'nullif({n(name)}, 0)'} AS {name}")
    for name, (col, test) in means.items():
        test = test or "true"
        value = f"CASE WHEN {test} THEN {col} END"
        mean = f"CASE WHEN count_if({test}) = count({value}) THEN avg({value}) END"
        cols.append(f"{f'coalesce({mean}, 0)' if name in zero else mean} AS {name}")
    for name, (top, bottom) in shares.items():
        upper = n(top) if name in zero else f"nullif({n(top)}, 0)"
        cols.append(f"{upper} / CAST({n(bottom)} AS DOUBLE) AS {name}")
    return f"SELECT {keys(unit)}{', '.join(cols)} FROM {src} GROUP BY {', '.join(unit)}"


def study_ctes(study: Study, src: str) -> list[str]:
    rows = f"SELECT * FROM {src}" + (f" WHERE {study.where}" if study.where else "")
    out = [f"r0 AS ({rows})"]
    last = "r0"
    if study.within:
        key, col = study.within
        out.append(f"r1 AS (SELECT r0.* FROM r0 JOIN (SELECT {key} AS k_ FROM r0 GROUP BY 1 HAVING count(DISTINCT {col}) "
                   f"+ max(CASE WHEN {col} IS NULL THEN 1 ELSE 0 END) > 1) ON {key} IS NOT DISTINCT FROM k_)")
        last = "r1"
    out.append(f"r2 AS (SELECT * FROM {last}" + (f" WHERE {study.then})" if study.then else ")"))
    if study.values:
        units = f"SELECT DISTINCT {keys(study.unit)}{', '.join(study.values)} FROM r2"
    else:
        units = profile_sql("r2", study.unit, study.item, study.counts, study.means, study.shares, study.zero)
    out.append(f"units AS ({units})")
    ids = list(dict.fromkeys([*study.facets, study.group, *([study.pair] if study.pair else [])]))
    out.append(f"long AS ({unpivot('units', ids, study.metrics, 'metric', 'value')})")
    return out


def study_sql(study: Study, src="obs", ctes=()):
    head = with_ctes(OBS, *ctes, *study_ctes(study, src))
    by = ["metric", *study.facets]
    if study.levels is None:
        return head + kruskal("long", by, study.group, "value")
    pair = tuple(lit(v) for v in study.levels)
    if study.pair:
        return head + signed_rank("long", by, study.pair, study.group, "value", pair)
    return head + rank_sum("long", by, study.group, "value", pair)


def register(name, study, columns=None, source=None, src="obs", ctes=()):
    """One query per study; ``source`` builds the labelled rows where labels are needed."""
    def rows(spark, d):
        return source(spark, d) if source else observations(spark, d, *columns)

    query(name, study_sql(study, src, ctes))(lambda spark, d: profiles.run_study(rows(spark, d), study))


TUMOUR = "tumour IS NOT NULL"
CLASSED = "immune IS NOT NULL"
WIDE = ["event", "sample", "patient", "tumour", "immune", "status", "effect", "level", "coverage", "el", "el_wt", "ba"]

# --- D32, D35, D42, D47, D50, D53, D57 - D60: from the observations -------------------

register("d32_primary_against_metastatic", Study(
    unit=("sample", "status"), group="status", levels=("Meta_recur", "Primary"), where=f"{TUMOUR} AND coverage > 30",
    counts={"burden": None, "neo": "effect = 'nonsynonymous' AND el < 0.1"},
    means={"level": ("level", None), "affinity": ("el", "el IS NOT NULL"),
           "neo_level": ("level", "effect = 'nonsynonymous' AND el < 0.1"),
           "neo_affinity": ("el", "effect = 'nonsynonymous' AND el < 0.1")},
    shares={"neo_share": ("neo", "burden")}), WIDE)

register("d35_burden_by_class", Study(
    unit=("sample", "immune"), group="immune", levels=COLD_HOT, where=CLASSED,
    counts={"burden": None, "neo": NEO30}, shares={"neo_share": ("neo", "burden")}), WIDE)

WITHIN_TUMOUR = dict(
    unit=("tumour", "immune"), group="immune", levels=COLD_HOT, where=f"{TUMOUR} AND {CLASSED}", within=("tumour", "immune"),
    then="coverage > 30", counts={"burden": None, "neo": NEO30},
    means={"level": ("level", None), "neo_level": ("level", NEO30)}, shares={"neo_share": ("neo", "burden")},
    zero=("neo", "neo_share"))
register("d42_within_tumour", Study(**WITHIN_TUMOUR), WIDE)
register("d42_within_tumour_paired", Study(**WITHIN_TUMOUR, pair="tumour"), WIDE)

BOTH = f"{CLASSED} AND {TUMOUR}"
register("d47_class_grid_by_sample", Study(
    unit=("sample", "immune"), group="immune", levels=COLD_HOT, where=BOTH,
    counts={"total": None, "neo": NEO30},
    means={"level": ("level", "coverage > 30"), "level_neo": ("level", NEO30),
           "affinity": ("el", "el IS NOT NULL"), "affinity_neo": ("el", "effect = 'nonsynonymous' AND el < 0.1 AND el_wt > el")},
    shares={"neo_share": ("neo", "total")}), WIDE)
for _unit in ("sample", "patient"):
    register(f"d47_patients_with_both_by_{_unit}", Study(
        unit=tuple(dict.fromkeys(("patient", _unit, "immune"))), group="immune", levels=COLD_HOT, where=CLASSED,
        within=("patient", "immune"), then=f"{TUMOUR} AND coverage > 30", counts={"burden": None},
        means={"level": ("level", None), "level_neo": ("level", NEO30)}), WIDE)
register("d47_affinity_rows", Study(
    unit=("sample", "immune", "event"), group="immune", levels=COLD_HOT, where=f"{CLASSED} AND el IS NOT NULL",
    values=("el",)), WIDE)
register("d47_affinity_by_patient", Study(
    unit=("patient", "immune"), group="immune", levels=COLD_HOT,
    where=f"{CLASSED} AND effect = 'nonsynonymous' AND el < 0.1 AND el_wt > el", means={"affinity": ("el", None)}), WIDE)


FREQ = f"""neo AS (SELECT * FROM obs WHERE {BOTH} AND {NEO30}),
freq AS (SELECT event, immune, n AS freq, n / CAST(total AS DOUBLE) AS share FROM (
  SELECT event, immune, count(DISTINCT sample) AS n FROM neo GROUP BY ALL)
  JOIN (SELECT event, count(DISTINCT sample) AS total FROM neo GROUP BY 1) USING (event)),
long AS (SELECT immune, 'freq' AS metric, CAST(freq AS DOUBLE) AS value FROM freq UNION ALL SELECT immune, 'share', share FROM freq)"""


@query("d47_event_frequency", with_ctes(OBS, FREQ) + rank_sum("long", ["metric"], "immune", "value", ("'cold'", "'hot'")))
def _(spark, d):
    neo = observations(spark, d, *WIDE).filter(f"{BOTH} AND {NEO30}")
    shares = grouped.parent_share(neo, ["event", "immune"], ["event"], "sample").withColumnRenamed("n_item", "freq")
    return ranks.rank_sum_by(profiles.stack(shares, ["immune"], ["freq", "share"]), ["metric"], "immune", "value", COLD_HOT)


ALLELE_FREQ = f"""freq AS (SELECT event, allele, immune, n / CAST(total AS DOUBLE) AS share FROM (
  SELECT event, allele, immune, count(DISTINCT sample) AS n FROM obs WHERE {BOTH} GROUP BY ALL)
  JOIN (SELECT allele, count(DISTINCT sample) AS total FROM obs WHERE {BOTH} GROUP BY 1) USING (allele))"""


@query("d47_pair_frequency", with_ctes(OBS, ALLELE_FREQ) + rank_sum("freq", [], "immune", "share", ("'cold'", "'hot'")))
def _(spark, d):
    rows = observations(spark, d, "event", "allele", "immune", "tumour", "sample").filter(BOTH)
    shares = grouped.parent_share(rows, ["event", "allele", "immune"], ["allele"], "sample")
    return ranks.rank_sum_by(shares, [], "immune", "share", COLD_HOT)


register("d50_histology_profile", Study(
    unit=("sample", "histology"), group="histology", levels=None, where=f"{TUMOUR} AND histology IS NOT NULL",
    counts={"total": None, "nonsynonymous": "effect = 'nonsynonymous'"},
    means={"level": ("level", "coverage > 60 AND effect = 'nonsynonymous'")}),
    ["event", "sample", "histology", "tumour", "effect", "level", "coverage"])

register("d58_types_by_class", Study(
    unit=("sample", "immune", "mut_type"), group="immune", levels=COLD_HOT, where=f"{CLASSED} AND mut_type <> 'T>C'",
    counts={"total": None}, facets=("mut_type",)), ["event", "sample", "immune", "mut_type"])


D58 = Study(unit=("sample", "immune", "mut_type"), group="immune", levels=COLD_HOT, where=CLASSED, counts={"total": None},
            facets=("mut_type",))


@query("d58_types_by_class_stars", "SELECT mut_type, CASE WHEN p_value <= 0.0001 THEN '****' WHEN p_value <= 0.001 THEN '***' "
       "WHEN p_value <= 0.01 THEN '**' WHEN p_value <= 0.05 THEN '*' WHEN p_value IS NOT NULL THEN 'ns' END AS stars FROM ("
       + study_sql(D58) + ")")
def _(spark, d):
    tests = profiles.run_study(observations(spark, d, "event", "sample", "immune", "mut_type"), D58)
    return profiles.with_stars(tests).select("mut_type", "stars")


register("d59_burden_by_patient_and_class", Study(
    unit=("patient", "immune"), group="immune", levels=COLD_HOT, where=f"{BOTH} AND effect = 'nonsynonymous'",
    counts={"burden": None}), WIDE)

D59 = Study(unit=("sample", "neoantigenic", "immune"), group="immune", levels=COLD_HOT,
            where=f"{BOTH} AND effect = 'nonsynonymous'", counts={"burden": None}, facets=("neoantigenic",))
MARKED = f"marked AS (SELECT *, {NEO} AS neoantigenic FROM obs)"


def marked(spark, d, *more):
    cols = dict.fromkeys([*WIDE, *more])
    return observations(spark, d, *cols).withColumn("neoantigenic", labels.neoantigen_test())


register("d59_burden_by_flag_and_class", D59, source=marked, src="marked", ctes=(MARKED,))


@query("d59_boxes", with_ctes(OBS, MARKED, *study_ctes(D59, "marked")) + box("long", ["metric", "neoantigenic", "immune"], "value"))
def _(spark, d):
    return profiles.study_boxes(marked(spark, d), D59)


@query("d60_purity_by_class", BASE + rank_sum("samples", [], "immune", "purity", ("'cold'", "'hot'")))
def _(spark, d):
    return ranks.rank_sum_by(samples(spark, d), [], "immune", "purity", COLD_HOT)


@query("d60_purity_boxes", with_ctes(OBS, "s AS (SELECT immune, purity FROM samples WHERE immune IS NOT NULL)") + box("s", ["immune"], "purity"))
def _(spark, d):
    return moments.box_stats_by(samples(spark, d).filter("immune is not null"), ["immune"], "purity")


TWO_STAGE = """stages AS (SELECT patient, sample_type, avg(n) AS burden, avg(m) AS level FROM (
  SELECT patient, sample, sample_type, count(DISTINCT event) AS n, avg(level) AS m FROM obs WHERE coverage > 60 AND patient IN (
    SELECT patient FROM obs GROUP BY 1 HAVING count(DISTINCT sample_type) > 1) GROUP BY ALL) GROUP BY ALL)"""
TWO_STAGE_LONG = "long AS (" + unpivot("stages", ["patient", "sample_type"], ["burden", "level"], "metric", "value") + ")"


def two_stage(spark, d):
    rows = observations(spark, d, "patient", "sample", "sample_type", "event", "level", "coverage")
    paired = joins.keep_matching(rows, labels.paired_patients(rows)).filter("coverage > 60")
    return grouped.two_stage_mean(paired, ["patient", "sample", "sample_type"], ["patient", "sample_type"],
                                  {"burden": F.count_distinct("event"), "level": F.avg("level")})


@query("d57_two_stage_means", with_ctes(OBS, TWO_STAGE) + f"SELECT patient, sample_type, {r6('burden')} AS burden, {r6('level')} AS level FROM stages")
def _(spark, d):
    return two_stage(spark, d)


@query("d57_two_stage_test", with_ctes(OBS, TWO_STAGE, TWO_STAGE_LONG) + rank_sum(
    "long", ["metric"], "sample_type", "value", ("'normal'", "'tumour'")))
def _(spark, d):
    long = profiles.stack(two_stage(spark, d), ["sample_type"], ["burden", "level"])
    return ranks.rank_sum_by(long, ["metric"], "sample_type", "value", ("normal", "tumour"))


# --- D34, D46, D48: by feature label -------------------------------------------------

LABELLED = """labelled AS (SELECT obs.*, feature, de_ok FROM obs LEFT JOIN features USING (patient, combine) LEFT JOIN de_flag USING (gene))"""
LABEL_CTES = (FEATURES, DE, LABELLED)


def labelled(spark, d):
    rows = observations(spark, d, *WIDE, "combine", "sample_type", "gene", "locus")
    rows = natural_join(rows, labels.patient_features(rows), "left")
    return natural_join(rows, labels.downregulated(de_results(spark, d)), "left", ["gene"])


CHOSEN = f"feature IS NOT NULL AND feature <> 'normal-specific' AND {NEO30} AND de_ok"
SIDES = ("shared", "tumour-specific")
register("d34_feature_level_paired", Study(
    unit=("patient", "feature"), group="feature", levels=SIDES, where=CHOSEN, within=("patient", "feature"),
    means={"level": ("level", None)}, pair="patient"), source=labelled, src="labelled", ctes=LABEL_CTES)
register("d34_class_level_paired", Study(
    unit=("tumour", "immune"), group="immune", levels=COLD_HOT,
    where=f"{BOTH} AND feature <> 'normal-specific' AND {NEO30}", within=("tumour", "immune"),
    means={"level": ("level", None)}, pair="tumour"), source=labelled, src="labelled", ctes=LABEL_CTES)
register("d34_affinity_by_class", Study(
    unit=("sample", "event", "immune"), group="immune", levels=COLD_HOT,
    where=f"feature IS NOT NULL AND {CLASSED} AND effect = 'nonsynonymous' AND el < 0.1 AND el_wt > el AND de_ok",
    values=("el",)), source=labelled, src="labelled", ctes=LABEL_CTES)
register("d34_affinity_by_feature", Study(
    unit=("sample", "event", "feature"), group="feature", levels=SIDES,
    where="feature <> 'normal-specific' AND effect = 'nonsynonymous' AND el < 0.1 AND el_wt > el AND de_ok",
    values=("el",)), source=labelled, src="labelled", ctes=LABEL_CTES)

MIXED = """mixed AS (SELECT labelled.*, CASE WHEN patient IN (SELECT patient FROM obs WHERE immune IS NOT NULL GROUP BY 1
  HAVING count(DISTINCT immune) > 1) THEN 'mixed' ELSE immune END AS immune_patient FROM labelled WHERE immune IS NOT NULL)"""


@query("d34_mixed_patients", with_ctes(OBS, *LABEL_CTES, MIXED) + f"""SELECT patient, feature, immune_patient, {r6('avg(level)')} AS level
FROM mixed WHERE {CHOSEN} GROUP BY ALL""")
def _(spark, d):
    rows = labels.mixed_class(labelled(spark, d)).filter(CHOSEN)
    return rows.groupBy("patient", "feature", "immune_patient").agg(F.avg("level").alias("level"))


register("d46_affinity_by_feature_and_locus", Study(
    unit=("event", "feature", "locus"), group="feature", levels=None, where=f"feature IS NOT NULL AND {NEO30}",
    means={"affinity": ("el", None)}, facets=("locus",)), source=labelled, src="labelled", ctes=LABEL_CTES)

SPECIFIC = f"specific AS (SELECT obs.*, feature2, {NEO} AS neoantigenic FROM obs LEFT JOIN event_features USING (event))"
SPEC_CTES = (EVENT_FEATURES, SPECIFIC)


def specific(spark, d):
    rows = observations(spark, d, *WIDE, "sample_type", "histology")
    tagged = natural_join(rows, labels.event_features(rows).withColumnRenamed("feature", "feature2"), "left", ["event"])
    return tagged.withColumn("neoantigenic", labels.neoantigen_test())


# Almost every event of the fixture is seen in both sample types, so the label of
# the event within one patient carries these comparisons.
register("d48_feature_rows", Study(
    unit=("sample", "event", "feature"), group="feature", levels=SIDES, where=f"el IS NOT NULL AND {NEO30}",
    values=("el", "level")), source=labelled, src="labelled", ctes=LABEL_CTES)
register("d48_feature_counts", Study(
    unit=("event", "feature"), group="feature", levels=SIDES, where=f"el IS NOT NULL AND {NEO30}", item="sample",
    counts={"n_sample": None}), source=labelled, src="labelled", ctes=LABEL_CTES)
register("d48_specific_by_class", Study(
    unit=("sample", "immune"), group="immune", levels=COLD_HOT, where=f"el IS NOT NULL AND {CLASSED} AND {NEO30}",
    counts={"total": None, "own": "feature = 'tumour-specific'"}, means={"affinity": ("el", None)},
    shares={"own_share": ("own", "total")}), source=labelled, src="labelled", ctes=LABEL_CTES)
register("d50_histology_by_feature", Study(
    unit=("sample", "histology", "feature2"), group="histology", levels=None, where=f"{TUMOUR} AND histology IS NOT NULL",
    counts={"nonsynonymous": "effect = 'nonsynonymous'"}, means={"level": ("level", "coverage > 60")},
    facets=("feature2",)), source=specific, src="specific", ctes=SPEC_CTES)

# --- D37, D39, D41: allele loss ------------------------------------------------------

LOH_ROWS = """loh_rows AS (SELECT obs.*, loh, loh_patient FROM obs JOIN (SELECT sample, patient, tumour, locus, loh FROM prepared) p
  USING (sample, patient, tumour, locus) JOIN (SELECT patient, bool_or(loh) AS loh_patient FROM prepared GROUP BY 1) q USING (patient))"""
LOH_CTES = (LOH, PREPARED, LOH_ROWS)


def loh_rows(spark, d):
    lost = labels.prepare_loh(loh(spark, d))
    rows = observations(spark, d, *WIDE, "locus", "allele", "combine")
    both = natural_join(rows, lost.select("sample", "patient", "tumour", "locus", "loh"))
    return natural_join(both, labels.loh_by_patient(lost))


STRONG = "coverage > 30 AND el < 0.05"
register("d37_loh_by_locus", Study(
    unit=("sample", "locus", "loh"), group="loh", levels=(False, True), where="loh IS NOT NULL AND coverage > 30", item="combine",
    counts={"all_": None, "hot": "immune = 'hot'", "cold": "immune = 'cold'", "hot_strong": "immune = 'hot' AND el < 0.05"},
    means={"level": ("level", None), "level_hot": ("level", "immune = 'hot'"), "level_cold": ("level", "immune = 'cold'"),
           "level_hot_strong": ("level", "immune = 'hot' AND el < 0.05")},
    shares={"strong_share": ("hot_strong", "hot")}), source=loh_rows, src="loh_rows", ctes=LOH_CTES)
register("d37_loh_by_sample", Study(
    unit=("sample", "loh"), group="loh", levels=(False, True), where="loh IS NOT NULL AND coverage > 30",
    counts={"total": None, "neo_hot": "effect = 'nonsynonymous' AND el < 0.1 AND immune = 'hot'"},
    means={"level_neo_hot": ("level", "effect = 'nonsynonymous' AND el < 0.1 AND immune = 'hot'")}),
    source=loh_rows, src="loh_rows", ctes=LOH_CTES)


HETERO = """hetero AS (SELECT loh_rows.* FROM loh_rows JOIN (SELECT sample, locus, loh FROM loh_rows GROUP BY ALL
  HAVING count(DISTINCT allele) > 1) USING (sample, locus, loh))"""


def hetero(spark, d):
    rows = loh_rows(spark, d)
    return grouped.keep_groups(rows, ["sample", "locus", "loh"], F.count_distinct("allele"), lambda n: n > 1)


register("d37_heterogeneous_alleles", Study(
    unit=("sample", "locus", "loh"), group="loh", levels=(False, True), where="coverage > 30 AND immune = 'hot'", item="combine",
    counts={"frequency": None, "strong": "el < 0.05"}, means={"level": ("level", None)},
    shares={"share": ("strong", "frequency")}), source=hetero, src="hetero", ctes=(*LOH_CTES, HETERO))


@query("d37_share_of_sample", with_ctes(OBS, *LOH_CTES, """num AS (SELECT sample, loh, count(DISTINCT event) AS n FROM loh_rows
WHERE coverage > 30 AND effect = 'nonsynonymous' AND el < 0.1 AND immune = 'hot' GROUP BY ALL),
shares AS (SELECT loh, n / CAST(total AS DOUBLE) AS share FROM num JOIN (SELECT sample, count(DISTINCT event) AS total FROM loh_rows
WHERE coverage > 30 GROUP BY 1) USING (sample))""") + rank_sum("shares", [], "loh", "share", ("false", "true")))
def _(spark, d):
    rows = loh_rows(spark, d).filter("coverage > 30")
    hot = (F.col("effect") == "nonsynonymous") & (F.col("el") < 0.1) & (F.col("immune") == "hot")
    shares = grouped.conditional_share(rows, ["sample", "loh"], "event", hot, share_of=["sample"])
    return ranks.rank_sum_by(shares, [], "loh", "share", (False, True))


@query("d37_patients_by_loh_kinds", with_ctes(OBS, *LOH_CTES, """kinds AS (SELECT patient, count(DISTINCT loh) AS nb, count(DISTINCT combine) AS
frequency, avg(level) AS level FROM loh_rows WHERE coverage > 30 AND el < 0.05 GROUP BY 1),
long AS (""" + unpivot("kinds", ["nb"], ["frequency", "level"], "metric", "value") + ")") + rank_sum(
    "long", ["metric"], "nb", "value", ("1", "2")))
def _(spark, d):
    kinds = loh_rows(spark, d).filter(STRONG).groupBy("patient").agg(
        F.count_distinct("loh").alias("nb"), F.count_distinct("combine").alias("frequency"), F.avg("level").alias("level"))
    return ranks.rank_sum_by(profiles.stack(kinds, ["nb"], ["frequency", "level"]), ["metric"], "nb", "value", (1, 2))


register("d39_loh_by_patient", Study(
    unit=("patient", "loh_patient"), group="loh_patient", levels=(False, True), item="combine",
    counts={"total": None, "nonsynonymous": "effect = 'nonsynonymous'", "neo": NEO60, "neo_any": "effect = 'nonsynonymous' AND el < 0.1 AND coverage > 60"},
    means={"level": ("level", "coverage > 60 AND effect = 'nonsynonymous'"),
           "el_score": ("el", "coverage > 60 AND effect = 'nonsynonymous' AND el IS NOT NULL"),
           "ba_score": ("ba", "coverage > 60 AND effect = 'nonsynonymous' AND ba IS NOT NULL")},
    shares={"share": ("neo_any", "total")}), source=loh_rows, src="loh_rows", ctes=LOH_CTES)

ON_LOST = """on_lost AS (SELECT obs.*, lost FROM obs JOIN (SELECT DISTINCT sample, patient, tumour, locus, allele, lost FROM lost WHERE loh) l
  USING (sample, patient, tumour, locus, allele))"""
LOST_CTES = (LOH, PREPARED, LOST, ON_LOST)


def on_lost(spark, d):
    copies = labels.lost_alleles(labels.prepare_loh(loh(spark, d))).filter("loh")
    copies = copies.select("sample", "patient", "tumour", "locus", "allele", "lost").distinct()
    return natural_join(observations(spark, d, *WIDE, "locus", "allele", "combine"), copies)


LOST_SCORES = dict(group="lost", levels=(False, True), where=f"{NEO30} AND ba IS NOT NULL AND lost IS NOT NULL")
register("d41_scores_on_lost_alleles", Study(
    unit=("sample", "event", "lost"), values=("el", "level", "ba"), **LOST_SCORES), source=on_lost, src="on_lost", ctes=LOST_CTES)
register("d41_patient_means_on_lost_alleles", Study(
    unit=("patient", "lost"), means={"el_": ("el", None), "level_": ("level", None), "ba_": ("ba", None)}, **LOST_SCORES),
    source=on_lost, src="on_lost", ctes=LOST_CTES)
register("d41_patients_with_both", Study(
    unit=("sample", "patient", "event", "lost"), within=("patient", "lost"), values=("el", "level", "ba"), **LOST_SCORES),
    source=on_lost, src="on_lost", ctes=LOST_CTES)


@query("d41_share_disrupted", with_ctes(OBS, *LOST_CTES) + f"""SELECT patient, n_item, n_all, {r6('n_item / CAST(n_all AS DOUBLE)')} AS share FROM (
SELECT patient, count(DISTINCT CASE WHEN lost THEN combine END) AS n_item, count(DISTINCT combine) AS n_all FROM on_lost WHERE {NEO30}
GROUP BY 1) WHERE n_item > 0""")
def _(spark, d):
    return grouped.conditional_share(on_lost(spark, d).filter(NEO30), ["patient"], "combine", F.col("lost"))


# --- D30, D31, D51, D56, D61: correlations --------------------------------------------

COHORTS = {"all_": "true", "cold": f"{TUMOUR} AND immune = 'cold'", "hot": f"{TUMOUR} AND immune = 'hot'", "normal": "sample_type = 'normal'"}
D30_COUNTS = {**{f"n_{c}": t for c, t in COHORTS.items()},
              "neo_cold": f"{COHORTS['cold']} AND effect = 'nonsynonymous' AND el < 0.05",
              "neo_hot": f"{COHORTS['hot']} AND effect = 'nonsynonymous' AND el < 0.05"}
D30_MEANS = {**{f"level_{c}": ("level", t) for c, t in COHORTS.items()},
             "level_neo_cold": ("level", D30_COUNTS["neo_cold"])}
D30_SHARES = {"neo_share_hot": ("neo_hot", "n_hot")}
D30_METRICS = [*D30_COUNTS, *D30_MEANS, *D30_SHARES]
D30_SQL = ("units AS (" + profile_sql("(SELECT * FROM obs WHERE coverage > 30)", ["patient"], "event", D30_COUNTS, D30_MEANS, D30_SHARES) + "), "
           "both_ AS (SELECT * FROM units JOIN cells USING (patient)), long AS ("
           + unpivot("both_", ["cell_type", "score"], D30_METRICS, "metric", "x") + ")")


@query("d30_cell_type_correlation", with_ctes(OBS, CELLS, D30_SQL) + tidy(
    bh(spearman_raw("long", ["metric", "cell_type"], "x", "score"), by=["metric"]),
    ["metric", "cell_type", "n", "method"], ["rho", "p_value", "p_adj"]))
def _(spark, d):
    rows = observations(spark, d, *WIDE, "sample_type").filter("coverage > 30")
    units = profiles.profile(rows, ["patient"], "event", D30_COUNTS, D30_MEANS, D30_SHARES)
    return profiles.correlate(units, cell_scores(spark, d), D30_METRICS, "score", by=["cell_type"], adjust=True)


# The main cohort: coverage above 60, all samples.
MAIN_COUNTS, MAIN_MEANS = {"total": None}, {"level": ("level", None)}
D30_MAIN_SQL = ("units AS (" + profile_sql("(SELECT * FROM obs WHERE coverage > 60)", ["patient"], "event", MAIN_COUNTS, MAIN_MEANS)
                + "), both_ AS (SELECT * FROM units JOIN cells USING (patient)), long AS ("
                + unpivot("both_", ["cell_type", "score"], ["total", "level"], "metric", "x") + ")")


@query("d30_cell_type_correlation_main", with_ctes(OBS, CELLS, D30_MAIN_SQL) + tidy(
    bh(spearman_raw("long", ["metric", "cell_type"], "x", "score"), by=["metric"]),
    ["metric", "cell_type", "n", "method"], ["rho", "p_value", "p_adj"]))
def _(spark, d):
    rows = observations(spark, d, "patient", "event", "level", "coverage").filter("coverage > 60")
    units = profiles.profile(rows, ["patient"], "event", MAIN_COUNTS, MAIN_MEANS)
    return profiles.correlate(units, cell_scores(spark, d), ["total", "level"], "score", by=["cell_type"], adjust=True)


D31 = dict(counts={"burden": None, "neo": "effect = 'nonsynonymous' AND el < 0.05"},
           means={"level": ("level", None), "neo_level": ("level", "effect = 'nonsynonymous' AND el < 0.05")},
           shares={"neo_share": ("neo", "burden")})
D31_METRICS = ["burden", "neo", "level", "neo_level", "neo_share"]
D31_SQL = ("units AS (" + profile_sql(f"(SELECT * FROM obs WHERE {TUMOUR} AND coverage > 30)", ["sample", "purity"], "event", **D31)
           + "), long AS (" + unpivot("units", ["purity"], D31_METRICS, "metric", "x") + ")")


def purity_units(spark, d):
    rows = observations(spark, d, "sample", "purity", "event", "effect", "el", "level", "tumour", "coverage")
    return profiles.profile(rows.filter(f"{TUMOUR} AND coverage > 30"), ["sample", "purity"], "event", **D31)


@query("d31_purity_correlation", with_ctes(OBS, D31_SQL) + spearman("long", ["metric"], "x", "purity"))
def _(spark, d):
    return profiles.correlate(purity_units(spark, d), None, D31_METRICS, "purity")


LINE = ", ".join(f"{r6(c)} AS {c}" for c in ("slope", "intercept", "r2"))


def line_sql(src, by, x, y):
    return (f"SELECT {keys(by)}CAST(n AS BIGINT) AS n, {LINE} FROM (SELECT {keys(by)}regr_count({y}, {x}) AS n, regr_slope({y}, {x}) AS slope, "
            f"regr_intercept({y}, {x}) AS intercept, regr_r2({y}, {x}) AS r2 FROM {src} GROUP BY {', '.join(by)})")


@query("d31_purity_lines", with_ctes(OBS, D31_SQL) + line_sql("long", ["metric"], "x", "purity"))
def _(spark, d):
    return profiles.fit_lines(purity_units(spark, d), None, D31_METRICS, "purity")


D51 = dict(counts={"total": None, "ag": "mut_type = 'A>G'", "ct": "mut_type = 'C>T'", "neo": NEO},
           shares={"ag_share": ("ag", "total"), "ct_share": ("ct", "total"), "neo_share": ("neo", "total")})
D51_METRICS = ["total", "ag", "ct", "neo", "ag_share", "ct_share", "neo_share"]
D51_SQL = ("units AS (" + profile_sql("obs", ["patient"], "event", **D51) + "), both_ AS (SELECT * FROM units JOIN expression USING (patient)), long AS ("
           + unpivot("both_", ["gene", "expression"], D51_METRICS, "metric", "x") + ")")


def d51_units(spark, d):
    rows = observations(spark, d, "patient", "event", "mut_type", "effect", "el", "el_wt", "coverage")
    return profiles.profile(rows, ["patient"], "event", **D51)


@query("d51_regulator_correlation", with_ctes(OBS, EXPRESSION, D51_SQL) + spearman("long", ["metric", "gene"], "x", "expression"))
def _(spark, d):
    return profiles.correlate(d51_units(spark, d), expression(spark, d), D51_METRICS, "expression", by=["gene"])


@query("d51_regulator_lines", with_ctes(OBS, EXPRESSION, D51_SQL) + line_sql("long", ["metric", "gene"], "x", "expression"))
def _(spark, d):
    return profiles.fit_lines(d51_units(spark, d), expression(spark, d), D51_METRICS, "expression", by=["gene"])


D56 = dict(counts={"total": None, "neo": NEO}, shares={"neo_share": ("neo", "total")})
D56_METRICS = ["total", "neo", "neo_share", "gene_1", "gene_2"]
D56_SQL = ("units AS (" + profile_sql("obs", ["patient"], "combine", **D56) + """),
both_ AS (SELECT units.*, cell_type, score, a.expression AS gene_1, log2(nullif(b.expression, 0)) AS gene_2 FROM units JOIN cells USING (patient)
LEFT JOIN (SELECT * FROM expression WHERE gene = 'Brand#1') a USING (patient) LEFT JOIN (SELECT * FROM expression WHERE gene = 'Brand#2') b
USING (patient)), long AS (""" + unpivot("both_", ["cell_type", "score"], D56_METRICS, "metric", "x") + ")")


@query("d56_abundance_correlation", with_ctes(OBS, CELLS, EXPRESSION, D56_SQL) + spearman("long", ["metric", "cell_type"], "x", "score"))
def _(spark, d):
    rows = observations(spark, d, "patient", "event", "allele", "combine", "effect", "el", "el_wt", "coverage")
    units = profiles.profile(rows, ["patient"], "combine", **D56)
    genes = reshape.wide_from_long(expression(spark, d).filter("gene in ('Brand#1', 'Brand#2')"), ["patient"], "gene",
                                   "expression", ["Brand#1", "Brand#2"])
    genes = genes.select("patient", F.col("Brand#1").alias("gene_1"), F.log2(F.nullif("Brand#2", F.lit(0.0))).alias("gene_2"))
    units = natural_join(units, genes, "left")
    return profiles.correlate(units, cell_scores(spark, d), D56_METRICS, "score", by=["cell_type"])


D61_COUNTS = {"total": None, "neo": f"{TUMOUR} AND coverage > 30 AND el < 0.05 AND effect = 'nonsynonymous'"}


@query("d61_share_and_level", with_ctes(OBS, "units AS (" + profile_sql(
    "obs", ["sample"], "event", D61_COUNTS, {"level": ("level", D61_COUNTS["neo"])}, {"proportion": ("neo", "total")}) + ")") +
    f"SELECT sample, {r6('proportion')} AS proportion, {r6('level')} AS level FROM units WHERE proportion IS NOT NULL")
def _(spark, d):
    rows = observations(spark, d, "sample", "event", "tumour", "coverage", "el", "effect", "level")
    units = profiles.profile(rows, ["sample"], "event", D61_COUNTS, {"level": ("level", D61_COUNTS["neo"])}, {"proportion": ("neo", "total")})
    return units.filter("proportion is not null").select("sample", "proportion", "level")


@query("d61_loci", BASE + "SELECT DISTINCT locus FROM alleles")
def _(spark, d):
    return observations(spark, d, "locus").distinct()


# --- D14, D43, D44, D45, D49, D52, D53: genes, sets, slices ---------------------------

PRESENCE = f"""carriers AS (SELECT DISTINCT patient, gene, true AS present FROM obs WHERE {NEO}),
presence AS (SELECT e.patient, e.gene, expression, coalesce(present, false) AS present, log2(expression) AS value FROM expression e
  JOIN (SELECT DISTINCT patient FROM obs) USING (patient) LEFT JOIN carriers c ON c.patient = e.patient AND c.gene = e.gene
  WHERE e.gene IN (SELECT gene FROM carriers) AND expression > 0)"""


def presence(spark, d):
    rows = observations(spark, d, "patient", "gene", "effect", "el", "el_wt", "coverage").withColumn(
        "neoantigenic", labels.neoantigen_test())
    carriers = labels.variant_presence(rows)
    cells = joins.keep_matching(expression(spark, d), rows.select("patient").distinct())
    cells = joins.keep_matching(cells, carriers.select("gene").distinct())
    return joins.flag_matching(cells, carriers, "present").withColumn("value", F.log2("expression"))


@query("d14_variant_presence", with_ctes(OBS, EXPRESSION, PRESENCE) + f"SELECT patient, gene, present, {r6('value')} AS value FROM presence")
def _(spark, d):
    return presence(spark, d).select("patient", "gene", "present", "value")


@query("d14_expression_by_presence", with_ctes(OBS, EXPRESSION, PRESENCE) + "SELECT *, CASE WHEN p_value <= 0.0001 THEN '****' "
       "WHEN p_value <= 0.001 THEN '***' WHEN p_value <= 0.01 THEN '**' WHEN p_value <= 0.05 THEN '*' WHEN p_value IS NOT NULL THEN 'ns' END "
       "AS stars FROM (" + rank_sum("presence", ["gene"], "present", "value", ("false", "true")) + ")")
def _(spark, d):
    tests = ranks.rank_sum_by(presence(spark, d), ["gene"], "present", "value", (False, True))
    return tests.withColumn("stars", stars("p_value"))


@query("d14_boxes", with_ctes(OBS, EXPRESSION, PRESENCE) + box("presence", ["gene", "present"], "value"))
def _(spark, d):
    return moments.box_stats_by(presence(spark, d), ["gene", "present"], "value")


SAMPLE_EXPR = """sample_expr AS (SELECT sample, gene, avg(ba) AS expression FROM obs WHERE ba IS NOT NULL GROUP BY ALL),
classed AS (SELECT e.*, tumour, immune, sample_type, patient FROM sample_expr e JOIN samples USING (sample)),
both_ AS (SELECT classed.* FROM classed JOIN (SELECT tumour, gene FROM classed WHERE immune IS NOT NULL AND tumour IS NOT NULL GROUP BY ALL
  HAVING count(DISTINCT immune) > 1) USING (tumour, gene) WHERE immune IS NOT NULL)"""


def long_expression(spark, d):
    """Mean expression per sample and gene, with what is known of the sample."""
    cells = observations(spark, d, "sample", "gene", "ba").filter("ba is not null").groupBy("sample", "gene").agg(
        F.avg("ba").alias("expression"))
    return natural_join(cells, samples(spark, d).select("sample", "tumour", "immune", "sample_type", "patient"))


def expression_both(spark, d):
    rows = long_expression(spark, d).filter(f"{BOTH}")
    return grouped.keep_groups(rows, ["tumour", "gene"], F.count_distinct("immune"), lambda n: n > 1)


@query("d43_expression_by_class", with_ctes(OBS, SAMPLE_EXPR) + rank_sum("both_", ["gene"], "immune", "expression", ("'cold'", "'hot'")))
def _(spark, d):
    return ranks.rank_sum_by(expression_both(spark, d), ["gene"], "immune", "expression", COLD_HOT)


@query("d43_gene_means_paired", with_ctes(OBS, SAMPLE_EXPR, "means AS (SELECT gene, immune, avg(expression) AS value FROM both_ GROUP BY ALL)")
       + signed_rank("means", [], "gene", "immune", "value", ("'cold'", "'hot'")))
def _(spark, d):
    means = expression_both(spark, d).groupBy("gene", "immune").agg(F.avg("expression").alias("value"))
    return ranks.signed_rank_by(means, [], "gene", "immune", "value", COLD_HOT)


@query("d43_expression_by_sample_type", with_ctes(OBS, SAMPLE_EXPR) + rank_sum("classed", ["gene"], "sample_type", "expression", ("'normal'", "'tumour'")))
def _(spark, d):
    return ranks.rank_sum_by(long_expression(spark, d), ["gene"], "sample_type", "expression", ("normal", "tumour"))


D53_SQL = """means AS (SELECT gene, patient, sample_type, avg(expression) AS value FROM classed JOIN (
  SELECT patient FROM classed GROUP BY 1 HAVING count(DISTINCT sample_type) > 1) USING (patient)
  WHERE gene IN ('Brand#1', 'Brand#2') GROUP BY ALL)"""


@query("d53_regulators_normal_against_tumour", with_ctes(OBS, SAMPLE_EXPR, D53_SQL) + rank_sum(
    "means", ["gene"], "sample_type", "value", ("'normal'", "'tumour'")))
def _(spark, d):
    rows = long_expression(spark, d)
    paired = joins.keep_matching(rows, labels.paired_patients(rows)).filter("gene in ('Brand#1', 'Brand#2')")
    means = paired.groupBy("gene", "patient", "sample_type").agg(F.avg("expression").alias("value"))
    return ranks.rank_sum_by(means, ["gene"], "sample_type", "value", ("normal", "tumour"))


@query("d44_gene_summary", BASE + f"""SELECT gene, {r6('max(n / 354.0)')} AS average, {r6('avg(level) / 2')} AS editing_level FROM (
SELECT DISTINCT event, allele, tumour, level, el, gene FROM obs WHERE {TUMOUR} AND effect = 'nonsynonymous' AND el < 0.05)
JOIN (SELECT event, allele, count(DISTINCT tumour) AS n FROM obs WHERE {TUMOUR} AND effect = 'nonsynonymous' AND el < 0.05 GROUP BY ALL)
USING (event, allele) GROUP BY 1 ORDER BY average DESC""")
def _(spark, d):
    rows = observations(spark, d, "event", "allele", "tumour", "level", "el", "gene", "effect").filter(
        f"{TUMOUR} AND effect = 'nonsynonymous' AND el < 0.05").drop("effect").distinct()
    rows = grouped.add_group_stats(rows, (["event", "allele"], {"n": F.count_distinct("tumour")}))
    return rows.groupBy("gene").agg((F.max("n") / F.lit(354.0)).alias("average"), (F.avg("level") / 2).alias("editing_level")
                                    ).orderBy(F.desc("average"))


@query("d45_type_share", BASE + f"""SELECT mut_type, count(DISTINCT event) AS n_item, {r6('count(DISTINCT event) / 38.0')} AS share
FROM obs WHERE {NEO30} GROUP BY 1 ORDER BY n_item DESC""")
def _(spark, d):
    rows = observations(spark, d, "event", "mut_type", "effect", "el", "el_wt", "coverage").filter(NEO30)
    return grouped.parent_share(rows, ["mut_type"], [], "event", denominator=38).orderBy(F.desc("n_item"))


@query("d49_event_sets", BASE + """SELECT event, count(DISTINCT sample) AS n_sample, count(DISTINCT tumour) AS n_tumour, part FROM obs JOIN (
SELECT event, CASE WHEN bool_or(immune = 'hot') AND bool_or(immune = 'cold') THEN 'both' WHEN bool_or(immune = 'cold') THEN 'cold only' END
AS part FROM obs WHERE coverage > 90 AND immune IS NOT NULL GROUP BY 1) USING (event) WHERE part IS NOT NULL GROUP BY event, part""")
def _(spark, d):
    obs = observations(spark, d, "event", "sample", "tumour", "immune", "coverage")
    seen = {c: F.bool_or((F.col("coverage") > 90) & (F.col("immune") == c)).alias(c) for c in ("hot", "cold")}
    sets = obs.groupBy("event").agg(F.count_distinct("sample").alias("n_sample"), F.count_distinct("tumour").alias("n_tumour"), *seen.values())
    return sets.filter("event is not null and cold").select(
        "event", F.when(F.col("hot"), "both").otherwise("cold only").alias("part"), "n_sample", "n_tumour")


def slices_sql(name):
    return BASE + f"""SELECT {name}, n, CAST(total AS BIGINT) AS total, {r6('share')} AS share, {r6('stacked')} AS stacked,
{r6(f'share * 50 + coalesce(lead(stacked) OVER (ORDER BY share, {name}), 0)')} AS position,
printf('%.1f%%', round(share * 100 + 1e-9, 1)) AS label FROM (SELECT *, sum(share * 100) OVER (ORDER BY share DESC, {name} DESC) AS stacked
FROM (SELECT {name}, count(DISTINCT event) AS n, sum(count(DISTINCT event)) OVER () AS total, n / CAST(total AS DOUBLE) AS share FROM obs GROUP BY 1))"""


for _name in ("effect", "mut_type", "histology"):
    query(f"d52_slices_{_name}", slices_sql(_name))(lambda spark, d, name=_name: moments.slice_positions(
        observations(spark, d, name, "event").groupBy(name).agg(F.count_distinct("event").alias("n")), name, "n"))

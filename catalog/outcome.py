"""Survival and mixed-model studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.cohort import EXPRESSION, OBS, SURVIVAL, expression, observations, survival, with_ctes
from catalog.comparison import profile_sql
from catalog.ingest import NEO
from catalog.registry import query
from catalog.sqlkit import cox, cox_ctes, km, log_rank, reml, reml_ctes
from catalog.statistics import four_decimals
from cohortry.operators.joins import natural_join
from cohortry.plans import outcome
from cohortry.plans.profiles import profile

NEO30 = "effect = 'nonsynonymous' AND el < 0.1 AND el_wt > el AND coverage > 30"

TABLE = ("events_ AS (" + profile_sql("obs", ["patient"], "event", {"total_event": None, "neo_event": NEO},
                                      shares={"neo_share": ("neo_event", "total_event")}, zero=("neo_event", "neo_share"))
         + "), pairs_ AS (" + profile_sql("obs", ["patient"], "combine", {"total_combine": None, "neo_burden": NEO}, zero=("neo_burden",))
         + "), followed AS (SELECT * FROM events_ JOIN pairs_ USING (patient) JOIN survival USING (patient))")


def split(x, src="followed"):
    return f"split_ AS (SELECT *, {x} > (SELECT median({x}) FROM {src}) AS above_median FROM {src})"


def followed(spark, d):
    rows = observations(spark, d, "patient", "event", "combine", neo=NEO)
    return outcome.burden_table(rows, survival(spark, d), "neo")


SIDES, NAMES = ("false", "true"), ("False", "True")
ENDS = outcome.ENDS
MEASURES = {"neoantigens": "neo_burden", "burden": "total_event", "share": "neo_share"}


for _label, _x in MEASURES.items():
    for _end, (_time, _event) in ENDS.items():
        query(f"d54_curves_by_{_label}_{_end}", with_ctes(OBS, SURVIVAL, TABLE, split(_x)) + km("split_", ["above_median"], _time, _event))(
            lambda spark, d, x=_x, end=_end: outcome.split_curves(followed(spark, d), x, end))
        query(f"d54_log_rank_by_{_label}_{_end}",
              with_ctes(OBS, SURVIVAL, TABLE, split(_x)) + log_rank("split_", [], _time, _event, "above_median", SIDES, NAMES))(
            lambda spark, d, x=_x, end=_end: outcome.split_test(followed(spark, d), x, end))

for _by in ("stage", "sex"):
    query(f"d54_log_rank_per_{_by}", with_ctes(OBS, SURVIVAL, TABLE, split("neo_burden")) + log_rank(
        "split_", [_by], "os_time", "cens_os", "above_median", SIDES, NAMES))(
        lambda spark, d, by=_by: outcome.split_test(followed(spark, d), "neo_burden", "os", [by]))


@query("d54_sex_by_side", with_ctes(OBS, SURVIVAL, TABLE, split("neo_burden")) +
       "SELECT sex, above_median, count(*) AS n FROM split_ GROUP BY ALL")
def _(spark, d):
    return outcome.split_table(followed(spark, d), "neo_burden", "sex")


COUNTS = ["total_event", "total_combine", "neo_burden"]


@query("d54_cox_burden", with_ctes(OBS, SURVIVAL, TABLE, *cox_ctes("followed", "os_time", "cens_os", COUNTS)) + cox())
def _(spark, d):
    return outcome.hazards(followed(spark, d), COUNTS, "os")


# Per region: each region has the follow-up of its patient, and regions without the counted items are absent.
REGION = ["sample", "patient"]
NONSYN = "effect = 'nonsynonymous'"
PRESENT = {"burden": ("event", NONSYN, False), "neoantigens": ("combine", NEO, False), "share": ("event", NEO, True)}


def region_sql(item, test, share):
    if share:
        units = profile_sql("obs", REGION, item, {"n_all": None, "n_item": test}, shares={"x": ("n_item", "n_all")})
    else:
        units = profile_sql(f"(SELECT * FROM obs WHERE {test})", REGION, item, {"x": None})
    return f"followed AS (SELECT * FROM ({units}) JOIN survival USING (patient) WHERE x IS NOT NULL)"


def regions(spark, d, label):
    rows = observations(spark, d, *REGION, "event", "combine", "effect", "el", "el_wt", "coverage")
    return outcome.present_burden(rows, survival(spark, d), REGION, *PRESENT[label])


for _label, _how in PRESENT.items():
    _head = with_ctes(OBS, SURVIVAL, region_sql(*_how), split("x"))
    for _end, (_time, _event) in ENDS.items():
        query(f"d54_region_curves_by_{_label}_{_end}", _head + km("split_", ["above_median"], _time, _event))(
            lambda spark, d, label=_label, end=_end: outcome.split_curves(regions(spark, d, label), "x", end))
        query(f"d54_region_log_rank_by_{_label}_{_end}", _head + log_rank("split_", [], _time, _event, "above_median", SIDES, NAMES))(
            lambda spark, d, label=_label, end=_end: outcome.split_test(regions(spark, d, label), "x", end))

_head = with_ctes(OBS, SURVIVAL, region_sql(*PRESENT["neoantigens"]), split("x"))
for _by in ("stage", "sex"):
    for _end, (_time, _event) in ENDS.items():
        query(f"d54_region_curves_per_{_by}_{_end}", _head + km("split_", [_by, "above_median"], _time, _event))(
            lambda spark, d, by=_by, end=_end: outcome.split_curves(regions(spark, d, "neoantigens"), "x", end, [by]))
        query(f"d54_region_log_rank_per_{_by}_{_end}", _head + log_rank("split_", [_by], _time, _event, "above_median", SIDES, NAMES))(
            lambda spark, d, by=_by, end=_end: outcome.split_test(regions(spark, d, "neoantigens"), "x", end, [by]))


@query("d54_region_sex_by_side", _head + "SELECT sex, above_median, count(*) AS n FROM split_ GROUP BY ALL")
def _(spark, d):
    return outcome.split_table(regions(spark, d, "neoantigens"), "x", "sex")


SCORED = "el IS NOT NULL AND effect = 'nonsynonymous'"
SCORED_TABLE = (f"scored AS (SELECT * FROM obs WHERE {SCORED}), followed AS (SELECT * FROM ("
                + profile_sql("scored", REGION, "event", {"total_event": None}) + ") JOIN ("
                + profile_sql("scored", REGION, "combine", {"total_combine": None, "neo_burden": NEO})
                + ") USING (sample, patient) JOIN survival USING (patient) WHERE neo_burden IS NOT NULL)")


def scored_regions(spark, d):
    rows = observations(spark, d, *REGION, "event", "combine", "effect", "el", "el_wt", "coverage").filter(SCORED)
    return outcome.scored_burden(rows, survival(spark, d), REGION, NEO)


@query("d54_region_cox_burden", with_ctes(OBS, SURVIVAL, SCORED_TABLE, *cox_ctes("followed", "os_time", "cens_os", COUNTS)) + cox())
def _(spark, d):
    return outcome.hazards(scored_regions(spark, d), COUNTS, "os")


@query("d54_region_log_rank_scored_os", with_ctes(OBS, SURVIVAL, SCORED_TABLE, split("neo_burden")) + log_rank(
    "split_", [], "os_time", "cens_os", "above_median", SIDES, NAMES))
def _(spark, d):
    return outcome.split_test(scored_regions(spark, d), "neo_burden", "os")


def expression_followed(spark, d):
    wide = expression(spark, d).filter("gene in ('Brand#1', 'Brand#2')").groupBy("patient").agg(
        F.max(F.when(F.col("gene") == "Brand#1", F.col("expression"))).alias("gene_1"),
        F.max(F.when(F.col("gene") == "Brand#2", F.col("expression"))).alias("gene_2"))
    return natural_join(wide, survival(spark, d))


GENE_TABLE = """followed AS (SELECT * FROM (SELECT patient, max(CASE WHEN gene = 'Brand#1' THEN expression END) AS gene_1,
  max(CASE WHEN gene = 'Brand#2' THEN expression END) AS gene_2 FROM expression WHERE gene IN ('Brand#1', 'Brand#2') GROUP BY 1)
  JOIN survival USING (patient))"""


@query("d54_cox_expression", with_ctes(EXPRESSION, SURVIVAL, GENE_TABLE, *cox_ctes("followed", "os_time", "cens_os", ["gene_1", "gene_2"])) + cox())
def _(spark, d):
    return outcome.hazards(expression_followed(spark, d), ["gene_1", "gene_2"], "os")


for _gene in ("gene_1", "gene_2"):
    for _end, (_time, _event) in ENDS.items():
        query(f"d54_log_rank_by_{_gene}_{_end}", with_ctes(EXPRESSION, SURVIVAL, GENE_TABLE, split(_gene)) + log_rank(
            "split_", [], _time, _event, "above_median", SIDES, NAMES))(
            lambda spark, d, x=_gene, end=_end: outcome.split_test(expression_followed(spark, d), x, end))


UNIT = ["immune", "tumour", "patient", "sample"]


def class_units(spark, d):
    rows = observations(spark, d, *UNIT, "event", "effect", "el", "el_wt", "coverage", "level", "ba").filter(
        "immune is not null and tumour is not null")
    return profile(rows, UNIT, "event", {"total": None, "neo": NEO30},
                   {"level": ("level", "coverage > 60 AND effect = 'nonsynonymous'"),
                    "affinity": ("ba", "coverage > 60 AND effect = 'nonsynonymous' AND el IS NOT NULL")})


CLASS_UNITS = ("class_units AS (SELECT *, CASE WHEN immune = 'cold' THEN 0 ELSE 1 END AS is_other FROM (" + profile_sql(
    "(SELECT * FROM obs WHERE immune IS NOT NULL AND tumour IS NOT NULL)", UNIT, "event", {"total": None, "neo": NEO30},
    {"level": ("level", "coverage > 60 AND effect = 'nonsynonymous'"),
     "affinity": ("ba", "coverage > 60 AND effect = 'nonsynonymous' AND el IS NOT NULL")}) + "))")


for _measure in ("total", "neo", "level", "affinity"):
    query(f"d55_mixed_model_{_measure}", with_ctes(OBS, CLASS_UNITS, *reml_ctes("class_units", _measure, "is_other", "tumour")) + reml("is_other"))(
        lambda spark, d, measure=_measure: four_decimals(outcome.class_model(class_units(spark, d), measure)))


# The three models on well-covered, scored, nonsynonymous rows, and the neoantigen count by the flag of the notebook.
SCORED60 = "immune IS NOT NULL AND tumour IS NOT NULL AND coverage > 60 AND el IS NOT NULL AND effect = 'nonsynonymous'"
SCORED_MEANS = {"level": ("level", None), "affinity": ("ba", None)}
IS_OTHER = "SELECT *, CASE WHEN immune = 'cold' THEN 0 ELSE 1 END AS is_other FROM"
SCORED_UNITS = f"scored_units AS ({IS_OTHER} (" + profile_sql(f"(SELECT * FROM obs WHERE {SCORED60})", UNIT, "event", {"total": None}, SCORED_MEANS) + "))"
FLAGGED_UNITS = f"flagged_units AS ({IS_OTHER} (" + profile_sql(
    f"(SELECT * FROM obs WHERE immune IS NOT NULL AND tumour IS NOT NULL AND {NEO})", UNIT, "event", {"neo": None}) + "))"


def scored_units(spark, d):
    rows = observations(spark, d, *UNIT, "event", "effect", "el", "coverage", "level", "ba").filter(SCORED60)
    return profile(rows, UNIT, "event", {"total": None}, SCORED_MEANS)


for _measure in ("total", "level", "affinity"):
    query(f"d55_scored_model_{_measure}", with_ctes(OBS, SCORED_UNITS, *reml_ctes("scored_units", _measure, "is_other", "tumour")) + reml("is_other"))(
        lambda spark, d, measure=_measure: four_decimals(outcome.class_model(scored_units(spark, d), measure)))


@query("d55_flagged_model_neo", with_ctes(OBS, FLAGGED_UNITS, *reml_ctes("flagged_units", "neo", "is_other", "tumour")) + reml("is_other"))
def _(spark, d):
    rows = observations(spark, d, *UNIT, "event", "effect", "el", "el_wt", "coverage").filter(f"{NEO} AND immune IS NOT NULL AND tumour IS NOT NULL")
    return four_decimals(outcome.class_model(profile(rows, UNIT, "event", {"neo": None}), "neo"))

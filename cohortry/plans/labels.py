"""Label columns that later comparisons group by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.nullrules import column, matches, n_distinct, str_c
from cohortry.operators.joins import flag_matching, keep_matching


def canonical_allele(c) -> Column:
    """``hla_a_03_01`` to ``HLA-A*03:01``; missing when a part is missing."""
    part = F.split(F.upper(column(c)), "_")
    bit = [F.get(part, F.lit(i)) for i in range(4)]
    return F.concat(bit[0], F.lit("-"), bit[1], F.lit("*"), bit[2], F.lit(":"), bit[3])


def sample_labels(df: DataFrame, code: str = "sample_code") -> DataFrame:
    """Normal or tumour, primary or metastatic, and the event-allele key."""
    c = F.col(code)
    # The sample-code prefixes of the cohort.
    primary, spread = ["SU_T", "SU_LN"], ["BR", "BP", "MR"]

    def starts(prefixes):
        test = c.startswith(prefixes[0])
        for p in prefixes[1:]:
            test = test | c.startswith(p)
        return test

    return (df.withColumn("sample_type", F.when(matches(code, "SU_N"), "normal").otherwise("tumour"))
            .withColumn("status", F.when(starts(primary), "Primary").when(starts(spread), "Meta_recur"))
            .withColumn("combine", str_c("event", F.lit("_"), "allele")))


def presence_label(df: DataFrame, keys: list[str], sample_type: str = "sample_type") -> DataFrame:
    """Per key: seen in tumour, in normal, or in both samples."""
    tumour = F.bool_or(F.col(sample_type) == "tumour").alias("_in_tumour")
    normal = F.bool_or(F.col(sample_type) == "normal").alias("_in_normal")
    seen = df.groupBy(*keys).agg(tumour, normal)
    label = (F.when(F.col("_in_tumour") & F.col("_in_normal"), "shared")
             .when(F.col("_in_tumour"), "tumour-specific").otherwise("normal-specific"))
    return seen.select(*keys, label.alias("feature"))


def paired_patients(df: DataFrame) -> DataFrame:
    """Patients that have both normal and tumour samples."""
    return df.groupBy("patient").agg(n_distinct("sample_type").alias("_n")).filter("_n > 1").select("patient")


def patient_features(df: DataFrame) -> DataFrame:
    """Label of each (patient, combine), for paired patients only."""
    labels = presence_label(df, ["patient", "combine"])
    return keep_matching(labels, paired_patients(df))


def event_features(df: DataFrame) -> DataFrame:
    """Label of each event over the whole cohort; missing if seen only in normal samples."""
    return presence_label(df, ["event"]).withColumn(
        "feature", F.when(F.col("feature") != "normal-specific", F.col("feature")))


def neoantigen_test(el_below: float = 0.1, coverage_above: float = 60,
                    effect: str = "nonsynonymous") -> Column:
    return F.coalesce((F.col("effect") == effect) & (F.col("el") < el_below)
                      & (F.col("el_wt") > F.col("el")) & (F.col("coverage") > coverage_above), F.lit(False))


def mark_neoantigens(df: DataFrame, **thresholds) -> DataFrame:
    """Row flag ``neoantigenic`` and event flag ``neo_event``."""
    marked = df.withColumn("neoantigenic", neoantigen_test(**thresholds))
    return flag_matching(marked, marked.filter("neoantigenic").select("event"), "neo_event")


def downregulated(de: DataFrame, log_fc_below: float = -0.1, p_below: float = 0.05) -> DataFrame:
    """Per gene: false when it is significantly lower, true otherwise."""
    lower = F.coalesce((F.col("log_fc") < log_fc_below) & (F.col("adj_p") < p_below), F.lit(False))
    return de.select("gene", (~lower).alias("de_ok"))


def prepare_loh(loh: DataFrame) -> DataFrame:
    return loh.filter("passed").select(
        "sample", "patient", "tumour", "locus", "allele1", "allele2", "cn1", "cn2", "loh").distinct()


def loh_by_patient(loh: DataFrame) -> DataFrame:
    return loh.groupBy("patient").agg(F.bool_or("loh").alias("loh_patient"))


def lost_alleles(loh: DataFrame, only_loh: bool = False) -> DataFrame:
    """One row per allele copy: lost when its copy number is the lower one."""
    rows = loh.filter(F.col("cn1").isNotNull() & F.col("cn2").isNotNull())
    if only_loh:
        rows = rows.filter("loh")
    named = rows.withColumn("allele.1", canonical_allele("allele1")).withColumn(
        "allele.2", canonical_allele("allele2"))
    ids = [c for c in named.columns if c not in ("allele.1", "allele.2")]
    long = named.unpivot(ids, [F.col("`allele.1`"), F.col("`allele.2`")], "slot", "allele")
    lost = F.when(F.col("slot") == "allele.1", F.col("cn1") < F.col("cn2")).otherwise(
        F.col("cn2") < F.col("cn1"))
    return long.withColumn("lost", lost)


def majority_class(df: DataFrame) -> DataFrame:
    """Immune class that holds more of a paired patient's tumours; ties have none."""
    rows = keep_matching(df.filter("immune is not null"), paired_patients(df))
    sides = (rows.select("patient", "immune", "tumour").distinct().groupBy("patient").agg(
        F.count_if(F.col("immune") == "cold").alias("cold"),
        F.count_if(F.col("immune") == "hot").alias("hot")))
    return sides.filter("cold != hot").select(
        "patient", F.when(F.col("cold") > F.col("hot"), "cold").otherwise("hot").alias("assigned"))


def mixed_class(df: DataFrame) -> DataFrame:
    """``immune_patient``: the patient's class, or ``mixed`` where it has both."""
    rows = df.filter("immune is not null")
    both = rows.groupBy("patient").agg(F.count_distinct("immune").alias("_n")).filter("_n > 1")
    return flag_matching(rows, both.select("patient"), "_both").withColumn(
        "immune_patient", F.when(F.col("_both"), "mixed").otherwise(F.col("immune"))).drop("_both")


def variant_presence(df: DataFrame, unit: str = "patient") -> DataFrame:
    """(unit, gene) cells in which the gene carries a neoantigenic event."""
    return df.filter("neoantigenic").select(unit, "gene").distinct()



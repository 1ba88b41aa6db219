"""From input tables to the observation table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.nullrules import as_number, n_distinct, paste0
from cohortry.operators.grouped import add_group_stats, keep_groups, pick_where
from cohortry.operators.joins import drop_matching, keep_matching, natural_join
from cohortry.sources.layout import KeyedTable


def resolve_purity(calls: DataFrame) -> DataFrame:
    """First estimate where the call is OK, adjusted where it was rerun, else missing."""
    # The call codes of the quality sheet.
    purity = (F.when(F.col("call") == "OK", as_number("purity_first"))
              .when(F.col("call").isin("RERUN", "RERUN_NOVEL"), as_number("purity_adjusted")))
    return calls.select(F.regexp_replace("sample", r"\.", "-").alias("sample"), purity.alias("purity"))


def attach_samples(events: DataFrame, samples: DataFrame, immune: DataFrame) -> DataFrame:
    return natural_join(natural_join(events, samples).distinct(), immune, "left").distinct()


def attach_samples_keyed(events: KeyedTable, samples: KeyedTable, immune: KeyedTable) -> KeyedTable:
    """:func:`attach_samples` over tables laid out by sample: no row of an ordinary sample is moved."""
    return events.join(samples).distinct().join(immune, "left").distinct()


def passes_quality(unresolved: str = "*"):
    return F.coalesce(F.col("pass_present") & F.col("pass_homo") & (F.col("mut_type") != unresolved), F.lit(False))


def quality_filter(events: DataFrame, unresolved: str = "*") -> DataFrame:
    return events.filter(passes_quality(unresolved))


def recurrent_events(df: DataFrame, more_than: int = 10, unit: str = "tumour") -> DataFrame:
    """Rows of the events found in more than so many tumours; ``nb_tumour`` says in how many."""
    return keep_groups(df, ["event"], n_distinct(unit), lambda n: n > more_than, keep="nb_tumour").distinct()


def recurrence_counts(df: DataFrame, more_than: int = 10, unit: str = "tumour") -> DataFrame:
    """Number of events before and after the recurrence filter."""
    per_event = df.groupBy("event").agg(n_distinct(unit).alias("_n"))
    return per_event.agg(F.count(F.lit(1)).alias("n_before"), F.count_if(F.col("_n") > more_than).alias("n_after"))


def fill_homozygous(hla: DataFrame, mark: str = "-") -> DataFrame:
    """Replace the homozygous mark by the patient's first allele of that locus."""
    filled = pick_where(hla, ["locus", "patient"], "allele", F.col("slot") == "allele_1", "_first")
    return filled.withColumn("allele", F.when(F.col("allele") == mark, F.col("_first")).otherwise(
        F.col("allele"))).drop("_first")


def typed_alleles(hla: DataFrame, untyped: str = "Not typed") -> DataFrame:
    return hla.filter(F.col("allele") != untyped).distinct()


def common_alleles(hla: DataFrame, more_than: int = 20) -> DataFrame:
    common = hla.groupBy("allele").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > more_than)
    return keep_matching(hla, common.select("allele"))


def type_conflicts(df: DataFrame) -> DataFrame:
    """Rows per (event, mutation type) of the events that have more than one type."""
    counts = df.groupBy("event", "mut_type").agg(F.count(F.lit(1)).alias("n"))
    return keep_groups(counts, ["event"], F.count(F.lit(1)), lambda n: n > 1, keep="n_types")


def resolve_types(df: DataFrame, wrong: DataFrame | None = None) -> DataFrame:
    """Drop the listed (event, mut_type) pairs; without a list keep each event's most
    frequent type, the first in text order on a tie."""
    if wrong is not None:
        return drop_matching(df, wrong, ["event", "mut_type"])
    counts = df.groupBy("event", "mut_type").agg(F.count(F.lit(1)).alias("_n"))
    best = counts.groupBy("event").agg(F.min(F.struct((-F.col("_n")).alias("n"), "mut_type")).alias("_best"))
    return keep_matching(df, best.select("event", F.col("_best.mut_type").alias("mut_type")))


def event_key(binding: DataFrame) -> DataFrame:
    """Binding scores under the event's ``chrom:pos:ref:alt`` name."""
    colon = F.lit(":")
    key = paste0("chrom", colon, "pos", colon, "ref", colon, "alt")
    return binding.select(key.alias("event"), "el", "el_wt", "ba", "allele_key").distinct()


def assemble(events: DataFrame, hla: DataFrame, purity: DataFrame) -> DataFrame:
    """Distinct events with the patient's alleles and the sample's purity.

    The inputs are made distinct, so their join is: no row is compared after the alleles have multiplied it.
    """
    return natural_join(natural_join(events.distinct(), hla.distinct()), purity.distinct(), "left")


def assemble_keyed(events: KeyedTable, hla: DataFrame, purity: KeyedTable) -> DataFrame:
    """:func:`assemble` over tables laid out by sample: the purity joins in place, only the patient's alleles need an exchange."""
    return natural_join(events.distinct().join(purity, "left").rows(), hla).distinct()


def class_one(df: DataFrame, binding: DataFrame, loci=("A", "B", "C"), key_length: int = 11) -> DataFrame:
    """Nonsynonymous rows of the class-I loci with the scores of their allele."""
    rows = df.filter(F.col("locus").isin(*loci) & (F.col("effect") == "nonsynonymous"))
    return natural_join(rows.withColumn("allele_key", F.substring("allele", 1, key_length)), binding)


def tumour_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct nonsynonymous tumour rows with each allele's tumours and samples."""
    rows = df.filter(F.col("tumour").isNotNull() & (F.col("effect") == "nonsynonymous")).select(*columns).distinct()
    return add_group_stats(rows, (["allele"], {"total_tumour": n_distinct("tumour"),
                                               "total_sample": n_distinct("sample")}))

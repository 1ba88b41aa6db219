"""Event-allele associations, their null and their displays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.nullrules import divide, n_distinct, n_distinct_where
from cohortry.operators.adjust import p_adjust_bh, significant_rows
from cohortry.operators.contingency import chisq_by
from cohortry.operators.grouped import keep_groups, parent_share
from cohortry.operators.joins import keep_matching, natural_join
from cohortry.operators.permute import permutation_null, permutation_test
from cohortry.operators.reshape import wide_from_long
from cohortry.plans.labels import majority_class

CLASSES = {"cold": "cold", "hot": "hot"}


def hit_cells(df: DataFrame, cell: list[str], whole: list[str], unit: str = "tumour") -> DataFrame:
    """Units per cell, and the rest of the coarser group's units."""
    cells = parent_share(df, cell, whole, unit)
    return cells.select(*cell, F.col("n_item").alias("hit"), (F.col("n_all") - F.col("n_item")).alias("miss"))


def event_by_allele(df: DataFrame, event: str = "event", unit: str = "tumour") -> DataFrame:
    """Is the event spread unevenly over the alleles of a locus?"""
    cells = hit_cells(df, [event, "allele", "locus"], ["allele"], unit)
    return p_adjust_bh(chisq_by(cells, [event, "locus"], "hit", "miss"))


def allele_by_event(df: DataFrame, unit: str = "tumour") -> DataFrame:
    """Is the allele spread unevenly over the events of a mutation type?"""
    cells = hit_cells(df, ["event", "allele", "locus", "mut_type"], ["event"], unit)
    return p_adjust_bh(chisq_by(cells, ["allele", "mut_type"], "hit", "miss"))


def permutation_association(df: DataFrame, row_id: str, event: str = "event", unit: str = "tumour",
                            reps: int = 100, seed: int = 123, null_cohort: DataFrame | None = None) -> DataFrame:
    """Observed cell counts against counts under shuffled alleles."""
    null = permutation_null(df if null_cohort is None else null_cohort, row_id, "allele", [event], unit, reps, seed)
    observed = df.groupBy("allele", "locus", event).agg(n_distinct(unit).alias("n_unit"))
    return p_adjust_bh(permutation_test(observed, null, [event, "locus"], "n_unit"))


def class_counts(df: DataFrame, keys: list[str], unit: str, group: str = "immune") -> DataFrame:
    """Distinct units per key in each class, absent as 0."""
    seen = df.filter(F.col(group).isNotNull()).select(*keys, unit, group).distinct()
    return seen.groupBy(*keys).agg(
        *[F.count_if(F.col(group) == F.lit(v)).alias(n) for n, v in CLASSES.items()])


def class_association(df: DataFrame, unit: str = "sample", group: str = "immune",
                      event: str = "event") -> DataFrame:
    """Do the alleles of an event differ between cold and hot?"""
    cells = class_counts(df, [event, "locus", "allele"], unit, group)
    return p_adjust_bh(chisq_by(cells, [event, "locus"], "cold", "hot"))


def significant_class_rows(df: DataFrame, unit: str = "sample", event: str = "event", alpha: float = 0.05) -> DataFrame:
    """The classed rows of events whose alleles differ between the classes after correction."""
    tests = class_association(df, unit, event=event).select(event, "locus", "p_adj")
    return significant_rows(df.filter("immune is not null"), tests, alpha=alpha)


def frequent_pairs(df: DataFrame, more_than: int, unit: str = "tumour") -> DataFrame:
    """Rows of the (event, allele) pairs seen in more than so many units."""
    return keep_groups(df, ["event", "allele"], n_distinct(unit), lambda n: n > more_than)


def class_shares(df: DataFrame, keys: list[str], unit: str = "sample") -> DataFrame:
    """Share of each class's units that carry the key."""
    return parent_share(df.filter("immune is not null"), [*keys, "immune"], ["immune"], unit)


def share_association(df: DataFrame, event: str = "event", unit: str = "sample") -> DataFrame:
    """Cold against hot shares of all cells of a locus."""
    shares = class_shares(df, [event, "locus", "allele"], unit)
    wide = shares.groupBy(event, "locus", "allele").agg(*[
        F.coalesce(F.max(F.when(F.col("immune") == v, F.col("share"))), F.lit(0.0)).alias(n)
        for n, v in CLASSES.items()])
    return p_adjust_bh(chisq_by(wide, ["locus"], "cold", "hot"))


def normals_with_class(df: DataFrame) -> DataFrame:
    """Normal samples with the class that most of the patient's tumours have."""
    return natural_join(df.filter("sample_type = 'normal'"), majority_class(df), "inner", ["patient"])


def both_classes(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the keys seen in more than one class."""
    return keep_groups(df.filter("immune is not null"), keys, n_distinct("immune"), lambda n: n > 1)


def class_pair_shares(df: DataFrame, unit: str) -> DataFrame:
    """Units of each (event, allele) and class, and their share within (allele, class)."""
    rows = both_classes(df.filter("tumour is not null"), ["event", "allele"])
    return parent_share(rows, ["event", "allele", "locus", "combine", "immune"], ["allele", "immune"], unit)


def higher_in(shares: DataFrame, keys: list[str], more: str, less: str) -> DataFrame:
    """Shares of the keys in which class ``more`` exceeds class ``less``."""
    sides = shares.groupBy(*keys).agg(
        F.max(F.when(F.col("immune") == more, F.col("share"))).alias("_more"),
        F.max(F.when(F.col("immune") == less, F.col("share"))).alias("_less"))
    return keep_matching(shares, sides.filter("_more > _less").select(*keys))


def bubbles(df: DataFrame, keys=("event", "allele", "mut_type", "locus"), within=("event", "locus"),
            unit: str = "tumour", row_weighted: bool = False) -> DataFrame:
    """Units per cell and the cell's share of all counts within ``within``.

    ``row_weighted`` lets each cell count once per input row in the total.
    """
    keys, within = list(keys), list(within)
    cells = df.groupBy(*keys).agg(n_distinct(unit).alias("nb_tumour"), F.count(F.lit(1)).alias("_rows"))
    weight = F.col("nb_tumour") * F.col("_rows") if row_weighted else F.col("nb_tumour")
    totals = cells.groupBy(*within).agg(F.sum(weight).alias("_total"))
    joined = natural_join(cells, totals, "inner", within)
    return joined.select(*keys, "nb_tumour", divide("nb_tumour", "_total").alias("proportion"))


def cell_counts(df: DataFrame, keys: list[str], unit: str = "tumour", where: Column | None = None) -> DataFrame:
    rows = df if where is None else df.filter(where)
    return rows.groupBy(*keys).agg(n_distinct(unit).alias("nb_tumour"))


def event_annotation(df: DataFrame, unit: str = "tumour") -> DataFrame:
    """Units and germline presence of each event."""
    return df.groupBy("event").agg(n_distinct(unit).alias("nb_unit"), F.bool_or("in_normal").alias("in_normal"))


def allele_annotation(df: DataFrame, unit: str = "tumour", family: int = 5) -> DataFrame:
    return df.groupBy("allele").agg(n_distinct(unit).alias("nb_unit")).withColumn(
        "family", F.substring("allele", 1, family))


def class_contingency(df: DataFrame, row: str, unit: str) -> DataFrame:
    """One test of ``row`` against class, over distinct units."""
    sides = df.filter(F.col(row).isNotNull() & F.col("immune").isNotNull()).groupBy(row).agg(
        *[n_distinct_where(F.col("immune") == v, unit).alias(n) for n, v in CLASSES.items()])
    return chisq_by(sides, [], "cold", "hot")


def heat_matrix(cells: DataFrame, value: str, row: str = "event", column: str = "allele") -> DataFrame:
    """One row per event and one column per allele that occurs in ``cells``; absent pairs are 0."""
    return wide_from_long(cells, [row], column, value, fill=0.0)

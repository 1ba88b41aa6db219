"""A training-data pipeline over the documents: language ID, quality rules, exact and near
duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of the documents they got. A stage works on all rows its predecessor kept. Columns
beside ``doc_id`` and ``text`` travel as one struct, so their names never clash with an
operator's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm import exact_dedup, jaccard_join, language_id, line_labels, packing
from cohortry.session import staged

OTHERS = "_others"
#: A text whose likeliest language is less certain than this has no language.
LEAST_CERTAIN = 0.5


def packed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and all other columns as one struct."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(True).alias("_"), *others).alias(OTHERS))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from rows that were packed."""
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"{OTHERS}.`{c}`").alias(c) for c in docs.columns])


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; those without letters or a likely language go."""
    model = language_id.fit_on_documents(docs)
    named = language_id.identify(packed(docs), model)
    return unpacked(named.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_CERTAIN)), docs)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base counts and have enough content lines."""
    field = line_labels.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return unpacked(line_labels.judge(packed(docs), field).filter("kept"), docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the smallest id."""
    return unpacked(exact_dedup.exact_dedup(packed(docs)).filter("kept"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that with the smallest id; texts without words all stay.

    Null ids come after all others; ties go to the smallest hash of the text, and of rows
    that share id and text one stays.
    """
    place = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "_hash")
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"))
    near = staged(jaccard_join.near_duplicates(marked).filter(F.col("class_key").isNotNull())
                  .select("doc_id", "_hash", "class_key", place.alias("_place")), "near")
    best = near.groupBy("class_key").agg(F.min("_place").alias("_best"), F.count("*").alias("_rows")).filter("_rows > 1")
    # Keys of rows that go, and of rows that share id and text and stay once.
    keys = near.join(best, "class_key").groupBy("doc_id", "_hash").agg(
        F.max(~F.col("_place").eqNullSafe(F.col("_best"))).alias("_goes"), F.count("*").alias("_twins"))
    keys = staged(keys.filter("_goes OR _twins > 1").withColumnsRenamed({"doc_id": "_id", "_hash": "_key"}), "keys")
    rows = packed(docs).withColumn("_text_hash", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_key"))
    rest = rows.join(keys, same, "left_anti").drop("_text_hash")
    twins = rows.join(keys.filter("NOT _goes"), same).dropDuplicates(["doc_id", "_text_hash"]).select(rest.columns)
    return unpacked(rest.unionByName(twins), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of power-of-two lengths: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    return packing.decompose(docs.select("doc_id", "text"))


STAGES = [
    ("language ID", keep_languages),
    ("quality rules", keep_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("packing", pack),
]

#: Trained models and tokens are beyond SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)

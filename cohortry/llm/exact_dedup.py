"""Exact duplicates of texts by two-pass Bloom filtering, in DataFrame operations.

First pass: every text becomes a 64-bit hash, and the hash a word number and a mask of
bits in that word (a blocked Bloom filter). Words and masks are counted with map-side
combining; the masks that occurred twice are merged, word by word, into a filter of
possibly repeated texts. Second pass: each row is tested against the filter. Only rows
that hit shuffle, on the SHA-256 of their text, to be compared exactly; all others pass
straight through as groups of one.

The filter has at most ``max_words`` words and is broadcast; this bound does not grow
with the data. A filter that is too small only lets more rows shuffle. Large groups do
not meet in one task: copies are combined before the shuffle, and the groups that hold
over a thousandth of the candidate rows, fewer than a thousand, are joined by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.arrow_rows import pack, unpacked
from cohortry.llm.registry import documents, query
from cohortry.session import staged

#: Fixed value: what counts as white space.
WHITE = r"[\x20\x09-\x0D]+"
#: Most filter words (64 bits each), and distinct texts for which one word is planned.
MAX_WORDS, TEXTS_PER_WORD = 1 << 20, 1
BITS = 3
#: A group with one of so many candidate rows is joined by broadcast.
LARGE_SHARE = 1000
RESULT = ["keep_id", "group_size", "kept", "text_sha256"]


def normalised(text: Column) -> Column:
    """Each run of white space is one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def word_and_mask(hashed: Column, words: int) -> tuple[Column, Column]:
    """The filter word of a hash, and its bits there; word and bits use different parts of the hash."""
    word = F.shiftrightunsigned(hashed, 24) % words
    mask = F.lit(0).cast("long")
    for k in range(BITS):
        place = F.shiftrightunsigned(hashed, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return word, mask


def repeated_filter(docs: DataFrame, text: str, max_words: int) -> tuple[DataFrame, int]:
    """The words of the filter of possibly repeated texts, and the number of words planned."""
    hashed = F.xxhash64(normalised(F.col(text)))
    words = 1 << max(4, min(max_words, docs.count() // TEXTS_PER_WORD).bit_length() - 1)
    word, mask = word_and_mask(hashed, words)
    counted = docs.select(word.alias("_word"), mask.alias("_mask")).groupBy("_word", "_mask").agg(F.count("*").alias("_n"))
    return staged(counted.filter("_n > 1").groupBy("_word").agg(F.bit_or("_mask").alias("_bits")), "bloom"), words


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """All rows of ``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when their normalised texts are; null counts as empty. Of equal texts
    the row with the smallest id is kept; a null id is never smaller than another, and a
    group of null ids alone has a null ``keep_id``. Of rows that also share the id, one is
    kept (the one whose other columns hash lowest). An empty table stays empty. Columns of
    ``docs`` with a name of the result are replaced, all other names are free. Texts of any length are
    compared whole.
    """
    rows = pack(docs, doc_id, text, RESULT)
    own = unpacked(docs, doc_id, text, RESULT, keep_text=True)
    bits, words = repeated_filter(rows, "_text", max_words)
    clean = normalised(F.col("_text"))
    word, mask = word_and_mask(F.xxhash64(clean), words)
    # The tie is hashed here, so that a caller who drops the text does not shuffle it.
    rows = rows.withColumns({"text_sha256": F.sha2(clean, 256), "_word": word, "_mask": mask, "_tie": F.xxhash64("_text", "_others")})
    # At most max_words rows of two numbers.
    tested = rows.join(F.broadcast(bits), "_word", "left").withColumn(
        "_hit", F.coalesce(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False)))
    tested = tested.drop("_word", "_mask", "_bits")
    alone = tested.filter(~F.col("_hit")).select(
        *own, F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")

    candidates = tested.filter("_hit")
    groups = staged(candidates.groupBy(F.col("text_sha256").alias("_sha")).agg(
        F.min("_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    large = F.col("group_size") * LARGE_SHARE > total
    # Fewer than LARGE_SHARE groups can each hold over one LARGE_SHARE-th of the rows.
    same = F.col("text_sha256") == F.col("_sha")
    of_large = candidates.join(F.broadcast(groups.filter(large)), same)
    others = candidates.join(F.broadcast(groups.filter(large)), same, "left_anti").join(groups.filter(~large), same)
    grouped = of_large.unionByName(others)
    # Rows that share the smallest id of their group: one of them is kept.
    twins = Window.partitionBy("text_sha256", "_id").orderBy("_tie")
    grouped = grouped.withColumn("kept", F.col("_id").eqNullSafe(F.col("keep_id")) & (F.row_number().over(twins) == 1))
    return alone.unionByName(grouped.select(*own, *RESULT))


@query("op10_exact_dedup", r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)""")
def _(spark, d):
    return exact_dedup(documents(spark, d).select("doc_id", "text")).drop("text")

"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed 1- to 3-grams of every labelled text per language. Each task
sums its texts into count vectors and emits the buckets that are not zero, Spark adds
them up, and the log-probability matrix (languages x buckets) is broadcast; its size is
checked against ``MAX_MATRIX_BYTES`` and does not depend on the number of rows. Scoring
looks up, in numpy, only the n-grams that a text has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.llm.arrow_rows import add_columns, slices, texts_of
from cohortry.llm.registry import documents, query
from cohortry.session import staged

ORDERS, BUCKETS, SMOOTHING = (1, 2, 3), 1 << 15, 0.5
MAX_MATRIX_BYTES = 64 << 20
#: Characters that are counted at once; longer texts go in blocks that overlap.
BLOCK = 1 << 18
UNKNOWN = "und"


def blocks(text: str) -> Iterator[np.ndarray]:
    """The n-gram buckets of a text in lower case, a space at each end, block by block.

    Every n-gram is counted once, whatever the block size.
    """
    wide = f" {text.lower()} "
    overlap = max(ORDERS) - 1
    for at in range(0, len(wide), BLOCK):
        codes = np.frombuffer(wide[max(0, at - overlap):at + BLOCK].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        seen = min(at, overlap)
        found = []
        for n in ORDERS:
            # N-grams that end in this block.
            first, last = max(0, seen - n + 1), len(codes) - n + 1
            if last <= first:
                continue
            h = codes[first:last].copy()
            for k in range(1, n):
                h = h * np.uint64(0x100000001B3) + codes[first + k:last + k]
            h = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            found.append((h >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64))
        if found:
            yield np.concatenate(found)


@dataclass(frozen=True)
class Model:
    """Languages, log-probabilities of buckets (buckets x languages) and of languages."""

    languages: list[str]
    log_buckets: np.ndarray
    log_prior: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its posterior probability; ties go to the first by name."""
        if text is None or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        total = self.log_prior.copy()
        for found in blocks(text):
            total += self.log_buckets[found].sum(axis=0, dtype=np.float64)
        best = int(total.argmax())
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Train on all rows whose ``lang`` and ``text`` are not null; without any, the model knows no language."""
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs = {}, {}
        for batch in slices(batches):
            for name, t in zip(batch.column(lang).to_pylist(), texts_of(batch, text), strict=True):
                mine = counts.setdefault(name, np.zeros(BUCKETS, np.int64))
                docs[name] = docs.get(name, 0) + 1
                for found in blocks(t):
                    mine += np.bincount(found, minlength=BUCKETS)
        for name, mine in counts.items():
            used = np.flatnonzero(mine)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([name] * (len(used) + 1)), "bucket": pa.array([-1, *used.tolist()], pa.int32()),
                "n": pa.array([docs[name], *mine[used].tolist()], pa.int64())})

    summed = staged(rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "counts")
    per_language = summed.filter("bucket = -1")
    languages = [r.lang for r in per_language.select("lang").orderBy("lang").limit(MAX_MATRIX_BYTES // (4 * BUCKETS) + 1).collect()]
    if 4 * BUCKETS * len(languages) > MAX_MATRIX_BYTES:
        raise ValueError(f"more than {MAX_MATRIX_BYTES // (4 * BUCKETS)} languages: the matrix would be too large to broadcast")
    # At most languages x buckets rows, bounded by the check above.
    found = summed.toPandas()
    place = {name: i for i, name in enumerate(languages)}
    counts, docs = np.zeros((BUCKETS, len(languages))), np.zeros(len(languages))
    at = found["lang"].map(place).to_numpy(dtype=np.int64)
    bucket, n = found["bucket"].to_numpy(), found["n"].to_numpy()
    counts[bucket[bucket >= 0], at[bucket >= 0]] = n[bucket >= 0]
    docs[at[bucket < 0]] = n[bucket < 0]
    smooth = counts + SMOOTHING
    return Model(languages, np.log(smooth / smooth.sum(axis=0)).astype(np.float32), np.log(docs / max(1, docs.sum())))


def identify(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned.
    Repeated rows are each scored; an empty table stays empty; columns of ``docs`` named
    ``lang_pred`` or ``score`` are replaced, all other names are free. Texts are read whole, in blocks.
    Of equally likely languages the first by name is taken. Without ``keep_text`` the text is left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        known = shared.value

        def compute(batch):
            made = [known.predict(t) for t in batch.column(text).to_pylist()]
            return [[m[0] for m in made], [m[1] for m in made]]
        return compute

    return add_columns(docs, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], start, [text],
                       keep_text)


def held_out(doc_id="doc_id"):
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit_on_documents(docs: DataFrame) -> Model:
    return fit(docs.filter(~held_out()))


@query("op8_language_id")
def _(spark, d):
    docs = documents(spark, d)
    named = identify(docs.select("doc_id", "text"), fit_on_documents(docs), keep_text=False)
    return named.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

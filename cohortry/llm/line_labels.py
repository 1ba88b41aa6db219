"""Quality rules: a linear-chain conditional random field over the lines of a text.

Every line with a word has a few discrete features. The field scores the two labels,
content and boilerplate, of each line by its features and of neighbouring lines by their
transition; Viterbi decoding finds the best labels of a whole text. A text is kept if
it passes the base counts and content lines hold enough of its words.

Weights are trained on a bounded sample of labelled documents (``SAMPLE`` of either
quality, those with the smallest hash of their id, of at most ``SAMPLE_LINES`` lines). Lines
of good documents are content. The labels of lines in bad documents are not known: they start
as boilerplate and are decoded anew between rounds, so clean lines in bad documents stop
counting as boilerplate. The sample is fitted on the driver; all texts are decoded in one
pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.llm.arrow_rows import add_columns, slices, texts_of
from cohortry.llm.registry import documents, query
from cohortry.llm.text_stats import SPACES, SYMBOLS, base_counts

SAMPLE, SAMPLE_LINES = 800, 200
ROUNDS, STEPS, RATE, RIDGE = 3, 60, 0.3, 1e-4
LEAST_WORDS, MOST_REPEATED = 10, 20
MIN_CONTENT = 0.5
#: Words are what the base counts take for words: no other white space parts them.
WORD = re.compile(f"[^{SPACES}]+")
CONTENT, BOILERPLATE = 0, 1
#: Values of each feature.
LEVELS = [5, 5, 5, 5, 4, 2, 4, 4, 2]
OFFSETS = np.cumsum([0, *LEVELS])[:-1].tolist()
RESULT = [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
RESULT += [T.StructField("base_failed", T.BooleanType()), T.StructField("content_share", T.DoubleType()),
           T.StructField("kept", T.BooleanType())]


def level(share: float, bounds: tuple[float, ...]) -> int:
    return sum(share > b for b in bounds)


def features(line: str, words: list[str], seen: bool) -> list[int]:
    """One active feature per group, as numbers from ``OFFSETS`` on."""
    n, letters = len(words), "".join(words)
    upper = sum(1 for a, b in zip(letters, letters.lower(), strict=False) if a != b)
    found = [
        level(sum(map(line.count, SYMBOLS)) / n, (0, 0.1, 0.3, 0.6)),
        level((line.count("!") + line.count("?")) / n, (0, 0.15, 0.4, 0.8)),
        level(upper / len(letters), (0.05, 0.2, 0.4, 0.7)),
        level(len(set(words)) / n, (0.25, 0.45, 0.65, 0.85)),
        level(n, (3, 8, 20)),
        int(letters[-1] in ".!?:;\"'…。"),
        level(sum(map(str.isdigit, letters)) / len(letters), (0, 0.1, 0.3)),
        level(len(letters) / n, (3, 7, 12)),
        int(seen),
    ]
    return [o + f for o, f in zip(OFFSETS, found, strict=True)]


def lines_of(text: str) -> tuple[list[list[int]], list[int]]:
    """Features and word counts of the lines with a word."""
    found, sizes, seen = [], [], set()
    for line in text.split("\n"):
        words = WORD.findall(line)
        if words:
            found.append(features(line, words, line in seen))
            sizes.append(len(words))
            seen.add(line)
    return found, sizes


@dataclass(frozen=True)
class Field:
    """Weights: features (for boilerplate against content), first label, transitions."""

    weights: np.ndarray
    first: np.ndarray
    moves: np.ndarray

    def decode(self, found: list[list[int]]) -> list[int]:
        """The best labels by Viterbi's algorithm; ties are content."""
        if not found:
            return []
        scores = self.weights[np.array(found)].sum(axis=1).tolist()
        (cc, cb), (bc, bb) = self.moves.tolist()
        content, boiler = self.first[0], self.first[1] + scores[0]
        back = []
        for s in scores[1:]:
            a, b = content + cc, boiler + bc
            c, d = content + cb, boiler + bb
            back.append((CONTENT if a >= b else BOILERPLATE, CONTENT if c >= d else BOILERPLATE))
            content, boiler = (a if a >= b else b), (c if c >= d else d) + s
        labels = [CONTENT if content >= boiler else BOILERPLATE]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def no_field() -> Field:
    """Scores nothing, so every line is content."""
    return Field(np.zeros(sum(LEVELS)), np.zeros(2), np.zeros((2, 2)))


def _gradient(field: Field, docs: list[np.ndarray], labels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient of the mean log-likelihood of a line; ``docs`` from long to short."""
    lengths = np.array([len(d) for d in docs])
    total = lengths.sum()
    scores = np.zeros((len(docs), lengths[0], 2))
    for i, d in enumerate(docs):
        scores[i, :len(d), 1] = field.weights[d].sum(axis=1)
    active = [int((lengths > t).sum()) for t in range(lengths[0])]
    forward, backward = np.zeros_like(scores), np.zeros_like(scores)
    forward[:, 0] = field.first + scores[:, 0]
    for t in range(1, lengths[0]):
        k = active[t]
        forward[:k, t] = np.logaddexp.reduce(forward[:k, t - 1, :, None] + field.moves, axis=1) + scores[:k, t]
    for t in range(lengths[0] - 2, -1, -1):
        k = active[t + 1]
        backward[:k, t] = np.logaddexp.reduce(field.moves + (scores[:k, t + 1] + backward[:k, t + 1])[:, None, :], axis=2)
    log_z = np.logaddexp.reduce(forward[np.arange(len(docs)), lengths - 1], axis=1)
    weights, first, moves = np.zeros_like(field.weights), np.zeros(2), np.zeros((2, 2))
    for i, (d, y) in enumerate(zip(docs, labels, strict=True)):
        n = len(d)
        p = np.exp(forward[i, :n] + backward[i, :n] - log_z[i])
        np.add.at(weights, d, (y - p[:, 1])[:, None])
        first[y[0]] += 1
        first -= p[0]
        if n > 1:
            np.add.at(moves, (y[:-1], y[1:]), 1)
            pair = forward[i, :n - 1, :, None] + field.moves + (scores[i, 1:n] + backward[i, 1:n])[:, None, :] - log_z[i]
            moves -= np.exp(pair).sum(axis=0)
    return weights / total, first / total, moves / total


def train(docs: list[np.ndarray], good: list[bool]) -> Field:
    """Weights from documents (lines x features) and whether each is good; none of a kind: :func:`no_field`."""
    order = sorted((i for i in range(len(docs)) if len(docs[i])), key=lambda i: -len(docs[i]))
    docs, good = [docs[i] for i in order], [good[i] for i in order]
    field = no_field()
    if not any(good) or all(good):
        return field
    labels = [np.full(len(d), CONTENT if g else BOILERPLATE) for d, g in zip(docs, good, strict=True)]
    for _ in range(ROUNDS):
        field = no_field()
        squares = [np.zeros_like(p) for p in (field.weights, field.first, field.moves)]
        for _ in range(STEPS):
            steps = _gradient(field, docs, labels)
            parts = []
            for p, g, s in zip((field.weights, field.first, field.moves), steps, squares, strict=True):
                g = g - RIDGE * p
                s += g * g
                parts.append(p + RATE * g / np.sqrt(s + 1e-12))
            field = Field(*parts)
        labels = [y if g else np.array(field.decode(d.tolist())) for d, g, y in zip(docs, good, labels, strict=True)]
        # A bad document keeps at least its worst line.
        for d, g, y in zip(docs, good, labels, strict=True):
            if not g and not y.any():
                y[field.weights[d].sum(axis=1).argmax()] = BOILERPLATE
    return field


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Field:
    """Train on at most ``sample`` documents of either quality in ``labels`` (``doc_id``, ``quality``)."""
    kinds = [labels.filter((F.col("quality") == q) & F.col(doc_id).isNotNull()).select(doc_id, "quality")
             .orderBy(F.xxhash64(doc_id), doc_id).limit(sample) for q in (0, 1)]
    # At most two samples of ids.
    chosen = F.broadcast(kinds[0].unionByName(kinds[1]).groupBy(doc_id).agg(F.min("quality").alias("_quality")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, quality = batch.column(doc_id).to_pylist(), batch.column("_quality").to_pylist()
            rows = [(i, q, bytes(np.array(lines_of(t)[0], np.uint8).reshape(-1))) for i, q, t in
                    zip(ids, quality, texts_of(batch, text), strict=True) if t.count("\n") < SAMPLE_LINES]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
                                              pa.array([r[2] for r in rows], pa.binary())], names=["id", "quality", "lines"])

    picked = docs.select(F.col(doc_id).cast("long").alias(doc_id), text).join(chosen, doc_id)
    lines = picked.select(doc_id, text, F.col("_quality").cast("int").alias("_quality")).mapInArrow(run, "id long, quality int, lines binary")
    rows = lines.groupBy("id").agg(F.min(F.struct("lines", "quality")).alias("r")).orderBy("id").collect()
    return train([np.frombuffer(r.r.lines, np.uint8).reshape(-1, len(LEVELS)).astype(np.int64) for r in rows],
                 [r.r.quality == 1 for r in rows])


def judge(docs: DataFrame, field: Field, min_content: float = MIN_CONTENT, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``content_share`` and ``kept``.

    ``content_share`` is the share of words in content lines, null without words. Null and
    empty texts have no words and fail the base counts. Texts of any length are judged whole, in the
    memory of one task; of equally good labels a line is content. Repeated rows are each judged; an empty
    table stays empty; columns of ``docs`` with a name of the result are replaced, all other names are free.
    Without ``keep_text`` the text is left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def start():
        known = shared.value

        def one(t: str) -> tuple:
            counts = base_counts(t)
            failed = counts[0] < LEAST_WORDS or 100 * counts[4] > MOST_REPEATED * counts[0]
            found, sizes = lines_of(t)
            share = None
            if sizes:
                share = sum(s for s, y in zip(sizes, known.decode(found), strict=True) if y == CONTENT) / sum(sizes)
            return *counts, failed, share, not failed and share is not None and share >= min_content

        def compute(batch):
            made = [one(t) for t in texts_of(batch, text)]
            return [[m[k] for m in made] for k in range(len(RESULT))]
        return compute

    return add_columns(docs, RESULT, start, [text], keep_text)


@query("op7_line_labels")
def _(spark, d):
    docs = documents(spark, d)
    field = fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    return judge(docs.select("doc_id", "text"), field, keep_text=False)

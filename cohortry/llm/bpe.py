"""Byte-level BPE encoding and decoding with a given vocabulary file.

Each distinct pre-token is merged by a priority queue of merge ranks over a doubly
linked list of symbols. Queue entries are never removed; an entry whose two symbols
are no longer neighbours is stale and skipped. Decoding concatenates the byte strings
of the vocabulary.

The vocabulary file is read once on the driver and broadcast (1.5 MB; its size does not
grow with the data), so executors need no file of their own. Results of short stretches
between white space are remembered per worker in tables of bounded size.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache
from hashlib import sha256
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.llm.arrow_rows import add_columns, texts_of
from cohortry.llm.registry import documents, query

#: Fixed value: the characters with the Unicode property White_Space.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Fixed value: the public pre-token pattern of byte-level BPE.
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: Stretches that can be encoded apart: every pre-token lies within one of them.
STRETCH = rf"[{WHITE}]+(?![^{WHITE}])| ?[^{WHITE}]+|[{WHITE}]"
#: Remembered pieces and pre-tokens per generation (two are kept), and the longest that is remembered.
REMEMBERED, PRE_TOKENS, LONGEST = 1 << 18, 1 << 19, 48
#: Bits of an id and of a place in a pre-token, where several share one number.
ID_BITS, PLACE_BITS = 20, 32
NONE, PLACE = (1 << ID_BITS) - 1, (1 << PLACE_BITS) - 1


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next free one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Bpe:
    """Encoder and decoder of one vocabulary, from the JSON text of its file."""

    def __init__(self, text: str):
        model = json.loads(text)
        vocab = model["model"]["vocab"]
        letters = byte_letters()
        to_byte = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.words = [b""] * (1 + max(*vocab.values(), *self.special.values()))
        for word, i in vocab.items():
            self.words[i] = bytes(to_byte[c] for c in word)
        for word, i in self.special.items():
            self.words[i] = word.encode()
        self.byte_ids = [vocab[c] for c in letters]
        self.merges = {}  # both ids in one number -> rank from 1 and new id in one number
        for rank, pair in enumerate(model["model"]["merges"], 1):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a] << ID_BITS | vocab[b]] = rank << ID_BITS | vocab[a + b]
        #: Rank of the merge of two bytes, 0 where there is none.
        self.byte_merges = [self.merges.get(a << ID_BITS | b, 0) >> ID_BITS for a in self.byte_ids for b in self.byte_ids]
        self.pre_token = regex.compile(PRE_TOKEN)
        self.recent, self.earlier = {}, {}  # ids of pre-tokens, which many pieces share

    def merge(self, raw: bytes) -> list[int]:
        """The ids of one pre-token."""
        symbols = [*map(self.byte_ids.__getitem__, raw)]
        n, find, first = len(symbols), self.merges.get, self.byte_merges
        # A queue entry is the rank and the place of the left symbol in one number.
        queue = [rank << PLACE_BITS | i for i, (a, b) in enumerate(pairwise(raw)) if (rank := first[a << 8 | b])]
        if not queue:
            return symbols
        heapify(queue)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        symbols.append(NONE)  # a neighbour of the last symbol with which nothing merges
        while queue:
            entry = heappop(queue)
            i = entry & PLACE
            left = symbols[i]
            if left == NONE:
                continue  # stale: the symbol is gone
            j = after[i]
            found = find(left << ID_BITS | symbols[j])
            if not found or found >> ID_BITS != entry >> PLACE_BITS:
                continue  # stale: a symbol has grown
            symbols[i] = whole = found & NONE
            symbols[j] = NONE
            after[i] = k = after[j]
            if found := find(whole << ID_BITS | symbols[k]):
                heappush(queue, found >> ID_BITS << PLACE_BITS | i)
            if k < n:
                before[k] = i
            h = before[i]
            if h >= 0 and (found := find(symbols[h] << ID_BITS | whole)):
                heappush(queue, found >> ID_BITS << PLACE_BITS | h)
        return [s for s in symbols if s != NONE]

    def stretch(self, text: str) -> bytes:
        get, learn = self.recent.get, self._learn
        # One ASCII word, perhaps after a space, is one pre-token.
        words = [text] if text.isascii() and text.removeprefix(" ").isalpha() else self.pre_token.findall(text)
        return b"".join([get(word) or learn(word) for word in words])

    def _learn(self, word: str) -> bytes:
        ids = self.earlier.get(word)
        if ids is None:
            found = self.merge(word.encode())
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(word) <= LONGEST:
            if len(self.recent) >= PRE_TOKENS:
                self.recent, self.earlier = {}, self.recent
            self.recent[word] = ids
        return ids

    def decode(self, ids) -> str:
        words = self.words
        return b"".join([words[i] for i in ids]).decode(errors="replace")


class Encoder:
    """Text to ids, as little-endian unsigned 32-bit integers.

    ``stretch`` encodes, in that form, what lies between white space. Special tokens in a text are
    taken as such, as the vocabulary's library does by default.

    Most texts hold single spaces and line ends only. They are cut at spaces, and each
    piece, with the space before it, is looked up whole. Any text with another run of
    white space takes the general way over ``STRETCH``; both give the same ids.
    """

    def __init__(self, stretch, special: dict[str, int]):
        self.encode_stretch = stretch
        self.recent, self.earlier = {}, {}
        self.split = re.compile(STRETCH).findall
        self.white = re.compile(f"[{WHITE}]").match
        self.special = {s: np.array([i], "<u4").tobytes() for s, i in special.items()}
        self.any_special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def _remember(self, key: str, text: str, edge: bool = False) -> bytes | None:
        if key in self.earlier:
            ids = self.earlier[key]
        else:
            ids = None if edge else self.encode_stretch(text)
        if len(key) <= LONGEST:
            if len(self.recent) >= REMEMBERED:
                self.recent, self.earlier = {}, self.recent
            self.recent[key] = ids
        return ids

    def _general(self, text: str) -> bytes:
        get, learn = self.recent.get, self._remember
        return b"".join([get("\0" + part) or learn("\0" + part, part) for part in self.split(text)])

    def _learn(self, piece: str) -> bytes | None:
        """Ids of a piece and the space before it; None if white space at its ends may join a longer run."""
        line_end = piece[:1] == "\n"
        inner = piece[1:] if line_end else piece
        edge = bool(inner) and bool(self.white(inner[0]) or self.white(inner[-1]))
        return self._remember(piece, piece if line_end else " " + piece, edge)

    def _plain(self, text: str) -> bytes:
        spaced = text.replace("\n", " \n")
        if "  " in spaced or "\n\n" in text:
            return self._general(text)
        first, *pieces = spaced.split(" ")
        get, learn = self.recent.get, self._learn
        if "\0" in text:
            return self._general(text)
        ids = [get(p) or learn(p) for p in pieces]
        if None in ids or (first and self.white(first[-1])):
            return self._general(text)
        return self._general(first) + b"".join(ids)

    def __call__(self, text: str) -> bytes:
        if self.any_special and any(s in text for s in self.special):
            return b"".join([self.special.get(part) or self._plain(part) for part in self.any_special.split(text) if part])
        return self._plain(text)


@lru_cache(maxsize=2)
def own_encoder(vocabulary: str) -> tuple[Bpe, Encoder]:
    bpe = Bpe(vocabulary)
    return bpe, Encoder(bpe.stretch, bpe.special)


@lru_cache(maxsize=2)
def library_encoder(vocabulary: str) -> Encoder:
    """The same encoder with a library's merges for pieces that are new.

    The merge ranks come from the vocabulary file, the merging from tiktoken, which is
    several times faster on single pieces than the tokenizers library; the ids are equal.
    """
    import tiktoken
    bpe = Bpe(vocabulary)
    special = set(bpe.special.values())
    ranks = {word: i for i, word in enumerate(bpe.words) if i not in special}
    merged = tiktoken.Encoding("vocabulary", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})
    return Encoder(lambda text: np.array(merged.encode_ordinary(text), "<u4").tobytes(), bpe.special)


def vocabulary_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def lists(packed: list[bytes]) -> pa.Array:
    """Packed ids as a list array, without a Python object per id."""
    ends = np.cumsum([0, *[len(p) // 4 for p in packed]])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4"), pa.int32()))


def encode(docs: DataFrame, vocabulary: str | None = None, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the token ids of the whole ``text`` in the array column ``out``.

    Null and empty texts give an empty array. An empty table gives an empty table; repeated
    rows are each encoded; other columns stay, but one named ``out`` is replaced. A text of any
    length is encoded whole, in the memory of one task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(
        vocabulary_text(vocabulary or public_tokenizers.path("byte_bpe_50k.json")))

    def start():
        encoder = own_encoder(shared.value)[1]
        return lambda batch: [lists([encoder(t) for t in texts_of(batch, text)])]

    return add_columns(docs, [T.StructField(out, T.ArrayType(T.IntegerType()))], start, [text])


def decode(tokens: DataFrame, vocabulary: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``tokens`` with the text of the array column ``ids`` in ``out``; null ids give the empty text.

    Bytes that are no UTF-8 become the replacement character. Special tokens are kept.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(
        vocabulary_text(vocabulary or public_tokenizers.path("byte_bpe_50k.json")))

    def start():
        bpe = own_encoder(shared.value)[0]

        def compute(batch):
            column = batch.column(ids)
            return [[bpe.decode(column[i].values.to_numpy().tolist() if column[i].is_valid else ())
                     for i in range(len(column))]]
        return compute

    return add_columns(tokens, [T.StructField(out, T.StringType())], start, [ids])


def round_trip(docs: DataFrame, vocabulary: str | None = None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``n_tokens`` and SHA-256 digests of the ids of the whole ``text`` and of the text they decode to.

    ``ids_sha256`` is over the decimal ids joined by commas, ``decoded_sha256`` over the decoded text in
    UTF-8. Ids stay in the task that made them. Nulls count as empty; columns of these names are replaced;
    empty tables, repeated rows and texts of any length as with :func:`encode` and :func:`decode`.
    Without ``keep_text`` the text is left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(
        vocabulary_text(vocabulary or public_tokenizers.path("byte_bpe_50k.json")))

    def start():
        bpe, encoder = own_encoder(shared.value)
        decimal = [b"%d" % i for i in range(len(bpe.words))]

        def compute(batch):
            sizes, of_ids, of_text = [], [], []
            for t in texts_of(batch, text):
                ids = np.frombuffer(encoder(t), "<u4").tolist()
                sizes.append(len(ids))
                of_ids.append(sha256(b",".join([decimal[i] for i in ids])).hexdigest())
                of_text.append(sha256(bpe.decode(ids).encode()).hexdigest())
            return [sizes, of_ids, of_text]
        return compute

    return add_columns(docs, [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                              T.StructField("decoded_sha256", T.StringType())], start, [text], keep_text)


@query("op1_bpe_round_trip")
def _(spark, d):
    return round_trip(documents(spark, d).select("doc_id", "text"), keep_text=False)

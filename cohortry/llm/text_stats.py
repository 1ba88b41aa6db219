"""Counts over whole texts that the quality operators share."""

from __future__ import annotations

from operator import eq

import numpy as np

#: The symbols that count, and the characters that part words.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes]) -> int:
    """Words in five-word windows that occur twice or more, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    mixed = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        mixed = (mixed ^ ids[k:k + n].astype(np.uint64)) * _MIX
        mixed ^= mixed >> np.uint64(29)
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():
        return 0  # equal windows would have equal hashes
    # Exact: windows are numbered through numbers of their parts.
    pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
    fours = np.unique(pairs[:-2] * (len(pairs) + 1) + pairs[2:], return_inverse=True)[1]
    place, times = np.unique(fours[:-1] * len(known) + ids[WINDOW - 1:], return_inverse=True, return_counts=True)[1:]
    edges = np.zeros(len(words) + 1, np.int64)
    twice = np.flatnonzero(times[place] > 1)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + WINDOW, -1)
    return int((edges.cumsum() > 0).sum())


def repeated_lines(lines: list[str]) -> int:
    """Lines with a word that equal an earlier line."""
    worded = [line for line in lines if line.strip(SPACES)]
    return len(worded) - len(set(worded))


def base_counts(text: str, words: list[bytes] | None = None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "replace").split() if words is None else words
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            repeated_lines(text.split("\n")), repeated_words(words))


#: Shares and means that describe a text, all zero for one without words.
STATISTICS = ["n_words", "word_length", "symbol_share", "bar_share", "mark_share", "upper_share", "digit_share",
              "stop_share", "distinct_share", "same_word_share", "repeat_share", "dup_line_share", "n_lines", "line_words"]


def statistics(text: str) -> list[float]:
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, chars, symbols, dup_lines, repeats = base_counts(text, words)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = sum(1 for line in text.split("\n") if line.strip(SPACES))
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    return [float(n), chars / n, symbols / chars, int(counts[124]) / n, int(counts[33] + counts[63]) / n,
            upper / max(1, upper + lower), int(counts[48:58].sum()) / chars, int(counts[46]) / n,
            len(set(words)) / n, sum(map(eq, words, words[1:])) / n, repeats / n, dup_lines / lines,
            float(lines), n / lines]

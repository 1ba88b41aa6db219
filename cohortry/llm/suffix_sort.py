"""Sorting of suffixes by comparisons that look at hashes, not at bytes.

Polynomial hashes of all prefixes give the hash of any substring at once, so a binary search
finds the longest common extension of two suffixes in a logarithmic number of steps, and
the byte after it tells their order. A bottom-up mergesort uses that comparison; all merges of
a level run together as array operations. Extensions that hashes call equal are
compared byte by byte at the end; if one differs, the sort is done again on the bytes.
"""

from __future__ import annotations

import numpy as np

#: Odd multipliers of the polynomial and of the last mixing step.
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
WORD = 1 << 64
SHIFT = np.uint64(32)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of the base and of its inverse, as many as were asked for so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            self.up, self.down = _powers(BASE, size), _powers(pow(BASE, -1, WORD), size)


POWERS = Powers()
#: A number for each byte, so that short runs of small bytes do not give small sums.
LETTERS = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (np.arange(1, 257, dtype=np.uint64) << np.uint64(40))


class Prefixes:
    """Hashes of the substrings of a byte string."""

    def __init__(self, raw: np.ndarray):
        POWERS.reach(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(LETTERS[raw] * POWERS.up[:len(raw)], out=self.sums[1:])

    def hashes(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * POWERS.down[start]

    def grams(self, k: int) -> np.ndarray:
        """Mixed hashes of all substrings of ``k`` bytes."""
        n = len(self.sums) - k
        out = (self.sums[k:] - self.sums[:n]) * POWERS.down[:n]
        out ^= out >> SHIFT
        out *= np.uint64(MIX)
        out ^= out >> SHIFT
        return out

    def common(self, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
        """The longest common extensions from ``i`` and ``j``, at most ``most``, by binary search."""
        low, high = np.zeros(len(i), np.int64), np.full(len(i), most, np.int64)
        for _ in range(most.bit_length()):
            middle = (low + high + 1) >> 1
            same = self.hashes(i, middle) == self.hashes(j, middle)
            low = np.where(same, middle, low)
            high = np.where(same, high, middle - 1)
        return low


def _heads(raw: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """The first eight bytes at ``at``, or ``most`` if that is less, as numbers that order as the bytes do."""
    padded = np.append(raw, np.zeros(8, np.uint8))
    words = np.ndarray(len(raw) + 1, ">u8", padded, strides=(1,))
    return words[at].astype(np.uint64) >> np.uint64(max(0, 64 - 8 * most))


def sort_suffixes(raw: np.ndarray, at: np.ndarray, segment: np.ndarray, rank: np.ndarray, most: int):
    """Order of the suffixes at ``at`` by their segment, first ``most`` bytes and rank.

    ``segment`` ascends and every suffix has ``most`` bytes. Also returns whether each suffix
    of the order has the same segment and bytes as the one before it. Suffixes are sorted by their
    first bytes as numbers; those that agree in them are merged by comparisons.
    """
    prefixes = Prefixes(raw)
    n = len(at)
    heads = _heads(raw, at, most)
    order = np.lexsort((heads, segment))
    tied = (np.diff(segment[order]) == 0) & (np.diff(heads[order]) == 0)
    run = np.cumsum(np.append(0, ~tied)) if n else order
    open_ = np.flatnonzero(np.append(tied, False) | np.append(False, tied)) if n else order
    order[open_] = _merged(raw, prefixes, at, run[open_], rank, order[open_], most)
    same = np.zeros(n, bool)
    near = np.flatnonzero(tied) + 1
    i, j = at[order[near - 1]], at[order[near]]
    same[near] = prefixes.hashes(i, most) == prefixes.hashes(j, most)
    if not _verified(raw, at[order[np.flatnonzero(same) - 1]], at[order[np.flatnonzero(same)]], most):
        order = np.array(sorted(range(n), key=lambda x: (segment[x], raw[at[x]:at[x] + most].tobytes(), rank[x])), np.int64)
        near = np.flatnonzero(segment[order[1:]] == segment[order[:-1]]) + 1
        same = np.zeros(n, bool)
        same[near] = [raw[a:a + most].tobytes() == raw[b:b + most].tobytes()
                      for a, b in zip(at[order[near - 1]], at[order[near]], strict=True)]
    return order, same


def _merged(raw: np.ndarray, prefixes: Prefixes, at: np.ndarray, segment: np.ndarray, rank: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """``order`` sorted by a mergesort within each run of equal ``segment``, which has a number per place of ``order``."""
    n = len(order)

    def before(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether suffix x precedes suffix y; both are numbers of suffixes."""
        i, j = at[x], at[y]
        length = prefixes.common(i, j, most)
        ends = length == most
        step = np.where(ends, 0, length)
        return np.where(ends, rank[x] < rank[y], raw[i + step] < raw[j + step])

    order = order.copy()
    first = np.flatnonzero(np.diff(segment, prepend=-1))
    sizes = np.diff(np.append(first, n))
    inside = np.arange(n) - np.repeat(first, sizes)
    size_of, first_of = np.repeat(sizes, sizes), np.repeat(first, sizes)
    half = 1
    while half < sizes.max(initial=0):
        # Each place finds, by binary search, how many of the other half go before it.
        active = np.flatnonzero(size_of > half)  # whole segments that are not sorted yet
        place, begin = inside[active], first_of[active]
        pair = place // (2 * half) * (2 * half)
        right = place - pair >= half
        other = pair + np.where(right, 0, half)
        low, high = np.zeros(len(active), np.int64), np.clip(size_of[active] - other, 0, half)
        own, other = order[active], begin + other
        live = np.flatnonzero(high > 0)
        while len(live):
            middle = (low[live] + high[live]) >> 1
            goes = before(order[other[live] + middle], own[live])
            low[live] = np.where(goes, middle + 1, low[live])
            high[live] = np.where(goes, high[live], middle)
            live = live[low[live] < high[live]]
        order[begin + place - np.where(right, half, 0) + low] = own
        half *= 2
    return order


def _verified(raw: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> bool:
    """Whether substrings that have equal hashes are equal."""
    offsets = np.arange(most)
    return all((raw[i[k:k + 4096, None] + offsets] == raw[j[k:k + 4096, None] + offsets]).all() for k in range(0, len(i), 4096))

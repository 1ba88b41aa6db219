"""Keyed pseudo-random permutations of row numbers.

A permutation of 0..n-1 is computed place by place, so a shuffle of a label needs no
sorting and no row has to move. The numbers below ``width * height``, the smallest such
product from n on, are pairs of digits; each round adds to one digit, modulo its size, a hash of the
other, which can be undone, so a network of rounds is a permutation of the pairs. Places
that land on n or beyond are sent through again until they land below (cycle walking), which
leaves a permutation of 0..n-1.
"""

from __future__ import annotations

import hashlib
import math
import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROUNDS = 6
MASK = (1 << 32) - 1
#: The multiplier of the mixing function, an odd number below 2^27, so that products fit in 63 bits.
MULTIPLIER = 73244475


def shape(n: int) -> tuple[int, int]:
    """Sizes of the two digits."""
    width = math.isqrt(max(n, 1) - 1) + 1
    return width, -(-max(n, 1) // width)


def round_keys(seed: int, reps: int) -> np.ndarray:
    """The keys of replicates 1 to ``reps``, one row each: 32 bits of a digest per round."""
    return np.array([[int(hashlib.md5(f"{seed}|{rep}|{r}".encode()).hexdigest()[:8], 16) for r in range(ROUNDS)]
                     for rep in range(1, reps + 1)], np.int64).reshape(reps, ROUNDS)


def mix(x: np.ndarray, key: int) -> np.ndarray:
    h = (x + key) & MASK
    for _ in range(2):
        h = ((h ^ (h >> 16)) * MULTIPLIER) & MASK
    return h ^ (h >> 16)


def _network(x: np.ndarray, width: int, height: int, keys) -> np.ndarray:
    high, low = x // width, x % width
    for r, key in enumerate(keys):
        if r % 2:
            high = (high + mix(low, int(key))) % height
        else:
            low = (low + mix(high, int(key))) % width
    return high * width + low


def permuted(x: np.ndarray, n: int, keys) -> np.ndarray:
    """Where the permutation of one replicate sends the numbers ``x``, each from 0 to n-1."""
    width, height = shape(n)
    out = _network(x, width, height, keys)
    beyond = np.flatnonzero(out >= n)
    while len(beyond):
        out[beyond] = _network(out[beyond], width, height, keys)
        beyond = beyond[out[beyond] >= n]
    return out

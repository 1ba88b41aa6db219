"""MD5 of many short texts at once.

The steps run over arrays, one element per text, so a digest costs a fraction of a call. Texts that
share their bytes but for a lead of the same length are laid out once. What does not fit one
block of 64 bytes goes through the library.
"""

from __future__ import annotations

import hashlib
import math
import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
ADDED = [np.uint32(int(abs(math.sin(i + 1)) * 2 ** 32)) for i in range(64)]
SHIFTS = [np.uint32(s) for turn in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for _ in range(4) for s in turn]
#: Bytes of a text that fit one block, beside the mark of its end and its length.
FITS = 55
#: Digests whose steps run together: enough that a step costs more than its call, few enough for a core's cache.
AT_ONCE = 1 << 15


def _block(words: list[np.ndarray | None], n: int) -> list[np.ndarray]:
    """The four words of the digests of ``n`` blocks; a word of None is zero in all."""
    a, b, c, d = (np.full(n, word, np.uint32) for word in START)
    f = np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            at = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            at = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            at = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            at = 7 * i % 16
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        np.add(f, ADDED[i], out=f)
        if words[at] is not None:
            np.add(f, words[at], out=f)
        np.left_shift(f, SHIFTS[i], out=a)
        np.right_shift(f, np.uint32(32) - SHIFTS[i], out=f)
        np.bitwise_or(a, f, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return [word + np.uint32(first) for word, first in zip((a, b, c, d), START)]


def _number(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Eight bytes of a digest as a number in the order of the bytes."""
    return high.byteswap().astype(np.uint64) << np.uint64(32) | low.byteswap()


def digests(leads: list[bytes], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the MD5 of each lead followed by each text, one row per lead.

    The halves are numbers; pairs of them have the order of the digests.
    """
    out = np.empty((2, len(leads), len(texts)), np.uint64)
    size = np.array([len(text) for text in texts], np.int64)
    for length in {len(lead) for lead in leads}:
        mine = np.array([i for i, lead in enumerate(leads) if len(lead) == length])
        begins = np.frombuffer(b"".join([leads[i][:64].ljust(64, b"\0") for i in mine]), "<u4").reshape(-1, 16).astype(np.uint32)
        fits = np.flatnonzero(size + length <= FITS)
        gap = bytes(length)
        laid = np.frombuffer(b"".join([(gap + texts[k] + b"\x80").ljust(56, b"\0") for k in fits]), "<u4").reshape(-1, 14)
        for at in range(0, len(fits), AT_ONCE):
            here = fits[at:at + AT_ONCE]
            columns = [*laid[at:at + AT_ONCE].T.astype(np.uint32), ((size[here] + length) * 8).astype(np.uint32)]
            together = AT_ONCE // len(here)
            for some in range(0, len(mine), together):
                of, start = mine[some:some + together], begins[some:some + together]
                words = [(column | start[:, w, None]).ravel() if 4 * w < length else np.tile(column, len(of)) if column.any() else None
                         for w, column in enumerate(columns)]
                a, b, c, d = _block([*words, None], len(of) * len(here))
                shape = len(of), len(here)
                out[0][np.ix_(of, here)], out[1][np.ix_(of, here)] = _number(a, b).reshape(shape), _number(c, d).reshape(shape)
        for k in np.flatnonzero(size + length > FITS):
            for i in mine:
                out[:, i, k] = np.frombuffer(hashlib.md5(leads[i] + texts[k]).digest(), ">u8")
    return out[0], out[1]

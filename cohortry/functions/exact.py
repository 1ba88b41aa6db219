"""Exact null distributions of rank tests on small panels without ties.

A distribution depends on the sizes of a panel only, so it is made once per task for all
panels of those sizes. Counts are kept as probabilities, which neither overflow nor cancel.
"""

from __future__ import annotations

import math
import sys
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Up to so many pairs, all orders are counted for a rank correlation; beyond, a series is used.
COUNTED_PAIRS = 9
#: Coefficients of the Edgeworth series of Spearman's statistic (algorithm AS 89).
SERIES = (0.2274, 0.2531, 0.1745, 0.0758, 0.1033, 0.3932, 0.0879, 0.0151, 0.0072, 0.0831, 0.0131, 4.6e-4)


@lru_cache(maxsize=256)
def rank_sum_null(m: int, n: int) -> np.ndarray:
    """P(U <= u) for u from 0 to m*n, where U counts pairs in which the first of m and n is larger.

    The largest of all values belongs to the first group with chance m/(m+n), and is then larger
    than all n others. Takes time in m*n squared and memory in m*n times the smaller size.
    """
    m, n = max(m, n), min(m, n)  # the distribution is the same for both orders
    columns = [np.ones(1)] * (n + 1)  # for one size of the first group: by size of the second
    for i in range(1, m + 1):
        row = [np.ones(1)]
        for j in range(1, n + 1):
            both = np.zeros(i * j + 1)
            both[j:] += columns[j] * (i / (i + j))
            both[:len(row[-1])] += row[-1] * (j / (i + j))
            row.append(both)
        columns = row
    return np.minimum(np.cumsum(columns[n]), 1.0)


@lru_cache(maxsize=4096)
def signed_rank_null(n: int) -> np.ndarray:
    """P(V <= v) for v from 0 to n(n+1)/2, where V sums the ranks with a positive sign."""
    out = np.ones(1)
    for rank in range(1, n + 1):
        longer = np.zeros(len(out) + rank)
        longer[:len(out)] += out / 2
        longer[rank:] += out / 2
        out = longer
    return np.minimum(np.cumsum(out), 1.0)


@lru_cache(maxsize=16)
def spearman_null(n: int) -> np.ndarray:
    """P(D <= d) for d from 0 on, where D sums the squared gaps between two orders of n.

    Counted over sets of second ranks that the first few items have taken.
    """
    top = n * (n * n - 1) // 3
    reached = {0: np.eye(1, top + 1)[0]}
    for item in range(n):
        after: dict[int, np.ndarray] = {}
        for taken, counts in reached.items():
            for rank in range(n):
                if not taken >> rank & 1:
                    gap = (item - rank) ** 2
                    into = after.setdefault(taken | 1 << rank, np.zeros(top + 1))
                    into[gap:] += counts[:top + 1 - gap]
        reached = after
    return np.cumsum(reached[(1 << n) - 1]) / math.factorial(n)


def spearman_series(d: float, n: int, lower: bool) -> float:
    """P(D >= d), or P(D < d) if ``lower``, by the Edgeworth series."""
    c = SERIES
    b = 1 / n
    x = (6 * (d - 1) * b / (n * n - 1) - 1) * math.sqrt(1 / b - 1)
    y = x * x
    inner = c[8] - c[9] * b + y * b * (c[10] - c[11] * y)
    u = x * b * (c[0] + b * (c[1] + c[2] * b) + y * (-c[3] + b * (c[4] + c[5] * b) - y * b * (c[6] + c[7] * b - y * inner)))
    tail = math.erfc((-x if lower else x) / math.sqrt(2)) / 2
    return min(1.0, max(0.0, (-u if lower else u) / math.exp(y / 2) + tail))


def two_sided(null: np.ndarray, at: int) -> float:
    """Twice the smaller tail of a symmetric count, the observed value in it; at most 1."""
    at = min(at, len(null) - 1 - at)
    return min(1.0, 2 * float(null[at]))


def spearman_two_sided(rho: float, n: int) -> float:
    d = round((n ** 3 - n) * (1 - rho) / 6)
    if n <= COUNTED_PAIRS:
        null = spearman_null(n)
        below = float(null[d])
        above = 1 - (float(null[d - 1]) if d else 0.0)
        return min(1.0, 2 * min(below, above))
    if d > (n ** 3 - n) / 6:
        return min(1.0, 2 * spearman_series(d, n, False))
    return min(1.0, 2 * spearman_series(d + 2, n, True))


def _each(compute, *columns: pd.Series) -> pd.Series:
    """``compute`` of each row without missing values."""
    known = ~np.any([c.isna().to_numpy() for c in columns], axis=0)
    out = np.full(len(known), None, dtype=object)
    values = [c.to_numpy()[known].tolist() for c in columns]
    out[known] = [compute(*row) for row in zip(*values, strict=True)]
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.DoubleType())
def rank_sum_exact(statistic: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return _each(lambda u, m, n: two_sided(rank_sum_null(int(max(m, n)), int(min(m, n))), round(u)), statistic, n1, n2)


@F.pandas_udf(T.DoubleType())
def signed_rank_exact(statistic: pd.Series, n: pd.Series) -> pd.Series:
    return _each(lambda v, k: two_sided(signed_rank_null(int(k)), round(v)), statistic, n)


@F.pandas_udf(T.DoubleType())
def spearman_exact(rho: pd.Series, n: pd.Series) -> pd.Series:
    return _each(lambda r, k: spearman_two_sided(r, int(k)) if k > 1 else None, rho, n)

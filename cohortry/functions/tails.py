"""Tail probabilities for the last step of a test.

The tests reduce to one row per group on Spark; these Arrow-batched functions
turn that row's statistic into a p-value.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors get these functions with the job and need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_STEPS = 100_000
_EPS = 1e-16
_TINY = 1e-300
#: From here on a gamma shape or a number of degrees of freedom takes its asymptotic form.
_FAR = 50_000.0


def _lgamma(v: np.ndarray) -> np.ndarray:
    return np.fromiter((math.lgamma(x) for x in v), float, len(v))


def _erfc(v: np.ndarray) -> np.ndarray:
    return np.fromiter(map(math.erfc, v), float, len(v))


def _upper_gamma_far(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Temme's uniform expansion of Q(a, x), for a from ``_FAR`` on."""
    m = (x - a) / a
    far = np.abs(m) > 1e-4
    with np.errstate(divide="ignore", invalid="ignore"):
        # m - log(1 + m), by its series where the difference would lose digits.
        gap = np.where(far, m - np.log1p(m), m * m * (1 / 2 - m * (1 / 3 - m * (1 / 4 - m * (1 / 5 - m / 6)))))
        eta = np.sign(m) * np.sqrt(2 * gap)
        first = np.where(far, 1 / m - 1 / eta, -1 / 3 + eta * (1 / 12 - eta * (2 / 135 - eta / 864)))
        second = np.where(far, 1 / eta ** 3 - 1 / m ** 3 - 1 / m ** 2 - 1 / (12 * m), -1 / 540 - eta / 288)
        # Both cancel for small m; there the leading terms do.
        second = np.where(np.abs(m) < 0.02, -1 / 540 - eta / 288, second)
    return 0.5 * _erfc(eta * np.sqrt(a / 2)) + np.exp(-a * gap) / np.sqrt(2 * np.pi * a) * (first + second / a)


def upper_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma Q(a, x) for a > 0, x >= 0.

    NaN where a series or fraction does not settle.
    """
    out = np.ones_like(x)
    scale = np.zeros_like(x)
    distant = (a >= _FAR) & (x > 0)
    if distant.any():
        out[distant] = _upper_gamma_far(a[distant], x[distant])
    live = (x > 0) & ~distant
    scale[live] = np.exp(a[live] * np.log(x[live]) - x[live] - _lgamma(a[live]))
    series = live & (x < a + 1)
    if series.any():
        s, z = a[series].copy(), x[series]
        term = 1.0 / s
        total = term.copy()
        for _ in range(_STEPS):
            s += 1
            term = term * z / s
            total += term
            if np.all(term < total * _EPS):
                break
        else:
            total[:] = np.nan
        out[series] = 1 - total * scale[series]
    fraction = live & ~series
    if fraction.any():
        s, z = a[fraction], x[fraction]
        b = z + 1 - s
        c = np.full_like(z, 1 / _TINY)
        d = 1 / b
        h = d.copy()
        for i in range(1, _STEPS):
            an = -i * (i - s)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = b + an / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            step = d * c
            h = h * step
            if np.all(np.abs(step - 1) < 1e-15):
                break
        else:
            h[:] = np.nan
        out[fraction] = h * scale[fraction]
    return np.clip(out, 0.0, 1.0)


def _beta_fraction(a, b, x):
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in range(1, _STEPS):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            step = d * c
            h = h * step
        if np.all(np.abs(step - 1) < 1e-15):
            return h
    return np.full_like(h, np.nan)


def beta_share(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b)."""
    out = np.where(x >= 1, 1.0, 0.0)
    live = (x > 0) & (x < 1)
    for flip in (False, True):
        near = live & ((x >= (a + 1) / (a + b + 2)) == flip)
        if not near.any():
            continue
        p, q, z = a[near], b[near], x[near]
        if flip:
            p, q, z = q, p, 1 - z
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q)
                       + p * np.log(z) + q * np.log1p(-z))
        part = front * _beta_fraction(p, q, z) / p
        out[near] = 1 - part if flip else part
    return np.clip(out, 0.0, 1.0)


def student_tails(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) of Student's distribution; Hill's normal form for many degrees of freedom."""
    out = np.empty_like(t)
    far = dof >= _FAR
    near = ~far
    if near.any():
        v, d = t[near], dof[near]
        out[near] = beta_share(d / 2, np.full_like(v, 0.5), d / (d + v * v))
    if far.any():
        v, d = t[far], dof[far]
        a = d - 0.5
        b = 48 * a * a
        z2 = a * np.log1p(v * v / d)
        z = np.sqrt(z2) * (1 + ((((-0.4 * z2 - 3.3) * z2 - 24) * z2 - 85.5) / (0.8 * z2 * z2 + 100 + b) + z2 + 3) / b)
        out[far] = _erfc(z / math.sqrt(2))
    return out


def student_points(tail: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """The t with P(|T| >= t) = tail, for tails between 0 and 1.

    The point is bracketed by doubling; then Newton steps, or halving where a step leaves the bracket.
    """
    low, high = np.zeros_like(tail), np.ones_like(tail)
    while (short := student_tails(high, dof) > tail).any():
        low = np.where(short, high, low)
        high = np.where(short, 2 * high, high)
    # Twice the density at 0; its logarithm by lgamma, or 1/sqrt(2 pi) where that is the limit.
    with np.errstate(over="ignore"):
        peak = np.where(dof < _FAR, np.exp(_lgamma((dof + 1) / 2) - _lgamma(dof / 2)) / np.sqrt(dof * np.pi), 1 / math.sqrt(2 * math.pi))
    t = (low + high) / 2
    for _ in range(80):
        over = student_tails(t, dof) - tail
        low, high = np.where(over > 0, t, low), np.where(over > 0, high, t)
        step = t + over / (2 * peak * np.exp(-(dof + 1) / 2 * np.log1p(t * t / dof)))
        after = np.where((step > low) & (step < high), step, (low + high) / 2)
        if np.all(np.abs(after - t) <= 1e-15 * t):
            break
        t = after
    return t


def _where_known(compute, *series: pd.Series) -> pd.Series:
    arrays = [s.to_numpy(dtype=float, na_value=np.nan) for s in series]
    known = np.all([np.isfinite(v) for v in arrays], axis=0)
    out = np.full(len(known), None, dtype=object)
    if known.any():
        found = compute(*[v[known] for v in arrays])
        out[known] = [v if math.isfinite(v) else None for v in found.tolist()]
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.DoubleType())
def chi_square_tail(statistic: pd.Series, dof: pd.Series) -> pd.Series:
    """P(X >= statistic) for a chi-square variable."""
    return _where_known(
        lambda s, d: upper_gamma(d / 2, np.maximum(s, 0.0) / 2), statistic, dof)


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return _where_known(
        lambda v: _erfc(np.abs(v) / math.sqrt(2)), z)


@F.pandas_udf(T.DoubleType())
def student_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    return _where_known(student_tails, t, dof)


@F.pandas_udf(T.DoubleType())
def student_point(tail: pd.Series, dof: pd.Series) -> pd.Series:
    """The t that a Student variable exceeds in size with probability ``tail``."""
    return _where_known(student_points, tail, dof)


@F.pandas_udf(T.StructType([T.StructField("statistic", T.DoubleType()), T.StructField("dof", T.LongType())]))
def log_rank_form(gap: pd.Series, spread: pd.Series, seen: pd.Series) -> pd.DataFrame:
    """Quadratic form of the gaps over the levels that have subjects."""
    rows = []
    for u, v, n in zip(gap, spread, seen):
        here = np.flatnonzero(np.asarray(n, float) > 0)
        k = len(u)
        m = np.asarray(v, float).reshape(k, k)[np.ix_(here, here)][:-1, :-1]
        w = np.asarray(u, float)[here][:-1]
        if len(here) < 2 or not np.any(m):
            rows.append((None, None))
        else:
            rows.append((float(w @ np.linalg.pinv(m) @ w), len(here) - 1))
    out = pd.DataFrame(rows, columns=["statistic", "dof"])
    return out.astype({"statistic": "float64", "dof": "Int64"})

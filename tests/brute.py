"""Plain NumPy answers to compare the Spark operators with."""

import math

import numpy as np


def midranks(v):
    v = np.asarray(v, float)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def tie_sum(v):
    _, t = np.unique(np.asarray(v, float), return_counts=True)
    return float((t.astype(float) ** 3 - t).sum())


def normal_p(z):
    return math.erfc(abs(z) / math.sqrt(2))


def rank_sum(a, b):
    r = midranks(np.concatenate([a, b]))
    n1, n2 = len(a), len(b)
    w = r[:n1].sum() - n1 * (n1 + 1) / 2
    n = n1 + n2
    sd = math.sqrt(n1 * n2 / 12 * (n + 1 - tie_sum(np.concatenate([a, b])) / (n * (n - 1))))
    gap = w - n1 * n2 / 2
    z = (gap - np.sign(gap) * 0.5) / sd
    return w, z, normal_p(z)


def kruskal(groups):
    v = np.concatenate(groups)
    r, n, at, h = midranks(v), len(v), 0, 0.0
    for g in groups:
        h += r[at:at + len(g)].sum() ** 2 / len(g)
        at += len(g)
    h = 12 / (n * (n + 1)) * h - 3 * (n + 1)
    return h / (1 - tie_sum(v) / (n ** 3 - n))


def signed_rank(d):
    d = np.array([x for x in d if x != 0])
    r, n = midranks(np.abs(d)), len(d)
    v = r[d > 0].sum()
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie_sum(np.abs(d)) / 48)
    gap = v - n * (n + 1) / 4
    return v, (gap - np.sign(gap) * 0.5) / sd


def bh(p):
    known = [x for x in p if x is not None]
    n = len(known)
    order = sorted(range(n), key=lambda i: -known[i])
    out, low = [0.0] * n, 1.0
    for k, i in enumerate(order):
        low = min(low, known[i] * n / (n - k))
        out[i] = low
    it = iter(out)
    return [None if x is None else next(it) for x in p]


def chi_square(rows):
    t = np.asarray(rows, float)
    if len(t) == 1:
        return (t[0, 0] - t[0, 1]) ** 2 / t.sum()
    e = np.outer(t.sum(1), t.sum(0)) / t.sum()
    gap = np.abs(t - e)
    if t.shape == (2, 2):
        gap = gap - min(0.5, gap.min())
    return float((gap ** 2 / e).sum())


def efron(beta, time, died, x):
    total = 0.0
    for t in np.unique(time[died == 1]):
        at, dead = time >= t, (time == t) & (died == 1)
        d = dead.sum()
        total += beta * x[dead].sum()
        s, e = np.exp(beta * x[at]).sum(), np.exp(beta * x[dead]).sum()
        total -= sum(math.log(s - k / d * e) for k in range(d))
    return total


def maximum(f, low, high):
    for _ in range(200):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (a, high) if f(a) < f(b) else (low, b)
    return (low + high) / 2


def kaplan_meier(time, died):
    s, out = 1.0, []
    for t in np.unique(time):
        n, d = (time >= t).sum(), ((time == t) & (died == 1)).sum()
        s *= 1 - d / n
        out.append((t, n, d, s))
    return out


def log_rank(time, died, group, levels):
    k = len(levels)
    u, v = np.zeros(k), np.zeros((k, k))
    for t in np.unique(time[died == 1]):
        y = np.array([((time >= t) & (group == g)).sum() for g in levels], float)
        d = np.array([((time == t) & (died == 1) & (group == g)).sum() for g in levels], float)
        n, m = y.sum(), d.sum()
        u += d - m * y / n
        if n > 1:
            p = y / n
            v += m * (n - m) / (n - 1) * (np.diag(p) - np.outer(p, p))
    return float(u[:-1] @ np.linalg.solve(v[:-1, :-1], u[:-1]))


def reml(log_theta, y, x, g):
    theta = math.exp(log_theta)
    same = g[:, None] == g[None, :]
    v = np.eye(len(y)) + theta * same
    design = np.column_stack([np.ones(len(y)), x])
    vi = np.linalg.inv(v)
    xx = design.T @ vi @ design
    b = np.linalg.solve(xx, design.T @ vi @ y)
    r = y - design @ b
    rest = float(r @ vi @ r)
    free = len(y) - 2
    value = free * math.log(rest) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(xx)[1]
    sigma2 = rest / free
    return -value, b, np.sqrt(np.diag(np.linalg.inv(xx)) * sigma2), sigma2

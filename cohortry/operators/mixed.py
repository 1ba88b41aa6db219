"""Linear model with a random intercept per group, fitted by REML."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.tails import student_two_sided
from cohortry.operators.moments import quantiles_by
from cohortry.session import staged

#: Newton steps at most, and the relative step at which the variance ratio counts as found.
NEWTON_STEPS, TOLERANCE = 12, 1e-7


def _search(df: DataFrame, y: str, x: str, group: str) -> dict | None:
    """The best variance ratio and what belongs to it; None where there is nothing to fit.

    Rows reduce to sums per group, and groups of equal size to one row, because
    the likelihood depends on a group only through its size and products of its
    sums. One Spark job over that table evaluates a grid of variance ratios; a few
    more give the derivatives for Newton steps. Each returns a few numbers per
    ratio.
    """
    rows = staged(df.select(
        F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x"), F.col(group).alias("g")
    ).filter("y is not null and x is not null and g is not null"))
    mean = rows.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    packed = mean.select(F.struct("mx", "my").alias("_m"))
    centred = rows.withColumn("_m", packed.scalar()).select(
        "g", (F.col("x") - F.col("_m.mx")).alias("x"), (F.col("y") - F.col("_m.my")).alias("y"))
    groups = centred.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"),
        F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("x") * F.col("y")).alias("xy"),
        F.sum(F.col("y") * F.col("y")).alias("yy"))
    sizes = staged(groups.groupBy("n").agg(
        F.count(F.lit(1)).alias("m"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy"),
        F.sum("xx").alias("xx"), F.sum("xy").alias("xy"), F.sum("yy").alias("yy"),
        F.sum(F.col("sx") * F.col("sx")).alias("sxsx"),
        F.sum(F.col("sx") * F.col("sy")).alias("sxsy"),
        F.sum(F.col("sy") * F.col("sy")).alias("sysy")))
    centre = mean.first()
    n_rows, n_groups = sizes.agg(F.sum(F.col("n") * F.col("m")), F.sum("m")).first()
    if not n_rows or n_rows < 3:
        return None

    def sums(thetas: list[float]) -> list[dict]:
        """The likelihood's sums and their first two derivatives at each ratio."""
        grid = sizes.withColumn("theta", F.explode(F.array(*[F.lit(float(t)) for t in thetas])))
        n, m, theta = F.col("n").cast("double"), F.col("m").cast("double"), F.col("theta")
        w = 1 / (1 + n * theta)
        picks = [F.sum(m * F.log(1 + n * theta)).alias("v0"), F.sum(m * n * w).alias("v1"),
                 F.sum(-m * n * n * w * w).alias("v2")]
        for name, size in (("s00", m * n), ("s01", F.col("sx")), ("t0", F.col("sy"))):
            picks += [F.sum(size * w).alias(f"{name}_0"), F.sum(-n * size * w * w).alias(f"{name}_1"),
                      F.sum(2 * n * n * size * w * w * w).alias(f"{name}_2")]
        for name, full, outer in (("s11", "xx", "sxsx"), ("t1", "xy", "sxsy"), ("q", "yy", "sysy")):
            picks += [F.sum(F.col(full) - theta * w * F.col(outer)).alias(f"{name}_0"),
                      F.sum(-w * w * F.col(outer)).alias(f"{name}_1"),
                      F.sum(2 * n * w * w * w * F.col(outer)).alias(f"{name}_2")]
        found = grid.groupBy("theta").agg(*picks).collect()
        return sorted((r.asDict() for r in found), key=lambda r: r["theta"])

    free = n_rows - 2

    def solve(s: dict) -> dict | None:
        a = [np.array([[s[f"s00_{k}"], s[f"s01_{k}"]], [s[f"s01_{k}"], s[f"s11_{k}"]]]) for k in range(3)]
        t = [np.array([s[f"t0_{k}"], s[f"t1_{k}"]]) for k in range(3)]
        det = np.linalg.det(a[0])
        if det <= 1e-12 * max(1.0, s["s00_0"] * abs(s["s11_0"])):
            return None
        cov = np.linalg.inv(a[0])
        b = cov @ t[0]
        gap = t[1] - a[1] @ b
        rest = max(s["q_0"] - b @ t[0], 1e-300)
        rest1 = s["q_1"] - 2 * b @ t[1] + b @ a[1] @ b
        rest2 = s["q_2"] - 2 * b @ t[2] + b @ a[2] @ b - 2 * gap @ cov @ gap
        turn = cov @ a[1]
        det1 = s["v1"] + np.trace(turn)
        det2 = s["v2"] + np.trace(cov @ a[2]) - np.trace(turn @ turn)
        return {"theta": s["theta"], "b": b, "cov": cov, "cov1": -cov @ a[1] @ cov,
                "rest": rest, "rest1": rest1, "rest2": rest2, "det2": det2,
                "value": free * math.log(rest) + s["v0"] + math.log(det),
                "slope": free * rest1 / rest + det1,
                "curve": free * (rest2 / rest - (rest1 / rest) ** 2) + det2}

    low, high, points = -14.0, 14.0, 33
    best = None
    for _ in range(2):
        width = (high - low) / (points - 1)
        thetas = [math.exp(low + i * width) for i in range(points)]
        fits = [v for v in map(solve, sums(thetas if best else [0.0, *thetas])) if v]
        if not fits:
            return None
        best = min([*fits, *([best] if best else [])], key=lambda v: v["value"])
        if best["theta"] == 0.0:
            break
        at = math.log(best["theta"])
        low, high = at - width, at + width
    # A ratio of 0 is the boundary, where there is no step to take.
    converged = best["theta"] == 0.0
    for _ in range(NEWTON_STEPS):
        if converged or best["curve"] <= 0:
            break
        step = best["slope"] / best["curve"]
        if abs(step) <= TOLERANCE * best["theta"]:
            converged = True
            break
        nearer = solve(sums([best["theta"] - step])[0]) if step < best["theta"] else None
        if nearer is None:
            break
        best = nearer
    return {"best": best, "free": free, "n_rows": int(n_rows), "n_groups": int(n_groups), "mx": centre["mx"], "my": centre["my"],
            "converged": converged, "sigma2": float(best["rest"]) / free}


def random_intercept(df: DataFrame, y: str, x: str, group: str) -> DataFrame:
    """Fit ``y ~ x + (1 | group)``; two rows, intercept and slope.

    ``converged`` is false where the search ended before the variance ratio settled.
    """
    schema = ("term string, estimate double, std_err double, dof double, t double, "
              "sigma double, group_sd double, n long, n_groups long, singular boolean, converged boolean")
    found, records = _search(df, y, x, group), []
    if found:
        best, free, sigma2 = found["best"], found["free"], found["sigma2"]
        theta = best["theta"]
        singular = theta < 1e-6
        # The fit is in centred units: intercept = (1, -mean) of the centred coefficients.
        contrasts = {"intercept": np.array([1.0, -found["mx"]]), x: np.array([0.0, 1.0])}
        # Hessian of the REML deviance in (sigma^2, theta).
        hss = -free / sigma2 ** 2 + 2 * best["rest"] / sigma2 ** 3
        hst = -best["rest1"] / sigma2 ** 2
        htt = best["rest2"] / sigma2 + best["det2"]
        hessian = np.array([[hss, hst], [hst, htt]])
        records = []
        for name, c in contrasts.items():
            v = float(c @ best["cov"] @ c)
            dof = float(free)
            if not singular and np.linalg.det(hessian) > 0:
                g = np.array([v, sigma2 * float(c @ best["cov1"] @ c)])
                spread = 2 * float(g @ np.linalg.solve(hessian, g))
                if spread > 0:
                    dof = float(2 * (sigma2 * v) ** 2 / spread)
            value = float(c @ best["b"]) + (found["my"] if name == "intercept" else 0.0)
            error = float(math.sqrt(sigma2 * v))
            records.append((name, value, error, dof, value / error if error else None,
                            math.sqrt(sigma2), math.sqrt(sigma2 * theta), found["n_rows"],
                            found["n_groups"], singular, found["converged"]))
    out = df.sparkSession.createDataFrame(records, schema)
    return out.withColumn("p_value", student_two_sided("t", "dof"))


def _known(df: DataFrame, y: str, x: str, group: str) -> DataFrame:
    return df.select(F.col(group).alias(group), F.col(y).cast("double").alias("_y"), F.col(x).cast("double").alias("_x")).filter(
        F.col(group).isNotNull() & F.col("_y").isNotNull() & F.col("_x").isNotNull())


def _effects(rows: DataFrame, found: dict, group: str) -> DataFrame:
    """Residuals of the fixed part are averaged by group and drawn towards 0, the more the smaller the group."""
    b, theta = found["best"]["b"], float(found["best"]["theta"])
    gap = F.col("_y") - found["my"] - float(b[0]) - float(b[1]) * (F.col("_x") - found["mx"])
    sums = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(gap).alias("_gap"))
    return sums.select(group, "n", (theta * F.col("_gap") / (1 + theta * F.col("n"))).alias("effect"))


def random_effects(df: DataFrame, y: str, x: str, group: str) -> DataFrame:
    """The predicted effect of each group in ``y ~ x + (1 | group)``: the best linear unbiased predictor."""
    found, rows = _search(df, y, x, group), _known(df, y, x, group)
    return _effects(rows, found, group) if found else _effects(rows, {"best": {"b": (0.0, 0.0), "theta": 0.0}, "mx": 0.0, "my": 0.0}, group).limit(0)


def residual_summary(df: DataFrame, y: str, x: str, group: str) -> DataFrame:
    """One row about the fit of ``y ~ x + (1 | group)``: the REML criterion, the correlation of the fixed
    effects and the exact quartiles of the residuals in units of sigma. No row where nothing can be fitted."""
    found, rows = _search(df, y, x, group), _known(df, y, x, group)
    probs = {"lowest": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "highest": 1.0}
    facts = {"n": ("long", None), "n_groups": ("long", None), "reml_criterion": ("double", None), "fixed_correlation": ("double", None)}
    scaled = rows.select(F.lit(0.0).alias("_scaled")).limit(0)
    if found:
        best, free, b = found["best"], found["free"], found["best"]["b"]
        turn = np.array([[1.0, -found["mx"]], [0.0, 1.0]])
        cov = turn @ best["cov"] @ turn.T
        spread = math.sqrt(cov[0, 0] * cov[1, 1])
        values = (found["n_rows"], found["n_groups"], float(best["value"]) + free * (1 + math.log(2 * math.pi / free)),
                  float(cov[0, 1] / spread) if spread else None)
        facts = {name: (kind, v) for (name, (kind, _)), v in zip(facts.items(), values, strict=True)}
        fixed = found["my"] + float(b[0]) + float(b[1]) * (F.col("_x") - found["mx"])
        scaled = rows.join(_effects(rows, found, group), group).select(
            ((F.col("_y") - fixed - F.col("effect")) / math.sqrt(found["sigma2"])).alias("_scaled"))
    quartiles = quantiles_by(scaled, [], "_scaled", probs)
    return quartiles.filter(F.col("median").isNotNull()).select(
        *[F.lit(v).cast(kind).alias(name) for name, (kind, v) in facts.items()], *probs)

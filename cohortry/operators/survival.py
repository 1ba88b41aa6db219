"""Survival curves and tests from counts per distinct time."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.tails import chi_square_tail, log_rank_form, normal_two_sided
from cohortry.operators.ranks import significant_digits
from cohortry.operators.running import BUCKET, KEY, Run, clean, cut_ranges, running, settle
from cohortry.session import staged

DEATHS_PER_BLOCK = 4096
SPREAD_DEATHS = 1_000_000
#: Fixed value: the 97.5 % point of the normal distribution.
NORMAL_975 = 1.959963984540054


def _timed(df: DataFrame, time: str, event: str) -> DataFrame:
    return (df.withColumn("_time", F.col(time).cast("double"))
            .withColumn("_died", F.col(event).cast("int"))
            .filter(F.col("_time").isNotNull() & F.col("_died").isNotNull()))


def _counts(df: DataFrame, time: str, event: str, strata: list[str]) -> DataFrame:
    return _timed(df, time, event).groupBy(*strata, "_time").agg(
        F.sum("_died").alias("n_event"), F.count(F.lit(1)).alias("_n"))


def _curve(counts: DataFrame, strata: list[str], buckets: int | None, more: list[str] = ()) -> DataFrame:
    """Product-limit estimates at the distinct times of ``counts``."""
    counts, buckets = settle(counts, strata, buckets)
    cut = cut_ranges(counts, strata, "_time", buckets, used=["_n", "n_event"])
    risk = running(cut, "_time", [Run("n_risk", "_n", reverse=True), Run("_events_upto", "n_event")])
    d, n = F.col("n_event"), F.col("n_risk")
    steps = (
        risk.withColumn("_log", F.when(d < n, F.log1p(-d / n)).otherwise(F.lit(0.0)))
        .withColumn("_all_died", ((d == n) & (n > 0)).cast("long"))
        .withColumn("_var", F.when(d < n, d / (n.cast("double") * (n - d))).otherwise(F.lit(0.0))))
    curve = clean(running(steps, "_time", [
        Run("_log_surv", "_log"), Run("_ended", "_all_died"), Run("_greenwood", "_var")]))
    alive = F.col("_ended") == 0
    survival = F.when(alive, F.exp("_log_surv")).otherwise(F.lit(0.0))
    return curve.select(
        *strata, F.col("_time").alias("time"), "n_risk", "n_event",
        (F.col("_n") - F.col("n_event")).alias("n_censored"), survival.alias("survival"),
        F.when(alive, survival * F.sqrt("_greenwood")).alias("std_err"), *more)


def kaplan_meier(df: DataFrame, time: str, event: str, strata: list[str] = (),
                 buckets: int | None = None) -> DataFrame:
    """Product-limit curve: one row per stratum and distinct time."""
    strata = list(strata)
    return _curve(_counts(df, time, event, strata), strata, buckets)


def risk_table(df: DataFrame, time: str, event: str, at: list[float], strata: list[str] = (),
               buckets: int | None = None) -> DataFrame:
    """Numbers at risk, events so far and survival at the times ``at``, one row per stratum and time.

    ``n_risk`` counts subjects whose time is not before; survival is that just after. The times
    join the distinct times of the curve as rows without subjects, so the running sums that make the
    curve answer for them too and no row looks another up.
    """
    strata = list(strata)
    counts = _counts(df, time, event, strata).withColumn("_asked", F.lit(False))
    asked = F.array(*[F.lit(float(t)) for t in dict.fromkeys(at)])
    zero = F.lit(0).cast("long")
    grid = counts.select(*strata).distinct() if strata else counts.limit(1).select()
    grid = grid.select(*strata, F.explode(asked).alias("_time"), zero.alias("n_event"), zero.alias("_n"), F.lit(True).alias("_asked"))
    both = counts.unionByName(grid).groupBy(*strata, "_time").agg(
        F.sum("n_event").alias("n_event"), F.sum("_n").alias("_n"), F.bool_or("_asked").alias("_asked"))
    curve = _curve(both, strata, buckets, ["_asked", "_events_upto"]).filter("_asked")
    # After the last subject n_risk has no rows left to sum.
    return curve.select(*strata, "time", "n_risk", F.col("_events_upto").alias("events_so_far"), "survival", "std_err")


#: Closer to one half than this counts as one half.
HALF_SLACK = 1.5e-8


def median_survival(df: DataFrame, time: str, event: str, strata: list[str] = (), buckets: int | None = None) -> DataFrame:
    """Median time per stratum with 95 % limits from the log survival, null where the curve stays above a half.

    Where the curve runs level at a half, the median is the middle of that step.
    """
    strata = list(strata)
    curve = kaplan_meier(df, time, event, strata, buckets)
    spread = NORMAL_975 * F.col("std_err") / F.col("survival")
    lines = {"median": F.col("survival"),
             "median_low": F.when(F.col("survival") > 0, F.col("survival") * F.exp(-spread)),
             "median_high": F.when(F.col("survival") > 0, F.least(F.lit(1.0), F.col("survival") * F.exp(spread)))}
    ends = []
    for name, line in lines.items():
        ends += [F.min(F.when(line < 0.5 + HALF_SLACK, F.col("time"))).alias(f"_{name}_first"),
                 F.min(F.when(line < 0.5 - HALF_SLACK, F.col("time"))).alias(f"_{name}_next")]
    rows = curve.groupBy(*strata).agg(F.sum(F.col("n_event") + F.col("n_censored")).alias("n"), F.sum("n_event").alias("n_event"), *ends)
    middle = [((F.col(f"_{m}_first") + F.coalesce(f"_{m}_next", f"_{m}_first")) / 2).alias(m) for m in lines]
    return rows.filter("n > 0").select(*strata, "n", "n_event", *middle)


def _levels_of(df: DataFrame, group: str) -> list:
    """The levels present. Each becomes a row and column of the test's covariance, so they are few."""
    return sorted(row[0] for row in df.select(group).filter(F.col(group).isNotNull()).distinct().collect())


def log_rank(df: DataFrame, time: str, event: str, group: str, by: list[str] = (),
             levels: list | None = None, buckets: int | None = None) -> DataFrame:
    """Log-rank test of the levels of ``group``, one row per ``by`` panel."""
    by = list(by)
    rows = _timed(df, time, event).filter(F.col(group).isNotNull())
    levels = list(levels) if levels is not None else _levels_of(rows, group)
    if len(levels) < 2:
        raise ValueError("a log-rank test needs two levels")
    index = range(len(levels))
    is_level = [F.col(group) == F.lit(v) for v in levels]
    counts = rows.groupBy(*by, "_time").agg(
        *[F.count_if(is_level[i]).alias(f"_n{i}") for i in index],
        *[F.count_if(is_level[i] & (F.col("_died") == 1)).alias(f"_d{i}") for i in index])
    counts, buckets = settle(counts, by, buckets)
    cut = cut_ranges(counts, by, "_time", buckets,
                     used=[f"_{k}{i}" for k in "nd" for i in index])
    risk = running(cut, "_time", [Run(f"_y{i}", f"_n{i}", reverse=True) for i in index])
    deaths = reduce(lambda a, b: a + b, [F.col(f"_d{i}") for i in index]).cast("double")
    at_risk = reduce(lambda a, b: a + b, [F.col(f"_y{i}") for i in index]).cast("double")
    share = [F.col(f"_y{i}") / F.col("_y") for i in index]
    spread = F.when(F.col("_y") > 1, F.col("_d") * (F.col("_y") - F.col("_d")) / (F.col("_y") - 1)
                    ).otherwise(F.lit(0.0))
    sums = (
        risk.withColumn("_d", deaths).withColumn("_y", at_risk).filter("_d > 0")
        .groupBy(*by).agg(
            *[F.max(f"_y{i}").alias(f"_seen{i}") for i in index],
            *[F.sum(f"_d{i}").alias(f"_o{i}") for i in index],
            *[F.sum(F.col("_d") * share[i]).alias(f"_e{i}") for i in index],
            *[F.sum(spread * share[i] * ((1.0 if i == j else 0.0) - share[j])).alias(f"_v{i}_{j}")
              for i in index for j in index]))
    tested = sums.withColumn("_test", log_rank_form(
        F.array(*[F.col(f"_o{i}") - F.col(f"_e{i}") for i in index]),
        F.array(*[F.col(f"_v{i}_{j}") for i in index for j in index]),
        F.array(*[F.col(f"_seen{i}") for i in index])))
    return tested.select(
        *by, *[F.col(f"_o{i}").alias(f"observed_{v}") for i, v in enumerate(levels)],
        *[F.col(f"_e{i}").alias(f"expected_{v}") for i, v in enumerate(levels)],
        "_test.statistic", "_test.dof",
        chi_square_tail("_test.statistic", "_test.dof").alias("p_value"))


def _per_covariate(values: dict[str, float]) -> Column:
    pairs = [F.lit(v) for item in values.items() for v in item]
    return F.create_map(*pairs)[F.col("covariate")]


def cox_ph(df: DataFrame, time: str, event: str, covariates: list[str],
           max_steps: int = 25, tolerance: float = 1e-9, buckets: int | None = None) -> DataFrame:
    """One proportional-hazards fit per covariate, each on its own; Efron ties.

    A fit that does not converge has ``converged`` false.
    """
    return _cox_fits(df, time, event, covariates, max_steps, tolerance, buckets).drop("score_test")


def _cox_fits(df: DataFrame, time: str, event: str, covariates: list[str],
              max_steps: int = 25, tolerance: float = 1e-9, buckets: int | None = None) -> DataFrame:
    """The fits of :func:`cox_ph` and the score test of no effect.

    All covariates advance together: a Newton step is one aggregate over the
    staged distinct (covariate, time, value) counts and returns three numbers per covariate.
    """
    rows = _timed(df, time, event).select(
        "_time", "_died", *[F.col(c).cast("double").alias(c) for c in covariates])
    long = rows.unpivot(["_time", "_died"], list(covariates), "covariate", "_x").filter(
        F.col("_x").isNotNull() & ~F.isnan("_x"))
    cells = long.groupBy("covariate", "_time", "_x").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_died").alias("_d"))
    cells, buckets = settle(cells, ["covariate"], buckets)
    cells = cut_ranges(cells, ["covariate"], "_time", buckets, used=["_n", "_d"])
    if buckets > 1:
        cells = staged(cells)
    place = [c for c in (KEY, BUCKET) if c in cells.columns]
    shape = {r["covariate"]: r for r in cells.groupBy("covariate").agg(
        F.sum("_n").alias("n"), F.sum("_d").alias("n_event"),
        (F.sum(F.col("_n") * F.col("_x")) / F.sum("_n")).alias("centre"),
        (F.max("_x") - F.min("_x")).alias("width")).collect()}
    names = [c for c in covariates if c in shape]
    many_deaths = any(shape[c]["n_event"] > SPREAD_DEATHS for c in names)
    # Work in units of the covariate's range, so that steps are well scaled.
    unit = {c: shape[c]["width"] or 1.0 for c in names}
    scaled = (F.col("_x") - _per_covariate({c: shape[c]["centre"] for c in names})
              ) / _per_covariate(unit)

    def evaluate(beta: dict[str, float]) -> dict[str, tuple[float, float, float]]:
        x = F.col("_u")
        w = F.exp(_per_covariate(beta) * x)
        times = (
            cells.withColumn("_u", scaled)
            .groupBy("covariate", *place, "_time").agg(
                *[F.sum(F.col("_n") * w * x ** k).alias(f"_r{k}") for k in range(3)],
                *[F.sum(F.col("_d") * w * x ** k).alias(f"_e{k}") for k in range(3)],
                F.sum("_d").alias("_deaths"), F.sum(F.col("_d") * x).alias("_dx")))
        risk = clean(running(times, "_time", [
            Run(f"_s{k}", f"_r{k}", reverse=True) for k in range(3)])).filter("_deaths > 0")
        # Efron's terms, one per death, made in bounded blocks; with many deaths
        # the blocks spread over tasks, so that one time may hold most of them.
        last_block = F.ceil(F.col("_deaths") / DEATHS_PER_BLOCK) - 1
        blocks = risk.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last_block)))
        if many_deaths:
            blocks = blocks.repartition("covariate", "_time", "_block")
        start = F.col("_block") * DEATHS_PER_BLOCK
        stop = F.least(F.col("_deaths"), start + DEATHS_PER_BLOCK) - 1
        terms = blocks.withColumn("_rank", F.explode(F.sequence(start, stop)))
        part = F.col("_rank") / F.col("_deaths")
        a0, a1, a2 = [F.col(f"_s{k}") - part * F.col(f"_e{k}") for k in range(3)]
        first = F.col("_rank") == 0
        sums = terms.groupBy("covariate").agg(
            F.sum(F.when(first, _per_covariate(beta) * F.col("_dx")).otherwise(0.0) - F.log(a0)),
            F.sum(F.when(first, F.col("_dx")).otherwise(0.0) - a1 / a0),
            F.sum(a2 / a0 - (a1 / a0) * (a1 / a0)))
        return {r[0]: (r[1], r[2], r[3]) for r in sums.collect()}

    beta = {c: 0.0 for c in names}
    state = evaluate(beta)
    null_loglik = {c: state.get(c, (0.0, 0.0, 0.0))[0] for c in names}
    done, usable, steps = set(), set(), 0
    usable = {c for c in names if c in state and state[c][2] > 1e-12}
    score_test = {c: state[c][1] ** 2 / state[c][2] for c in usable}
    step = {c: state[c][1] / state[c][2] for c in usable}
    while steps < max_steps and usable - done:
        steps += 1
        trial = {c: beta[c] + step[c] if c in usable - done else beta[c] for c in names}
        moved = evaluate(trial)
        for c in sorted(usable - done):
            gain = moved[c][0] - state[c][0]
            if not math.isfinite(gain) or gain < -1e-8 * (1 + abs(state[c][0])):
                step[c] /= 2
                continue
            beta[c], state[c] = trial[c], moved[c]
            if abs(gain) <= tolerance * (1 + abs(state[c][0])) and abs(step[c]) < 1e-6 * (
                    1 + abs(beta[c])):
                done.add(c)
            elif state[c][2] <= 1e-12:
                usable.discard(c)
            else:
                step[c] = state[c][1] / state[c][2]
    results = []
    for c in names:
        coef = beta[c] / unit[c]
        error = 1 / math.sqrt(state[c][2]) / unit[c] if c in usable else None
        results.append((
            c, int(shape[c]["n"]), int(shape[c]["n_event"]),
            coef if c in usable else None, error, coef / error if error else None,
            null_loglik[c], state[c][0] if c in state else None, c in done, score_test.get(c)))
    fits = df.sparkSession.createDataFrame(
        results, "covariate string, n long, n_event long, coef double, std_err double, "
                 "z double, loglik_null double, loglik double, converged boolean, score_test double")
    return fits.withColumn("hazard_ratio", F.exp("coef")).withColumn(
        "p_value", normal_two_sided("z"))


def concordance(df: DataFrame, time: str, event: str, covariates: list[str], buckets: int | None = None) -> DataFrame:
    """How often, of two subjects, the one with the larger value has its event first; a row per covariate.

    A pair counts if one had its event while the other was still at risk; two events at one time do
    not count. ``concordance`` is the share of pairs in order, ties in value as a half, and ``std_err``
    comes from the influence of each subject on that share (infinitesimal jackknife). Values are compared
    to 12 significant digits, as in the rank tests.

    No pair is made. Times are numbered, and a pair is counted at the highest bit in which its
    two numbers differ: there both lie in one block, the earlier in its lower half and the
    later in its upper half. So each distinct (time, value) has one row per bit, and running sums
    over the values of a block give the partners of a row below, at and above its value.
    """
    rows = _timed(df, time, event).select("_time", "_died", *[significant_digits(F.col(c).cast("double")).alias(c) for c in covariates])
    long = rows.unpivot(["_time", "_died"], list(covariates), "covariate", "_x").filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    counts, parts = settle(long.groupBy("covariate", "_time", "_died", "_x").agg(F.count(F.lit(1)).alias("_n")), ["covariate"], buckets)
    times = counts.groupBy("covariate", "_time").agg(F.lit(1).cast("long").alias("_one"))
    ranked = clean(running(cut_ranges(times, ["covariate"], "_time", parts, used=["_one"]), "_time", [Run("_rank", "_one")]))
    # At one time the censored are still at risk, so they come after the events.
    code = 2 * F.col("_rank") + F.when(F.col("_died") == 1, F.lit(0)).otherwise(F.lit(1))
    cells = staged(counts.join(ranked.select("covariate", "_time", "_rank").hint("merge"), ["covariate", "_time"]).select(
        "covariate", code.alias("_code"), (F.col("_died") == 1).alias("_event"), "_x", "_n"))
    bits = int(cells.agg(F.max("_code")).first()[0] or 0).bit_length()
    block = ["covariate", "_bit", "_prefix"]
    split = cells.withColumn("_bit", F.explode(F.sequence(F.lit(0), F.lit(max(bits - 1, 0))))).withColumn(
        "_prefix", F.expr("shiftright(_code, _bit + 1)")).withColumn("_upper", F.expr("shiftright(_code, _bit) & 1") == 1)
    sides = split.groupBy(*block, "_x").agg(
        F.sum(F.when(F.col("_upper"), F.col("_n")).otherwise(F.lit(0))).alias("_later"),
        F.sum(F.when(~F.col("_upper") & F.col("_event"), F.col("_n")).otherwise(F.lit(0))).alias("_events"))
    # Blocks without a pair need no sums.
    sides, parts = settle(sides, block, buckets)
    summed = clean(running(cut_ranges(sides, block, "_x", parts, used=["_later", "_events"]), "_x", [
        Run("_later_upto", "_later", total="_later_all"), Run("_events_upto", "_events", total="_events_all")]))
    # Each cell has become a row per bit, which the size estimate does not know: neither side may be broadcast.
    seen = split.join(summed.hint("merge"), [*block, "_x"])
    upper, first = F.col("_upper"), ~F.col("_upper") & F.col("_event")
    zero = F.lit(0).cast("long")
    below, above = F.col("_later_upto") - F.col("_later"), F.col("_later_all") - F.col("_later_upto")
    weaker, stronger = F.col("_events_upto") - F.col("_events"), F.col("_events_all") - F.col("_events_upto")
    each = seen.groupBy("covariate", "_code", "_x").agg(
        F.first("_n").cast("double").alias("_n"),
        F.sum(F.when(first, below).when(upper, stronger).otherwise(zero)).cast("double").alias("_good"),
        F.sum(F.when(first, above).when(upper, weaker).otherwise(zero)).cast("double").alias("_bad"),
        F.sum(F.when(first, F.col("_later")).when(upper, F.col("_events")).otherwise(zero)).cast("double").alias("_tied"))
    n, good, tied = F.col("_n"), F.col("_good") + F.col("_tied") / 2, F.col("_tied")
    pairs = F.col("_good") + F.col("_bad") + tied
    sums = each.groupBy("covariate").agg(
        (F.sum(n * F.col("_good")) / 2).alias("_c"), (F.sum(n * F.col("_bad")) / 2).alias("_d"), (F.sum(n * tied) / 2).alias("_t"),
        F.sum(n * good * good).alias("_gg"), F.sum(n * good * pairs).alias("_gp"), F.sum(n * pairs * pairs).alias("_pp"))
    every = F.col("_c") + F.col("_d") + F.col("_t")
    share = F.col("concordance")
    return sums.withColumn("concordance", F.try_divide(F.col("_c") + F.col("_t") / 2, every)).select(
        "covariate", F.col("_c").cast("long").alias("n_concordant"), F.col("_d").cast("long").alias("n_discordant"),
        F.col("_t").cast("long").alias("n_tied"), "concordance",
        F.try_divide(F.sqrt(F.greatest(F.col("_gg") - 2 * share * F.col("_gp") + share * share * F.col("_pp"), F.lit(0.0))), every).alias("std_err"))


def cox_summary(df: DataFrame, time: str, event: str, covariates: list[str], buckets: int | None = None) -> DataFrame:
    """The fits of :func:`cox_ph` with 95 % limits, likelihood-ratio, Wald and score tests, and concordance.

    Concordance is that of the fitted risk, so values count downwards where the coefficient is negative.
    """
    df = staged(df.select(time, event, *covariates))  # the fits and the concordance both read it
    fits = staged(_cox_fits(df, time, event, covariates, buckets=buckets))
    order = concordance(df, time, event, covariates, buckets).withColumnRenamed("std_err", "concordance_se")
    falls = F.col("coef") < 0
    ratio = 2 * (F.col("loglik") - F.col("loglik_null"))
    wald = F.col("z") * F.col("z")
    one = F.lit(1)

    def limit(sign: int) -> Column:
        return F.exp(F.col("coef") + sign * NORMAL_975 * F.col("std_err"))

    return fits.join(order, "covariate", "left").select(
        "covariate", "n", "n_event", "coef", "hazard_ratio", "std_err", "z", "p_value", "converged",
        limit(-1).alias("ratio_low"), limit(1).alias("ratio_high"),
        ratio.alias("likelihood_ratio"), chi_square_tail(ratio, one).alias("likelihood_ratio_p"),
        wald.alias("wald"), chi_square_tail(wald, one).alias("wald_p"),
        "score_test", chi_square_tail("score_test", one).alias("score_test_p"),
        F.when(falls, F.col("n_discordant")).otherwise(F.col("n_concordant")).alias("n_concordant"),
        F.when(falls, F.col("n_concordant")).otherwise(F.col("n_discordant")).alias("n_discordant"), "n_tied",
        F.when(falls, 1 - F.col("concordance")).otherwise(F.col("concordance")).alias("concordance"), "concordance_se")

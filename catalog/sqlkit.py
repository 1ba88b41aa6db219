"""SQL text for the oracle side of the statistics, written independently of the
DataFrame formulas: ranks from window functions, tails from power series."""

from __future__ import annotations

import hashlib


def keys(by) -> str:
    return "".join(f"{b}, " for b in by)


def part(by, *more) -> str:
    cols = [*by, *more]
    return f"PARTITION BY {', '.join(cols)} " if cols else ""


def group(by) -> str:
    return f"GROUP BY {', '.join(by)}" if by else ""


def r6(expr: str) -> str:
    return f"round(({expr}) + 1e-10, 6) + 0.0"


def rp(expr: str) -> str:
    """A probability: six decimals, or six significant digits if it is below a thousandth."""
    return f"CASE WHEN ({expr}) > 0 AND ({expr}) < 1e-3 THEN CAST(printf('%.5e', CAST({expr} AS DOUBLE)) AS DOUBLE) ELSE {r6(expr)} END"


def tidy(sql: str, plain=(), rounded=(), tail: str = "") -> str:
    cols = [*plain, *[f"{rp(c) if c in ('p_value', 'p_adj') or c.endswith('_p') else r6(c)} AS {c}" for c in rounded]]
    return f"SELECT {', '.join(cols)} FROM ({sql}) {tail}"


def _downwards(depth: int, step: str, start: str) -> str:
    """A continued fraction from its far end: ``step`` of ``acc_`` and the level ``k_``."""
    levels = f"list_transform(range({depth}, 0, -1), lambda k0_: CAST(k0_ AS DOUBLE))"
    return f"list_reduce({levels}, lambda acc_, k_: {step}, {start})"


def chi_tail(x: str, dof: str) -> str:
    """One minus a series; where that leaves few digits, a continued fraction."""
    a, z = f"(({dof}) / 2.0::DOUBLE)", f"(({x}) / 2.0::DOUBLE)"
    terms = (f"list_sum(list_transform(range(0, CAST(2 * {z} + 300 AS BIGINT)), "
             f"lambda i_: exp(({a} + i_) * ln({z}) - {z} - lgamma({a} + i_ + 1))))")
    fraction = _downwards(400, f"{z} + 2 * k_ - 1 - {a} - k_ * (k_ - {a}) / acc_", f"({z} + 801 - {a})")
    far = f"exp({a} * ln({z}) - {z} - lgamma({a})) / {fraction}"
    return (f"CASE WHEN ({x}) IS NULL OR ({dof}) IS NULL THEN NULL WHEN ({x}) <= 1e-14 THEN 1.0::DOUBLE "
            f"WHEN {z} > 2 * {a} + 30 THEN {far} WHEN 1 - {terms} < 1e-3 THEN {far} ELSE 1 - {terms} END")


def normal_tail(z: str) -> str:
    return chi_tail(f"({z}) * ({z})", "1")


def _beta_series(a: str, b: str, y: str) -> str:
    front = (f"exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + {a} * ln({y}) + {b} * ln(1 - {y})) / {a}")
    terms = (f"list_sum(list_transform(range(0, 1500), lambda i_: exp(lgamma({a} + {b} + i_) - lgamma({a} + {b}) "
             f"+ lgamma({a} + 1) - lgamma({a} + 1 + i_) + i_ * ln({y}))))")
    return f"({front} * {terms})"


def _beta_fraction(a: str, b: str, y: str) -> str:
    """The incomplete beta function by its continued fraction, for y well below a / (a + b)."""
    m = "floor(k_ / 2)"
    odd = f"(-({a} + {m}) * ({a} + {b} + {m}) * {y} / (({a} + 2 * {m}) * ({a} + 2 * {m} + 1)))"
    even = f"({m} * ({b} - {m}) * {y} / (({a} + 2 * {m} - 1) * ({a} + 2 * {m})))"
    whole = _downwards(400, f"1 + (CASE WHEN k_ % 2 = 1 THEN {odd} ELSE {even} END) / acc_", "1.0::DOUBLE")
    return f"(exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + {a} * ln({y}) + {b} * ln(1 - {y})) / {a} / {whole})"


def t_tail(t: str, dof: str) -> str:
    """One minus a series near the middle; where that leaves few digits, a continued fraction."""
    y = f"(({t}) * ({t}) / (({dof}) + ({t}) * ({t})))"
    rest = f"(({dof}) / (({dof}) + ({t}) * ({t})))"
    half, b = "0.5::DOUBLE", f"(({dof}) / 2.0::DOUBLE)"
    series, far = f"1 - {_beta_series(half, b, y)}", _beta_fraction(b, half, rest)
    return (f"CASE WHEN ({t}) IS NULL OR ({dof}) IS NULL THEN NULL WHEN abs({t}) < 1e-12 THEN 1.0::DOUBLE "
            f"WHEN {rest} < 1e-300 THEN 0.0::DOUBLE WHEN {y} >= 0.8 OR {b} * ln({rest}) < -30 THEN {far} "
            f"WHEN {series} < 1e-3 THEN {far} ELSE {series} END")


def digits12(v: str) -> str:
    """12 significant digits, as the rank operators compare values."""
    power = f"pow(10.0::DOUBLE, floor(log10(abs({v}))))"
    return (f"CASE WHEN abs({v}) > 1e-290 AND abs({v}) < 1e290 THEN round(CAST({v} AS DOUBLE) / {power}, 11) * {power} "
            f"ELSE CAST({v} AS DOUBLE) END")


def _ranked(src: str, by, v: str, also: str, where: str) -> str:
    return (f"SELECT {keys(by)}{also}, rank() OVER ({part(by)}ORDER BY v) "
            f"+ (count(*) OVER ({part(by, 'v')}) - 1) / 2.0::DOUBLE AS mid, "
            f"CAST(count(*) OVER ({part(by, 'v')}) AS DOUBLE) AS t "
            f"FROM (SELECT *, {digits12(v)} AS v FROM {src}) WHERE v IS NOT NULL AND {where}")


def either(condition: str, counted: str, approximate: str, name: str, form: str) -> str:
    """p_value and method of a test that counts some panels and approximates others."""
    return (f"{rp(f'CASE WHEN {condition} THEN {counted} ELSE {approximate} END')} AS p_value, "
            f"CASE WHEN {condition} THEN '{name}, exact' ELSE '{name}, {form}' END AS method")


def subset_ways(most: int) -> str:
    """How many subsets of 1..n with j members have the sum s."""
    return (f"ways(n, j, s, c) AS (SELECT 0, 0, 0, 1.0::DOUBLE UNION ALL SELECT n + 1, j + take, s + take * (n + 1), sum(c) "
            f"FROM ways, (VALUES (0), (1)) v(take) WHERE n < {most} GROUP BY 1, 2, 3)")


def order_ways(most: int) -> str:
    """How many orders of n items, of which some have got their rank, have the sum d of squared gaps."""
    return (f"orders_(n, item, taken, d, c) AS (SELECT n, 0, 0, 0, 1.0::DOUBLE FROM range(2, {most + 1}) t(n) UNION ALL "
            f"SELECT n, item + 1, taken | (1 << r), d + (item - r) * (item - r), sum(c) FROM (SELECT *, unnest(range(n)) AS r FROM orders_ "
            f"WHERE item < n) WHERE (taken >> r) & 1 = 0 GROUP BY 1, 2, 3, 4)")


def _two_tails(ways: str, where: str, at: str) -> str:
    return (f"(SELECT least(1.0, 2 * least(sum(CASE WHEN s <= round({at}) THEN c ELSE 0 END), sum(CASE WHEN s >= round({at}) THEN c ELSE 0 END)) / sum(c)) "
            f"FROM {ways} WHERE {where})")


def rank_sum(src: str, by, g: str, v: str, levels, exact: bool = False) -> str:
    a, b = levels
    ranked = _ranked(src, by, v, f"CASE WHEN {g} = {a} THEN 1 ELSE 0 END AS one", f"{g} IN ({a}, {b})")
    sums = (f"SELECT {keys(by)}CAST(sum(one) AS DOUBLE) AS a, CAST(sum(1 - one) AS DOUBLE) AS b, "
            f"sum(one * mid) AS r, sum(t * t - 1) AS ties FROM ({ranked}) {group(by)}")
    stat = (f"SELECT *, r - a * (a + 1) / 2 AS w, sqrt(a * b / 12 * (a + b + 1 - CASE WHEN a + b > 1 "
            f"THEN ties / ((a + b) * (a + b - 1)) ELSE 0 END)) AS sd FROM ({sums}) WHERE a > 0 AND b > 0")
    z = (f"SELECT *, CASE WHEN sd > 0 THEN (w - a * b / 2 - sign(w - a * b / 2) * 0.5) / sd END AS z FROM ({stat})")
    return (f"SELECT {keys(by)}CAST(a AS BIGINT) AS n1, CAST(b AS BIGINT) AS n2, {r6('w')} AS statistic, "
            f"{r6('z')} AS z, " + (
                either("ties = 0", _two_tails("ways", "ways.n = a + b AND ways.j = a", "r"), normal_tail("z"), "rank-sum", "normal") if exact
                else f"{rp(normal_tail('z'))} AS p_value, 'rank-sum, normal' AS method") + f" FROM ({z}) t_")


def kruskal(src: str, by, g: str, v: str) -> str:
    ranked = _ranked(src, by, v, g, f"{g} IS NOT NULL")
    levels = (f"SELECT {keys(by)}{g}, CAST(count(*) AS DOUBLE) AS n, sum(mid) AS r, sum(t * t - 1) AS ties "
              f"FROM ({ranked}) GROUP BY {keys(by)}{g}")
    sums = (f"SELECT {keys(by)}count(*) AS k, sum(n) AS n, sum(r * r / n) AS q, sum(ties) AS ties "
            f"FROM ({levels}) {group(by)}")
    h = (f"SELECT *, CASE WHEN n * n * n - n > ties THEN (12 / (n * (n + 1)) * q - 3 * (n + 1)) "
         f"/ (1 - ties / (n * n * n - n)) END AS h FROM ({sums}) WHERE k > 1")
    return (f"SELECT {keys(by)}k AS n_levels, CAST(n AS BIGINT) AS n, {r6('h')} AS statistic, k - 1 AS dof, "
            f"{rp(chi_tail('h', 'k - 1'))} AS p_value, 'Kruskal-Wallis' AS method FROM ({h})")


def _series_tail(d: str, lower: bool) -> str:
    """The Edgeworth series of Spearman's statistic; Horner's rule undone."""
    c = [0.2274, 0.2531, 0.1745, 0.0758, 0.1033, 0.3932, 0.0879, 0.0151, 0.0072, 0.0831, 0.0131, 4.6e-4]
    x = f"((6 * ({d} - 1) / (n * (n * n - 1.0::DOUBLE)) - 1) * sqrt(n - 1.0::DOUBLE))"
    u = (f"({x} / n * ({c[0]} + {c[1]} / n + {c[2]} / (n * n) + pow({x}, 2) * ({-c[3]} + {c[4]} / n + {c[5]} / (n * n)) "
         f"- pow({x}, 4) / n * ({c[6]} + {c[7]} / n - pow({x}, 2) * ({c[8]} - {c[9]} / n + pow({x}, 2) / n * ({c[10]} - {c[11]} * pow({x}, 2))))))")
    sign = "-" if lower else ""
    z = f"({sign}{x})"
    half = f"(({normal_tail(z)}) / 2)"
    return f"greatest(0.0, least(1.0, {sign}{u} / exp(pow({x}, 2) / 2) + CASE WHEN {z} > 0 THEN {half} ELSE 1 - {half} END))"


def spearman_exact(src: str, by, x: str, y: str) -> str:
    """Panels without ties count orders or take the series; the others have the t approximation."""
    plain = spearman_raw(src, by, x, y, ", count(DISTINCT rx) = count(*) AND count(DISTINCT ry) = count(*) AS untied")
    d = f"SELECT *, round((pow(n, 3) - n) * (1 - rho) / 6) AS d FROM ({plain})"
    counted = ("(SELECT least(1.0, 2 * least(sum(CASE WHEN o.d <= t_.d THEN c ELSE 0 END), sum(CASE WHEN o.d >= t_.d THEN c ELSE 0 END)) / sum(c)) "
               "FROM orders_ o WHERE o.n = t_.n AND o.item = o.n)")
    series = (f"least(1.0, 2 * CASE WHEN d > (pow(n, 3) - n) / 6 THEN {_series_tail('d', False)} ELSE {_series_tail('(d + 2)', True)} END)")
    return (f"SELECT {keys(by)}n, {r6('rho')} AS rho, "
            + either("untied AND rho IS NOT NULL", f"CASE WHEN n <= 9 THEN {counted} ELSE {series} END", "p_value", "Spearman", "t") + f" FROM ({d}) t_")


def spearman_raw(src: str, by, x: str, y: str, more: str = "") -> str:
    def mid(v):
        return (f"rank() OVER ({part(by)}ORDER BY {v}) + (count(*) OVER ({part(by, v)}) - 1) / 2.0::DOUBLE")
    rows = (f"SELECT {keys(by)}{mid('x')} AS rx, {mid('y')} AS ry FROM (SELECT {keys(by)}{digits12(x)} AS x, "
            f"{digits12(y)} AS y FROM {src}) WHERE x IS NOT NULL AND y IS NOT NULL")
    sums = (f"SELECT {keys(by)}count(*) AS n, CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) "
            f"THEN corr(rx, ry) END AS rho{more} FROM ({rows}) {group(by)}")
    t = (f"SELECT *, CASE WHEN n > 2 AND abs(rho) < 1 THEN rho * sqrt(n - 2) / sqrt(1 - rho * rho) END AS t "
         f"FROM ({sums})")
    return (f"SELECT {keys(by)}n, rho, CASE WHEN n > 2 AND abs(rho) >= 1 THEN 0.0::DOUBLE "
            f"ELSE {t_tail('t', 'n - 2')} END AS p_value, 'Spearman, t' AS method{', untied' if more else ''} FROM ({t})")


def spearman(src: str, by, x: str, y: str) -> str:
    return tidy(spearman_raw(src, by, x, y), [*by, "n", "method"], ["rho", "p_value"])


def signed_rank(src: str, by, pair: str, g: str, v: str, levels, exact: bool = False) -> str:
    a, b = levels
    means = (f"SELECT {keys(by)}{pair}, {digits12('a')} - {digits12('b')} AS d FROM (SELECT {keys(by)}{pair}, "
             f"avg(CASE WHEN {g} = {a} THEN {v} END) AS a, avg(CASE WHEN {g} = {b} THEN {v} END) AS b "
             f"FROM (SELECT * REPLACE ({digits12(v)} AS {v}) FROM {src}) WHERE {g} IN ({a}, {b}) AND {v} IS NOT NULL "
             f"GROUP BY {keys(by)}{pair})")
    pairs = f"SELECT * REPLACE ({digits12('d')} AS d) FROM ({means})"
    size = "CASE WHEN d <> 0 THEN abs(d) END"
    ranked = (f"SELECT *, rank() OVER ({part(by)}ORDER BY {size} NULLS LAST) "
              f"+ (count(*) OVER ({part(by, size)}) - 1) / 2.0::DOUBLE AS mid, "
              f"CAST(count(*) OVER ({part(by, size)}) AS DOUBLE) AS t FROM ({pairs})")
    sums = (f"SELECT {keys(by)}CAST(coalesce(count_if(d <> 0), 0) AS DOUBLE) AS n, coalesce(count_if(d = 0), 0) AS n_zero, "
            f"count_if(d IS NULL) AS n_dropped, coalesce(sum(CASE WHEN d > 0 THEN mid END), 0) AS v, "
            f"coalesce(sum(CASE WHEN d <> 0 THEN t * t - 1 END), 0) AS ties FROM ({ranked}) {group(by)} HAVING count(*) > 0")
    sd = (f"SELECT *, sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS sd, v - n * (n + 1) / 4 AS gap FROM ({sums})")
    z = f"SELECT *, CASE WHEN sd > 0 THEN (gap - sign(gap) * 0.5) / sd END AS z FROM ({sd})"
    return (f"SELECT {keys(by)}CAST(n AS BIGINT) AS n_pairs, CAST(n_zero AS BIGINT) AS n_zero, "
            f"CAST(n_dropped AS BIGINT) AS n_dropped, {r6('v')} AS statistic, {r6('z')} AS z, " + (
                either("ties = 0 AND n_zero = 0 AND n > 0", _two_tails("ways", "ways.n = t_.n", "v"), normal_tail("z"), "signed-rank", "normal")
                if exact else f"{rp(normal_tail('z'))} AS p_value, 'signed-rank, normal' AS method") + f" FROM ({z}) t_")


def chisq_raw(src: str, by, a: str, b: str) -> str:
    """Observed against expected cell by cell."""
    cells = (f"SELECT {keys(by)}CAST({a} AS DOUBLE) AS a, CAST({b} AS DOUBLE) AS b, count(*) OVER ({part(by)}) AS k, "
             f"sum(CAST({a} AS DOUBLE)) OVER ({part(by)}) AS sa, sum(CAST({b} AS DOUBLE)) OVER ({part(by)}) AS sb FROM {src}")
    gaps = (f"SELECT *, (a + b) * sa / nullif(sa + sb, 0) AS ea, (a + b) * sb / nullif(sa + sb, 0) AS eb FROM ({cells})")
    one = ("CASE WHEN k = 1 THEN CASE WHEN a + b > 0 THEN (a - b) * (a - b) / (a + b) END "
           "WHEN ea > 0 AND eb > 0 THEN CASE WHEN k = 2 THEN "
           "pow(abs(a - ea) - least(0.5, abs(a - ea)), 2) / ea + pow(abs(b - eb) - least(0.5, abs(b - eb)), 2) / eb "
           "ELSE pow(a - ea, 2) / ea + pow(b - eb, 2) / eb END END")
    sums = (f"SELECT {keys(by)}max(k) AS n_rows, CASE WHEN count(c) = count(*) THEN sum(c) END AS statistic, "
            f"greatest(1, max(k) - 1) AS dof FROM (SELECT *, {one} AS c FROM ({gaps})) {group(by)}")
    return f"SELECT *, {chi_tail('statistic', 'dof')} AS p_value FROM ({sums})"


def chisq(src: str, by, a: str, b: str) -> str:
    return tidy(chisq_raw(src, by, a, b), [*by, "n_rows", "dof"], ["statistic", "p_value"])


def bh(sql: str, p: str = "p_value", out: str = "p_adj", by=()) -> str:
    ranked = (f"SELECT *, CASE WHEN {p} IS NOT NULL THEN {p} * count({p}) OVER ({part(by)}) / "
              f"row_number() OVER ({part(by)}ORDER BY {p} NULLS LAST) END AS scaled FROM ({sql})")
    return (f"SELECT * EXCLUDE (scaled), CASE WHEN {p} IS NOT NULL THEN least(1.0, min(scaled) OVER ({part(by)}"
            f"ORDER BY {p} DESC NULLS LAST)) END AS {out} FROM ({ranked})")


def box(src: str, by, v: str) -> str:
    quart = (f"SELECT {keys(by)}count({v}) AS n, quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.5) AS median, "
             f"quantile_cont({v}, 0.75) AS q3 FROM {src} WHERE {v} IS NOT NULL {group(by)}")
    on = " AND ".join(f"q.{b} IS NOT DISTINCT FROM s.{b}" for b in by) or "true"
    inside = f"s.{v} BETWEEN q.q1 - 1.5 * (q.q3 - q.q1) AND q.q3 + 1.5 * (q.q3 - q.q1)"
    qkeys = "".join(f"q.{b}, " for b in by)
    return (f"SELECT {qkeys}q.n, {r6('q.q1')} AS q1, {r6('q.median')} AS median, {r6('q.q3')} AS q3, "
            f"{r6(f'min(CASE WHEN {inside} THEN s.{v} END)')} AS whisker_low, "
            f"{r6(f'max(CASE WHEN {inside} THEN s.{v} END)')} AS whisker_high, "
            f"CAST(count_if(NOT ({inside})) AS BIGINT) AS n_outliers "
            f"FROM ({quart}) q JOIN {src} s ON {on} AND s.{v} IS NOT NULL GROUP BY {qkeys}q.n, q.q1, q.median, q.q3")


def welch(src: str, by, g: str, v: str, levels) -> str:
    a, b = levels
    def f(fn, lv):
        return f"{fn}(CASE WHEN {g} = {lv} THEN {v} END)"
    sums = (f"SELECT {keys(by)}{f('count', a)} AS n1, {f('count', b)} AS n2, {f('avg', a)} AS mean1, "
            f"{f('avg', b)} AS mean2, {f('var_samp', a)} / {f('count', a)} AS s1, "
            f"{f('var_samp', b)} / {f('count', b)} AS s2 FROM {src} {group(by)}")
    stat = (f"SELECT *, (mean1 - mean2) / sqrt(s1 + s2) AS statistic, (s1 + s2) * (s1 + s2) / "
            f"(s1 * s1 / (n1 - 1) + s2 * s2 / (n2 - 1)) AS dof FROM ({sums}) WHERE n1 > 0 AND n2 > 0")
    return tidy(f"SELECT *, {t_tail('statistic', 'dof')} AS p_value FROM ({stat})",
                [*by, "n1", "n2"], ["mean1", "mean2", "statistic", "dof", "p_value"])


def line_band_ctes(src: str, by, x: str, y: str) -> list[str]:
    """Sums of each panel, and the 97.5 % point of its t distribution by halving."""
    return [f"fits_ AS MATERIALIZED (SELECT {keys(by)}count(*) AS n, avg({x}) AS mx, avg({y}) AS my, regr_sxx({y}, {x}) AS sxx, regr_sxy({y}, {x}) AS sxy, "
            f"regr_syy({y}, {x}) AS syy, min({x}) AS lo, max({x}) AS hi FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL {group(by)})",
            f"point_(n, i, a, b) AS (SELECT DISTINCT n, 0, 0.0::DOUBLE, 1000.0::DOUBLE FROM fits_ WHERE n > 2 UNION ALL "
            f"SELECT n, i + 1, CASE WHEN p > 0.05 THEN m ELSE a END, CASE WHEN p > 0.05 THEN b ELSE m END FROM "
            f"(SELECT *, {t_tail('m', '(n - 2)')} AS p FROM (SELECT *, (a + b) / 2 AS m FROM point_ WHERE i < 60)))"]


def line_band(by, points: int = 80) -> str:
    rows = (f"SELECT {keys(by)}f.n, CAST(k AS INTEGER) AS place, lo + (hi - lo) * k / {points - 1} AS x, mx, my, sxx, sxy / sxx AS slope, a AS t, "
            f"sqrt((syy - sxy * sxy / sxx) / (f.n - 2)) AS err FROM fits_ f LEFT JOIN (SELECT * FROM point_ WHERE i = 60) p ON f.n = p.n, range({points}) r(k)")
    half = f"SELECT *, my + slope * (x - mx) AS fit, t * err * sqrt(1.0 / n + (x - mx) * (x - mx) / sxx) AS half FROM ({rows})"
    return tidy(f"SELECT *, fit - half AS low, fit + half AS high FROM ({half})", [*by, "n", "place"], ["x", "fit", "low", "high"])


def _at_risk(src: str, by, time: str, event: str, extra: str = "") -> str:
    return (f"SELECT {keys(by)}{time} AS time, count(*) AS n, CAST(sum({event}) AS BIGINT) AS d{extra} FROM {src} "
            f"WHERE {time} IS NOT NULL AND {event} IS NOT NULL GROUP BY {keys(by)}{time}")


def km(src: str, by, time: str, event: str) -> str:
    over = f"({part(by)}ORDER BY time DESC)"
    risk = f"SELECT *, CAST(sum(n) OVER {over} AS BIGINT) AS y FROM ({_at_risk(src, by, time, event)})"
    up = f"({part(by)}ORDER BY time)"
    surv = (f"SELECT *, CASE WHEN max(CASE WHEN d = y THEN 1 ELSE 0 END) OVER {up} = 1 THEN 0.0 "
            f"ELSE product(1 - d / CAST(y AS DOUBLE)) OVER {up} END AS survival, "
            f"sum(CASE WHEN d < y THEN d / (CAST(y AS DOUBLE) * (y - d)) ELSE 0 END) OVER {up} AS g FROM ({risk})")
    return (f"SELECT {keys(by)}time, y AS n_risk, d AS n_event, n - d AS n_censored, {r6('survival')} AS survival, "
            f"{r6('CASE WHEN survival > 0 THEN survival * sqrt(g) END')} AS std_err FROM ({surv})")


def _km_raw(src: str, by, time: str, event: str) -> str:
    """The curve by a product over earlier times, found pair by pair."""
    counts = _at_risk(src, by, time, event)
    up = f"({part(by)}ORDER BY time)"
    risk = f"SELECT *, CAST(sum(n) OVER ({part(by)}ORDER BY time DESC) AS BIGINT) AS y FROM ({counts})"
    return (f"SELECT *, CASE WHEN max(CASE WHEN d = y THEN 1 ELSE 0 END) OVER {up} = 1 THEN 0.0 "
            f"ELSE product(1 - d / CAST(y AS DOUBLE)) OVER {up} END AS s, "
            f"sum(CASE WHEN d < y THEN d / (CAST(y AS DOUBLE) * (y - d)) ELSE 0 END) OVER {up} AS g FROM ({risk})")


def risk_table(src: str, by, time: str, event: str, at) -> str:
    asked = ", ".join(f"({float(t)!r}::DOUBLE)" for t in at)
    rows = (f"SELECT {keys(by)}t_ AS time, coalesce(sum(n) FILTER (c.time >= t_), 0) AS y, coalesce(sum(d) FILTER (c.time <= t_), 0) AS e, "
            f"coalesce(arg_max(s, c.time) FILTER (c.time <= t_), 1.0) AS s, coalesce(arg_max(g, c.time) FILTER (c.time <= t_), 0.0) AS g "
            f"FROM ({_km_raw(src, by, time, event)}) c, (VALUES {asked}) v(t_) GROUP BY {keys(by)}t_")
    return (f"SELECT {keys(by)}time, CAST(y AS BIGINT) AS n_risk, CAST(e AS BIGINT) AS events_so_far, {r6('s')} AS survival, "
            f"{r6('CASE WHEN s > 0 THEN s * sqrt(g) END')} AS std_err FROM ({rows})")


def median_survival(src: str, by, time: str, event: str) -> str:
    lines = {"median": "s", "median_low": "CASE WHEN s > 0 THEN s * exp(-1.959963984540054 * sqrt(g)) END",
             "median_high": "CASE WHEN s > 0 THEN least(1.0, s * exp(1.959963984540054 * sqrt(g))) END"}
    ends = ", ".join(f"(min(CASE WHEN {e} < 0.5 + 1.5e-8 THEN time END) + coalesce(min(CASE WHEN {e} < 0.5 - 1.5e-8 THEN time END), "
                     f"min(CASE WHEN {e} < 0.5 + 1.5e-8 THEN time END))) / 2.0 AS {name}" for name, e in lines.items())
    rows = f"SELECT {keys(by)}CAST(sum(n) AS BIGINT) AS n, CAST(sum(d) AS BIGINT) AS n_event, {ends} FROM ({_km_raw(src, by, time, event)}) {group(by)}"
    return tidy(rows, [*by, "n", "n_event"], list(lines))


def log_rank(src: str, by, time: str, event: str, g: str, levels, names) -> str:
    a, b = levels
    counts = (f"SELECT {keys(by)}{time} AS time, count_if({g} = {a}) AS n0, count_if({g} = {b}) AS n1, "
              f"count_if({g} = {a} AND {event} = 1) AS d0, count_if({g} = {b} AND {event} = 1) AS d1 FROM {src} "
              f"WHERE {time} IS NOT NULL AND {event} IS NOT NULL AND {g} IS NOT NULL GROUP BY {keys(by)}{time}")
    over = f"({part(by)}ORDER BY time DESC)"
    risk = (f"SELECT *, CAST(sum(n0) OVER {over} AS DOUBLE) AS y0, CAST(sum(n1) OVER {over} AS DOUBLE) AS y1, "
            f"CAST(d0 + d1 AS DOUBLE) AS d FROM ({counts})")
    sums = (f"SELECT {keys(by)}CAST(sum(d0) AS BIGINT) AS o0, CAST(sum(d1) AS BIGINT) AS o1, "
            f"sum(d * y0 / (y0 + y1)) AS e0, sum(d * y1 / (y0 + y1)) AS e1, "
            f"sum(CASE WHEN y0 + y1 > 1 THEN d * (y0 + y1 - d) / (y0 + y1 - 1) * y0 * y1 / ((y0 + y1) * (y0 + y1)) "
            f"ELSE 0 END) AS v FROM ({risk}) WHERE d > 0 {group(by)}")
    stat = f"SELECT *, CASE WHEN v > 0 THEN (o0 - e0) * (o0 - e0) / v END AS x FROM ({sums})"
    return (f"SELECT {keys(by)}o0 AS observed_{names[0]}, o1 AS observed_{names[1]}, {r6('e0')} AS expected_{names[0]}, "
            f"{r6('e1')} AS expected_{names[1]}, {r6('x')} AS statistic, "
            f"CASE WHEN x IS NOT NULL THEN CAST(1 AS BIGINT) END AS dof, {rp(chi_tail('x', '1'))} AS p_value FROM ({stat})")


def unpivot(src: str, ids, columns, names_to: str, values_to: str) -> str:
    """One SELECT per column, so that missing values keep their rows."""
    return " UNION ALL ".join(
        f"SELECT {keys(ids)}'{c}' AS {names_to}, CAST({c} AS DOUBLE) AS {values_to} FROM {src}" for c in columns)


def cox_ctes(src: str, time: str, event: str, covariates, steps: int = 9) -> list[str]:
    """Newton's method written out step by step, one fit per covariate."""
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS covariate, CAST({time} AS DOUBLE) AS time, {event} AS died, CAST({c} AS DOUBLE) AS x FROM {src} "
        f"WHERE {c} IS NOT NULL AND {time} IS NOT NULL AND {event} IS NOT NULL" for c in covariates)
    out = [f"cells_ AS MATERIALIZED (SELECT covariate, time, died, x - avg(x) OVER (PARTITION BY covariate) AS x FROM ({rows}))",
           "b0 AS MATERIALIZED (SELECT DISTINCT covariate, 0.0::DOUBLE AS beta FROM cells_)"]
    for i in range(steps):
        sums = ", ".join([f"sum(exp(beta * x) * pow(x, {k})) AS r{k}, sum(died * exp(beta * x) * pow(x, {k})) AS e{k}" for k in range(3)])
        suffix = ", ".join(f"sum(r{k}) OVER (PARTITION BY covariate ORDER BY time DESC) AS s{k}" for k in range(3))
        a = [f"(s{k} - j / CAST(d AS DOUBLE) * e{k})" for k in range(3)]
        out += [
            f"t{i} AS MATERIALIZED (SELECT covariate, beta, time, {sums}, CAST(sum(died) AS BIGINT) AS d, sum(died * x) AS dx "
            f"FROM cells_ JOIN b{i} USING (covariate) GROUP BY covariate, beta, time)",
            f"u{i} AS MATERIALIZED (SELECT *, unnest(range(d)) AS j FROM (SELECT *, {suffix} FROM t{i}) WHERE d > 0)",
            f"g{i} AS MATERIALIZED (SELECT covariate, beta, sum(CASE WHEN j = 0 THEN beta * dx ELSE 0 END - ln({a[0]})) AS ll, "
            f"sum(CASE WHEN j = 0 THEN dx ELSE 0 END - {a[1]} / {a[0]}) AS score, "
            f"sum({a[2]} / {a[0]} - pow({a[1]} / {a[0]}, 2)) AS info FROM u{i} GROUP BY covariate, beta)",
            f"b{i + 1} AS MATERIALIZED (SELECT covariate, beta + score / info AS beta FROM g{i})"]
    return out


def cox(steps: int = 9) -> str:
    last = f"g{steps - 1}"
    fit = (f"SELECT covariate, n, n_event, beta AS coef, 1 / sqrt(info) AS std_err, beta * sqrt(info) AS z, g0.ll AS loglik_null, "
           f"f.ll AS loglik, abs(f.score) < 1e-6 * sqrt(info) AS converged, exp(beta) AS hazard_ratio FROM (SELECT * FROM {last}) f "
           f"JOIN (SELECT covariate, ll FROM g0) g0 USING (covariate) JOIN (SELECT covariate, count(*) AS n, "
           f"CAST(sum(died) AS BIGINT) AS n_event FROM cells_ GROUP BY 1) USING (covariate)")
    return tidy(f"SELECT *, {normal_tail('z')} AS p_value FROM ({fit})", ["covariate", "n", "n_event", "converged"],
                ["coef", "std_err", "z", "loglik_null", "loglik", "hazard_ratio", "p_value"])


def concordance_cte(src: str, time: str, event: str, covariates) -> str:
    """All comparable pairs of each covariate, an event and a subject still at risk, one by one."""
    rows = " UNION ALL ".join(f"SELECT '{c}' AS covariate, {time} AS time, {event} AS died, {digits12(c)} AS x FROM {src} "
                              f"WHERE {c} IS NOT NULL AND {time} IS NOT NULL AND {event} IS NOT NULL" for c in covariates)
    return (f"order_ AS MATERIALIZED (WITH p AS MATERIALIZED (SELECT *, row_number() OVER () AS i FROM ({rows})), "
            "pairs AS (SELECT a.covariate, a.i, b.i AS j, sign(a.x - b.x) AS s FROM p a JOIN p b ON a.covariate = b.covariate AND a.died = 1 "
            "AND (a.time < b.time OR (a.time = b.time AND b.died = 0))), "
            "shares AS (SELECT covariate, count_if(s > 0) AS good, count_if(s < 0) AS bad, count_if(s = 0) AS tied, "
            "(count_if(s > 0) + count_if(s = 0) / 2.0::DOUBLE) / count(*) AS c, CAST(count(*) AS DOUBLE) AS n FROM pairs GROUP BY 1), "
            "each AS (SELECT covariate, i, sum((s + 1) / 2.0::DOUBLE) AS g, CAST(count(*) AS DOUBLE) AS m FROM "
            "(SELECT covariate, i, s FROM pairs UNION ALL SELECT covariate, j, s FROM pairs) GROUP BY 1, 2) "
            "SELECT covariate, good, bad, tied, c, sqrt(sum(pow((g - c * m) / n, 2))) AS se FROM each JOIN shares USING (covariate) GROUP BY ALL)")


def cox_summary(steps: int = 9) -> str:
    fit = (f"SELECT covariate, n, n_event, f.beta AS coef, exp(f.beta) AS hazard_ratio, 1 / sqrt(f.info) AS std_err, f.beta * sqrt(f.info) AS z, "
           f"abs(f.score) < 1e-6 * sqrt(f.info) AS converged, exp(f.beta - 1.959963984540054 / sqrt(f.info)) AS ratio_low, "
           f"exp(f.beta + 1.959963984540054 / sqrt(f.info)) AS ratio_high, 2 * (f.ll - g0.ll) AS likelihood_ratio, f.beta * f.beta * f.info AS wald, "
           f"g0.score * g0.score / g0.info AS score_test, CASE WHEN f.beta < 0 THEN bad ELSE good END AS n_concordant, "
           f"CASE WHEN f.beta < 0 THEN good ELSE bad END AS n_discordant, tied AS n_tied, CASE WHEN f.beta < 0 THEN 1 - c ELSE c END AS concordance, "
           f"se AS concordance_se FROM g{steps - 1} f JOIN g0 USING (covariate) JOIN order_ USING (covariate) JOIN (SELECT covariate, count(*) AS n, "
           f"CAST(sum(died) AS BIGINT) AS n_event FROM cells_ GROUP BY 1) USING (covariate)")
    tests = ", ".join(f"{chi_tail(t, '1')} AS {t}_p" for t in ("likelihood_ratio", "wald", "score_test"))
    return tidy(f"SELECT *, {normal_tail('z')} AS p_value, {tests} FROM ({fit})",
                ["covariate", "n", "n_event", "converged", "n_concordant", "n_discordant", "n_tied"],
                ["coef", "hazard_ratio", "std_err", "z", "p_value", "ratio_low", "ratio_high", "likelihood_ratio", "likelihood_ratio_p", "wald",
                 "wald_p", "score_test", "score_test_p", "concordance", "concordance_se"])


def reml_ctes(src: str, y: str, x: str, g: str, rounds: int = 8) -> list[str]:
    """Likelihood of a random intercept on a grid of variance ratios, refined."""
    out = [f"rows__ AS MATERIALIZED (SELECT CAST({x} AS DOUBLE) - avg(CAST({x} AS DOUBLE)) OVER () AS x, {y} - avg({y}) OVER () AS y, {g} AS g, "
           f"avg(CAST({x} AS DOUBLE)) OVER () AS mx, avg({y}) OVER () AS my FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL AND {g} IS NOT NULL)",
           "groups_ AS MATERIALIZED (SELECT count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy "
           "FROM rows__ GROUP BY g)"]

    def fit(thetas):
        f = "(theta / (1 + n * theta))"
        sums = (f"SELECT theta, sum(ln(1 + n * theta)) AS lv, sum(n / (1 + n * theta)) AS s00, sum(sx / (1 + n * theta)) AS s01, "
                f"sum(xx - {f} * sx * sx) AS s11, sum(sy / (1 + n * theta)) AS t0, sum(xy - {f} * sx * sy) AS t1, "
                f"sum(yy - {f} * sy * sy) AS q, CAST(sum(n) AS DOUBLE) - 2 AS free FROM groups_, ({thetas}) GROUP BY theta")
        det = f"SELECT *, s00 * s11 - s01 * s01 AS det FROM ({sums})"
        beta = f"SELECT *, (s11 * t0 - s01 * t1) / det AS b0, (s00 * t1 - s01 * t0) / det AS b1 FROM ({det})"
        rest = f"SELECT *, q - b0 * t0 - b1 * t1 AS rest, lv + ln(det) AS ld FROM ({beta})"
        return f"SELECT *, free * ln(rest) + ld AS crit FROM ({rest})"

    grid = ("SELECT 0.0::DOUBLE AS theta UNION ALL SELECT exp(-14.0::DOUBLE + i * 0.875) AS theta FROM range(33) t(i)")
    out.append(f"m0 AS MATERIALIZED ({fit(grid)} ORDER BY crit LIMIT 1)")
    width = 0.875
    for i in range(1, rounds):
        step = 2 * width / 32
        grid = (f"SELECT exp(CASE WHEN theta > 0 THEN ln(theta) ELSE -745 END - {width!r} + i * {step!r}) AS theta FROM m{i - 1}, range(33) t(i) "
                f"WHERE theta > 0")
        out.append(f"m{i} AS MATERIALIZED (SELECT * FROM (SELECT * FROM ({fit(grid)}) UNION ALL SELECT * FROM m{i - 1}) ORDER BY crit LIMIT 1)")
        width = step
    best = f"m{rounds - 1}"
    out.append(f"near_ AS MATERIALIZED ({fit(f'SELECT theta * (1 + k * 0.05) AS theta FROM {best}, (VALUES (-2), (-1), (1), (2)) v(k) WHERE theta > 0')})")
    out.append(f"best_ AS (SELECT * FROM {best})")
    return out


EFFECTS = ("(SELECT g, count(*) AS n, any_value(theta) * sum(y - b0 - b1 * x) / (1 + any_value(theta) * count(*)) AS effect "
           "FROM rows__, best_ GROUP BY g)")


def random_effects(g: str) -> str:
    return f"SELECT g AS {g}, n, round(effect + 1e-9, 3) + 0.0 AS effect FROM {EFFECTS}"


def residual_summary() -> str:
    scaled = f"SELECT (y - b0 - b1 * x - effect) / sqrt(rest / free) AS s FROM rows__ JOIN {EFFECTS} e USING (g), best_"
    parts = ", ".join(f"round(quantile_cont(s, {q}) + 1e-9, 3) + 0.0 AS {name}" for name, q in
                      (("lowest", 0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("highest", 1)))
    return (f"SELECT CAST(max(free) AS BIGINT) + 2 AS n, (SELECT count(*) FROM groups_) AS n_groups, "
            f"round(max(crit + free * (1 + ln(2 * pi() / free))), 4) + 0.0 AS reml_criterion, "
            f"round(max((-s01 - mx * s00) / sqrt((s11 + 2 * mx * s01 + mx * mx * s00) * s00)) + 1e-9, 4) + 0.0 AS fixed_correlation, "
            f"any_value(q.lowest) AS lowest, any_value(q.q1) AS q1, any_value(q.median) AS median, any_value(q.q3) AS q3, any_value(q.highest) AS highest "
            f"FROM best_, (SELECT any_value(mx) AS mx FROM rows__), (SELECT {parts} FROM ({scaled})) q")


def reml(x: str) -> str:
    """Coefficients with Satterthwaite degrees of freedom from five-point
    differences, to four decimals."""
    v0 = "({p}s11 / {p}det + 2 * mx * {p}s01 / {p}det + mx * mx * {p}s00 / {p}det)"
    v1 = "({p}s00 / {p}det)"

    def first(e):
        p = [e(f"k{i}.") for i in range(4)]
        return f"(({p[0]} - 8 * {p[1]} + 8 * {p[2]} - {p[3]}) / (12 * b.theta * 0.05))"

    def second(e):
        p = [e(f"k{i}.") for i in range(4)]
        return f"((-{p[0]} + 16 * {p[1]} - 30 * {e('b.')} + 16 * {p[2]} - {p[3]}) / (12 * pow(b.theta * 0.05, 2)))"

    nears = " ".join(f"LEFT JOIN (SELECT * FROM near_ ORDER BY theta LIMIT 1 OFFSET {i}) k{i} ON true" for i in range(4))
    body = []
    for term, v in ((None, v0), (x, v1)):
        name, est = ("intercept", "b.b0 + my - b.b1 * mx") if term is None else (x, "b.b1")
        b = v.format(p="b.")
        body.append(
            f"SELECT '{name}' AS term, {est} AS estimate, sqrt(b.rest / b.free * {b}) AS std_err, {b} AS v, "
            f"{first(lambda p, v=v: v.format(p=p))} AS dv, b.theta, b.free, b.rest, b.rest / b.free AS s2, "
            f"{first(lambda p: p + 'rest')} AS r1, {second(lambda p: p + 'rest')} AS r2, {second(lambda p: p + 'ld')} AS d2 "
            f"FROM best_ b CROSS JOIN (SELECT any_value(mx) AS mx, any_value(my) AS my FROM rows__) {nears}")
    hess = (f"SELECT *, -free / pow(s2, 2) + 2 * rest / pow(s2, 3) AS hss, -r1 / pow(s2, 2) AS hst, r2 / s2 + d2 AS htt FROM ("
            + " UNION ALL ".join(body) + ")")
    spread = f"SELECT *, hss * htt - hst * hst AS det, 2 * (v * v * htt - 2 * v * s2 * dv * hst + pow(s2 * dv, 2) * hss) AS top FROM ({hess})"
    dof = (f"SELECT *, CASE WHEN theta >= 1e-6 AND det > 0 AND top > 0 THEN 2 * pow(s2 * v, 2) / (top / det) ELSE free END AS dof FROM ({spread})")
    return (f"SELECT term, round(estimate + 1e-10, 4) + 0.0 AS estimate, round(std_err + 1e-10, 4) + 0.0 AS std_err, "
            f"round(dof, 0) + 0.0 AS dof, round(estimate / std_err + 1e-10, 2) + 0.0 AS t, round(sqrt(s2) + 1e-10, 4) + 0.0 AS sigma, "
            f"round(sqrt(s2 * theta) + 1e-10, 4) + 0.0 AS group_sd, round({t_tail('estimate / std_err', 'dof')}, 4) + 0.0 AS p_value, "
            f"CAST(free AS BIGINT) + 2 AS n, (SELECT count(*) FROM groups_) AS n_groups, theta < 1e-6 AS singular FROM ({dof})")


def feistel_ctes(base: str, label: str, seed: int, reps: int, columns: str) -> list[str]:
    """Shuffles of a label by keyed permutations: numbered rows, label places, and ``shuffled``."""
    keys = ", ".join(f"({rep}, {', '.join(str(int(hashlib.md5(f'{seed}|{rep}|{r}'.encode()).hexdigest()[:8], 16)) for r in range(6))})"
                     for rep in range(1, reps + 1))

    def network(rows: str) -> str:
        """``rows`` has x, the keys and the sizes; gives x after six rounds."""
        sql = f"SELECT *, x // wide AS hi, x % wide AS lo FROM ({rows})"
        for r in range(6):
            src, dst, size = ("lo", "hi", "high") if r % 2 else ("hi", "lo", "wide")
            sql = f"SELECT *, ({src} + k{r}) & 4294967295 AS h FROM ({sql})"
            for _ in range(2):
                sql = f"SELECT * REPLACE (((xor(h, h >> 16)) * 73244475) & 4294967295 AS h) FROM ({sql})"
            sql = f"SELECT * EXCLUDE (h) REPLACE (({dst} + xor(h, h >> 16)) % {size} AS {dst}) FROM ({sql})"
        return f"SELECT * EXCLUDE (hi, lo) REPLACE (hi * wide + lo AS x) FROM ({sql})"

    fields = "number, rep, k0, k1, k2, k3, k4, k5, wide, high, n"
    return [
        f"numbered AS MATERIALIZED (SELECT {columns}, {label}, row_number() OVER (ORDER BY md5(concat_ws('|', {seed}, 0, id))) - 1 AS number FROM {base})",
        "sizes AS MATERIALIZED (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS wide, CAST(ceil(n / ceil(sqrt(n))) AS BIGINT) AS high "
        "FROM (SELECT count(*) AS n FROM numbered))",
        f"keys(rep, k0, k1, k2, k3, k4, k5) AS (VALUES {keys})",
        f"walk AS (SELECT {fields}, x FROM ({network(f'SELECT {fields}, number AS x FROM numbered, keys, sizes')}) "
        f"UNION ALL SELECT {fields}, x FROM ({network(f'SELECT {fields}, x FROM walk WHERE x >= n')}))",
        f"places AS MATERIALIZED (SELECT {label}, count(*) AS c, sum(count(*)) OVER (ORDER BY {label} NULLS LAST) AS upto FROM numbered GROUP BY {label})",
        f"shuffled AS MATERIALIZED (SELECT CAST(w.rep AS BIGINT) AS rep, {columns}, p.{label} FROM (SELECT rep, number, x FROM walk WHERE x < n) w "
        f"JOIN numbered b USING (number) ASOF JOIN (SELECT {label}, CAST(upto - c AS BIGINT) AS start FROM places) p ON w.x >= p.start)"]

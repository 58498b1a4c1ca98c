"""Regression-based tests."""

from __future__ import annotations

from weftline.operators import clean, regress
from weftline.plans.catalog.base import Tables, all_pairs_sql, channels_of, eliminated, panel_sql, points_sql, query, r6
from weftline.plans.catalog.moments import edges_out
from weftline.plans.catalog.spectra import ACF, CLOSED, EV

G1 = points_sql("ev_mean", True) + (
    ", g0 AS (SELECT src, dst, x, y, row_number() OVER (PARTITION BY src, dst ORDER BY t) AS pos FROM pt), "
    "g1 AS (SELECT src, dst, y, lag(y) OVER w AS y1, lag(x) OVER w AS x1 FROM g0 WINDOW w AS (PARTITION BY src, dst ORDER BY pos)), "
    "g2 AS (SELECT src, dst, count(*) AS m, corr(y, x1) AS a, corr(y, y1) AS b, corr(x1, y1) AS c FROM g1 WHERE y1 IS NOT NULL GROUP BY 1, 2), "
    "g3 AS (SELECT src, dst, m, pow((a - b * c) / sqrt((1 - b * b) * (1 - c * c)), 2) AS r2 FROM g2)"
)


@query("granger_f_lag1", G1 + " SELECT src, dst, m AS n, round(r2 / (1 - r2) * (m - 3), 6) + 0.0 AS f FROM g3")
def granger_f_lag1(tb: Tables):
    t = regress.granger_tests(tb.ev_mean().pair_points(True), 1)
    return t.select("src", "dst", "n", r6("f").alias("f"))


def f_tail_sql(f: str, d1: str, d2: str, steps: int = 4000) -> str:
    """Upper tail of the F distribution by Simpson's rule: with 1 - u * u in place of the beta variable the integrand is smooth."""
    low = f"sqrt(1 - {d2} / ({d2} + {d1} * greatest({f}, 0)))"
    u = f"({low} + (1 - {low}) * i / {steps}.0)"
    weight = f"CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    area = f"list_sum(list_transform(range(0, {steps + 1}), lambda i: ({weight}) * pow(greatest(1 - pow({u}, 2), 0), {d2} / 2.0 - 1) * pow({u}, {d1} - 1))) * (1 - {low}) / {3 * steps}.0"
    return f"least(1.0, 2 * {area} * exp(lgamma(({d1} + {d2}) / 2.0) - lgamma({d1} / 2.0) - lgamma({d2} / 2.0)))"


def granger_sql(name: str, lag: int) -> str:
    """Own lags and then the other channel's lags are taken out of y one by one; what is left gives both sums of squares."""
    past = ", ".join(f"lag({c}, {k}) OVER w AS {c}{k}" for c in "xy" for k in range(1, lag + 1))
    parts = [
        points_sql(name, True),
        f"n0 AS MATERIALIZED (SELECT src, dst, x, y, row_number() OVER (PARTITION BY src, dst ORDER BY t) - 1 AS pos FROM pt), "
        f"n1 AS MATERIALIZED (SELECT src, dst, pos, y, {past} FROM n0 WINDOW w AS (PARTITION BY src, dst ORDER BY pos))",
    ]
    tests = []
    for o in range(1, lag + 1):
        zs = ", ".join([f"y{k} AS z{k - 1}" for k in range(1, o + 1)] + [f"x{k} AS z{o + k - 1}" for k in range(1, o + 1)])
        parts.append(f"g{o} AS MATERIALIZED (SELECT src, dst, pos AS t, 0.0::DOUBLE AS x, y, {zs} FROM n1 WHERE pos >= {o})")
        parts.append(eliminated(f"g{o}", 2 * o, f"u{o}"))
        tests.append(
            f"SELECT src, dst, {o} AS o, n - {2 * o + 1} AS df, (rr - ru) / ru / {o} * (n - {2 * o + 1}) AS f FROM (SELECT src, dst, count(*) AS n, sum(y * y) AS ru FROM u{o} GROUP BY 1, 2) "
            f"JOIN (SELECT src, dst, sum(y * y) AS rr FROM g{o}_{o - 1} GROUP BY 1, 2) USING (src, dst)"
        )
    parts.append(f"ft AS MATERIALIZED ({' UNION ALL '.join(tests)})")
    return ", ".join(parts) + f" SELECT src, dst, round(least(1.0, {lag} * min({f_tail_sql('f', 'o', 'df')})), 6) + 0.0 AS value FROM ft GROUP BY 1, 2"


def granger_all_sql(name: str, lag: int) -> str:
    """All channels' lags, those of the tested one last."""
    chans = channels_of(name)
    cond = " AND ".join(f'"{c}" IS NOT NULL' for c in chans)
    past = ", ".join(f'lag("{c}", {k}) OVER (ORDER BY t) AS v{i}_{k}' for i, c in enumerate(chans) for k in range(1, lag + 1))
    rows, m = [], len(chans)
    for i, a in enumerate(chans):
        for j, b in enumerate(chans):
            if i != j:
                order = [c for c in range(m) if c != i] + [i]
                zs = ", ".join(f"v{c}_{k} AS z{q}" for q, (c, k) in enumerate((c, k) for c in order for k in range(1, lag + 1)))
                rows.append(f"SELECT '{a}' AS src, '{b}' AS dst, t, 0.0::DOUBLE AS x, \"{b}\" AS y, {zs} FROM c1 WHERE v0_{lag} IS NOT NULL")
    last = (m - 1) * lag - 1
    return (
        panel_sql(name) + f", c0 AS MATERIALIZED (SELECT * FROM p WHERE {cond}), c1 AS MATERIALIZED (SELECT *, {past} FROM c0), g AS MATERIALIZED ({' UNION ALL '.join(rows)}), "
        + eliminated("g", m * lag, "u")
        + f", ft AS (SELECT src, dst, n - {m * lag + 1} AS df, (rr - ru) / ru / {lag} * (n - {m * lag + 1}) AS f FROM (SELECT src, dst, count(*) AS n, sum(y * y) AS ru FROM u GROUP BY 1, 2) "
        f"JOIN (SELECT src, dst, sum(y * y) AS rr FROM g_{last} GROUP BY 1, 2) USING (src, dst)) "
        f"SELECT src, dst, CASE WHEN df > 0 THEN round({f_tail_sql('f', str(lag), f'({m} * df)')}, 6) + 0.0 END AS value FROM {all_pairs_sql(name, True)} LEFT JOIN ft USING (src, dst)"
    )


@query("granger_full", granger_sql("ev_mean", 3))
def granger_full(tb: Tables):
    return edges_out(regress.granger_full(tb.ev_mean(), 3))


@query("granger_partial", granger_all_sql("od_day", 2))
def granger_partial(tb: Tables):
    return edges_out(regress.granger_partial(tb.od_day(), 2))


LAG0 = CLOSED + (
    ", d0 AS (SELECT channel, lead(x) OVER w - x AS d, x AS l FROM n0 WINDOW w AS (PARTITION BY channel ORDER BY pos)), "
    "d1 AS (SELECT channel, count(*) AS n, regr_slope(d, l) AS b, regr_sxx(d, l) AS sxx, regr_syy(d, l) AS syy, regr_sxy(d, l) AS sxy FROM d0 WHERE d IS NOT NULL GROUP BY 1)"
)


@query("adf_stat_lag0", LAG0 + " SELECT channel, round(b / sqrt((syy - b * sxy) / (n - 2) / sxx), 6) + 0.0 AS stat FROM d1")
def adf_stat_lag0(tb: Tables):
    return regress.adf(tb.ev_mean().long(), 0).select("channel", r6("stat").alias("stat"))


@query("adf")
def adf(tb: Tables):
    a = regress.adf(tb.od_day().long())
    return a.select("channel", r6("stat").alias("stat"), r6("pvalue").alias("pvalue"), "used_lag", "nobs")


@query(
    "ljung_box_q",
    ACF + ", lb AS (SELECT channel, n, lag, acf FROM rho WHERE lag BETWEEN 1 AND greatest(1, least(n // 5, 20))) "
    "SELECT channel, round(CAST(max(n) AS DOUBLE) * (max(n) + 2) * sum(acf * acf / (n - lag)), 6) + 0.0 AS lb_q FROM lb GROUP BY 1",
)
def ljung_box_q(tb: Tables):
    return regress.ljung_box(tb.ev_mean().long()).select("channel", r6("lb_q").alias("lb_q"))


@query(
    "autocorr_summary",
    ACF
    + ", pr AS (SELECT channel, x AS a, lead(x) OVER (PARTITION BY channel ORDER BY pos) AS b FROM n0), "
    "m1 AS (SELECT channel, corr(a, b) AS rho1, sum(a * b) / sum(CASE WHEN b IS NOT NULL THEN a * a END) AS phi_ar1, count(*) AS n FROM pr GROUP BY 1), "
    "t1 AS (SELECT channel, greatest(1.0, 1 + 2 * coalesce(sum(acf) FILTER (acf > 0), 0)) AS tau_int FROM rho WHERE lag >= 1 AND lag <= greatest(10, n // 4) GROUP BY 1) "
    "SELECT channel, round(rho1, 6) + 0.0 AS rho1, round(phi_ar1, 6) + 0.0 AS phi_ar1, round(tau_int, 6) + 0.0 AS tau_int, round(n / tau_int, 4) + 0.0 AS n_eff FROM m1 JOIN t1 USING (channel)",
)
def autocorr_summary(tb: Tables):
    s = regress.autocorr_summary(tb.ev_mean().long())
    return s.select("channel", *[r6(c).alias(c) for c in ("rho1", "phi_ar1", "tau_int")], r6("n_eff", 4).alias("n_eff"))


DAY = panel_sql("od_day")


@query(
    "ar2_prewhiten",
    DAY
    + ", f AS (SELECT t, channel, coalesce(value, avg(value) OVER (PARTITION BY channel)) AS value FROM pl), "
    "g AS MATERIALIZED (SELECT *, lag(value, 1) OVER w AS l1, lag(value, 2) OVER w AS l2 FROM f WINDOW w AS (PARTITION BY channel ORDER BY t)), "
    "s AS (SELECT channel, sum(l1 * l1) AS a, sum(l1 * l2) AS b, sum(l2 * l2) AS c, sum(l1 * value) AS u, sum(l2 * value) AS v FROM g WHERE l2 IS NOT NULL GROUP BY 1) "
    "SELECT t, channel, round(CASE WHEN t < 2 THEN 0.0 ELSE value - (c * u - b * v) / (a * c - b * b) * l1 - (a * v - b * u) / (a * c - b * b) * l2 END, 2) + 0.0 AS value FROM g JOIN s USING (channel)",
)
def ar2_prewhiten(tb: Tables):
    return regress.prewhiten(clean.fill_mean(tb.od_day().long()), 2).select("t", "channel", r6("value", 2).alias("value"))


@query("ar_diagnostics")
def ar_diagnostics(tb: Tables):
    d = regress.ar_diagnostics(clean.fill_mean(tb.od_day().long()), 2)
    return d.select("channel", *[r6(c).alias(c) for c in d.columns if c != "channel"])


@query(
    "regression_r2",
    EV + ", c AS (SELECT click, view FROM p WHERE click IS NOT NULL AND view IS NOT NULL) SELECT 'click' AS target, 'view' AS controls, round(regr_r2(click, view), 6) + 0.0 AS r2 FROM c",
)
def regression_r2(tb: Tables):
    return regress.r_squared(tb.ev_mean(), "click", ["view"]).select("target", "controls", r6("r2").alias("r2"))



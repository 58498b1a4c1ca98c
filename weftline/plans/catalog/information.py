"""Count-based information metrics."""

from __future__ import annotations

from weftline.operators import information as info
from weftline.operators import moments
from weftline.plans.catalog.base import Tables, panel_sql, points_sql, query, r6, residual_sql
from weftline.plans.catalog.moments import edges_out


def codes_sql(source: str) -> str:
    """``d(src, dst, pos, sx, sy)``: gap-closed positions and 8 quantile bins of both series."""
    q = ", ".join(f"quantile_cont({{c}}, {i / 8})" for i in range(9))
    return (
        f", n0 AS MATERIALIZED (SELECT src, dst, x, y, row_number() OVER (PARTITION BY src, dst ORDER BY t) - 1 AS pos FROM {source}), "
        f"eg AS (SELECT src, dst, list_sort(list_distinct([{q.format(c='x')}])) AS ex, list_sort(list_distinct([{q.format(c='y')}])) AS ey FROM n0 GROUP BY 1, 2), "
        "d AS MATERIALIZED (SELECT n0.src, n0.dst, pos, "
        "CASE WHEN len(ex) > 2 THEN len(list_filter(ex[2:len(ex) - 1], lambda e: e <= x)) ELSE 0 END AS sx, "
        "CASE WHEN len(ey) > 2 THEN len(list_filter(ey[2:len(ey) - 1], lambda e: e <= y)) ELSE 0 END AS sy FROM n0 JOIN eg USING (src, dst))"
    )


def te_sql(prefix: str, source: str = "pt", lag: int = 1) -> str:
    hx = " * 9 + ".join(f"lag(sx, {k}) OVER w" for k in range(1, lag + 1))
    hy = " * 9 + ".join(f"lag(sy, {k}) OVER w" for k in range(1, lag + 1))
    return (
        prefix + codes_sql(source)
        + f", h AS (SELECT src, dst, sy, {hx} AS hx, {hy} AS hy FROM d WINDOW w AS (PARTITION BY src, dst ORDER BY pos)), "
        "j AS (SELECT src, dst, sy, hx, hy, count(*) AS c FROM h WHERE hx IS NOT NULL GROUP BY ALL), "
        "m AS (SELECT *, sum(c) OVER (PARTITION BY src, dst, sy, hy) AS c_yh, sum(c) OVER (PARTITION BY src, dst, hy, hx) AS c_hh, "
        "sum(c) OVER (PARTITION BY src, dst, hy) AS c_h FROM j) "
        "SELECT src, dst, round(sum(c * log2((c / c_hh) / (c_yh / c_h))) / sum(c), 6) + 0.0 AS value FROM m GROUP BY 1, 2"
    )


@query("te_full", te_sql(points_sql("ev_mean", True)))
def te_full(tb: Tables):
    return edges_out(info.te_full(tb.ev_mean()))


@query("te_full_counts", te_sql(points_sql("ev_count", True)))
def te_full_counts(tb: Tables):
    """Dense tied integers: fewer than eight distinct edges."""
    return edges_out(info.te_full(tb.ev_count()))


@query("te_full_lag2", te_sql(points_sql("od_day", True), lag=2))
def te_full_lag2(tb: Tables):
    return edges_out(info.te_full(tb.od_day(), lag=2))


@query("te_partial", te_sql(residual_sql("ev_mean", True)))
def te_partial(tb: Tables):
    return edges_out(info.transfer_entropy(moments.residual_points(tb.ev_mean(), True), 1))


def ordinal_sql(prefix: str) -> str:
    def code(c: str) -> str:
        v0, v1, v2 = c, f"lead({c}, 1) OVER w", f"lead({c}, 2) OVER w"
        r0 = f"(({v1} < {v0})::INT + ({v2} < {v0})::INT)"
        r1 = f"(({v0} <= {v1})::INT + ({v2} < {v1})::INT)"
        r2 = f"(({v0} <= {v2})::INT + ({v1} <= {v2})::INT)"
        return f"{r0} * 9 + {r1} * 3 + {r2}"

    return (
        prefix
        + ", n0 AS (SELECT src, dst, x, y, row_number() OVER (PARTITION BY src, dst ORDER BY t) AS pos FROM pt), "
        f"o AS (SELECT src, dst, {code('x')} AS ox, {code('y')} AS oy FROM n0 WINDOW w AS (PARTITION BY src, dst ORDER BY pos)), "
        "j AS (SELECT src, dst, ox, oy, count(*) AS c FROM o WHERE ox IS NOT NULL AND oy IS NOT NULL GROUP BY ALL), "
        "m AS (SELECT *, sum(c) OVER (PARTITION BY src, dst, ox) AS cx, sum(c) OVER (PARTITION BY src, dst, oy) AS cy, sum(c) OVER (PARTITION BY src, dst) AS n FROM j) "
        "SELECT src, dst, round(CASE WHEN max(n) >= 20 THEN greatest(0.0, sum(c / n * log2(c * n / (cx * cy)))) ELSE 0.0 END, 6) + 0.0 AS value FROM m GROUP BY 1, 2"
    )


@query("ordinal_full", ordinal_sql(points_sql("ev_mean", False)))
def ordinal_full(tb: Tables):
    return edges_out(info.ordinal_full(tb.ev_mean()))


@query("ordinal_directed", ordinal_sql(points_sql("ev_mean", True, 1)))
def ordinal_directed(tb: Tables):
    return edges_out(info.ordinal_directed(tb.ev_mean(), 1))


@query(
    "shannon_entropy",
    panel_sql("ev_mean")
    + ", s AS (SELECT channel, min(value) AS lo, max(value) AS hi, count(value) AS n FROM pl GROUP BY 1), "
    "b AS (SELECT *, greatest(4, least(32, n // 2)) AS b FROM s), "
    "h AS (SELECT pl.channel, n, least(floor((value - lo) / (hi - lo) * b), b - 1) AS cell, count(*) AS c FROM pl JOIN b USING (channel) WHERE value IS NOT NULL GROUP BY ALL) "
    "SELECT channel, round(-sum(c / (n + 1e-12) * log2(c / (n + 1e-12))), 6) + 0.0 AS value FROM h GROUP BY 1",
)
def shannon_entropy(tb: Tables):
    return info.shannon_entropy(tb.ev_mean().long()).select("channel", r6("value").alias("value"))


@query(
    "perm_entropy",
    panel_sql("ev_mean")
    + ", n0 AS (SELECT channel, value AS x, row_number() OVER (PARTITION BY channel ORDER BY t) AS pos FROM pl WHERE value IS NOT NULL), "
    "o AS (SELECT channel, ((lead(x, 1) OVER w < x)::INT + (lead(x, 2) OVER w < x)::INT) * 9 + ((x <= lead(x, 1) OVER w)::INT + (lead(x, 2) OVER w < lead(x, 1) OVER w)::INT) * 3 "
    "+ ((x <= lead(x, 2) OVER w)::INT + (lead(x, 1) OVER w <= lead(x, 2) OVER w)::INT) AS code FROM n0 WINDOW w AS (PARTITION BY channel ORDER BY pos)), "
    "j AS (SELECT channel, code, count(*) AS c FROM o WHERE code IS NOT NULL GROUP BY ALL), m AS (SELECT *, sum(c) OVER (PARTITION BY channel) AS n FROM j) "
    "SELECT channel, round(-sum(c / (n + 1e-12) * log2(c / (n + 1e-12) + 1e-12)) / (log2(6) + 1e-12), 6) + 0.0 AS value FROM m GROUP BY 1",
)
def perm_entropy(tb: Tables):
    return info.permutation_entropy(tb.ev_mean().long()).select("channel", r6("value").alias("value"))

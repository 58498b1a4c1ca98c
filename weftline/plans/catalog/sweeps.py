"""Lag, window and cube sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import sweep
from weftline.plans.catalog.base import Tables, eliminated, panel_sql, points_sql, query, r6, with_controls_sql
from weftline.plans.catalog.information import te_sql

DAY = panel_sql("od_day")
EV = panel_sql("ev_mean")


def edges_sql(prefix: str, sizes: list[int], lags: list[int], directed: bool, stride: int | None = None) -> str:
    """``we(window_size, start, lag, src, dst, value)`` for correlation in every window."""
    order = "a.channel <> b.channel" if directed else "a.channel < b.channel"
    shift = "l.lag" if directed else "0"
    ws = ", ".join(f"({w}, {stride or max(1, w // 5)})" for w in sizes)
    return (
        prefix
        + f", nn AS (SELECT max(t) + 1 AS n FROM p), wz(w, s) AS (VALUES {ws}), lg(lag) AS (VALUES {', '.join(f'({v})' for v in lags)}), "
        "win AS (SELECT w, unnest(range(0, n - w + 1, s)) AS start FROM wz, nn), "
        "we AS MATERIALIZED (SELECT w AS window_size, start, l.lag, a.channel AS src, b.channel AS dst, "
        f"CASE WHEN count(*) >= {4 if directed else 3} THEN corr(a.value, b.value) END AS value FROM win JOIN pl a ON a.t >= start AND a.t < start + w "
        f"JOIN lg l ON true JOIN pl b ON b.t = a.t + {shift} AND b.t < start + w AND {order} "
        "WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY ALL), "
        "wq AS (SELECT window_size, start, lag, avg(abs(value)) AS metric FROM we GROUP BY ALL)"
    )


POS = edges_sql(panel_sql("od_month"), [20], [1], False)


@query(
    "window_pos",
    POS + " SELECT printf('pos_w%d_l%d_i%d_s%d', window_size, lag, start // 4, start) AS id, window_size, lag, start, start + window_size AS \"end\", round(metric, 6) + 0.0 AS metric FROM wq",
)
def window_pos(tb: Tables):
    s = sweep.scan_positions(tb.od_month(), "correlation_full", 20)
    return s.select("id", "window_size", "lag", "start", "end", r6("metric").alias("metric"))


@query(
    "window_edges",
    POS + " SELECT window_size, start, src, dst, round(value, 6) + 0.0 AS value FROM we",
)
def window_edges(tb: Tables):
    p = tb.od_month()
    g = sweep.WindowGrid.plan(p.length(), 20)
    return sweep.window_edges(p, "correlation_full", [g]).select("window_size", "start", "src", "dst", r6("value").alias("value"))


@query(
    "window_size",
    edges_sql(DAY, [100, 200, 400], [1], True)
    + ", b AS (SELECT window_size, lag, arg_max(start, (metric, -start)) AS start, max(metric) AS metric FROM wq GROUP BY 1, 2) "
    "SELECT printf('size_w%d_l%d', window_size, lag) AS id, window_size, lag, start, start + window_size AS \"end\", round(metric, 6) + 0.0 AS metric FROM b",
)
def window_size(tb: Tables):
    s = sweep.scan_sizes(tb.od_day(), "correlation_directed", [100, 200, 400])
    return s.select("id", "window_size", "lag", "start", "end", r6("metric").alias("metric"))


def lag_sql(prefix: str, top: int) -> str:
    return (
        prefix
        + f", lg AS (SELECT unnest(range(1, {top + 1})) AS lag), le AS MATERIALIZED (SELECT l.lag, a.channel AS src, b.channel AS dst, corr(a.value, b.value) AS value "
        "FROM lg l JOIN pl a ON true JOIN pl b ON b.t = a.t + l.lag AND a.channel <> b.channel WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY ALL), "
        "lq AS (SELECT lag, avg(abs(value)) AS metric FROM le GROUP BY 1)"
    )


@query("lag_scan", lag_sql(EV, 8) + " SELECT printf('lag_l%d', lag) AS id, lag, round(metric, 6) + 0.0 AS metric FROM lq")
def lag_scan(tb: Tables):
    s = sweep.scan_lags(tb.ev_mean(), "correlation_directed", range(1, 9))
    return s.select("id", "lag", r6("metric").alias("metric"))


@query(
    "lag_opt",
    lag_sql(EV, 8).replace("WITH binned", "WITH RECURSIVE binned")
    + ", st(lag, best, best_lag, miss) AS (SELECT 0, -1e300::DOUBLE, 1, 0 UNION ALL "
    "SELECT lq.lag, greatest(best, metric), CASE WHEN metric > best THEN lq.lag ELSE best_lag END, CASE WHEN metric > best THEN 0 ELSE miss + 1 END "
    "FROM st JOIN lq ON lq.lag = st.lag + 1 WHERE NOT (st.miss >= 3 AND st.lag >= 3)) "
    "SELECT CAST(best_lag AS INTEGER) AS lag, round(best, 6) + 0.0 AS metric FROM st ORDER BY st.lag DESC LIMIT 1",
)
def lag_opt(tb: Tables):
    e = sweep.lag_edges(tb.ev_mean(), "correlation_directed", list(range(1, 9)))
    return sweep.best_lag(e).select(F.col("lag").cast("int").alias("lag"), r6("metric").alias("metric"))


CUBE = edges_sql(DAY, [200, 400], [1, 2, 3], True)


@query(
    "scan_cube",
    CUBE + " SELECT printf('cube_w%d_l%d_s%d', window_size, lag, start) AS id, window_size, lag, start, start + window_size AS \"end\", round(metric, 6) + 0.0 AS metric FROM wq WHERE metric IS NOT NULL",
)
def scan_cube(tb: Tables):
    s = sweep.cube_points(sweep.cube_edges(tb.od_day(), "correlation_directed", [200, 400], [1, 2, 3]))
    return s.select("id", "window_size", "lag", "start", "end", r6("metric").alias("metric"))


@query(
    "cube_extremes",
    CUBE
    + ", c AS (SELECT *, printf('cube_w%d_l%d_s%d', window_size, lag, start) AS id, quantile_cont(metric, 0.5) OVER () AS med FROM wq WHERE metric IS NOT NULL) "
    "SELECT arg_max(id, (metric, id)) AS best, arg_min(id, (round(abs(metric - med), 12), metric, id)) AS median, arg_min(id, (metric, id)) AS worst FROM c",
)
def cube_extremes(tb: Tables):
    s = sweep.cube_points(sweep.cube_edges(tb.od_day(), "correlation_directed", [200, 400], [1, 2, 3]))
    return sweep.extremes(s, [], "id", "id")


@query(
    "gallery_quantiles",
    CUBE
    + ", c AS (SELECT *, printf('cube_w%d_l%d_s%d', window_size, lag, start) AS id FROM wq WHERE metric IS NOT NULL), "
    "k AS (SELECT *, row_number() OVER (ORDER BY metric, id) - 1 AS i, count(*) OVER () AS n FROM c) "
    "SELECT id, i AS rank, round(metric, 6) + 0.0 AS metric FROM k WHERE i IN (0, n // 2, n - 1, round_even(0.1 * (n - 1), 0), round_even(0.25 * (n - 1), 0), "
    "round_even(0.5 * (n - 1), 0), round_even(0.75 * (n - 1), 0), round_even(0.9 * (n - 1), 0))",
)
def gallery_quantiles(tb: Tables):
    s = sweep.cube_points(sweep.cube_edges(tb.od_day(), "correlation_directed", [200, 400], [1, 2, 3]))
    return sweep.gallery(s, "quantiles").select("id", "rank", r6("metric").alias("metric"))


@query(
    "pair_score",
    CUBE + " SELECT window_size, start, lag, round(abs(value), 6) + 0.0 AS score FROM we WHERE src = '1-URGENT' AND dst = '5-LOW' AND value IS NOT NULL",
)
def pair_score(tb: Tables):
    """One pair's path through the cube."""
    e = sweep.cube_edges(tb.od_day(), "correlation_directed", [200, 400], [1, 2, 3], pairs=[("1-URGENT", "5-LOW")])
    return sweep.pair_scores(e, True).filter("score IS NOT NULL").select("window_size", "start", "lag", r6("score").alias("score"))


MAIN = edges_sql(DAY, [100, 200], [1], False) + ", b AS (SELECT window_size, arg_max(start, (metric, -start)) AS start, max(metric) AS metric FROM wq GROUP BY 1)"


@query("main_windows_mean", MAIN + " SELECT src, dst, round(avg(value), 6) + 0.0 AS value FROM we JOIN b USING (window_size, start) GROUP BY 1, 2")
def main_windows_mean(tb: Tables):
    e = sweep.main_windows(tb.od_day(), "correlation_full", [100, 200], "mean")
    return e.select("src", "dst", r6("value").alias("value"))


@query(
    "main_windows_best",
    MAIN + " SELECT src, dst, round(value, 6) + 0.0 AS value FROM we JOIN (SELECT * FROM b ORDER BY metric DESC, window_size LIMIT 1) USING (window_size, start)",
)
def main_windows_best(tb: Tables):
    e = sweep.main_windows(tb.od_day(), "correlation_full", [100, 200], "best")
    return e.select("src", "dst", r6("value").alias("value"))


@query(
    "main_window_cube",
    CUBE + " SELECT src, dst, round(value, 6) + 0.0 AS value FROM we JOIN (SELECT * FROM wq WHERE metric IS NOT NULL ORDER BY metric DESC, window_size, lag, start LIMIT 1) USING (window_size, lag, start)",
)
def main_window_cube(tb: Tables):
    e, _ = sweep.main_cube(tb.od_day(), "correlation_directed", [200, 400], [1, 2, 3])
    return e.select("src", "dst", r6("value").alias("value"))


def te_windows_sql(lag: int) -> str:
    """Transfer entropy in windows of 400 days, every 200: a window's number is part of the pair while it is worked on."""
    pts = points_sql("od_day", True).replace(", pt AS MATERIALIZED", ", all_pt AS MATERIALIZED", 1)
    pts += (
        ", nn AS (SELECT max(t) + 1 AS n FROM p), win AS (SELECT unnest(range(0, n - 399, 200)) AS start FROM nn), "
        "pt AS MATERIALIZED (SELECT src || '@' || start AS src, dst, t, x, y FROM win JOIN all_pt ON t >= start AND t < start + 400)"
    )
    return f"SELECT 400 AS window_size, CAST(split_part(src, '@', 2) AS BIGINT) AS start, {lag} AS lag, split_part(src, '@', 1) AS src, dst, value FROM ({te_sql(pts, lag=lag)})"


@query("te_windows", te_windows_sql(1) + " UNION ALL " + te_windows_sql(2))
def te_windows(tb: Tables):
    p = tb.od_day()
    g = sweep.WindowGrid.plan(p.length(), 400, 200)
    e = sweep.window_edges(p, "te_full", [g], [1, 2])
    return e.select("window_size", "start", "lag", "src", "dst", r6("value").alias("value"))


def partial_windows_sql(name: str, sizes: list[int]) -> str:
    """``we``: correlation of residuals on all other channels, separately in every window of more than seven complete rows."""
    ws = ", ".join(f"({w}, {max(1, w // 5)})" for w in sizes)
    by = "window_size, start, src, dst"
    return (
        panel_sql(name) + ", " + with_controls_sql(name, False)
        + f", nn AS (SELECT max(t) + 1 AS n FROM p), wz(w, s) AS (VALUES {ws}), win AS (SELECT w, unnest(range(0, n - w + 1, s)) AS start FROM wz, nn), "
        "wp AS MATERIALIZED (SELECT w AS window_size, start, pz.* FROM win JOIN pz ON t >= start AND t < start + w), "
        + eliminated("wp", 3, "pt", by)
        + f", we AS MATERIALIZED (SELECT {by}, CASE WHEN count(*) > 7 THEN corr(x, y) END AS value FROM pt GROUP BY ALL)"
    )


@query("window_edges_partial", partial_windows_sql("od_day", [60, 200]) + " SELECT window_size, start, src, dst, round(value, 6) + 0.0 AS value FROM we")
def window_edges_partial(tb: Tables):
    p = tb.od_day()
    grids = [sweep.WindowGrid.plan(p.length(), w) for w in (60, 200)]
    return sweep.window_edges(p, "correlation_partial", grids).select("window_size", "start", "src", "dst", r6("value").alias("value"))


@query(
    "window_pos_partial",
    partial_windows_sql("od_month", [20]) + ", wq AS (SELECT window_size, start, avg(abs(value * value)) AS metric FROM we GROUP BY ALL) "
    "SELECT printf('pos_w%d_l%d_i%d_s%d', window_size, 1, start // 4, start) AS id, window_size, 1 AS lag, start, start + window_size AS \"end\", round(metric, 6) + 0.0 AS metric FROM wq",
)
def window_pos_partial(tb: Tables):
    s = sweep.scan_positions(tb.od_month(), "h2_partial", 20)
    return s.select("id", "window_size", "lag", "start", "end", r6("metric").alias("metric"))

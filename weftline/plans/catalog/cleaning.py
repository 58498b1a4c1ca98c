"""Sources, filters and per-channel cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import clean, stl
from weftline.plans.catalog.base import Tables, panel_sql, query, r6

EV = panel_sql("ev_mean")
EV6 = panel_sql("ev_mean6")
DAY = panel_sql("od_day")
CNT = panel_sql("ev_count")


def long_out(df):
    return df.select("t", "channel", r6("value").alias("value"))


def register(name: str, panel: str, op, cte: str, value: str, extra: str = "") -> None:
    """A transform of the long panel whose SQL is ``value`` over ``extra`` CTEs and source ``s``."""
    sql = f"{cte}{extra} SELECT t, channel, round(CAST({value} AS DOUBLE), 6) + 0.0 AS value FROM " + ("s" if extra else "pl")

    @query(name, sql)
    def _run(tb: Tables):
        source = {"ev_mean": tb.ev_mean, "ev_mean6": lambda: tb.ev_mean(6), "od_day": tb.od_day, "ev_count": tb.ev_count}
        return long_out(op(source[panel]().long()))


@query("panel_build", f"{EV} SELECT t, channel, round(value, 6) + 0.0 AS value FROM pl")
def panel_build(tb: Tables):
    return long_out(tb.ev_mean().long())


@query(
    "tidy_valid_frac",
    f"{EV} SELECT channel, round(avg(CASE WHEN value IS NULL THEN 0.0 ELSE 1.0 END), 6) + 0.0 AS valid_frac "
    "FROM pl GROUP BY 1 HAVING avg(CASE WHEN value IS NULL THEN 0.0 ELSE 1.0 END) >= 0.2",
)
def tidy_valid_frac(tb: Tables):
    f = clean.valid_fraction(tb.ev_mean().long())
    return f.filter("valid_frac >= 0.2").select("channel", r6("valid_frac").alias("valid_frac"))


@query(
    "time_slice",
    f"{EV} SELECT (t - 10) // 3 AS t, channel, round(value, 6) + 0.0 AS value FROM pl "
    "WHERE t >= 10 AND t < 500 AND (t - 10) % 3 = 0",
)
def time_slice(tb: Tables):
    return long_out(clean.time_slice(tb.ev_mean().long(), 10, 500, 3))


@query(
    "drop_empty",
    f"{EV} SELECT t, channel, round(value, 6) + 0.0 AS value FROM pl "
    "WHERE t IN (SELECT t FROM pl WHERE value IS NOT NULL) AND channel IN (SELECT channel FROM pl WHERE value IS NOT NULL)",
)
def drop_empty(tb: Tables):
    return long_out(clean.drop_empty_rows(clean.drop_empty_channels(tb.ev_mean().long())))


@query(
    "drop_constant",
    f"{CNT} SELECT channel, count(*) AS n FROM pl WHERE channel IN "
    "(SELECT channel FROM pl GROUP BY 1 HAVING min(value) < max(value)) GROUP BY 1",
)
def drop_constant(tb: Tables):
    return clean.drop_constant_channels(tb.ev_count().long()).groupBy("channel").agg(F.count(F.lit(1)).alias("n"))


@query(
    "near_constant",
    f"{CNT} SELECT channel, round(count(DISTINCT value) * 1.0 / count(*), 6) + 0.0 AS uniq_frac FROM pl GROUP BY 1",
)
def near_constant(tb: Tables):
    return clean.distinct_fraction(tb.ev_count().long()).select("channel", r6("uniq_frac").alias("uniq_frac"))


@query(
    "variance_topk",
    f"{EV} SELECT channel, round(var_samp(value), 4) + 0.0 AS score FROM pl GROUP BY 1 ORDER BY var_samp(value) DESC, channel LIMIT 3",
)
def variance_topk(tb: Tables):
    return clean.top_channels(tb.ev_mean().long(), 3).select("channel", r6("score", 4).alias("score"))


@query(
    "transpose",
    f"{panel_sql('od_month')} SELECT channel, " + ", ".join(f"round(max(value) FILTER (t = {i}), 4) AS m{i}" for i in range(6)) + " FROM pl GROUP BY 1",
)
def transpose(tb: Tables):
    """In long form a transpose only swaps which column is pivoted."""
    cells = [r6(F.max(F.when(F.col("t") == i, F.col("value"))), 4).alias(f"m{i}") for i in range(6)]
    return tb.od_month().long().groupBy("channel").agg(*cells)


register("fill_mean", "ev_mean", clean.fill_mean, EV, "coalesce(value, avg(value) OVER (PARTITION BY channel))")
register(
    "fill_interp",
    "ev_mean",
    clean.fill_linear,
    EV,
    "coalesce(value, v0 + (v1 - v0) * (t - t0) / (t1 - t0), v0, v1, 0.0)",
    ", s AS (SELECT t, channel, value, "
    "last_value(value IGNORE NULLS) OVER w0 AS v0, last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER w0 AS t0, "
    "first_value(value IGNORE NULLS) OVER w1 AS v1, first_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER w1 AS t1 FROM pl "
    "WINDOW w0 AS (PARTITION BY channel ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
    "w1 AS (PARTITION BY channel ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))",
)
register("log_positive", "ev_mean", clean.log_positive, EV, "CASE WHEN value > 0 THEN ln(value) ELSE value END")
G1 = "(avg(pow({0} - m, 3)) / pow(avg(pow({0} - m, 2)), 1.5))"


@query(
    "auto_log_flags",
    f"{DAY}, c AS (SELECT channel, value, CASE WHEN value > 0 THEN ln(value) END AS lv FROM pl), "
    "s AS (SELECT channel, value, lv, avg(value) OVER (PARTITION BY channel) AS m, avg(lv) OVER (PARTITION BY channel) AS ml FROM c) "
    "SELECT channel, round(avg(pow(value - m, 3)) / pow(avg(pow(value - m, 2)), 1.5), 6) + 0.0 AS skew, "
    "round(avg(pow(lv - ml, 3)) / pow(avg(pow(lv - ml, 2)), 1.5), 6) + 0.0 AS log_skew, "
    "count(*) = count(lv) AND abs(avg(pow(lv - ml, 3)) / pow(avg(pow(lv - ml, 2)), 1.5)) < abs(avg(pow(value - m, 3)) / pow(avg(pow(value - m, 2)), 1.5)) AS use_log "
    "FROM s GROUP BY 1",
)
def auto_log_flags(tb: Tables):
    f = clean.auto_log_flags(tb.od_day().long())
    return f.select("channel", r6("skew").alias("skew"), r6("log_skew").alias("log_skew"), "use_log")


BY = "OVER (PARTITION BY channel)"
MED = f", m1 AS (SELECT *, quantile_cont(value, 0.5) {BY} AS med FROM pl), m2 AS (SELECT *, abs(value - med) AS dev FROM m1), s AS (SELECT *, quantile_cont(dev, 0.5) {BY} AS mad FROM m2)"
ROB = "abs(value - med) / (mad * 1.4826 + 1e-12) > 1.5"
STAT = f", s AS (SELECT *, avg(value) {BY} AS m, stddev_pop(value) {BY} AS sd, quantile_cont(value, 0.5) {BY} AS med, quantile_cont(value, 0.05) {BY} AS lo, quantile_cont(value, 0.95) {BY} AS hi, quantile_cont(value, 0.25) {BY} AS q1, quantile_cont(value, 0.75) {BY} AS q3, " \
    "quantile_cont(value, 0.5) OVER (PARTITION BY channel ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS lm FROM pl)"
MASK = "CASE WHEN {0} THEN NULL ELSE value END"


def masked(cond: str) -> str:
    return MASK.format(cond)


register("outlier_zscore_mask", "ev_mean", lambda d: clean.outliers(d, "zscore", "mask", z=2.0), EV, masked("abs(value - m) / (sd + 1e-12) > 2.0"), STAT)
register("outlier_robust_mask", "ev_mean", lambda d: clean.outliers(d, "robust_z", "mask", z=1.5), EV, masked(ROB), MED)
register("outlier_robust_median", "ev_mean", lambda d: clean.outliers(d, "robust_z", "median", z=1.5), EV, f"CASE WHEN {ROB} THEN med ELSE value END", MED)
register(
    "outlier_robust_local_median", "ev_mean", lambda d: clean.outliers(d, "robust_z", "local_median", z=1.5), EV,
    f"CASE WHEN {ROB} THEN lm ELSE value END",
    MED.replace(", s AS (SELECT *,", ", s AS (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY channel ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS lm,"),
)
IQR = "value < q1 - 0.5 * (q3 - q1 + 1e-12) OR value > q3 + 0.5 * (q3 - q1 + 1e-12)"
register("outlier_iqr_mask", "ev_mean", lambda d: clean.outliers(d, "iqr", "mask", k=0.5), EV, masked(IQR), STAT)
register("outlier_iqr_clip", "ev_mean", lambda d: clean.outliers(d, "iqr", "clip", p_low=5.0, p_high=95.0, k=0.5), EV, f"CASE WHEN {IQR} THEN least(greatest(value, lo), hi) ELSE value END", STAT)
register("outlier_percentile_mask", "ev_mean", lambda d: clean.outliers(d, "percentile", "mask", p_low=5.0, p_high=95.0), EV, masked("value < lo OR value > hi"), STAT)
register("outlier_percentile_clip", "ev_mean", lambda d: clean.outliers(d, "percentile", "winsorize", p_low=5.0, p_high=95.0), EV, "CASE WHEN value < lo OR value > hi THEN least(greatest(value, lo), hi) ELSE value END", STAT)
register("outlier_abs_mask", "ev_mean", lambda d: clean.outliers(d, "abs", "mask", abs_thr=60.0), EV, masked("abs(value) > 60.0"), STAT)
HAMPEL = (
    ", h1 AS (SELECT *, quantile_cont(value, 0.5) OVER w AS lm FROM pl WINDOW w AS (PARTITION BY channel ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), "
    "h2 AS (SELECT *, abs(value - lm) AS e FROM h1), "
    "s AS (SELECT *, quantile_cont(e, 0.5) OVER (PARTITION BY channel ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS ls FROM h2)"
)
register("outlier_hampel_mask", "ev_mean", lambda d: clean.outliers(d, "hampel", "mask", z=3.0), EV, masked("e / (ls * 1.4826 + 1e-12) > 3.0"), HAMPEL)
register("outlier_hampel_local_median", "ev_mean", lambda d: clean.outliers(d, "hampel", "local_median", z=3.0), EV, "CASE WHEN e / (ls * 1.4826 + 1e-12) > 3.0 THEN lm ELSE value END", HAMPEL)
STEP = "value - lag(value) OVER (PARTITION BY channel ORDER BY t)"
JUMP = (
    f", j0 AS (SELECT *, abs({STEP}) AS d FROM pl), j1 AS (SELECT *, quantile_cont(d, 0.5) {BY} AS dmed FROM j0), "
    f"j2 AS (SELECT *, abs(d - dmed) AS dd FROM j1), s AS (SELECT *, quantile_cont(dd, 0.5) {BY} AS dmad, "
    "quantile_cont(value, 0.5) OVER (PARTITION BY channel ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS lm FROM j2)"
)
register("outlier_jump_mask", "ev_mean", lambda d: clean.outliers(d, "jump", "mask", z=1.5), EV, masked("d > dmed + 1.5 * (dmad * 1.4826 + 1e-12)"), JUMP)
register("spike_replace", "ev_mean", lambda d: clean.replace_spikes(d, z=2.0, window=5), EV, "CASE WHEN d / (dmad * 1.4826 + 1e-12) > 2.0 THEN lm ELSE value END", JUMP)
register("clip_robust", "ev_mean", lambda d: clean.clip_robust(d, 1.5), EV, "CASE WHEN value IS NOT NULL THEN least(greatest(value, med - 1.5 * (mad * 1.4826 + 1e-12)), med + 1.5 * (mad * 1.4826 + 1e-12)) END", MED)
register("norm_zscore", "od_day", clean.zscore, DAY, f"(value - avg(value) {BY}) / stddev_pop(value) {BY}")
register("norm_zscore_sample", "od_day", lambda d: clean.zscore(d, 1), DAY, f"(value - avg(value) {BY}) / stddev_samp(value) {BY}")
register("norm_robust", "ev_mean", clean.robust_zscore, EV, "(value - med) / (mad * 1.4826 + 1e-12)", MED)
register("norm_minmax", "ev_mean", clean.minmax, EV, f"(value - min(value) {BY}) / (max(value) {BY} - min(value) {BY})")
RANK = (
    ", k AS (SELECT * FROM pl WHERE value IS NOT NULL), s AS (SELECT pl.t, pl.channel, pl.value, r.rmin, r.cnt, r.dense, r.ord, r.n FROM pl LEFT JOIN "
    "(SELECT t, channel, rank() OVER (PARTITION BY channel ORDER BY value) AS rmin, count(*) OVER (PARTITION BY channel, value) AS cnt, "
    "dense_rank() OVER (PARTITION BY channel ORDER BY value) AS dense, row_number() OVER (PARTITION BY channel ORDER BY value, t) AS ord, count(*) OVER (PARTITION BY channel) AS n FROM k) r "
    "ON r.t = pl.t AND r.channel = pl.channel)"
)
for ties, expr in {"avg": "rmin + (cnt - 1) / 2.0", "min": "rmin * 1.0", "max": "rmin + cnt - 1.0", "dense": "dense * 1.0", "first": "ord * 1.0"}.items():
    kind = {"avg": "average"}.get(ties, ties)
    register(f"norm_rank_{ties}", "ev_count", lambda d, kind=kind: clean.rank_normalize(d, "rank", kind), CNT, expr, RANK)
register("norm_rank_pct", "ev_mean", lambda d: clean.rank_normalize(d, "pct", "first"), EV, "(ord - 1.0) / greatest(1.0, n - 1.0)", RANK)
register(
    "detrend_linear", "ev_mean", clean.detrend_linear, EV,
    "value - my - b * (t - mt)",
    f", s AS (SELECT pl.t, pl.channel, pl.value, avg(CASE WHEN value IS NOT NULL THEN t END) {BY} AS mt, avg(value) {BY} AS my, regr_slope(value, t) {BY} AS b FROM pl)",
)
register("highpass", "ev_mean", clean.highpass, EV, "value - avg(value) OVER (PARTITION BY channel ORDER BY t ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING)")
register("rolling_median", "ev_mean", lambda d: clean.rolling_median(d, 5), EV, "quantile_cont(value, 0.5) OVER (PARTITION BY channel ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
register("diff", "ev_mean", clean.difference, EV, f"CASE WHEN t = 0 THEN 0.0 ELSE {STEP} END")
register(
    "diff_standardized", "ev_mean", clean.difference_standardized, EV, f"(d - avg(d) {BY}) / stddev_samp(d) {BY}",
    f", s AS (SELECT t, channel, CASE WHEN t = 0 THEN 0.0 ELSE {STEP} END AS d FROM pl)",
)
LAGGED = ", g AS (SELECT *, lag(value) OVER (PARTITION BY channel ORDER BY t) AS l FROM pl)"
register(
    "ar1_ols", "od_day", clean.prewhiten_ar1, DAY, "CASE WHEN t = 0 THEN 0.0 ELSE value - phi * l END",
    LAGGED + f", s AS (SELECT *, sum(l * value) {BY} / sum(CASE WHEN value IS NOT NULL THEN l * l END) {BY} AS phi FROM g)",
)
register(
    "ar1_corr", "od_day", clean.remove_ar1, DAY, "CASE WHEN abs(phi) > 0.01 AND t > 0 THEN value - phi * l ELSE value END",
    LAGGED + f", s AS (SELECT *, corr(l, value) {BY} AS phi FROM g)",
)
register(
    "clean_chain", "ev_mean", lambda d: clean.zscore(clean.fill_linear(clean.outliers(clean.fill_mean(d), "zscore", "mask", z=2.0))), EV,
    "(v - avg(v) OVER (PARTITION BY channel)) / stddev_pop(v) OVER (PARTITION BY channel)",
    f", f0 AS (SELECT t, channel, coalesce(value, avg(value) {BY}) AS value FROM pl), "
    f"f1 AS (SELECT t, channel, CASE WHEN abs(value - avg(value) {BY}) / (stddev_pop(value) {BY} + 1e-12) > 2.0 THEN NULL ELSE value END AS value FROM f0), "
    "f2 AS (SELECT t, channel, value, last_value(value IGNORE NULLS) OVER w0 AS v0, last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER w0 AS t0, "
    "first_value(value IGNORE NULLS) OVER w1 AS v1, first_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER w1 AS t1 FROM f1 "
    "WINDOW w0 AS (PARTITION BY channel ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), w1 AS (PARTITION BY channel ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), "
    "s AS (SELECT t, channel, coalesce(value, v0 + (v1 - v0) * (t - t0) / (t1 - t0), v0, v1, 0.0) AS v FROM f2)",
)


def local_fit_sql(name: str, source: str, width: int, beyond: int = 0) -> str:
    """CTE ``name(g, i, fit)``: degree-one local fits of ``source(g, i, v, w)`` at positions 0 .. n - 1 and ``beyond`` both ends."""
    return f"""{name}_n AS (SELECT g, max(i) + 1 AS n FROM {source} GROUP BY g),
{name}_p AS (SELECT g, n, unnest(range(-{beyond}, n + {beyond})) AS i FROM {name}_n),
{name}_w AS (SELECT *, greatest(least(i - {(width + 1) // 2 - 1}, n - {width}), 0) AS l FROM {name}_p),
{name}_h AS (SELECT *, greatest(i - l, least(l + {width}, n) - 1 - i) + greatest({width} - n, 0) // 2 AS h FROM {name}_w),
{name}_k AS (
  SELECT q.g, q.i, q.n, s.i - q.i AS d, s.v, s.w * CASE WHEN abs(s.i - q.i) <= 0.001 * h THEN 1.0 WHEN abs(s.i - q.i) <= 0.999 * h THEN pow(1 - pow(abs(s.i - q.i) / h, 3), 3) ELSE 0.0 END AS k
  FROM {name}_h q JOIN {source} s ON s.g = q.g AND s.i >= l AND s.i < l + {width}
),
{name}_s AS (SELECT g, i, n, sum(k) AS s0, sum(k * d) / sum(k) AS d, sum(k * d * d) / sum(k) - pow(sum(k * d) / sum(k), 2) AS c, sum(k * v) / sum(k) AS y, sum(k * v * d) / sum(k) AS yd FROM {name}_k GROUP BY g, i, n),
{name} AS MATERIALIZED (SELECT g, i, CASE WHEN s0 > 0 THEN CASE WHEN sqrt(greatest(c, 0)) > 0.001 * (n - 1) THEN y - d / c * (yd - d * y) ELSE y END END AS fit FROM {name}_s)"""


def stl_sql(panel: str, period: int, inner: int, outer: int, seasonal: int = 7) -> str:
    """Seasonal part and trend of mean-filled channels, every round spelled out."""
    nt, nl = stl.trend_span(period, seasonal), stl.low_pass_span(period)
    parts = [panel_sql(panel) + ", y AS MATERIALIZED (SELECT channel, t, coalesce(value, avg(value) OVER (PARTITION BY channel)) AS y FROM pl), len AS (SELECT max(t) + 1 AS n FROM y)"]
    parts.append("st0 AS MATERIALIZED (SELECT channel, t, y, 1.0::DOUBLE AS w, 0.0::DOUBLE AS trend, 0.0::DOUBLE AS seasonal FROM y)")
    at = 0
    for r in range(outer + 1):
        if r:
            parts.append(
                f"md{at} AS (SELECT channel, 6 * quantile_cont(abs(y - trend - seasonal), 0.5) AS h FROM st{at} GROUP BY 1), "
                f"sw{at} AS MATERIALIZED (SELECT channel, t, y, trend, seasonal, CASE WHEN abs(y - trend - seasonal) <= 0.001 * h THEN 1.0 WHEN abs(y - trend - seasonal) <= 0.999 * h "
                f"THEN pow(1 - pow(abs(y - trend - seasonal) / h, 2), 2) ELSE 0.0 END AS w FROM st{at} JOIN md{at} USING (channel))"
            )
        for k in range(inner):
            s = f"sw{at}" if r and not k else f"st{at}"
            at += 1
            parts.append(f"cy{at} AS MATERIALIZED (SELECT channel || '/' || (t % {period}) AS g, t // {period} AS i, channel, t, y - trend AS v, w FROM {s})")
            parts.append(local_fit_sql(f"cf{at}", f"cy{at}", seasonal, 1))
            parts.append(
                f"cc{at} AS MATERIALIZED (SELECT channel, i * {period} + ph AS t, fit AS c FROM cf{at} JOIN (SELECT DISTINCT g, channel, t % {period} AS ph FROM cy{at}) USING (g)), "
                f"m1{at} AS (SELECT channel, t, avg(c) OVER (PARTITION BY channel ORDER BY t ROWS BETWEEN CURRENT ROW AND {period - 1} FOLLOWING) AS c FROM cc{at}), "
                f"m2{at} AS (SELECT channel, t, avg(c) OVER (PARTITION BY channel ORDER BY t ROWS BETWEEN CURRENT ROW AND {period - 1} FOLLOWING) AS c FROM m1{at}), "
                f"m3{at} AS (SELECT channel, t, avg(c) OVER (PARTITION BY channel ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS c FROM m2{at}), "
                f"lv{at} AS MATERIALIZED (SELECT channel AS g, t + {period} AS i, c AS v, 1.0 AS w FROM m3{at}, len WHERE t + {period} < n)"
            )
            parts.append(local_fit_sql(f"lo{at}", f"lv{at}", nl))
            parts.append(
                f"se{at} AS MATERIALIZED (SELECT s.channel, s.t, s.y, s.w, c.c - l.fit AS seasonal FROM {s} s JOIN cc{at} c ON c.channel = s.channel AND c.t = s.t JOIN lo{at} l ON l.g = s.channel AND l.i = s.t), "
                f"de{at} AS MATERIALIZED (SELECT channel AS g, t AS i, y - seasonal AS v, w FROM se{at})"
            )
            parts.append(local_fit_sql(f"tr{at}", f"de{at}", nt))
            parts.append(f"st{at} AS MATERIALIZED (SELECT e.channel, e.t, e.y, e.w, r.fit AS trend, e.seasonal FROM se{at} e JOIN tr{at} r ON r.g = e.channel AND r.i = e.t)")
    return ", ".join(parts) + f" SELECT channel, t, round(trend, 5) + 0.0 AS trend, round(seasonal, 5) + 0.0 AS seasonal, round(y - seasonal, 5) + 0.0 AS value FROM st{at}"


def _decomposed(tb: Tables, **options):
    d = stl.decompose(clean.fill_mean(tb.ev_mean().long()), 24, **options)
    return d.select("channel", "t", r6("trend", 5).alias("trend"), r6("seasonal", 5).alias("seasonal"), r6(F.col("y") - F.col("seasonal"), 5).alias("value"))


@query("stl", stl_sql("ev_mean", 24, 2, 15))
def stl_robust(tb: Tables):
    """Daily season of hourly means, with fifteen rounds of robust weights."""
    return _decomposed(tb)


@query("stl_plain", stl_sql("ev_mean", 24, 5, 0))
def stl_plain(tb: Tables):
    return _decomposed(tb, robust=False)

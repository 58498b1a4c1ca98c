"""Spectral queries."""

from __future__ import annotations

from weftline.operators import spectral
from weftline.plans.catalog.base import Tables, controlled_points_sql, panel_sql, points_sql, query, r6
from weftline.plans.catalog.moments import edges_out

EV = panel_sql("ev_mean")
CLOSED = EV + ", n0 AS MATERIALIZED (SELECT channel, value AS x, row_number() OVER (PARTITION BY channel ORDER BY t) - 1 AS pos, count(*) OVER (PARTITION BY channel) AS n, avg(value) OVER (PARTITION BY channel) AS m FROM pl WHERE value IS NOT NULL)"


def dft(centre: str) -> str:
    return (
        CLOSED
        + f", sp AS MATERIALIZED (SELECT channel, n, k, sum((x - {centre}) * cos(2 * pi() * ((k * pos) % n) / n)) AS re, -sum((x - {centre}) * sin(2 * pi() * ((k * pos) % n) / n)) AS im "
        "FROM n0 JOIN (SELECT unnest(range(0, 4000)) AS k) ON k <= (n - 1) // 2 GROUP BY 1, 2, 3), "
        "am AS MATERIALIZED (SELECT channel, n, k, re, im, sqrt(re * re + im * im) AS amp FROM sp)"
    )


PEAKS = dft("m") + (
    ", nb AS (SELECT *, lag(amp) OVER w AS l, lead(amp) OVER w AS r, max(amp) OVER (PARTITION BY channel) AS top FROM am WHERE k > 0 WINDOW w AS (PARTITION BY channel ORDER BY k)), "
    "pk AS (SELECT channel, n, k, amp, row_number() OVER (PARTITION BY channel ORDER BY amp DESC, k DESC) AS rank FROM nb WHERE amp > l AND amp > r AND amp >= 0.2 * top)"
)


@query("spectrum", dft("m") + " SELECT channel, k, round(k * 1.0 / n, 6) + 0.0 AS freq, round(amp, 4) + 0.0 AS amp FROM am WHERE k > 0")
def spectrum(tb: Tables):
    s = spectral.spectrum(tb.ev_mean().long()).filter("k > 0")
    return s.select("channel", "k", r6("freq").alias("freq"), r6("amp", 4).alias("amp"))


@query("fft_peaks", PEAKS + " SELECT channel, rank, round(k * 1.0 / n, 6) + 0.0 AS freq, round(amp, 4) + 0.0 AS amp, round(n * 1.0 / k, 6) + 0.0 AS period FROM pk WHERE rank <= 3")
def fft_peaks(tb: Tables):
    s = spectral.fft_peaks(tb.ev_mean().long())
    return s.select("channel", "rank", r6("freq").alias("freq"), r6("amp", 4).alias("amp"), r6("period").alias("period"))


@query(
    "frequency_analysis",
    dft("0")
    + ", nb AS (SELECT *, lag(amp) OVER w AS l, lead(amp) OVER w AS r, max(amp) OVER (PARTITION BY channel) AS top FROM am WINDOW w AS (PARTITION BY channel ORDER BY k)) "
    "SELECT channel, round(k * 1.0 / n, 6) + 0.0 AS freq, round(amp, 4) + 0.0 AS amp FROM nb WHERE amp > l AND amp > r AND amp >= 0.02 * top",
)
def frequency_analysis(tb: Tables):
    s = spectral.frequency_analysis(tb.ev_mean().long(), ratio=0.02)
    return s.select("channel", r6("freq").alias("freq"), r6("amp", 4).alias("amp"))


@query("hurst_spectral", dft("m") + " SELECT channel, round((1 - regr_slope(log10(amp * amp), log10(k * 1.0 / n))) / 2, 6) + 0.0 AS value FROM am WHERE k > 0 GROUP BY 1")
def hurst_spectral(tb: Tables):
    return spectral.hurst_spectral(tb.ev_mean().long()).select("channel", r6("value").alias("value"))


ACF = CLOSED + (
    ", ac AS MATERIALIZED (SELECT a.channel, a.n, b.pos - a.pos AS lag, sum((a.x - a.m) * (b.x - b.m)) AS s FROM n0 a JOIN n0 b ON a.channel = b.channel AND b.pos >= a.pos AND b.pos - a.pos <= a.n // 2 GROUP BY 1, 2, 3), "
    "rho AS MATERIALIZED (SELECT channel, n, lag, s / first_value(s) OVER (PARTITION BY channel ORDER BY lag) AS acf FROM ac)"
)


@query("acf", ACF + " SELECT channel, lag, round(acf, 6) + 0.0 AS acf FROM rho WHERE lag >= 1")
def acf(tb: Tables):
    return spectral.acf(tb.ev_mean().long()).select("channel", "lag", r6("acf").alias("acf"))


@query(
    "seasonality",
    PEAKS + ACF[len(CLOSED):]
    + ", rn AS (SELECT *, lag(acf) OVER w AS l, lead(acf) OVER w AS r FROM rho WHERE lag >= 1 WINDOW w AS (PARTITION BY channel ORDER BY lag)), "
    "bp AS (SELECT channel, arg_max(lag, (acf, -lag)) AS acf_period, max(acf) AS acf_strength FROM rn WHERE acf > l AND acf > r AND acf >= 0.1 GROUP BY 1) "
    "SELECT c.channel, acf_period, round(acf_strength, 6) + 0.0 AS acf_strength, round(pk.n * 1.0 / pk.k, 6) + 0.0 AS fft_period, round(pk.k * 1.0 / pk.n, 6) + 0.0 AS fft_freq "
    "FROM (SELECT DISTINCT channel FROM n0) c LEFT JOIN bp USING (channel) LEFT JOIN pk ON pk.channel = c.channel AND pk.rank = 1",
)
def seasonality(tb: Tables):
    s = spectral.seasonality(tb.ev_mean().long())
    return s.select("channel", "acf_period", *[r6(c).alias(c) for c in ("acf_strength", "fft_period", "fft_freq")])


COH_OF_POINTS = (
    ", q0 AS MATERIALIZED (SELECT src, dst, x, y, row_number() OVER (PARTITION BY src, dst ORDER BY t) - 1 AS pos, count(*) OVER (PARTITION BY src, dst) AS n FROM pt), "
    "g0 AS (SELECT DISTINCT src, dst, n FROM q0), g1 AS (SELECT *, greatest(8, least(64, n // 2)) AS m FROM g0), "
    "sg AS (SELECT src, dst, m, unnest(range(0, (n - m) // (m - m // 2) + 1)) * (m - m // 2) AS s0 FROM g1), "
    "sv AS (SELECT q0.src, q0.dst, m, s0, pos - s0 AS j, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y FROM sg JOIN q0 ON q0.src = sg.src AND q0.dst = sg.dst AND pos >= s0 AND pos < s0 + m WINDOW w AS (PARTITION BY q0.src, q0.dst, s0)), "
    "ft AS (SELECT src, dst, m, s0, k, sum(h * x * cos(a)) AS xr, -sum(h * x * sin(a)) AS xi, sum(h * y * cos(a)) AS yr, -sum(h * y * sin(a)) AS yi FROM "
    "(SELECT *, 0.5 - 0.5 * cos(2 * pi() * j / m) AS h, 2 * pi() * k * j / m AS a FROM sv JOIN (SELECT unnest(range(0, 33)) AS k) ON k <= m // 2) GROUP BY 1, 2, 3, 4, 5), "
    "cb AS MATERIALIZED (SELECT src, dst, m, k, least(1.0, (pow(sum(xr * yr + xi * yi), 2) + pow(sum(xr * yi - xi * yr), 2)) / (sum(xr * xr + xi * xi) * sum(yr * yr + yi * yi))) AS coh FROM ft GROUP BY 1, 2, 3, 4)"
)


COH = points_sql("ev_mean", False) + COH_OF_POINTS


@query("coherence", COH + " SELECT src, dst, round(avg(coh), 6) + 0.0 AS value FROM cb GROUP BY 1, 2")
def coherence(tb: Tables):
    return edges_out(spectral.coherence_full(tb.ev_mean()))


@query("coherence_curve", COH + " SELECT src, dst, k, round(k * 1.0 / m, 6) + 0.0 AS freq, round(coh, 6) + 0.0 AS coh FROM cb")
def coherence_curve(tb: Tables):
    b = spectral.coherence_bins(tb.ev_mean().pair_points(False))
    return b.select("src", "dst", "k", r6("freq").alias("freq"), r6("coh").alias("coh"))


@query("coherence_peak", COH + ", b1 AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY coh DESC, k) AS rn FROM cb) SELECT src, dst, round(k * 1.0 / m, 6) + 0.0 AS freq, round(coh, 6) + 0.0 AS coh FROM b1 WHERE rn = 1")
def coherence_peak(tb: Tables):
    p = spectral.coherence_peaks(tb.ev_mean())
    return p.select("src", "dst", r6("freq").alias("freq"), r6("coh").alias("coh"))


@query("coherence_partial", controlled_points_sql("ev_mean", "view") + COH_OF_POINTS + " SELECT src, dst, round(avg(coh), 6) + 0.0 AS value FROM cb GROUP BY 1, 2")
def coherence_partial(tb: Tables):
    return edges_out(spectral.coherence_partial(tb.ev_mean(), ["view"]))

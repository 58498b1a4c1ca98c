"""Per-channel diagnostics."""

from __future__ import annotations

from weftline.operators import diagnostics as diag
from weftline.plans.catalog.base import Tables, query, r6
from weftline.plans.catalog.reductions import coords
from weftline.plans.catalog.spectra import CLOSED, EV


def value_out(df):
    return df.select("channel", r6("value").alias("value"))


@query(
    "hurst_aggvar",
    CLOSED
    + ", b AS (SELECT channel, m, pos // m AS b, avg(x) AS v FROM (SELECT channel, x, pos, n, mm AS m FROM n0 JOIN (SELECT unnest(range(1, 101)) AS mm) ON mm <= greatest(10, least(100, n // 2))) WHERE pos // m < n // m GROUP BY 1, 2, 3), "
    "s AS (SELECT channel, m, var_pop(v) AS va FROM b GROUP BY 1, 2 HAVING count(*) > 1 AND var_pop(v) > 0) SELECT channel, round(1 + regr_slope(log10(va), log10(m)) / 2, 6) + 0.0 AS value FROM s GROUP BY 1",
)
def hurst_aggvar(tb: Tables):
    return value_out(diag.hurst_aggvar(tb.ev_mean().long()))


@query(
    "hurst_rs",
    CLOSED
    + ", w0 AS (SELECT DISTINCT channel, n FROM n0), ws AS (SELECT channel, n, CAST(floor(pow(10, 1 + k * 0.25)) AS BIGINT) AS w, k FROM w0 JOIN (SELECT unnest(range(0, 60)) AS k) ON 1 + k * 0.25 < log10(n - 1) UNION ALL SELECT channel, n, n, 999 FROM w0), "
    "s AS (SELECT n0.channel, k, w, pos // w AS b, pos, x, sum(x) OVER (PARTITION BY n0.channel, k, pos // w ORDER BY pos) AS c FROM n0 JOIN ws ON ws.channel = n0.channel AND (pos // w + 1) * w <= ws.n), "
    "r AS (SELECT channel, k, w, b, greatest(max(c), 0) - least(min(c), 0) AS r, stddev_samp(x) AS sd FROM s GROUP BY 1, 2, 3, 4), "
    "m AS (SELECT channel, k, w, avg(r / sd) AS rs FROM r WHERE r > 0 AND sd > 0 GROUP BY 1, 2, 3) SELECT channel, round(regr_slope(log10(rs), log10(w)), 6) + 0.0 AS value FROM m GROUP BY 1",
)
def hurst_rs(tb: Tables):
    return value_out(diag.hurst_rs(tb.ev_mean().long()))


@query(
    "hurst_dfa",
    CLOSED
    + ", wk AS (SELECT channel, n, pos, sum(x - m) OVER (PARTITION BY channel ORDER BY pos) AS y FROM n0), "
    "sz AS (SELECT DISTINCT channel, n, CAST(floor(4 * pow(1.2, k)) AS BIGINT) AS w FROM (SELECT DISTINCT channel, n FROM n0) JOIN (SELECT unnest(range(0, 200)) AS k) ON k <= floor(ln(n * 0.1 / 4) / ln(1.2))), "
    "st AS (SELECT channel, w, unnest(range(0, n - w, w // 2)) AS s FROM sz), "
    "f AS (SELECT st.channel, w, s, sqrt(greatest(0.0, var_pop(y) - pow(covar_pop(y, pos), 2) / var_pop(pos))) AS f FROM st JOIN wk ON wk.channel = st.channel AND pos >= s AND pos < s + w GROUP BY 1, 2, 3), "
    "a AS (SELECT channel, w, avg(f) AS f FROM f GROUP BY 1, 2) SELECT channel, round(regr_slope(ln(f), ln(w)), 6) + 0.0 AS value FROM a GROUP BY 1",
)
def hurst_dfa(tb: Tables):
    return value_out(diag.hurst_dfa(tb.ev_mean().long()))


@query(
    "qc_table",
    EV
    + ", d0 AS (SELECT *, value - lag(value) OVER w AS dx, lag(value) OVER w AS l FROM pl WINDOW w AS (PARTITION BY channel ORDER BY t)), "
    "d1 AS (SELECT *, quantile_cont(value, 0.5) OVER c AS med, quantile_cont(dx, 0.5) OVER c AS dmed, stddev_pop(t) OVER c AS st FROM d0 WINDOW c AS (PARTITION BY channel)), "
    "d2 AS (SELECT *, quantile_cont(abs(value - med), 0.5) OVER c AS mad, quantile_cont(abs(dx - dmed), 0.5) OVER c AS dmad FROM d1 WINDOW c AS (PARTITION BY channel)) "
    "SELECT channel AS voxel_id, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS missing_frac, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) + 0.0 AS std, "
    "round(max(mad) * 1.4826, 6) + 0.0 AS robust_std, round(avg(CASE WHEN value IS NOT NULL THEN CASE WHEN abs(value - med) / (mad * 1.4826 + 1e-12) > 3 THEN 1.0 ELSE 0.0 END END), 6) + 0.0 AS outlier_frac, "
    "round(regr_slope(value, t) * max(st), 6) + 0.0 AS drift_slope, round(avg(CASE WHEN dx IS NOT NULL THEN CASE WHEN abs(dx - dmed) > 5 * (dmad + 1e-12) THEN 1.0 ELSE 0.0 END END), 6) + 0.0 AS spikes_frac, "
    "round(corr(l, value), 6) + 0.0 AS ar1 FROM d2 GROUP BY 1",
)
def qc_table(tb: Tables):
    q = diag.quality_table(tb.ev_mean().long(), with_adf=False)
    return q.select("voxel_id", *[r6(c).alias(c) for c in q.columns if c != "voxel_id"])


@query("qc_table_adf")
def qc_table_adf(tb: Tables):
    q = diag.quality_table(tb.od_day().long())
    return q.select("voxel_id", r6("stationarity_pval").alias("stationarity_pval"))


@query("diagnostics")
def diagnostics(tb: Tables):
    d = diag.diagnostics(tb.ev_mean().long())
    return d.select("channel", *[r6(c, 4).alias(c) for c in d.columns if c != "channel"])


@query(
    "qc_coords",
    "WITH e AS (SELECT vec_id AS t, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings) "
    "SELECT printf('d%02d', k) AS voxel_id, round(avg(v::DOUBLE), 6) + 0.0 AS mean, round(stddev_pop(v::DOUBLE), 6) + 0.0 AS std, k // 16 AS x, (k // 4) % 4 AS y, k % 4 AS z FROM e GROUP BY k",
)
def qc_coords(tb: Tables):
    """Quality table left-joined to the grid position of each channel."""
    q = diag.quality_table(tb.embedding_panel().long(), coords(tb), with_adf=False)
    return q.select("voxel_id", r6("mean").alias("mean"), r6("std").alias("std"), "x", "y", "z")

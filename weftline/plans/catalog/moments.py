"""Correlation-family queries."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import clean, moments
from weftline.panel import Panel
from weftline.plans.catalog.base import EVENT_TYPES, Tables, ahead_residual_sql, all_pairs_sql, channels_of, eliminated, panel_sql, points_sql, query, r6, residual_sql


def edges_out(df, digits: int = 6, *extra: str):
    return df.select("src", "dst", *extra, r6("value", digits).alias("value"))


def filled(panel: Panel) -> Panel:
    """Mean-filled panel (a fixed set of channel columns, so pivot back without discovery)."""
    return Panel.from_long(clean.fill_mean(panel.long()), panel.channels)


@query("corr_full", points_sql("ev_mean", False) + " SELECT src, dst, round(corr(x, y), 6) + 0.0 AS value FROM pt GROUP BY 1, 2")
def corr_full(tb: Tables):
    return edges_out(moments.correlation(tb.ev_mean()))


@query(
    "corr_pairs_subset",
    points_sql("od_day", False) + " SELECT src, dst, round(corr(x, y), 6) + 0.0 AS value FROM pt "
    "WHERE (src = '1-URGENT' AND dst IN ('2-HIGH', '5-LOW')) OR (src = '3-MEDIUM' AND dst = '5-LOW') GROUP BY 1, 2",
)
def corr_pairs_subset(tb: Tables):
    pairs = [("2-HIGH", "1-URGENT"), ("1-URGENT", "5-LOW"), ("3-MEDIUM", "5-LOW"), ("5-LOW", "5-LOW"), ("x", "5-LOW")]
    return edges_out(moments.correlation(tb.od_day(), pairs))


@query(
    "corr_wide_embeddings",
    "WITH e AS (SELECT vec_id AS t, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings), "
    "w AS (SELECT t, printf('d%02d', k) AS channel, CAST(v AS DOUBLE) AS value FROM e) "
    "SELECT a.channel AS src, b.channel AS dst, round(corr(a.value, b.value), 6) + 0.0 AS value "
    "FROM w a JOIN w b ON a.t = b.t AND a.channel < b.channel GROUP BY 1, 2",
)
def corr_wide_embeddings(tb: Tables):
    return edges_out(moments.correlation(tb.embedding_panel()))


@query("corr_directed", points_sql("ev_mean", True, 1) + " SELECT src, dst, round(corr(x, y), 6) + 0.0 AS value FROM pt GROUP BY 1, 2")
def corr_directed(tb: Tables):
    return edges_out(moments.lagged_correlation(tb.ev_mean(), [1]))


@query("corr_directed_lag3", points_sql("od_day", True, 3) + " SELECT src, dst, round(corr(x, y), 6) + 0.0 AS value FROM pt GROUP BY 1, 2")
def corr_directed_lag3(tb: Tables):
    return edges_out(moments.lagged_correlation(tb.od_day(), [3]))


@query("h2_full", points_sql("ev_mean", False) + " SELECT src, dst, round(pow(corr(x, y), 2), 6) + 0.0 AS value FROM pt GROUP BY 1, 2")
def h2_full(tb: Tables):
    return edges_out(moments.squared(moments.correlation(tb.ev_mean())))


@query("h2_directed", points_sql("ev_mean", True, 1) + " SELECT src, dst, round(pow(corr(x, y), 2), 6) + 0.0 AS value FROM pt GROUP BY 1, 2")
def h2_directed(tb: Tables):
    return edges_out(moments.squared(moments.lagged_correlation(tb.ev_mean(), [1])))


def partial_sql(power: int) -> str:
    """Correlation of residuals on all other channels; no value where complete rows are too few."""
    return (
        residual_sql("ev_mean", False)
        + f", e AS (SELECT src, dst, CASE WHEN count(*) > {len(EVENT_TYPES) + 2} THEN round(pow(corr(x, y), {power}), 6) + 0.0 END AS value FROM pt GROUP BY 1, 2) "
        f"SELECT src, dst, value FROM {all_pairs_sql('ev_mean', False)} LEFT JOIN e USING (src, dst)"
    )


@query("corr_partial_all", partial_sql(1))
def corr_partial_all(tb: Tables):
    """All channels through the precision matrix; the SQL takes the controls out one by one."""
    return edges_out(moments.partial_correlation(tb.ev_mean()))


@query("h2_partial", partial_sql(2))
def h2_partial(tb: Tables):
    return edges_out(moments.squared(moments.partial_correlation(tb.ev_mean())))


@query("corr_partial_residuals", residual_sql("ev_mean", False) + " SELECT src, dst, CASE WHEN count(*) >= 3 THEN round(corr(x, y), 6) + 0.0 END AS value FROM pt GROUP BY 1, 2")
def corr_partial_residuals(tb: Tables):
    """The same from the residual points of all pairs."""
    return edges_out(moments.corr_points(moments.residual_points(tb.ev_mean(), False)))


def triples_sql(least: int) -> str:
    """Partial correlation of each pair given each single other channel, in closed form over ``least`` or more rows complete in the three."""
    parts = []
    for i, s in enumerate(EVENT_TYPES):
        for d in EVENT_TYPES[i + 1 :]:
            for z in EVENT_TYPES:
                if z not in (s, d):
                    parts.append(f"SELECT '{s}' AS src, '{d}' AS dst, '{z}' AS control, corr({s}, {d}) AS xy, corr({s}, {z}) AS xz, corr({d}, {z}) AS yz, count(*) AS n FROM p WHERE {s} IS NOT NULL AND {d} IS NOT NULL AND {z} IS NOT NULL")
    return panel_sql("ev_mean") + f", c AS ({' UNION ALL '.join(parts)}) SELECT src, dst, control, CASE WHEN n >= {least} THEN round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) + 0.0 END AS value FROM c"


@query("corr_partial3", triples_sql(6))
def corr_partial3(tb: Tables):
    """Every three channels, through their precision matrix."""
    p = tb.ev_mean()
    out = None
    for three in itertools.combinations(p.channels, 3):
        edges = moments.partial_correlation(p.select(three))
        named = edges.withColumn("control", F.element_at(F.array_except(F.array(*[F.lit(c) for c in three]), F.array("src", "dst")), 1))
        out = named if out is None else out.unionByName(named)
    return edges_out(out, 6, "control")


@query("corr_partial_closed_form", triples_sql(3))
def corr_partial_closed_form(tb: Tables):
    p = tb.ev_mean()
    parts = [moments.partial_correlation_one(p, s, d, z).withColumn("control", F.lit(z)) for s, d in p.pair_list(False) for z in p.channels if z not in (s, d)]
    return edges_out(functools.reduce(DataFrame.unionByName, parts), 6, "control")


def controlled_sql() -> str:
    """Residuals on one control channel over rows complete in channel and control."""
    names = [c for c in EVENT_TYPES if c != "view"]
    res = " UNION ALL ".join(
        f"SELECT t, '{c}' AS channel, {c} - (avg({c}) OVER () + regr_slope({c}, view) OVER () * (view - avg(view) OVER ())) AS value "
        f"FROM p WHERE {c} IS NOT NULL AND view IS NOT NULL"
        for c in names
    )
    return (
        panel_sql("ev_mean") + f", r AS MATERIALIZED ({res}) SELECT a.channel AS src, b.channel AS dst, round(corr(a.value, b.value), 6) + 0.0 AS value "
        "FROM r a JOIN r b ON a.t = b.t AND a.channel < b.channel GROUP BY 1, 2"
    )


@query("corr_partial_controlled", controlled_sql())
def corr_partial_controlled(tb: Tables):
    return edges_out(moments.partial_correlation(tb.ev_mean(), ["view"]))


def trend_controlled_sql() -> str:
    res = " UNION ALL ".join(
        f"SELECT t, '{c}' AS channel, {c} - (avg({c}) OVER () + regr_slope({c}, t) OVER () * (t - avg(t) OVER ())) AS value FROM p WHERE {c} IS NOT NULL"
        for c in EVENT_TYPES
    )
    return (
        panel_sql("ev_mean") + f", r AS MATERIALIZED ({res}) SELECT a.channel AS src, b.channel AS dst, round(corr(a.value, b.value), 6) + 0.0 AS value "
        "FROM r a JOIN r b ON a.t = b.t AND a.channel < b.channel GROUP BY 1, 2"
    )


@query("corr_partial_trend", trend_controlled_sql())
def corr_partial_trend(tb: Tables):
    panel, extra = moments.control_columns(tb.ev_mean(), "trend")
    return edges_out(moments.partial_correlation(panel, extra=extra))


def shared_controls_sql(name: str) -> str:
    """Residuals of every channel on the mean of all, a trend, and the leading component by power iteration."""
    chans = channels_of(name)
    z = [f'coalesce("{c}", 0)' for c in chans]
    n = len(chans)
    lines = ", ".join("[" + ", ".join(f"sum({a} * {b})" for b in z) + "]" for a in z)
    step = f"list_transform(range(1, {n + 1}), lambda i: list_sum(list_transform(range(1, {n + 1}), lambda j: mat[i][j] * x[j])))"
    known = " + ".join(f'(("{c}" IS NOT NULL)::INT)' for c in chans)
    score = " + ".join(f"x[{k + 1}] * {v}" for k, v in enumerate(z))
    rows = " UNION ALL ".join(f"SELECT 'v' AS src, '{c}' AS dst, t, 0.0::DOUBLE AS x, \"{c}\" AS y, z0, z1, z2 FROM c0 WHERE \"{c}\" IS NOT NULL" for c in chans)
    return (
        panel_sql(name).replace("WITH ", "WITH RECURSIVE ", 1)
        + f", mat AS (SELECT [{lines}] AS mat FROM p), power(k, x) AS (SELECT 0, [{', '.join(['1.0::DOUBLE'] * n)}] UNION ALL "
        f"SELECT k + 1, list_transform(raw, lambda v: v / sqrt(list_sum(list_transform(raw, lambda u: u * u)))) FROM (SELECT k, {step} AS raw FROM power, mat WHERE k < 300)), "
        f"top AS (SELECT x FROM power WHERE k = 300), c0 AS MATERIALIZED (SELECT p.*, ({' + '.join(z)}) / ({known}) AS z0, t::DOUBLE AS z1, {score} AS z2 FROM p, top), g AS MATERIALIZED ({rows}), "
        + eliminated("g", 3, "u")
        + " SELECT a.dst AS src, b.dst AS dst, round(corr(a.y, b.y), 6) + 0.0 AS value FROM u a JOIN u b ON a.t = b.t AND a.dst < b.dst GROUP BY 1, 2"
    )


@query("corr_partial_mean_pca", shared_controls_sql("od_day"))
def corr_partial_mean_pca(tb: Tables):
    panel, extra = moments.control_columns(tb.od_day(), "global_mean_trend", 1)
    return edges_out(moments.partial_correlation(panel, extra=extra))


def pairwise_partial_sql(power: int = 1) -> str:
    """All other filled channels as controls, y one step ahead."""
    return ahead_residual_sql("ev_mean") + f" SELECT src, dst, round(pow(corr(x, y), {power}), 6) + 0.0 AS value FROM pt GROUP BY 1, 2"


@query("pairwise_partial", pairwise_partial_sql())
def pairwise_partial(tb: Tables):
    return edges_out(moments.corr_points(moments.pairwise_partial_points(filled(tb.ev_mean()), 1)))


@query("pairwise_partial_h2", pairwise_partial_sql(2))
def pairwise_partial_h2(tb: Tables):
    return edges_out(moments.squared(moments.corr_points(moments.pairwise_partial_points(filled(tb.ev_mean()), 1))))


@query(
    "lag_curve",
    panel_sql("ev_mean")
    + ", l AS (SELECT unnest(range(1, 21)) AS lag) SELECT CAST(l.lag AS INTEGER) AS lag, round(corr(a.click, b.error), 6) + 0.0 AS value "
    "FROM l JOIN p a ON true JOIN p b ON b.t = a.t + l.lag WHERE a.click IS NOT NULL AND b.error IS NOT NULL GROUP BY 1",
)
def lag_curve(tb: Tables):
    """Correlation of the first pair at lags 1..20, one pass."""
    p = tb.ev_mean().select(["click", "error"])
    return moments.lagged_correlation(p, list(range(1, 21)), [("click", "error")]).select("lag", r6("value").alias("value"))


@query(
    "pair_summary",
    points_sql("ev_mean", False)
    + ", e AS (SELECT src, dst, corr(x, y) AS v FROM pt GROUP BY 1, 2) SELECT src, dst, round(v, 6) + 0.0 AS value, CASE WHEN abs(v) > 0.05 THEN 'strong' ELSE '' END AS flag FROM e",
)
def pair_summary(tb: Tables):
    from weftline.operators.graph import pair_flags

    return pair_flags(edges_out(moments.correlation(tb.ev_mean()), 12), threshold=0.05).select(
        "src", "dst", r6("value").alias("value"), "flag"
    )

"""Grids, formulas, configuration-driven runs and export tables over the shared data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from weftline.operators import moments
from weftline.plans import registry
from weftline.plans.analysis import Analysis, preprocess
from weftline.plans.catalog.base import EVENT_TYPES, Tables, panel_sql, points_sql, query, r6
from weftline.sources import sinks, tables


GRID = (
    "WITH g AS (SELECT p_partkey AS i, p_partkey % 10 AS x, (p_partkey // 10) % 10 AS y, p_partkey // 100 % 15 AS z, p_size * 1.0 AS t0, p_retailprice AS t1, p_retailprice - p_size AS t2 FROM part), "
    "n AS (SELECT *, row_number() OVER (ORDER BY i) - 1 AS r, count(*) OVER (PARTITION BY x, y, z) AS c FROM g)"
)


def grid_frame(tb: Tables):
    k = F.col("p_partkey")
    wide = tb.read("part").select(
        k.alias("_row"), (k % 10).alias("x"), (F.floor(k / 10) % 10).alias("y"), (F.floor(k / 100) % 15).alias("z"),
        (F.col("p_retailprice") - F.col("p_size")).alias("t2"), F.col("p_size").alias("t0"), F.col("p_retailprice").alias("t1"),
    )
    return tables.positions(wide, [], "_row", "_n").drop("_row").withColumnRenamed("_n", "_row")


@query(
    "voxel_unpivot",
    GRID + ", v AS (SELECT printf('v%04d_x%d_y%d_z%d', r, x, y, z) AS channel, t0, t1, t2 FROM n) "
    "SELECT 0 AS t, channel, round(t0, 4) + 0.0 AS value FROM v UNION ALL SELECT 1, channel, round(t1, 4) + 0.0 FROM v UNION ALL SELECT 2, channel, round(t2, 4) + 0.0 FROM v",
)
def voxel_unpivot(tb: Tables):
    long, _ = tables.grid_to_long(grid_frame(tb))
    return long.select("t", "channel", r6("value", 4).alias("value"))


@query("voxel_coords", GRID + " SELECT printf('v%04d_x%d_y%d_z%d', r, x, y, z) AS channel, x, y, z, CASE WHEN c > 1 THEN 1 ELSE 0 END AS coord_duplicate FROM n")
def voxel_coords(tb: Tables):
    return tables.grid_to_long(grid_frame(tb))[1]


@query(
    "cell_split",
    "SELECT o_orderkey AS row, CAST(o_custkey AS DOUBLE) AS c1, round(o_totalprice, 2) AS c2, NULL::DOUBLE AS c3 FROM orders",
)
def cell_split(tb: Tables):
    """Rows packed into one text cell, split and read back as numbers."""
    o = tb.read("orders")
    packed = o.select(F.concat_ws(";", F.col("o_custkey").cast("string"), F.col("o_totalprice").cast("decimal(18,6)").cast("string"), "o_orderstatus").alias("_c0"), "o_orderkey")
    parts = tables.split_cells(packed.select("_c0"))
    keyed = packed.select("o_orderkey", F.split("_c0", "[,;\t]").alias("v"))
    cells = [tables.number(F.get("v", F.lit(i))) for i in range(len(parts.columns))]
    return keyed.select(F.col("o_orderkey").alias("row"), cells[0].alias("c1"), F.round(cells[1], 2).alias("c2"), cells[2].alias("c3"))


@query(
    "edge_export",
    points_sql("ev_mean", False)
    + ", e AS (SELECT src, dst, corr(x, y) AS v FROM pt GROUP BY 1, 2), m AS (SELECT * FROM e UNION ALL SELECT dst, src, v FROM e), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY abs(v) DESC, dst) AS rn FROM m), "
    "ids AS (SELECT channel AS name, row_number() OVER (ORDER BY channel) - 1 AS id FROM (SELECT DISTINCT channel FROM pl)) "
    "SELECT a.id AS src, b.id AS dst, k.src AS src_name, k.dst AS dst_name, round(v, 6) + 0.0 AS weight FROM k JOIN ids a ON a.name = k.src JOIN ids b ON b.name = k.dst WHERE rn <= 2",
)
def edge_export(tb: Tables):
    t = sinks.edge_table(moments.correlation(tb.ev_mean()), EVENT_TYPES, False, sinks.ExportPolicy(topk_per_node=2))
    return t.select("src", "dst", "src_name", "dst_name", r6("weight").alias("weight"))


@query(
    "config_run",
    panel_sql("ev_mean")
    + ", f AS (SELECT t, channel, coalesce(value, avg(value) OVER (PARTITION BY channel)) AS value FROM pl), "
    "z AS MATERIALIZED (SELECT t, channel, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS value FROM f WINDOW w AS (PARTITION BY channel)), "
    "cf AS (SELECT a.channel AS src, b.channel AS dst, corr(a.value, b.value) AS v FROM z a JOIN z b ON a.t = b.t AND a.channel < b.channel GROUP BY 1, 2), "
    "cd AS (SELECT a.channel AS src, b.channel AS dst, corr(a.value, b.value) AS v FROM z a JOIN z b ON b.t = a.t + 2 AND a.channel <> b.channel GROUP BY 1, 2) "
    "SELECT 'correlation_full' AS variant, src, dst, round(v, 6) + 0.0 AS value, CASE WHEN abs(v) > 0.05 THEN 'strong' ELSE '' END AS flag FROM cf "
    "UNION ALL SELECT 'correlation_directed', src, dst, round(v, 6) + 0.0, CASE WHEN abs(v) > 0.05 THEN 'strong' ELSE '' END FROM cd",
)
def config_run(tb: Tables):
    """A run described by settings text: clean, two methods, flags."""
    from weftline.plans.config import build_run_spec, parse_user_input

    spec = build_run_spec(parse_user_input("variants=corr_full,corr_directed; lag_selection=fixed; lag=2; include_scans=no"))
    a = Analysis(tb.ev_mean(), spec).prepare(normalize="zscore")
    a.run()
    s = a.summaries(threshold=0.05)
    return s.select("variant", "src", "dst", r6("value").alias("value"), "flag")


@query(
    "preprocess_chain",
    panel_sql("ev_mean")
    + ", f AS (SELECT t, channel, coalesce(value, avg(value) OVER (PARTITION BY channel)) AS value FROM pl), "
    "z AS (SELECT t, channel, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS value FROM f WINDOW w AS (PARTITION BY channel)) SELECT t, channel, round(value, 6) + 0.0 AS value FROM z",
)
def preprocess_chain(tb: Tables):
    p, _ = preprocess(tb.ev_mean(), normalize="zscore")
    return p.long().select("t", "channel", r6("value").alias("value"))


@query("all_methods")
def all_methods(tb: Tables):
    """Every registered pair method on one panel."""
    p = tb.od_month()
    out = None
    for name in registry.METHODS:
        one = registry.compute(p, name, 1).withColumn("variant", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("variant", "src", "dst", r6("value", 4).alias("value"))


# share of steps in time at which x - y changes its sign: count, changes, first and last sign of a stretch
SIGN_CHANGES = (
    lambda: np.zeros(4),
    lambda state, x, y: _stretch(state, np.sign(x - y)),
    lambda a, b: np.array([a[0] + b[0], a[1] + b[1] + (a[0] > 0 and b[0] > 0 and a[3] != b[2]), a[2] if a[0] else b[2], b[3] if b[0] else a[3]]),
    lambda state: state[1] / (state[0] - 1) if state[0] > 1 else None,
)


def _stretch(state, signs):
    own = np.array([len(signs), np.count_nonzero(np.diff(signs)), signs[0], signs[-1]])
    return SIGN_CHANGES[2](state, own)


@query(
    "user_metric",
    points_sql("ev_mean", False)
    + ", s AS (SELECT src, dst, sign(x - y) AS s, lag(sign(x - y)) OVER (PARTITION BY src, dst ORDER BY t) AS p FROM pt) "
    "SELECT src, dst, round(count(*) FILTER (s <> p) / (count(*) - 1.0), 6) + 0.0 AS value FROM s GROUP BY 1, 2",
)
def user_metric(tb: Tables):
    """A metric of the user's own, given as a mergeable state over points in time order."""
    registry.register_state_metric("sign_changes", *SIGN_CHANGES, ordered=True)
    try:
        edges = registry.compute(tb.ev_mean(), "sign_changes")
    finally:
        registry.METHODS.pop("sign_changes")
    return edges.select("src", "dst", r6("value").alias("value"))

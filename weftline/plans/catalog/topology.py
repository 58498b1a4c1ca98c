"""Graph measures, corrections and pair modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import graph, moments
from weftline.plans.catalog.base import EVENT_TYPES, Tables, points_sql, query, r6

THR = 0.02
E0 = points_sql("ev_mean", False) + ", e0 AS (SELECT src, dst, corr(x, y) AS value FROM pt GROUP BY 1, 2), "
UND = E0 + f"e AS MATERIALIZED (SELECT src, dst, abs(value) AS weight FROM e0 WHERE abs(value) >= {THR}), nodes AS (SELECT DISTINCT channel AS name FROM pl), m AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e)"
DIR = points_sql("ev_mean", True, 1) + f", e0 AS (SELECT src, dst, corr(x, y) AS value FROM pt GROUP BY 1, 2), e AS MATERIALIZED (SELECT src, dst, abs(value) AS weight FROM e0 WHERE abs(value) >= {THR}), nodes AS (SELECT DISTINCT channel AS name FROM pl)"


def und(tb: Tables):
    return graph.threshold_edges(moments.correlation(tb.ev_mean()), THR), nodes_of(tb)


def dire(tb: Tables):
    return graph.threshold_edges(moments.lagged_correlation(tb.ev_mean(), [1]).drop("lag"), THR), nodes_of(tb)


def nodes_of(tb: Tables):
    return tb.spark.createDataFrame([(c,) for c in EVENT_TYPES], "name string")


@query("graph_degree", UND + " SELECT name, round(coalesce(sum(weight), 0), 6) + 0.0 AS degree FROM nodes LEFT JOIN m ON m.dst = name GROUP BY 1")
def graph_degree(tb: Tables):
    return graph.weighted_degree(*und(tb)).select("name", r6("degree").alias("degree"))


@query("graph_in_degree", DIR + " SELECT name, round(coalesce(sum(weight), 0), 6) + 0.0 AS degree FROM nodes LEFT JOIN e ON e.dst = name GROUP BY 1")
def graph_in_degree(tb: Tables):
    return graph.weighted_degree(*dire(tb), True).select("name", r6("degree").alias("degree"))


@query("graph_density", UND + " SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM e) AS edges, round(2.0 * (SELECT count(*) FROM e) / 20, 6) + 0.0 AS density")
def graph_density(tb: Tables):
    return graph.density(*und(tb)).select("nodes", "edges", r6("density").alias("density"))


@query(
    "graph_clustering",
    UND
    + ", w AS (SELECT src, dst, cbrt(weight / (SELECT max(weight) FROM e)) AS s FROM m), d AS (SELECT src AS name, count(*) AS k FROM w GROUP BY 1), "
    "tr AS (SELECT a.src AS name, sum(a.s * b.s * c.s) AS t FROM w a JOIN w b ON a.src = b.src AND a.dst <> b.dst JOIN w c ON c.src = a.dst AND c.dst = b.dst GROUP BY 1) "
    "SELECT name, round(coalesce(t / (k * (k - 1)), 0.0), 6) + 0.0 AS clustering FROM nodes LEFT JOIN d USING (name) LEFT JOIN tr USING (name)",
)
def graph_clustering(tb: Tables):
    return graph.clustering(*und(tb)).select("name", r6("clustering").alias("clustering"))


@query(
    "graph_clustering_directed",
    DIR
    + ", h AS (SELECT src, dst, cbrt(weight / (SELECT max(weight) FROM e)) AS s FROM e), w AS (SELECT src, dst, sum(s) AS s FROM (SELECT src, dst, s FROM h UNION ALL SELECT dst, src, s FROM h) GROUP BY 1, 2), "
    "d AS (SELECT name, count(*) AS dt FROM (SELECT src AS name FROM e UNION ALL SELECT dst FROM e) GROUP BY 1), "
    "rc AS (SELECT a.src AS name, count(*) AS db FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src GROUP BY 1), "
    "tr AS (SELECT a.src AS name, sum(a.s * b.s * c.s) AS t FROM w a JOIN w b ON a.src = b.src AND a.dst <> b.dst JOIN w c ON c.src = a.dst AND c.dst = b.dst GROUP BY 1) "
    "SELECT name, round(coalesce(t / (2 * (dt * (dt - 1) - 2 * coalesce(db, 0))), 0.0), 6) + 0.0 AS clustering FROM nodes LEFT JOIN d USING (name) LEFT JOIN rc USING (name) LEFT JOIN tr USING (name)",
)
def graph_clustering_directed(tb: Tables):
    return graph.clustering(*dire(tb), True).select("name", r6("clustering").alias("clustering"))


BETWEEN = DIR.replace("WITH ", "WITH RECURSIVE ", 1) + (
    ", walks(s, v, d, seen) AS (SELECT name, name, 0.0::DOUBLE, [name] FROM nodes UNION ALL "
    "SELECT s, dst, d + weight, list_append(seen, dst) FROM walks JOIN e ON src = v WHERE NOT list_contains(seen, dst)), "
    "near AS (SELECT s, v, min(d) AS d FROM walks GROUP BY 1, 2), "
    "best AS (SELECT w.s, w.v, seen, count(*) OVER (PARTITION BY w.s, w.v) AS ways FROM walks w JOIN near n ON n.s = w.s AND n.v = w.v AND n.d = w.d WHERE w.s <> w.v), "
    "through AS (SELECT unnest(seen[2:len(seen) - 1]) AS name, 1.0 / ways AS x FROM best)"
)


@query("graph_betweenness", BETWEEN + " SELECT name, round(coalesce(sum(x), 0) / 12, 6) + 0.0 AS betweenness FROM nodes LEFT JOIN through USING (name) GROUP BY 1")
def graph_betweenness(tb: Tables):
    return graph.betweenness(*dire(tb), True).select("name", r6("betweenness").alias("betweenness"))


POWER = UND.replace("WITH ", "WITH RECURSIVE ", 1) + (
    ", ns AS (SELECT list(name ORDER BY name) AS ns FROM nodes), "
    "mat AS (SELECT list(line ORDER BY a) AS mat FROM (SELECT a.name AS a, list(coalesce(m.weight, 0) ORDER BY b.name) AS line FROM nodes a CROSS JOIN nodes b LEFT JOIN m ON m.dst = a.name AND m.src = b.name GROUP BY 1)), "
    "power(k, x, done) AS (SELECT 0, list_transform(ns, lambda z: 1.0::DOUBLE / len(ns)), false FROM ns UNION ALL "
    "SELECT k + 1, y, list_sum(list_transform(range(1, len(y) + 1), lambda i: abs(y[i] - x[i]))) < len(y) * 1e-6 FROM ("
    "SELECT k, x, list_transform(raw, lambda v: v / sqrt(list_sum(list_transform(raw, lambda u: u * u)))) AS y FROM ("
    "SELECT k, x, list_transform(range(1, len(x) + 1), lambda i: x[i] + list_sum(list_transform(range(1, len(x) + 1), lambda j: mat[i][j] * x[j]))) AS raw FROM power, mat WHERE NOT done AND k < 500)))"
)


@query("graph_eigenvector", POWER + " SELECT unnest(ns) AS name, round(unnest(x), 4) + 0.0 AS eigenvector FROM power, ns WHERE done")
def graph_eigenvector(tb: Tables):
    return graph.eigenvector(*und(tb)).select("name", r6("eigenvector", 4).alias("eigenvector"))


@query("graph_communities")
def graph_communities(tb: Tables):
    return graph.communities(*und(tb))


@query(
    "graph_connected",
    UND
    + ", RQ AS (SELECT 1) SELECT (SELECT count(*) FROM nodes) = (SELECT count(DISTINCT b) FROM (SELECT min(name) AS b FROM nodes UNION ALL SELECT dst FROM m WHERE src = (SELECT min(name) FROM nodes) "
    "UNION ALL SELECT m2.dst FROM m m1 JOIN m m2 ON m1.dst = m2.src WHERE m1.src = (SELECT min(name) FROM nodes) "
    "UNION ALL SELECT m3.dst FROM m m1 JOIN m m2 ON m1.dst = m2.src JOIN m m3 ON m2.dst = m3.src WHERE m1.src = (SELECT min(name) FROM nodes) "
    "UNION ALL SELECT m4.dst FROM m m1 JOIN m m2 ON m1.dst = m2.src JOIN m m3 ON m2.dst = m3.src JOIN m m4 ON m3.dst = m4.src WHERE m1.src = (SELECT min(name) FROM nodes))) AS connected",
)
def graph_connected(tb: Tables):
    e, n = und(tb)
    return tb.spark.createDataFrame([(graph.is_connected(graph.staged(e), n),)], "connected boolean")


@query(
    "connectome_edges",
    E0 + "z AS (SELECT 1) SELECT src, dst, round(value, 6) + 0.0 AS value FROM e0 WHERE abs(value) > 0.03",
)
def connectome_edges(tb: Tables):
    return graph.connectome_edges(moments.correlation(tb.ev_mean()), 0.03).select("src", "dst", r6("value").alias("value"))


@query(
    "topk_edges",
    points_sql("ev_mean", True, 1)
    + ", e AS (SELECT src, dst, corr(x, y) AS value FROM pt GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY abs(value) DESC, dst) AS rank FROM e) "
    "SELECT src, dst, rank, round(value, 6) + 0.0 AS value FROM k WHERE rank <= 2",
)
def topk_edges(tb: Tables):
    e = graph.top_edges(moments.lagged_correlation(tb.ev_mean(), [1]).drop("lag"), 2)
    return e.select("src", "dst", "rank", r6("value").alias("value"))


@query(
    "top_pairs",
    E0 + "k AS (SELECT * FROM e0 ORDER BY abs(value) DESC, src, dst LIMIT 3) SELECT src, dst, round(value, 6) + 0.0 AS value FROM k",
)
def top_pairs(tb: Tables):
    return graph.top_pairs(moments.correlation(tb.ev_mean()), 3).select("src", "dst", r6("value").alias("value"))


@query(
    "corr_matrix",
    E0 + "m AS (SELECT src AS name, dst, value FROM e0 UNION ALL SELECT dst, src, value FROM e0) SELECT name, "
    + ", ".join(f"round(coalesce(max(value) FILTER (dst = '{c}'), CASE WHEN name = '{c}' THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS {c}" for c in EVENT_TYPES)
    + " FROM m GROUP BY 1",
)
def corr_matrix(tb: Tables):
    m = graph.matrix(moments.correlation(tb.ev_mean()), EVENT_TYPES, False)
    return m.select("name", *[r6(c).alias(c) for c in EVENT_TYPES])


FDR = (
    "WITH pv AS (SELECT o_orderkey AS id, o_orderpriority AS g, o_totalprice / (SELECT max(o_totalprice) FROM orders) AS p FROM orders), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY p) AS k, count(*) OVER (PARTITION BY {g}) AS m FROM pv), "
    "q AS (SELECT *, min(p * m / k) OVER (PARTITION BY {g} ORDER BY p, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q0, k FROM r), "
    "s AS (SELECT id, g, min(q0) OVER (PARTITION BY {g}, p) AS q FROM q) SELECT id, g, round(greatest(0.0, least(1.0, q)), 6) + 0.0 AS q FROM s"
)


def pvalues(tb: Tables):
    o = tb.read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("g"), F.col("o_totalprice").alias("v"))
    top = tb.read("orders").agg(F.max("o_totalprice")).first()[0]
    return o.select("id", "g", (F.col("v") / F.lit(top)).alias("p"))


@query("fdr_bh", FDR.format(g="1"))
def fdr_bh(tb: Tables):
    return graph.fdr_bh(pvalues(tb), "p").select("id", "g", r6("q").alias("q"))


@query("fdr_bh_grouped", FDR.format(g="g"))
def fdr_bh_grouped(tb: Tables):
    return graph.fdr_bh(pvalues(tb), "p", ["g"]).select("id", "g", r6("q").alias("q"))


def grid_sql(cond: str) -> str:
    return (
        "WITH c AS (SELECT printf('v%06d', p_partkey) AS channel, p_partkey % 12 AS x, (p_partkey // 12) % 12 AS y, p_partkey // 144 AS z FROM part) "
        f"SELECT a.channel AS src, b.channel AS dst FROM c a JOIN c b ON a.channel < b.channel AND {cond}"
    )


def grid(tb: Tables):
    k = F.col("p_partkey")
    return tb.read("part").select(
        F.format_string("v%06d", k).alias("channel"), (k % 12).alias("x"), (F.floor(k / 12) % 12).alias("y"), F.floor(k / 144).alias("z")
    )


@query("neighbor_pairs_6", grid_sql("abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1"))
def neighbor_pairs_6(tb: Tables):
    return graph.neighbor_pairs(grid(tb), "6")


@query("neighbor_pairs_26", grid_sql("greatest(abs(a.x - b.x), abs(a.y - b.y), abs(a.z - b.z)) <= 2"))
def neighbor_pairs_26(tb: Tables):
    return graph.neighbor_pairs(grid(tb), "26", 2)


@query("graph_topology")
def graph_topology(tb: Tables):
    t, _ = graph.topology(moments.lagged_correlation(tb.ev_mean(), [1]).drop("lag"), nodes_of(tb), THR, True)
    return t.select("name", *[r6(c, 4).alias(c) for c in ("degree", "betweenness", "eigenvector", "clustering")], "community")

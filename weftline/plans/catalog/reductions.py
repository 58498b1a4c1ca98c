"""Dimensionality reduction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import reduce as red
from weftline.plans.catalog.base import Tables, panel_sql, query, r6

EMB = (
    "WITH e AS (SELECT vec_id AS t, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings), "
    "pl AS MATERIALIZED (SELECT t, printf('d%02d', k) AS channel, k, CAST(v AS DOUBLE) AS value FROM e)"
)


def coords(tb: Tables):
    """Dimension number as a position on a 4 x 4 x 4 grid."""
    k = F.col("id")
    return tb.spark.range(64).select(
        F.format_string("d%02d", k).alias("channel"), F.floor(k / 16).alias("x"), (F.floor(k / 4) % 4).alias("y"), (k % 4).alias("z")
    )


@query("reduce_variance", EMB + ", s AS (SELECT channel, var_samp(value) AS v FROM pl GROUP BY 1 ORDER BY v DESC, channel LIMIT 8) SELECT t, channel, round(value, 6) + 0.0 AS value FROM pl WHERE channel IN (SELECT channel FROM s)")
def reduce_variance(tb: Tables):
    return red.select_channels(tb.embedding_panel(), 8).panel.long().select("t", "channel", r6("value").alias("value"))


@query(
    "spatial_bin",
    EMB
    + ", c AS (SELECT DISTINCT channel, (k // 16) // 2 AS bx, ((k // 4) % 4) // 2 AS by_, (k % 4) // 2 AS bz FROM pl), b AS (SELECT channel, dense_rank() OVER (ORDER BY bx, by_, bz) - 1 AS i FROM c) "
    "SELECT t, printf('bin_%04d', i) AS channel, round(avg(value), 6) + 0.0 AS value FROM pl JOIN b USING (channel) GROUP BY 1, 2",
)
def spatial_bin(tb: Tables):
    return red.spatial(tb.embedding_panel(), coords(tb)).panel.long().select("t", "channel", r6("value").alias("value"))


@query("reduce_combine", EMB + " SELECT t, CASE WHEN k < 32 THEN 'low' ELSE 'high' END AS channel, round(avg(value), 6) + 0.0 AS value FROM pl GROUP BY 1, 2")
def reduce_combine(tb: Tables):
    """A mapping applied in long form (one map-side-combined shuffle)."""
    m = tb.spark.range(64).select(
        F.format_string("d%02d", F.col("id")).alias("source"), F.when(F.col("id") < 32, "low").otherwise("high").alias("target"), F.lit(1 / 32).alias("weight")
    )
    return red.combine(tb.embedding_panel(), m).select("t", "channel", r6("value").alias("value"))


@query(
    "standardize",
    panel_sql("od_month")
    + ", z AS (SELECT t, channel, coalesce(value, 0.0) AS v FROM pl) SELECT t, channel, round((v - avg(v) OVER w) / stddev_pop(v) OVER w, 6) + 0.0 AS value FROM z WINDOW w AS (PARTITION BY channel)",
)
def standardize(tb: Tables):
    return red.standardized(tb.od_month()).long().select("t", "channel", r6("value").alias("value"))


def leading_vectors_sql(matrix: str, count: int, squarings: int = 16) -> str:
    """CTEs ``v1(i, x)``, ``v2`` .. of the leading unit vectors of ``matrix(i, j, s)``: a power by repeated squaring, then deflation."""
    parts, g = [], matrix
    for c in range(1, count + 1):
        last = g
        for k in range(squarings):
            parts.append(f"q{c}_{k} AS MATERIALIZED (SELECT a.i, b.j, sum(a.s * b.s) AS s FROM {last} a JOIN {last} b ON a.j = b.i GROUP BY 1, 2)")
            parts.append(f"p{c}_{k} AS MATERIALIZED (SELECT i, j, s / (SELECT max(abs(s)) FROM q{c}_{k}) AS s FROM q{c}_{k})")
            last = f"p{c}_{k}"
        # all columns of the power point the same way; the longest is the most exact
        parts.append(f"c{c} AS (SELECT j FROM {last} GROUP BY 1 ORDER BY sum(s * s) DESC, j LIMIT 1)")
        parts.append(f"v{c} AS MATERIALIZED (SELECT i, s / sqrt((SELECT sum(s * s) FROM {last} WHERE j = (SELECT j FROM c{c}))) AS x FROM {last} WHERE j = (SELECT j FROM c{c}))")
        parts.append(f"l{c} AS (SELECT sum(a.x * {g}.s * b.x) AS l FROM {g} JOIN v{c} a ON a.i = {g}.i JOIN v{c} b ON b.i = {g}.j)")
        parts.append(f"d{c} AS MATERIALIZED (SELECT {g}.i, {g}.j, {g}.s - (SELECT l FROM l{c}) * a.x * b.x AS s FROM {g} JOIN v{c} a ON a.i = {g}.i JOIN v{c} b ON b.i = {g}.j)")
        g = f"d{c}"
    return ", ".join(parts)


def scores_sql(cells: str, count: int, by_weight: bool) -> str:
    """Scores on the leading vectors of standardised ``cells``; the largest weight (or else the largest score) of each is positive."""
    sql = (
        cells
        + ", st AS (SELECT i, avg(v) AS m, stddev_pop(v) AS d FROM cell GROUP BY 1), z AS MATERIALIZED (SELECT t, cell.i, (v - m) / CASE WHEN d > 0 THEN d ELSE 1 END AS z FROM cell JOIN st USING (i)), "
        "g AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.z * b.z) AS s FROM z a JOIN z b ON a.t = b.t GROUP BY 1, 2), " + leading_vectors_sql("g", count)
    )
    out = []
    for c in range(1, count + 1):
        sql += f", s{c} AS MATERIALIZED (SELECT t, sum(z * x) AS value FROM z JOIN v{c} USING (i) GROUP BY 1)"
        top = f"SELECT sign(arg_max(x, abs(x))) FROM v{c}" if by_weight else f"SELECT sign(arg_max(value, abs(value))) FROM s{c}"
        out.append(f"SELECT t, 'pc_{c:04d}' AS channel, round(value * ({top}), 4) + 0.0 AS value FROM s{c}")
    return sql + " " + " UNION ALL ".join(out)


EMBEDDED = "WITH cell AS (SELECT vec_id AS t, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)"
MONTHS = panel_sql("od_month") + ", cell AS (SELECT t, channel AS i, coalesce(value, 0) AS v FROM pl)"


@query("pca", scores_sql(EMBEDDED, 3, True))
def pca(tb: Tables):
    return red.pca(tb.embedding_panel(), 3).panel.long().select("t", "channel", r6("value", 4).alias("value"))


@query("pca_gram", scores_sql(MONTHS, 2, False))
def pca_gram(tb: Tables):
    p = tb.od_month()
    scores, _, _ = red.pca_gram(p.long(), p.length(), 2)
    return scores.select("t", "channel", r6("value", 4).alias("value"))


@query("pca_mapping")
def pca_mapping(tb: Tables):
    m = red.pca(tb.embedding_panel(), target_var=0.2, priority="explained_variance", mapping_topk=5).mapping
    return m.select("source", "target", r6("weight", 4).alias("weight"))


@query("kmeans")
def kmeans(tb: Tables):
    return red.kmeans(tb.embedding_panel(), 6, 1).panel.long().select("t", "channel", r6("value").alias("value"))

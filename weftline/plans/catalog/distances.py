"""Distance- and neighbour-based metrics."""

from __future__ import annotations

from weftline.operators import distances, moments, neighbors
from weftline.plans.catalog.base import Tables, ahead_residual_sql, channels_of, eliminated, panel_sql, points_sql, query, r6, residual_sql, with_controls_sql
from weftline.plans.catalog.moments import edges_out, filled


def dcor_sql(prefix: str) -> str:
    return (
        prefix
        + ", d AS MATERIALIZED (SELECT a.src, a.dst, a.t AS i, abs(a.x - b.x) AS u, abs(a.y - b.y) AS v FROM pt a JOIN pt b USING (src, dst)), "
        "r AS (SELECT src, dst, i, avg(u) AS mu, avg(v) AS mv, sum(u * v) AS uv, sum(u * u) AS uu, sum(v * v) AS vv, count(*) AS n FROM d GROUP BY 1, 2, 3), "
        "s AS (SELECT src, dst, max(n) AS n, sum(uv) / max(n) / max(n) - 2 * avg(mu * mv) + avg(mu) * avg(mv) AS cxy, "
        "sum(uu) / max(n) / max(n) - 2 * avg(mu * mu) + avg(mu) * avg(mu) AS cxx, sum(vv) / max(n) / max(n) - 2 * avg(mv * mv) + avg(mv) * avg(mv) AS cyy FROM r GROUP BY 1, 2) "
        "SELECT src, dst, round(CASE WHEN n >= 8 THEN sqrt(greatest(0.0, cxy) / sqrt(cxx * cyy)) ELSE 0.0 END, 6) + 0.0 AS value FROM s"
    )


@query("dcor_full", dcor_sql(points_sql("ev_mean", False)))
def dcor_full(tb: Tables):
    return edges_out(distances.dcor_full(tb.ev_mean()))


@query("dcor_full_ties", dcor_sql(points_sql("ev_count", False)))
def dcor_full_ties(tb: Tables):
    return edges_out(distances.dcor_full(tb.ev_count()))


@query("dcor_directed", dcor_sql(points_sql("ev_mean", True, 1)))
def dcor_directed(tb: Tables):
    return edges_out(distances.dcor_directed(tb.ev_mean(), 1))


@query("dcor_partial", dcor_sql(residual_sql("ev_mean", False)))
def dcor_partial(tb: Tables):
    return edges_out(distances.dcor_partial(tb.ev_mean()))



def mi_sql(prefix: str) -> str:
    """KSG by self-join; digamma(m) is a running harmonic sum minus Euler's constant."""
    return (
        prefix
        + ", psi AS MATERIALIZED (SELECT m, sum(CASE WHEN m > 1 THEN 1.0 / (m - 1) ELSE 0 END) OVER (ORDER BY m) - 0.5772156649015329 AS h FROM (SELECT unnest(range(1, 20000)) AS m)), "
        "dd AS MATERIALIZED (SELECT a.src, a.dst, a.t AS i, abs(a.x - b.x) AS u, abs(a.y - b.y) AS v FROM pt a JOIN pt b ON a.src = b.src AND a.dst = b.dst AND a.t <> b.t), "
        "kk AS (SELECT src, dst, i, min(greatest(u, v), 5)[5] AS eps FROM dd GROUP BY 1, 2, 3), "
        "cc AS (SELECT dd.src, dd.dst, dd.i, count(*) FILTER (u < eps OR (eps = 0 AND u = 0)) + 1 AS nx, count(*) FILTER (v < eps OR (eps = 0 AND v = 0)) + 1 AS ny FROM dd JOIN kk USING (src, dst, i) GROUP BY 1, 2, 3), "
        "mm AS (SELECT src, dst, avg(px.h + py.h) AS s, count(*) AS n FROM cc JOIN psi px ON px.m = nx JOIN psi py ON py.m = ny GROUP BY 1, 2) "
        "SELECT src, dst, round(greatest(0.0, pn.h + pk.h - s), 6) + 0.0 AS value FROM mm JOIN psi pn ON pn.m = n JOIN psi pk ON pk.m = 5"
    )


@query("mutinf_full", mi_sql(points_sql("ev_mean", False)))
def mutinf_full(tb: Tables):
    return edges_out(neighbors.mutinf_full(tb.ev_mean()))


@query("mutinf_full_ties", mi_sql(points_sql("ev_count", False)))
def mutinf_full_ties(tb: Tables):
    return edges_out(neighbors.mutinf_full(tb.ev_count()))


def cmi_sql() -> str:
    zs = range(len(channels_of("ev_mean")) - 2)
    q = "greatest(" + ", ".join(f"abs(a.z{k} - b.z{k})" for k in zs) + ")"
    return (
        panel_sql("ev_mean") + ", " + with_controls_sql("ev_mean", False) + ", "
        "psi AS MATERIALIZED (SELECT m, sum(CASE WHEN m > 1 THEN 1.0 / (m - 1) ELSE 0 END) OVER (ORDER BY m) - 0.5772156649015329 AS h FROM (SELECT unnest(range(1, 20000)) AS m)), "
        f"dd AS MATERIALIZED (SELECT a.src, a.dst, a.t AS i, abs(a.x - b.x) AS u, abs(a.y - b.y) AS v, {q} AS q FROM pz a JOIN pz b ON a.src = b.src AND a.dst = b.dst AND a.t <> b.t), "
        "kk AS (SELECT src, dst, i, min(greatest(u, v, q), 5)[5] AS eps FROM dd GROUP BY 1, 2, 3), "
        "cc AS (SELECT dd.src, dd.dst, dd.i, count(*) FILTER (greatest(u, q) < eps) + 1 AS nxz, count(*) FILTER (greatest(v, q) < eps) + 1 AS nyz, count(*) FILTER (q < eps) + 1 AS nz FROM dd JOIN kk USING (src, dst, i) GROUP BY 1, 2, 3), "
        "mm AS (SELECT src, dst, avg(a.h + b.h - c.h) AS s FROM cc JOIN psi a ON a.m = nxz JOIN psi b ON b.m = nyz JOIN psi c ON c.m = nz GROUP BY 1, 2) "
        "SELECT src, dst, round(greatest(0.0, pk.h - s), 6) + 0.0 AS value FROM mm JOIN psi pk ON pk.m = 5"
    )


@query("mutinf_partial", cmi_sql())
def mutinf_partial(tb: Tables):
    return edges_out(neighbors.mutinf_partial(tb.ev_mean()))


@query("pairwise_partial_mi", mi_sql(ahead_residual_sql("ev_mean")))
def pairwise_partial_mi(tb: Tables):
    return edges_out(neighbors.mutual_information(moments.pairwise_partial_points(filled(tb.ev_mean()), 1)))


def ah_sql(lag: int = 0, base: str | None = None, table: str = "p") -> str:
    names = channels_of("ev_mean6")
    ok = " AND ".join(f"a.{c} IS NOT NULL" for c in names)
    if lag:
        ok += " AND " + " AND ".join(f"b.{c} IS NOT NULL" for c in names)
    cells = ", ".join(f"a.{c} AS x_{c}, {'b' if lag else 'a'}.{c} AS y_{c}" for c in names)
    join = f"p a JOIN p b ON b.t = a.t + {lag}" if lag else f"{table} a"

    def states(side: str) -> str:
        return " UNION ALL ".join(
            f"SELECT '{c}' AS channel, pos, {side}_{c} AS s0, lead({side}_{c}, 1) OVER (ORDER BY pos) AS s1, lead({side}_{c}, 2) OVER (ORDER BY pos) AS s2 FROM f"
            for c in names
        )

    dist = "sqrt(pow(a.s0 - b.s0, 2) + pow(a.s1 - b.s1, 2) + pow(a.s2 - b.s2, 2))"
    return (
        (base or panel_sql("ev_mean6"))
        + f", f AS MATERIALIZED (SELECT row_number() OVER (ORDER BY a.t) - 1 AS pos, {cells} FROM {join} WHERE {ok}), "
        f"xs AS MATERIALIZED (SELECT * FROM ({states('x')}) WHERE s2 IS NOT NULL), ys AS MATERIALIZED (SELECT * FROM ({states('y')}) WHERE s2 IS NOT NULL), "
        f"nn AS (SELECT a.channel, a.pos, arg_min(b.pos, ({dist}, b.pos)) AS j FROM xs a JOIN xs b ON a.channel = b.channel AND a.pos <> b.pos GROUP BY 1, 2), "
        f"d1 AS (SELECT a.channel, a.pos, min({dist}) AS d FROM ys a JOIN ys b ON a.channel = b.channel AND a.pos <> b.pos GROUP BY 1, 2), "
        f"r AS (SELECT nn.channel AS src, a.channel AS dst, avg({dist} / CASE WHEN d = 0 THEN 1e-10 ELSE d END) AS h FROM nn JOIN ys a ON a.pos = nn.pos AND a.channel <> nn.channel "
        "JOIN ys b ON b.pos = nn.j AND b.channel = a.channel JOIN d1 ON d1.channel = a.channel AND d1.pos = a.pos GROUP BY 1, 2) "
        "SELECT src, dst, round(least(1.0, 1 / h), 6) + 0.0 AS value FROM r"
    )


@query("ah_full", ah_sql())
def ah_full(tb: Tables):
    return edges_out(neighbors.ah_full(tb.ev_mean(6)))


@query("ah_directed", ah_sql(1))
def ah_directed(tb: Tables):
    return edges_out(neighbors.ah_directed(tb.ev_mean(6), 1))


def autoregression_sql(name: str) -> str:
    """``vr``: residuals of every channel on all channels one row before, over rows complete in all."""
    chans = channels_of(name)
    cond = " AND ".join(f"{c} IS NOT NULL" for c in chans)
    past = ", ".join(f"lag({c}) OVER (ORDER BY t) AS z{k}" for k, c in enumerate(chans))
    rows = " UNION ALL ".join(f"SELECT 'v' AS src, '{c}' AS dst, t, 0.0::DOUBLE AS x, {c} AS y, {', '.join(f'z{k}' for k in range(len(chans)))} FROM c1 WHERE z0 IS NOT NULL" for c in chans)
    wide = ", ".join(f"max(y) FILTER (dst = '{c}') AS {c}" for c in chans)
    return (
        panel_sql(name) + f", c0 AS MATERIALIZED (SELECT * FROM p WHERE {cond}), c1 AS MATERIALIZED (SELECT *, {past} FROM c0), g AS MATERIALIZED ({rows}), "
        + eliminated("g", len(chans), "u") + f", vr AS MATERIALIZED (SELECT t, {wide} FROM u GROUP BY t)"
    )


@query("ah_partial", ah_sql(0, autoregression_sql("ev_mean6"), "vr"))
def ah_partial(tb: Tables):
    return edges_out(neighbors.ah_partial(tb.ev_mean(6), 1))


@query(
    "sampen",
    panel_sql("ev_mean")
    + ", n0 AS (SELECT channel, value AS x, row_number() OVER (PARTITION BY channel ORDER BY t) AS pos FROM pl WHERE value IS NOT NULL), "
    "e AS (SELECT channel, pos, x AS a0, lead(x, 1) OVER w AS a1, lead(x, 2) OVER w AS a2 FROM n0 WINDOW w AS (PARTITION BY channel ORDER BY pos)), "
    "s AS (SELECT channel, stddev_samp(x) * 0.1164 * (0.5627 * ln(2) + 1.3334) AS tol FROM n0 GROUP BY 1), "
    "c AS (SELECT a.channel, count(*) FILTER (abs(a.a0 - b.a0) < tol AND abs(a.a1 - b.a1) < tol) AS nb, count(*) FILTER (abs(a.a0 - b.a0) < tol AND abs(a.a1 - b.a1) < tol AND abs(a.a2 - b.a2) < tol) AS na "
    "FROM e a JOIN e b ON a.channel = b.channel AND a.pos < b.pos JOIN s ON s.channel = a.channel WHERE a.a2 IS NOT NULL AND b.a2 IS NOT NULL GROUP BY 1) "
    "SELECT channel, round(-ln(na / nb), 6) + 0.0 AS value FROM c",
)
def sampen(tb: Tables):
    return neighbors.sample_entropy(tb.ev_mean().long()).select("channel", r6("value").alias("value"))

"""Graph view of edges: thresholds, degrees, triangles, paths, communities, corrections.

Nodes are channels.  Algorithms that need the whole graph in a task run that way only while
the edge count is under ``TASK_EDGES``; larger graphs go through joins.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from weftline.functions.ranks import value_ranks
from weftline.session import staged

TASK_EDGES = 200_000


def threshold_edges(edges: DataFrame, threshold: float = 0.2) -> DataFrame:
    """``src, dst, weight, value`` with |value| >= threshold; missing values and loops drop out."""
    v = F.col("value")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) >= threshold) & (F.col("src") != F.col("dst"))
    return edges.filter(ok).select("src", "dst", F.abs(v).alias("weight"), "value")


def connectome_edges(edges: DataFrame, threshold: float = 0.2, p_value: bool = False) -> DataFrame:
    """Edges a drawing shows: strictly above the threshold, or p strictly below it."""
    hit = F.col("value") < threshold if p_value else F.abs("value") > threshold
    return edges.filter(hit & (F.col("src") != F.col("dst")))


def evidence_edges(edges: DataFrame, threshold: float) -> DataFrame:
    """p-value edges as 1 - p where p < threshold."""
    return edges.filter(F.col("value") < threshold).withColumn("value", 1 - F.col("value"))


def mirrored(edges: DataFrame) -> DataFrame:
    both = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(both.alias("_e"), *rest).select("_e.src", "_e.dst", *rest)


def pair_flags(edges: DataFrame, threshold: float = 0.2, alpha: float = 0.05, p_value: bool = False) -> DataFrame:
    """``src, dst, value, flag``: significant (p < alpha) or strong (|value| > threshold)."""
    hit = F.col("value") < alpha if p_value else F.abs("value") > threshold
    return edges.withColumn("flag", F.when(hit, F.lit("significant" if p_value else "strong")).otherwise(F.lit("")))


def top_pairs(edges: DataFrame, k: int = 20, p_value: bool = False) -> DataFrame:
    order = F.asc("value") if p_value else F.desc(F.abs("value"))
    return edges.orderBy(order, "src", "dst").limit(k)


def top_edges(edges: DataFrame, k: int = 50, min_abs: float = 0.0) -> DataFrame:
    """k strongest edges per source; a salted first pass keeps any hub's rows spread out."""
    v = F.abs("value")
    salted = edges.withColumn("_s", F.pmod(F.xxhash64("dst"), F.lit(32)))
    first = Window.partitionBy("src", "_s").orderBy(v.desc(), "dst")
    part = salted.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k)
    w = Window.partitionBy("src").orderBy(v.desc(), "dst")
    top = part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.filter((F.col("src") != F.col("dst")) & (v >= min_abs)).drop("_s", "_r")


# -- multiple testing ---------------------------------------------------------------------------


def fdr_bh(df: DataFrame, p: str = "value", keys: Sequence[str] = (), out: str = "q") -> DataFrame:
    """Benjamini-Hochberg q-values per group; missing p-values keep a missing q.

    q(p) is the least p' * m / rank(p') over p' >= p.  Ranks come from counted distinct values,
    the running minimum from buckets of them, so no group is sorted in one task.
    """
    keys = list(keys)
    data = df.withColumn("_p", F.when(~F.isnan(p), F.col(p)))
    if not keys:
        data, keys = data.withColumn("_all", F.lit(0)), ["_all"]
    r = staged(value_ranks(data, keys, "_p").withColumn("_raw", F.col("_p") * F.col("total") / F.col("rmax")))
    # from the largest p down: a frame that begins at each row is gone through anew for every row
    later = Window.partitionBy(*keys).orderBy(F.desc("_vb")).rowsBetween(Window.unboundedPreceding, -1)
    carry = r.groupBy(*keys, "_vb").agg(F.min("_raw").alias("_m")).select(*keys, "_vb", F.min("_m").over(later).alias("_next"))
    local = Window.partitionBy(*keys, "_vb").orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0)
    q = r.withColumn("_own", F.min("_raw").over(local)).join(carry, [*keys, "_vb"])
    q = q.select(*keys, "_p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "_own", "_next")).alias(out))
    return data.join(q, [*keys, "_p"], "left").drop("_p", "_all")


# -- node measures --------------------------------------------------------------------------------


def weighted_degree(edges: DataFrame, nodes: DataFrame, directed: bool = False) -> DataFrame:
    """``name, degree``: incoming weight for directed graphs, incident weight otherwise."""
    e = edges if directed else mirrored(edges)
    d = e.groupBy(F.col("dst").alias("name")).agg(F.sum("weight").alias("degree"))
    return nodes.join(d, "name", "left").fillna(0.0, ["degree"])


def density(edges: DataFrame, nodes: DataFrame, directed: bool = False) -> DataFrame:
    e = edges if directed else edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    m = e.agg(F.count(F.lit(1)).alias("edges"))
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    room = F.col("nodes") * (F.col("nodes") - 1)
    d = F.col("edges") * (1 if directed else 2) / F.when(room > 0, room)
    return m.crossJoin(F.broadcast(n)).select("nodes", "edges", F.coalesce(d, F.lit(0.0)).alias("density"))


def clustering(edges: DataFrame, nodes: DataFrame, directed: bool = False) -> DataFrame:
    """``name, clustering``: geometric-mean triangle weight over possible triangles.

    Triangles are found from their lowest-degree corner, so a hub never pairs up all of its
    neighbours.
    """
    a, b = F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    edges = staged(edges)  # one reading of what may be long metrics
    part = F.cbrt(F.col("weight") / F.col("_top"))
    scaled = edges.crossJoin(F.broadcast(edges.agg(F.max("weight").alias("_top"))))  # one row
    agg = F.sum(part) if directed else F.max(part)
    und = staged(scaled.groupBy(a, b).agg(agg.alias("s"), F.count(F.lit(1)).alias("arcs")))
    ends = F.explode(F.array("a", "b")).alias("name")
    reciprocal = F.sum(F.when(F.col("arcs") > 1, 1).otherwise(0)).alias("db")
    deg = und.select(ends, "arcs").groupBy("name").agg(
        F.count(F.lit(1)).alias("nb"), F.sum("arcs").alias("dt"), reciprocal
    )
    d = deg.select("name", "nb")
    ranked = (
        und.join(d.withColumnRenamed("name", "a").withColumnRenamed("nb", "na"), "a")
        .join(d.withColumnRenamed("name", "b").withColumnRenamed("nb", "nb_"), "b")
    )
    low = F.when(F.struct("na", "a") < F.struct(F.col("nb_").alias("na"), F.col("b").alias("a")), True).otherwise(False)
    o = ranked.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("v"), "s")
    one = o.select("u", F.col("v").alias("v1"), F.col("s").alias("s1"))
    two = o.select("u", F.col("v").alias("v2"), F.col("s").alias("s2"))
    wedges = one.join(two, "u").filter("v1 < v2")
    closing = und.select(F.col("a").alias("v1"), F.col("b").alias("v2"), F.col("s").alias("s3"))
    tri = wedges.join(closing, ["v1", "v2"]).withColumn("w", F.col("s1") * F.col("s2") * F.col("s3"))
    per = tri.select(F.explode(F.array("u", "v1", "v2")).alias("name"), "w").groupBy("name").agg(F.sum("w").alias("w"))
    j = nodes.join(deg, "name", "left").join(per, "name", "left")
    room = F.col("dt") * (F.col("dt") - 1) - 2 * F.col("db") if directed else F.col("nb") * (F.col("nb") - 1) / 2.0
    c = F.col("w") / F.when(room > 0, room)
    return j.select("name", F.coalesce(c, F.lit(0.0)).alias("clustering"))


def _graph_in_task(edges: DataFrame, nodes: DataFrame, directed: bool):
    """Names and arcs on the driver if the graph is under the bound, else None."""
    e = (edges if directed else mirrored(edges)).select("src", "dst", "weight")
    rows = e.limit(TASK_EDGES + 1).collect()
    if len(rows) > TASK_EDGES:
        return None
    names = [r[0] for r in nodes.orderBy("name").limit(TASK_EDGES + 1).collect()]
    if len(names) > TASK_EDGES:
        return None
    rank = {c: i for i, c in enumerate(names)}
    arcs: dict[int, dict[int, float]] = {i: {} for i in range(len(names))}
    for s, d, w in rows:
        arcs[rank[s]][rank[d]] = float(w)
    return names, arcs


def _dependencies(arcs: dict[int, dict[int, float]], s: int) -> dict[int, float]:
    """Share of shortest paths from s that pass through each node (weights are distances)."""
    done: list[int] = []
    pred: dict[int, list[int]] = {s: []}
    sigma, best, fixed = {s: 1.0}, {s: 0.0}, set()
    queue = [(0.0, s)]
    while queue:
        d, v = heapq.heappop(queue)
        if v in fixed or d > best[v]:
            continue
        fixed.add(v)
        done.append(v)
        for u, w in arcs[v].items():
            nd = d + w
            if u not in fixed and (u not in best or nd < best[u]):
                best[u], sigma[u], pred[u] = nd, sigma[v], [v]
                heapq.heappush(queue, (nd, u))
            elif u not in fixed and nd == best[u]:
                sigma[u] += sigma[v]
                pred[u].append(v)
    delta = dict.fromkeys(done, 0.0)
    for v in reversed(done):
        for u in pred[v]:
            delta[u] += sigma[u] / sigma[v] * (1.0 + delta[v])
    delta.pop(s, None)
    return delta


def betweenness(edges: DataFrame, nodes: DataFrame, directed: bool = False, inverse: bool = False, by_joins: bool = False) -> DataFrame:
    """``name, betweenness`` normalised; edge strength is the distance (``inverse``: one over it)."""
    if inverse:
        edges = edges.withColumn("weight", 1.0 / F.col("weight"))
    small = None if by_joins else _graph_in_task(edges, nodes, directed)
    if small is None:
        return _betweenness_joins(edges, nodes, directed)
    names, arcs = small
    n = len(names)
    spark = edges.sparkSession
    shared = spark.sparkContext.broadcast(arcs)  # at most TASK_EDGES arcs

    def work(batches):
        for pdf in batches:
            total: dict[int, float] = {}
            for s in pdf["id"]:
                for v, x in _dependencies(shared.value, int(s)).items():
                    total[v] = total.get(v, 0.0) + x
            yield pd.DataFrame({"v": pd.Series(list(total), dtype="int64"), "x": pd.Series(list(total.values()), dtype=float)})

    sums = spark.range(n).mapInPandas(work, "v bigint, x double").groupBy("v").agg(F.sum("x").alias("x"))
    label = spark.createDataFrame(list(enumerate(names)), "v bigint, name string")
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return label.join(sums, "v", "left").select("name", (F.coalesce("x", F.lit(0.0)) * scale).alias("betweenness"))


def _betweenness_joins(edges: DataFrame, nodes: DataFrame, directed: bool) -> DataFrame:
    """The same by relaxation: distances, then path counts, then dependencies, each to a fixed point."""
    arcs = staged((edges if directed else mirrored(edges)).groupBy("src", "dst").agg(F.min("weight").alias("w")))
    n = nodes.count()
    dist = nodes.select(F.col("name").alias("s"), F.col("name").alias("v"), F.lit(0.0).alias("d"))
    while True:
        step = dist.join(arcs, F.col("v") == F.col("src")).select("s", F.col("dst").alias("v"), (F.col("d") + F.col("w")).alias("d"))
        new = staged(dist.unionByName(step).groupBy("s", "v").agg(F.min("d").alias("d")))
        same = new.join(dist.withColumnRenamed("d", "d0"), ["s", "v"], "left").filter(~F.col("d").eqNullSafe(F.col("d0")))
        if same.isEmpty():
            break
        dist = new
    u = dist.select("s", F.col("v").alias("u"), F.col("d").alias("du"))
    tight = u.join(arcs, F.col("u") == F.col("src")).select("s", "u", F.col("dst").alias("v"), (F.col("du") + F.col("w")).alias("dv"))
    tight = staged(tight.join(dist.withColumnRenamed("d", "best"), ["s", "v"]).filter("dv = best AND v <> s").select("s", "u", "v"))

    def settle(start: DataFrame, update) -> DataFrame:
        cur = start
        while True:
            new = staged(update(cur))
            old = cur.withColumnRenamed("x", "x0")
            if new.join(old, ["s", "v"], "left").filter(~F.col("x").eqNullSafe(F.col("x0"))).isEmpty():
                return new
            cur = new

    root = dist.select("s", "v", F.when(F.col("s") == F.col("v"), 1.0).otherwise(0.0).alias("x"))

    def paths(cur):
        add = tight.join(cur.withColumnRenamed("v", "u"), ["s", "u"]).groupBy("s", "v").agg(F.sum("x").alias("y"))
        return root.withColumnRenamed("x", "r").join(add, ["s", "v"], "left").select("s", "v", (F.col("r") + F.coalesce("y", F.lit(0.0))).alias("x"))

    sigma = settle(root, paths)
    ratio = (
        tight.join(sigma.select("s", F.col("v").alias("u"), F.col("x").alias("su")), ["s", "u"])
        .join(sigma.select("s", "v", F.col("x").alias("sv")), ["s", "v"])
        .select("s", "u", "v", (F.col("su") / F.col("sv")).alias("share"))
    )
    ratio = staged(ratio)
    none = dist.select("s", "v", F.lit(0.0).alias("x"))

    def back(cur):
        add = ratio.join(cur, ["s", "v"]).groupBy("s", "u").agg(F.sum(F.col("share") * (1 + F.col("x"))).alias("y"))
        return none.drop("x").join(add.withColumnRenamed("u", "v"), ["s", "v"], "left").select("s", "v", F.coalesce("y", F.lit(0.0)).alias("x"))

    delta = settle(none, back)
    sums = delta.filter("s <> v").groupBy(F.col("v").alias("name")).agg(F.sum("x").alias("x"))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return nodes.join(sums, "name", "left").select("name", (F.coalesce("x", F.lit(0.0)) * scale).alias("betweenness"))


def eigenvector(edges: DataFrame, nodes: DataFrame, directed: bool = False, max_iter: int = 500, tol: float = 1e-6, by_joins: bool = False) -> DataFrame:
    """``name, eigenvector`` by power iteration on A + I; zeros if it does not settle."""
    small = None if by_joins else _graph_in_task(edges, nodes, directed)
    spark = edges.sparkSession
    if small is not None:
        names, arcs = small
        n = len(names)
        i = np.array([s for s, t in arcs.items() for _ in t], dtype=int)
        j = np.array([d for t in arcs.values() for d in t], dtype=int)
        w = np.array([v for t in arcs.values() for v in t.values()], dtype=float)
        x = np.full(n, 1.0 / max(n, 1))
        found = np.zeros(n)
        for _ in range(max_iter):
            y = x + np.bincount(j, weights=x[i] * w, minlength=n)
            y = y / (np.linalg.norm(y) or 1.0)
            if np.abs(y - x).sum() < n * tol:
                found = y
                break
            x = y
        return spark.createDataFrame(list(zip(names, found.tolist())), "name string, eigenvector double")
    arcs = staged((edges if directed else mirrored(edges)).select("src", "dst", "weight"))
    n = nodes.count()
    x = staged(nodes.select("name", F.lit(1.0 / n).alias("x")))
    for _ in range(max_iter):
        add = arcs.join(x.withColumnRenamed("name", "src"), "src").groupBy(F.col("dst").alias("name")).agg(F.sum(F.col("x") * F.col("weight")).alias("y"))
        raw = staged(x.join(add, "name", "left").select("name", "x", (F.col("x") + F.coalesce("y", F.lit(0.0))).alias("y")))
        norm = raw.agg(F.sqrt(F.sum(F.col("y") * F.col("y")))).first()[0] or 1.0
        gap = raw.agg(F.sum(F.abs(F.col("y") / norm - F.col("x")))).first()[0]
        x = raw.select("name", (F.col("y") / norm).alias("x"))
        if gap < n * tol:
            return x.withColumnRenamed("x", "eigenvector")
    return nodes.select("name", F.lit(0.0).alias("eigenvector"))


def communities(edges: DataFrame, nodes: DataFrame, by_joins: bool = False) -> DataFrame:
    """``name, community``: greedy modularity merging of the undirected, unweighted graph; largest community is 0."""
    und = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    small = None if by_joins else _graph_in_task(und.withColumn("weight", F.lit(1.0)), nodes, False)
    if small is not None:
        names, arcs = small
        groups = _merge_greedily(arcs)
        rows = [(names[v], k) for k, g in enumerate(groups) for v in g]
        return edges.sparkSession.createDataFrame(rows, "name string, community int")
    und = staged(und)
    m = und.count()
    member = staged(nodes.select("name", F.col("name").alias("c")))
    while True:
        c1, c2 = member.toDF("src", "c1"), member.toDF("dst", "c2")
        e = und.join(c1, "src").join(c2, "dst")
        between = mirrored(e.filter("c1 <> c2").select(F.col("c1").alias("src"), F.col("c2").alias("dst"))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))
        share = e.select(F.explode(F.array("c1", "c2")).alias("c")).groupBy("c").agg((F.count(F.lit(1)) / (2.0 * m)).alias("a"))
        gain = between.join(share.toDF("src", "au"), "src").join(share.toDF("dst", "av"), "dst")
        gain = gain.select("src", "dst", (F.col("w") / m - 2 * F.col("au") * F.col("av")).alias("dq"))
        best = gain.orderBy(F.desc("dq"), "src", "dst").limit(1).collect()
        if not best or best[0].dq < 0:
            break
        member = staged(member.withColumn("c", F.when(F.col("c") == best[0].src, best[0].dst).otherwise(F.col("c"))))
    size = member.groupBy("c").agg(F.count(F.lit(1)).alias("k"), F.min("name").alias("first")).withColumn("_g", F.lit(1))
    order = Window.partitionBy("_g").orderBy(F.desc("k"), "first")
    return member.join(size.select("c", (F.row_number().over(order) - 1).alias("community")), "c").select("name", "community")


def _merge_greedily(arcs: dict[int, dict[int, float]]) -> list[list[int]]:
    m = sum(len(t) for t in arcs.values()) / 2
    groups = {v: [v] for v in arcs}
    if m:
        a = {v: len(t) / (2 * m) for v, t in arcs.items()}
        w = {v: {u: 1.0 for u in t} for v, t in arcs.items()}
        while True:
            gains = [(-(w[u][v] / m - 2 * a[u] * a[v]), u, v) for u in w for v in w[u]]
            if not gains:
                break
            dq, u, v = min(gains)
            if dq > 0:
                break
            groups[v] += groups.pop(u)
            a[v] += a.pop(u)
            for k, x in w.pop(u).items():
                w[k].pop(u)
                if k != v:
                    w[v][k] = w[v].get(k, 0.0) + x
                    w[k][v] = w[v][k]
    return sorted((sorted(g) for g in groups.values()), key=lambda g: (-len(g), g[0]))


def _reaches_all(arcs: DataFrame, nodes: DataFrame) -> bool:
    n = nodes.count()
    if n == 0:
        return False
    seen = staged(nodes.orderBy("name").limit(1))
    front = seen
    while True:
        nxt = front.join(arcs, front["name"] == arcs["src"]).select(F.col("dst").alias("name")).distinct()
        front = staged(nxt.join(seen, "name", "left_anti"))
        if front.isEmpty():
            return seen.count() == n
        seen = staged(seen.unionByName(front))


def is_connected(edges: DataFrame, nodes: DataFrame, directed: bool = False) -> bool:
    """Connected, or strongly connected for directed graphs: one search, or one each way."""
    if not directed:
        return _reaches_all(mirrored(edges.select("src", "dst")), nodes)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return _reaches_all(edges.select("src", "dst"), nodes) and _reaches_all(back, nodes)


def topology(edges: DataFrame, nodes: DataFrame, threshold: float = 0.2, directed: bool = False, p_value: bool = False):
    """Node table (by degree) and global measures; None if the threshold leaves no edge."""
    if p_value:
        edges, threshold = evidence_edges(edges, threshold), 0.01
    e = staged(threshold_edges(edges, threshold))
    if e.isEmpty():
        return None
    table = weighted_degree(e, nodes, directed)
    for part in (betweenness(e, nodes, directed), eigenvector(e, nodes, directed), clustering(e, nodes, directed), communities(e, nodes)):
        table = table.join(part, "name")
    table = staged(table)
    d = density(e, nodes, directed).first()
    g = table.agg(F.avg("clustering"), F.countDistinct("community")).first()
    world = {
        "density": d.density, "avg_clustering": g[0], "communities_count": g[1], "is_connected": is_connected(e, nodes, directed)
    }
    return table.orderBy(F.desc("degree"), "name"), world


# -- pair modes ---------------------------------------------------------------------------------------


def neighbor_pairs(coords: DataFrame, kind: str = "26", radius: int = 1) -> DataFrame:
    """Pairs of grid points next to each other: ``src, dst`` with src before dst.

    kind 6: exactly one coordinate differs by 1; otherwise every coordinate within ``radius``.
    Each point is sent to its own cell and to those after it among the cells around, so two cells
    meet once, in a join on equal cells.  Copies of all points are too many for a broadcast, and
    Spark takes them for no larger than the points; hence the hint.
    """
    r = 1 if kind == "6" else max(1, int(radius))
    cell = [F.floor(F.col(c) / r).alias(f"c{c}") for c in "xyz"]
    a = coords.select(F.col("channel").alias("c1"), *[F.col(c).alias(f"{c}1") for c in "xyz"], *cell)
    steps = [s for s in itertools.product((-1, 0, 1), repeat=3) if s >= (0, 0, 0)]
    if kind == "6" and all(isinstance(coords.schema[c].dataType, IntegralType) for c in "xyz"):
        steps = [s for s in steps if sum(map(abs, s)) == 1]  # whole numbers: the other cells hold no neighbour
    offsets = F.explode(F.array(*[F.struct(*[F.lit(i).alias(c) for c, i in zip("xyz", s)]) for s in steps]))
    b = coords.select(F.col("channel").alias("c2"), *[F.col(c).alias(f"{c}2") for c in "xyz"], *cell).withColumn("_o", offsets)
    own = (F.col("_o.x") == 0) & (F.col("_o.y") == 0) & (F.col("_o.z") == 0)
    b = b.select("c2", "x2", "y2", "z2", own.alias("_own"), *[(F.col(f"c{c}") + F.col(f"_o.{c}")).alias(f"c{c}") for c in "xyz"])
    j = a.hint("merge").join(b, ["cx", "cy", "cz"]).filter(F.when(F.col("_own"), F.col("c1") < F.col("c2")).otherwise(F.col("c1") != F.col("c2")))
    d = [F.abs(F.col(f"{c}1") - F.col(f"{c}2")) for c in "xyz"]
    near = d[0] + d[1] + d[2] == 1 if kind == "6" else F.greatest(*d) <= r
    return j.filter(near).select(F.least("c1", "c2").alias("src"), F.greatest("c1", "c2").alias("dst"))


def random_pairs(names: Sequence[str], k: int, seed: int = 0, directed: bool = False) -> list[tuple[str, str]]:
    """k distinct pairs in a seeded order, at most all of them."""
    n = len(names)
    room = n * (n - 1) // (1 if directed else 2)
    rng = np.random.default_rng(seed)
    out: dict[tuple[int, int], None] = {}
    if k * 3 >= room:
        every = [(i, j) for i in range(n) for j in range(n) if (i != j if directed else i < j)]
        picks = [every[i] for i in rng.permutation(len(every))[:k]]
        return [(names[i], names[j]) for i, j in picks]
    while len(out) < k:
        i, j = (int(v) for v in rng.integers(0, n, 2))
        if i != j:
            out[(i, j) if directed or i < j else (j, i)] = None
    return [(names[i], names[j]) for i, j in out]


def matrix(edges: DataFrame, names: Sequence[str], directed: bool, fill: Column | float = 0.0, diagonal: float = 1.0) -> DataFrame:
    """Wide N x N view of edges: ``name`` and one column per channel."""
    e = edges if directed else mirrored(edges)
    cells = [
        F.coalesce(F.max(F.when(F.col("dst") == c, F.col("value"))), F.when(F.col("name") == c, F.lit(float(diagonal))).otherwise(fill)).alias(c)
        for c in names
    ]
    frame = e.select(F.col("src").alias("name"), "dst", "value")
    every = edges.sparkSession.createDataFrame([(c,) for c in names], "name string")
    return every.join(frame, "name", "left").groupBy("name").agg(*cells)

"""Exact nearest neighbours and ball counts for groups of any size, and the metrics on them.

Equal points are merged into weighted points.  Groups are cut by a partition tree into cells of bounded
size.  A point first searches its own cell; the distance found bounds which other cells it must visit, and
it visits them in rings, nearest first.  Counting adds the totals of cells inside a ball and visits only
cells that its border cuts.  Point pairs exist only as numpy blocks inside a task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.blocks import positions, rolling, running_sum
from weftline.functions.kdcells import CELL, Tree, boxes, grow, near_cells
from weftline.functions.ranks import value_ranks
from weftline.functions.special import digamma_int
from weftline.operators.moments import gram, linear_residual, residualize, solve_ols
from weftline.panel import Panel
from weftline.session import spread, staged

PAIR = ["src", "dst"]
K = 5
RING = 8
SORTED = 8
CHUNK = 1 << 21  # distances held at once


def _types(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keys)


def _held(cells: DataFrame, keys: list[str]):
    """Points grouped by cell under other names, so that both sides of a cogroup differ."""
    names = [*keys, "leaf"]
    rest = [c for c in ("id", "c", "w") if c in cells.columns]
    held = cells.select(*[F.col(c).alias(f"{c}_p") for c in [*names, *rest]])
    by = [f"{c}_p" for c in names]
    return spread(held, *by).groupBy(*by)


def _gaps(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Largest distance along one coordinate of each query to each box."""
    out = np.zeros((len(q), len(lo)))
    for k in range(q.shape[1]):
        np.maximum(out, np.maximum(lo[None, :, k] - q[:, k, None], q[:, k, None] - hi[None, :, k]), out=out)
    return out


def _corners(boxes: pd.DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.stack(boxes[c].to_numpy())[:, :dims].astype(float) for c in ("lo_b", "hi_b"))


def _box_rows(pairs: DataFrame, leaves: DataFrame, keys: list[str]):
    """The cells that a cell's points may reach, with their bounds, grouped by the first."""
    there = leaves.select(*keys, F.col("leaf").alias("other"), "lo", "hi", "wt")
    held = pairs.join(there, [*keys, "other"]).select(*[F.col(c).alias(f"{c}_b") for c in (*keys, "leaf", "other", "lo", "hi", "wt")])
    by = [f"{c}_b" for c in (*keys, "leaf")]
    return spread(held, *by).groupBy(*by)


def _none(columns: Sequence[str]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})


def _dist(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all rows of a to all rows of b, one coordinate at a time."""
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        d = np.abs(a[:, k, None] - b[None, :, k])
        if metric == "chebyshev":
            np.maximum(out, d, out=out)
        else:
            out += d * d
    return out if metric == "chebyshev" else np.sqrt(out)


def _search(q: np.ndarray, qid, p: np.ndarray, pid, pw, k: int, metric: str, own: bool):
    """Per query the k nearest rows of p as (distance, id, weight); a query skips one copy of itself."""
    step = max(1, CHUNK // max(1, len(p)))
    take = min(len(p), k + 1)
    dist, who, weight = [], [], []
    for s in range(0, len(q), step):
        d = _dist(q[s : s + step], p, metric)
        w = np.broadcast_to(pw, d.shape)
        if own:
            i = np.arange(len(d))
            w = w.copy()
            w[i, s + i] -= 1
            d[i, s + i] = np.where(w[i, s + i] > 0, d[i, s + i], np.inf)
        part = np.argpartition(d, take - 1, axis=1)[:, :take] if take < len(p) else np.tile(np.arange(len(p)), (len(d), 1))
        pd_, pw_, pi_ = np.take_along_axis(d, part, 1), np.take_along_axis(w, part, 1), np.asarray(pid)[part]
        if take < len(p):
            # keep the smallest id among equal distances at the cut
            edge = pd_.max(axis=1)
            tied = np.nonzero((d == edge[:, None]).sum(axis=1) > (pd_ == edge[:, None]).sum(axis=1))[0]
            for r in tied:
                o = np.lexsort((pid, d[r]))[:take]
                pd_[r], pw_[r], pi_[r] = d[r, o], w[r, o], np.asarray(pid)[o]
        o = np.lexsort((pi_, pd_), axis=1)
        dist.append(np.take_along_axis(pd_, o, 1))
        who.append(np.take_along_axis(pi_, o, 1))
        weight.append(np.take_along_axis(pw_, o, 1))
    return np.vstack(dist), np.vstack(who), np.vstack(weight)


CAND = "array<struct<d: double, id: bigint, w: bigint>>"


def _kth(k: int) -> Column:
    """Distance at which the sorted candidates ``cand`` reach weight k."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("d"))
    return F.aggregate(
        "cand", zero, lambda a, x: F.struct((a["n"] + x["w"]).alias("n"), F.when(a["d"].isNull() & (a["n"] + x["w"] >= k), x["d"]).otherwise(a["d"]).alias("d"))
    )["d"]


def nearest(points: DataFrame, keys: Sequence[str], k: int, metric: str = "chebyshev", cell: int = CELL) -> DataFrame:
    """``keys, id, c, w, eps, nn``: distance to the k-th other point and the nearest other id.

    ``points`` has the keys, ``id``, coordinates ``c`` and weight ``w`` (number of copies).  A point searches
    its own cell, then ring after ring of the cells next to it, as far as the distance found so far reaches.
    """
    keys = list(keys)
    tree = grow(points, keys, cell)
    kt = _types(points, keys)
    lists = "cd array<double>, ci array<bigint>, cw array<bigint>"

    def rows(d, i, w):
        keep = np.isfinite(d) & (w > 0)
        return {
            "cd": [x[g].tolist() for x, g in zip(d, keep)],
            "ci": [x[g].tolist() for x, g in zip(i, keep)],
            "cw": [x[g].tolist() for x, g in zip(w, keep)],
        }

    def zipped(df: DataFrame) -> DataFrame:
        z = F.transform(F.arrays_zip("cd", "ci", "cw"), lambda x: F.struct(x["cd"].alias("d"), x["ci"].alias("id"), x["cw"].alias("w")))
        return df.withColumn("cand", F.array_sort(z)).drop("cd", "ci", "cw")

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        c = np.stack(pdf["c"].to_numpy())
        d, i, w = _search(c, pdf["id"].to_numpy(), c, pdf["id"].to_numpy(), pdf["w"].to_numpy(), k, metric, True)
        return pdf[[*keys, "id", "c", "w", "leaf", "bound"]].assign(**rows(d, i, w))

    # the node above a cell has more than k points, and none of them is further away than it is wide
    cap = F.col("wide" if metric == "chebyshev" else "diag").alias("bound")
    held = spread(tree.cells.select(*keys, "id", "c", "w", "leaf", cap), *keys, "leaf")
    state = zipped(held.groupBy(*keys, "leaf").applyInPandas(own, f"{kt}, id bigint, c array<double>, w bigint, leaf string, bound double, {lists}"))
    if tree.depth:
        state = _rings(state, tree, keys, k, metric, kt, lists, rows, zipped)
    return staged(state.select(*keys, "id", "c", "w", _kth(k).alias("eps"), F.get("cand", F.lit(0))["id"].alias("nn")))


def _rings(state: DataFrame, tree: Tree, keys: list[str], k: int, metric: str, kt: str, lists: str, rows, zipped) -> DataFrame:
    """Candidates after visits to the other cells, nearest first, twice as many in each ring."""

    def closer(df: DataFrame) -> DataFrame:
        return df.withColumn("bound", F.least(F.col("bound"), F.coalesce(_kth(k), F.col("bound"))))

    state = staged(closer(state).withColumn("open", F.lit(True)))
    leaves = staged(boxes(tree, keys, F.col("w")))
    reach = state.groupBy(*keys, "leaf").agg(F.max("bound").alias("reach"))
    pairs = staged(near_cells(tree, leaves, leaves.join(reach, [*keys, "leaf"]), keys))

    def router(seen: int, ring: int):
        def route(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(b):
                return _none([*keys, "id", "c", "bound", "leaf"])
            c, bound = np.stack(q["c"].to_numpy()), q["bound"].to_numpy() * (1 + 1e-9) + 1e-300
            lo, hi = _corners(b, c.shape[1])
            names = b["other_b"].to_numpy()
            who, where = [], []
            step = max(1, CHUNK // len(b))
            for s in range(0, len(c), step):
                g = _gaps(c[s : s + step], lo, hi)
                order = np.argsort(g, axis=1, kind="stable")[:, seen : seen + ring]
                i, j = np.nonzero(np.take_along_axis(g, order, 1) <= bound[s : s + step, None])
                who.append(i + s)
                where.append(order[i, j])
            who, where = np.concatenate(who), np.concatenate(where)
            return q.iloc[who][[*keys, "id", "c", "bound"]].assign(leaf=names[where])

        return route

    def other(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return _none([*keys, "id", "cd", "ci", "cw"])
        d, i, w = _search(
            np.stack(q["c"].to_numpy()), q["id"].to_numpy(), np.stack(p["c_p"].to_numpy()), p["id_p"].to_numpy(), p["w_p"].to_numpy(), k, metric, False
        )
        d = np.where(d <= q["bound"].to_numpy()[:, None], d, np.inf)
        return q[[*keys, "id"]].assign(**rows(d, i, w))

    seen, ring = 0, RING
    while True:
        asking = spread(state.filter("open").select(*keys, "leaf", "id", "c", "bound"), *keys, "leaf").groupBy(*keys, "leaf")
        boxed = pairs if seen == 0 else pairs.join(state.filter("open").select(*keys, "leaf").distinct(), [*keys, "leaf"], "left_semi")
        visits = staged(asking.cogroup(_box_rows(boxed, leaves, keys)).applyInPandas(router(seen, ring), f"{kt}, id bigint, c array<double>, bound double, leaf string"))
        if visits.isEmpty():
            return state
        far = spread(visits, *keys, "leaf").groupBy(*keys, "leaf").cogroup(_held(tree.cells, keys)).applyInPandas(other, f"{kt}, id bigint, {lists}")
        extra = zipped(far).groupBy(*keys, "id").agg(F.flatten(F.collect_list("cand")).alias("more"), F.count("*").alias("asked"))
        merged = F.slice(F.array_sort(F.concat("cand", F.coalesce("more", F.array().cast(CAND)))), 1, k + 1)
        found = state.join(extra, [*keys, "id"], "left").withColumn("cand", merged).withColumn("open", F.coalesce(F.col("asked") == ring, F.lit(False))).drop("more", "asked")
        state = staged(closer(found))
        seen, ring = seen + ring, 2 * ring


def _count_1d(qv, eps, pv, pw, below=False):
    """Weight of sorted values strictly within eps (or equal, for eps 0), by the rounded difference; ``below``: of those not above the query."""
    order = np.argsort(pv, kind="stable")
    p, cum = pv[order], np.concatenate([[0], np.cumsum(pw[order])])
    lo, hi = np.searchsorted(p, qv - eps, "left"), np.searchsorted(p, qv + eps, "right")

    def inside(i):
        d = np.abs(p[np.clip(i, 0, len(p) - 1)] - qv)
        return (i >= 0) & (i < len(p)) & ((d < eps) | ((eps == 0) & (d == 0)))

    for _ in range(len(p) + 1):  # a value at a border may round either way
        step = ~inside(lo) & (lo < hi)
        if not step.any():
            break
        lo = lo + step
    for _ in range(len(p) + 1):
        step = ~inside(hi - 1) & (hi > lo)
        if not step.any():
            break
        hi = hi - step
    for _ in range(len(p) + 1):
        a, b = inside(lo - 1), inside(hi)
        if not (a.any() or b.any()):
            break
        lo, hi = lo - a, hi + b
    if below:
        own = np.searchsorted(p, qv, "right")
        lo, hi = np.minimum(lo, own), np.minimum(hi, own)
    return cum[hi] - cum[lo]


def ball_counts(points: DataFrame, queries: DataFrame, keys: Sequence[str], cell: int = CELL, below: bool = False) -> DataFrame:
    """``keys, id, count``: weight of points with Chebyshev distance < eps (== 0 when eps is 0).

    ``points``: keys, c, w without repeats; ``queries``: keys, id, c, eps.  Within a group all
    c have the same length.  A query located on a point counts that point too.  Cells wholly inside a
    ball add their weight; only those that its border cuts are visited.  ``below``, for one coordinate,
    counts only points that do not lie above the query.
    """
    keys = list(keys)
    kt = _types(points, keys)
    none = F.lit(None)
    asked = queries.select(*keys, "id", "c", "eps", none.cast("bigint").alias("w"))
    # points and queries lie in the same cells
    both = points.select(*keys, none.cast("bigint").alias("id"), "c", none.cast("double").alias("eps"), "w").unionByName(asked)
    tree = grow(both, keys, 2 * cell)
    cells = staged(tree.cells) if tree.depth else tree.cells
    held, ask = cells.filter("w IS NOT NULL").drop("id"), cells.filter("w IS NULL").select(*keys, "leaf", "id", "c", "eps")
    visits = ask
    sure = None
    if tree.depth:
        leaves = staged(boxes(tree, keys, F.col("w")))
        starts = ask.groupBy(*keys, "leaf").agg(
            *[F.array(*[fn(F.get("c", F.lit(i))) for i in range(tree.dims)]).alias(n) for fn, n in ((F.min, "lo"), (F.max, "hi"))], F.max("eps").alias("reach")
        )
        pairs = staged(near_cells(tree, leaves, starts, keys))

        def route(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(b):
                return _none([*keys, "id", "c", "eps", "leaf", "cnt"])
            c, eps = np.stack(q["c"].to_numpy()), q["eps"].to_numpy()
            lo, hi = _corners(b, c.shape[1])
            names, weight = b["other_b"].to_numpy(), b["wt_b"].to_numpy()
            who, where, whole = [], [], []
            step = max(1, CHUNK // len(b))
            for s in range(0, len(c), step):
                e = eps[s : s + step, None]
                near = _gaps(c[s : s + step], lo, hi) <= e * (1 + 1e-9) + 1e-300
                if below:
                    near &= lo[None, :, 0] <= c[s : s + step]
                inside = near & (not below or hi[None, :, 0] <= c[s : s + step]) & (np.maximum(_dist(c[s : s + step], lo, "chebyshev"), _dist(c[s : s + step], hi, "chebyshev")) < e)
                i, j = np.nonzero(near & ~inside)
                who.append(i + s)
                where.append(j)
                whole.append(inside @ weight)
            who, where, whole = np.concatenate(who), np.concatenate(where), np.concatenate(whole)
            cut = q.iloc[who][[*keys, "id", "c", "eps"]].assign(leaf=names[where], cnt=0)
            full = q[whole > 0][[*keys, "id", "c", "eps"]].assign(leaf=None, cnt=whole[whole > 0])
            return pd.concat([cut, full])

        asking = spread(ask, *keys, "leaf").groupBy(*keys, "leaf")
        routed = staged(asking.cogroup(_box_rows(pairs, leaves, keys)).applyInPandas(route, f"{kt}, id bigint, c array<double>, eps double, leaf string, cnt bigint"))
        visits = ask.unionByName(routed.filter("leaf IS NOT NULL").drop("cnt"))
        sure = routed.filter("leaf IS NULL").select(*keys, "id", "cnt")

    def count(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return _none([*keys, "id", "cnt"])
        qc, pc = np.stack(q["c"].to_numpy()), np.stack(p["c_p"].to_numpy())
        eps, w = q["eps"].to_numpy(), p["w_p"].to_numpy()
        if qc.shape[1] == 1:
            n = _count_1d(qc[:, 0], eps, pc[:, 0], w, below)
        else:
            step = max(1, CHUNK // len(p))
            out = []
            for s in range(0, len(q), step):
                d = _dist(qc[s : s + step], pc, "chebyshev")
                g = eps[s : s + step, None]
                out.append(((d < g) | ((g == 0) & (d == 0))) @ w)
            n = np.concatenate(out)
        return q[[*keys, "id"]].assign(cnt=n.astype("int64"))

    part = spread(visits, *keys, "leaf").groupBy(*keys, "leaf").cogroup(_held(held, keys)).applyInPandas(count, f"{kt}, id bigint, cnt bigint")
    part = part if sure is None else part.unionByName(sure)
    return part.groupBy(*keys, "id").agg(F.sum("cnt").alias("count"))


# -- mutual information -------------------------------------------------------------------


def _weighted(points: DataFrame, keys: list[str], cols: Sequence[str]) -> DataFrame:
    """Distinct points with their multiplicity and an id."""
    w = points.groupBy(*keys, *cols).agg(F.count(F.lit(1)).alias("w"), F.min("t").alias("id"))
    return w.select(*keys, "id", F.array(*[F.col(c) for c in cols]).alias("c"), "w")


def _sides(nn: DataFrame, keys: list[str], sides: dict[str, list[int]]) -> tuple[DataFrame, DataFrame]:
    """Marginal points and queries for several coordinate subsets at once, marked by ``side``."""
    cells = F.array(
        *[
            F.struct(F.lit(s).alias("side"), F.array(*[F.col("c")[i] for i in idx]).alias("c"))
            for s, idx in sides.items()
        ]
    )
    flat = nn.select(*keys, "id", "w", "eps", F.explode(cells).alias("m")).select(*keys, "m.side", "id", "w", "eps", "m.c")
    pts = flat.groupBy(*keys, "side", "c").agg(F.sum("w").alias("w"))
    return pts, flat.select(*keys, "side", "id", "c", "eps")


def _counts(nn: DataFrame, keys: list[str], sides: dict[str, list[int]], cell: int) -> DataFrame:
    pts, qs = _sides(nn, keys, sides)
    # along one coordinate a cell is counted by searches in its sorted values, so it may be larger
    wide = SORTED if all(len(idx) == 1 for idx in sides.values()) else 1
    c = ball_counts(pts, qs, [*keys, "side"], wide * cell)
    wide = c.groupBy(*keys, "id").agg(*[F.max(F.when(F.col("side") == s, F.col("count"))).alias(f"n_{s}") for s in sides])
    return nn.select(*keys, "id", "w").join(wide, [*keys, "id"])


def mutual_information(points: DataFrame, keys: Sequence[str] = PAIR, k: int = K, cell: int = CELL) -> DataFrame:
    """KSG mutual information (nats) per group of complete points; 0 with no more than k of them."""
    keys = list(keys)
    size = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    nn = nearest(_weighted(points, keys, ["x", "y"]), keys, k, "chebyshev", cell).filter("eps IS NOT NULL")
    c = _counts(nn, keys, {"x": [0], "y": [1]}, cell)
    # counts include the point itself, which is the +1 of the estimator
    m = c.groupBy(*keys).agg(
        F.sum(F.col("w") * (digamma_int(F.col("n_x")) + digamma_int(F.col("n_y")))).alias("s"), F.sum("w").alias("n")
    )
    value = digamma_int(F.col("n")) + digamma_int(F.lit(k)) - F.col("s") / F.col("n")
    ok = (F.col("total") > k) & (F.col("total") > 3)
    return size.join(m, keys, "left").select(
        *keys, F.when(ok, F.greatest(F.lit(0.0), value)).otherwise(F.lit(0.0)).alias("value")
    )


def conditional_information(
    points: DataFrame, controls: Sequence[str], keys: Sequence[str] = PAIR, k: int = K, cell: int = CELL
) -> DataFrame:
    """KSG conditional mutual information of x and y given the control columns."""
    keys, controls = list(keys), list(controls)
    size = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    nn = nearest(_weighted(points, keys, ["x", "y", *controls]), keys, k, "chebyshev", cell).filter("eps IS NOT NULL")
    z = list(range(2, 2 + len(controls)))
    c = _counts(nn, keys, {"xz": [0, *z], "yz": [1, *z], "z": z}, cell)
    term = digamma_int(F.col("n_xz")) + digamma_int(F.col("n_yz")) - digamma_int(F.col("n_z"))
    m = c.groupBy(*keys).agg((F.sum(F.col("w") * term) / F.sum("w")).alias("s"))
    value = F.greatest(F.lit(0.0), digamma_int(F.lit(k)) - F.col("s"))
    ok = (F.col("total") > k) & (F.col("total") > 3)
    return size.join(m, keys, "left").select(*keys, F.when(ok, value).otherwise(F.lit(0.0)).alias("value"))


def mutinf_full(panel: Panel, k: int = K, pairs=None) -> DataFrame:
    return mutual_information(panel.pair_points(False, pairs), k=k)


def mutinf_partial(panel: Panel, control: Sequence[str] | None = None, k: int = K, pairs=None) -> DataFrame:
    """Conditional MI of each pair given the controls (default: all other channels), listwise rows."""
    todo = panel.pair_list(False, pairs)
    widths: dict[int, list] = {}
    for a, b in todo:
        zs = [c for c in (panel.channels if control is None else control) if c in panel.channels and c not in (a, b)]
        widths.setdefault(len(zs), []).append((a, b, zs))
    out = None
    for width, items in sorted(widths.items()):
        cells = [
            F.struct(
                F.lit(a).alias("src"), F.lit(b).alias("dst"), panel.col(a).alias("x"), panel.col(b).alias("y"),
                *[panel.col(z).alias(f"z{i}") for i, z in enumerate(zs)],
            )
            for a, b, zs in items
        ]
        pts = panel.frame.select("t", F.explode(F.array(*cells)).alias("c")).select("t", "c.*").dropna()
        one = conditional_information(pts, [f"z{i}" for i in range(width)], k=k) if width else mutual_information(pts, k=k)
        out = one if out is None else out.unionByName(one)
    return out


# -- nearest-neighbour distance ratio -------------------------------------------------------


def _embed(frame: DataFrame, cols: Sequence[str], m: int, tau: int) -> DataFrame:
    """Complete rows renumbered, each column replaced by its delay vector."""
    full = frame.select("t", *[F.col(f"`{c}`") for c in cols]).dropna(how="any", subset=[f"`{c}`" for c in cols])
    pos = positions(full, [], "t", "pos").drop("t")

    def vectors(w):
        return {f"{c}#": F.array(F.col(f"`{c}`"), *[F.lead(F.col(f"`{c}`"), j * tau).over(w) for j in range(1, m)]) for c in cols}

    e = rolling(pos, [], "pos", vectors, after=(m - 1) * tau)
    return e.filter(F.col(f"`{cols[0]}#`")[m - 1].isNotNull()).select("pos", *[F.col(f"`{c}#`").alias(c) for c in cols])


def ah_ratio(
    frame: DataFrame, pairs: Sequence[tuple[str, str]], m: int = 3, tau: int = 1, cell: int = CELL
) -> DataFrame:
    """For column pairs (x, y): min(1, 1 / mean of d(Y_i, Y_nn_x(i)) / d1(Y_i)), nearest other state, smallest index on ties."""
    cols = list(dict.fromkeys([c for p in pairs for c in p]))
    states = _embed(frame, cols, m, tau)
    cells = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"`{c}`").alias("c")) for c in cols])
    pts = states.select("pos", F.explode(cells).alias("s")).select("s.channel", F.col("pos").alias("id"), "s.c", F.lit(1).cast("bigint").alias("w"))
    nn = nearest(pts, ["channel"], 1, "euclidean", cell)
    wide = nn.groupBy("id").agg(
        *[F.max(F.when(F.col("channel") == c, F.col("nn"))).alias(f"{c}#nn") for c in cols],
        *[F.max(F.when(F.col("channel") == c, F.col("eps"))).alias(f"{c}#d") for c in cols],
    ).withColumnRenamed("id", "pos")
    here = states.join(wide, "pos")
    xs = list(dict.fromkeys(x for x, _ in pairs))
    ys = list(dict.fromkeys(y for _, y in pairs))
    y_state = F.struct(*[F.col(f"`{c}`").alias(c) for c in ys])
    d1 = F.struct(*[F.col(f"`{c}#d`").alias(c) for c in ys])
    src = F.explode(F.array(*[F.struct(F.lit(c).alias("x"), F.col(f"`{c}#nn`").alias("j")) for c in xs]))
    left = here.select(y_state.alias("yi"), d1.alias("d1"), src.alias("s")).select("yi", "d1", F.col("s.x").alias("x"), F.col("s.j").alias("j"))
    there = states.select(F.col("pos").alias("j"), y_state.alias("yj"))
    both = left.join(there, "j")

    def ratio(y: str) -> Column:
        sq = F.aggregate(
            F.zip_with(F.col("yi")[y], F.col("yj")[y], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v
        )
        near = F.col("d1")[y]
        return F.sqrt(sq) / F.when(near == 0, F.lit(1e-10)).otherwise(near)

    allowed = {}
    for x, y in pairs:
        allowed.setdefault(y, []).append(x)
    out = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.when(F.col("x").isin(allowed[y]), ratio(y)).alias("r")) for y in ys]))
    r = both.select("x", out.alias("o")).select("x", "o.y", "o.r").filter("r IS NOT NULL")
    h = r.groupBy("x", "y").agg(F.avg("r").alias("h"))
    return h.select(
        F.col("x").alias("src"), F.col("y").alias("dst"),
        F.when(F.col("h") > 0, F.least(F.lit(1.0), 1.0 / F.col("h"))).otherwise(F.lit(0.0)).alias("value"),
    )


def ah_full(panel: Panel, m: int = 3, tau: int = 1, pairs=None) -> DataFrame:
    """Rows complete over all channels; direction src -> dst."""
    frame = panel.frame.dropna(how="any", subset=list(panel.channels))
    return ah_ratio(frame, panel.pair_list(True, pairs), m, tau)


def ah_directed(panel: Panel, lag: int = 1, m: int = 3, tau: int = 1, pairs=None) -> DataFrame:
    """src at t against dst at t+lag, rows complete over both copies of every channel."""
    lag = max(1, int(lag))
    frame = panel.shifted([lag])
    frame = frame.dropna(how="any", subset=[f"`{c}`" for c in frame.columns if c != "t"])
    todo = [(a, f"{b}@{lag}") for a, b in panel.pair_list(True, pairs)]
    return ah_ratio(frame, todo, m, tau).withColumn("dst", F.regexp_replace("dst", f"@{lag}$", ""))


def ah_partial(panel: Panel, lag: int = 1, control: Sequence[str] | None = None, m: int = 3, tau: int = 1, pairs=None) -> DataFrame:
    """The ratio on residuals: on the controls if given, else of a vector autoregression."""
    chans = list(panel.channels)
    full = panel.with_frame(panel.frame.dropna(how="any", subset=chans))
    if control:
        res = residualize(full, control)
        keep = [c for c in chans if c not in control]
        return ah_full(res.select(keep), m, tau, pairs)
    return ah_full(var_residuals(full, lag), m, tau, pairs)


def var_residuals(panel: Panel, lag: int) -> Panel:
    """Residuals of a VAR(lag) over gap-closed complete rows; the first ``lag`` rows drop out."""
    chans = list(panel.channels)
    lag = max(1, int(lag))
    pos = positions(panel.frame, [], "t", "pos").drop("t")

    def past(w):
        return {f"{c}~{k}": F.lag(F.col(f"`{c}`"), k).over(w) for c in chans for k in range(1, lag + 1)}

    d = rolling(pos, [], "pos", past, before=lag)
    reg = [F.col(f"`{c}~{k}`") for k in range(1, lag + 1) for c in chans]
    n, means, g = gram(d, [*[F.col(f"`{c}`") for c in chans], *reg])
    if n <= len(reg) + 1:
        return panel
    cols = []
    for i, c in enumerate(chans):
        b0, beta, _ = solve_ols(n, means, g, i, range(len(chans), len(chans) + len(reg)))
        cols.append(linear_residual(F.col(f"`{c}`"), b0, beta, reg).alias(c))
    out = d.filter(F.col("pos") >= lag).select(F.col("pos").alias("t"), *cols)
    return panel.with_frame(out)


# -- sample entropy -------------------------------------------------------------------------


def value_windows(values: DataFrame, eps: DataFrame, keys: Sequence[str], cell: int = CELL) -> DataFrame:
    """``keys, value, r, lo, hi``: for each distinct value its rank from 0, and the ranks [lo, hi) of values closer than ``eps``."""
    keys = list(keys)
    ranks = staged(value_ranks(values, keys, "value").select(*keys, "value", (F.col("dense") - 1).alias("r")))
    pts = ranks.select(*keys, F.array("value").alias("c"), F.lit(1).cast("bigint").alias("w"))
    asked = ranks.join(eps, keys).select(*keys, F.col("r").alias("id"), F.array("value").alias("c"), "eps")
    under = ball_counts(pts, asked, keys, SORTED * cell, below=True).withColumnRenamed("count", "under")
    both = ball_counts(pts, asked, keys, SORTED * cell).join(under, [*keys, "id"]).withColumnRenamed("id", "r")
    return ranks.join(both, [*keys, "r"]).select(*keys, "value", "r", (F.col("r") + 1 - F.col("under")).alias("lo"), (F.col("r") + 1 + F.col("count") - F.col("under")).alias("hi"))


def _node(level: int, at: Column) -> Column:
    """Number of the merge tree's node that covers the 2^level ranks from at * 2^level on."""
    return F.lit(level).cast("bigint") * (1 << 48) + at


def _above(r: Column, levels: int) -> Column:
    """All nodes over a rank."""
    return F.array(*[_node(k, F.shiftright(r, k)) for k in range(levels)])


def _covering(lo: Column, hi: Column, levels: int) -> Column:
    """The fewest nodes that make up the ranks [lo, hi): two a level at most."""
    parts = []
    for k in range(levels):
        a, b = F.shiftright(lo + ((1 << k) - 1), k), F.shiftright(hi, k)
        odd = lambda c: F.pmod(c, F.lit(2)) == 1
        parts.append(F.when((a < b) & odd(a), _node(k, a)))
        parts.append(F.when((a + F.pmod(a, F.lit(2)) < b) & odd(b), _node(k, b - 1)))
    return F.array_compact(F.array(*parts))


def box_matches(templates: DataFrame, keys: Sequence[str], dims: int, levels: int) -> DataFrame:
    """``keys, total``: ordered pairs of templates (w copies each) whose ranks lie in each other's windows, pairs of copies included.

    ``templates``: keys, w, and ``r0, lo0, hi0`` and so on.  All coordinates but the last are nodes of merge
    trees: a template stands in every node over its rank, and asks the few nodes that make up its window.
    Within a node the last coordinate is a running total, read at both ends of each window.
    """
    keys = list(keys)
    stand, ask = templates, templates
    nodes = []
    for d in range(dims - 1):
        nodes.append(f"n{d}")
        stand = stand.withColumn(f"n{d}", F.explode(_above(F.col(f"r{d}"), levels)))
        ask = ask.withColumn(f"n{d}", F.explode(_covering(F.col(f"lo{d}"), F.col(f"hi{d}"), levels)))
    last = dims - 1
    zero = F.lit(0).cast("bigint")
    ends = F.explode(F.array(F.struct((F.col(f"hi{last}") * 2).alias("at"), F.col("w").alias("asked")), F.struct((F.col(f"lo{last}") * 2).alias("at"), (-F.col("w")).alias("asked"))))
    there = stand.select(*keys, *nodes, (F.col(f"r{last}") * 2 + 1).alias("at"), F.col("w").alias("held"), zero.alias("asked"))
    events = there.unionByName(ask.select(*keys, *nodes, ends.alias("e")).select(*keys, *nodes, "e.at", zero.alias("held"), "e.asked"))
    # equal places of a node are one row, whatever share of the templates has them
    events = staged(events.groupBy(*keys, *nodes, "at").agg(F.sum("held").alias("held"), F.sum("asked").alias("asked")))
    run = running_sum(events, [*keys, *nodes], "at", "held", "below")
    return run.filter("asked <> 0").groupBy(*keys).agg(F.sum(F.col("asked") * F.col("below").cast("decimal(38,0)")).alias("total"))


def sample_entropy(long: DataFrame, m: int = 2, tolerance: float | None = None, keys: Sequence[str] = ("channel",), cell: int = CELL) -> DataFrame:
    """-ln(A/B) of template matches of length m+1 and m (strictly closer than the tolerance).

    The default tolerance is the sample deviation times 0.1164 (0.5627 ln m + 1.3334), about .2.  Matches are
    counted, never visited, so many of them cost no more than few.
    """
    keys = list(keys)
    factor = 0.1164 * (0.5627 * math.log(m) + 1.3334)
    data = staged(long.filter("value IS NOT NULL").select(*keys, "t", F.col("value").cast("double").alias("value")))
    p = positions(data, keys, "t", "pos")
    tol = F.lit(float(tolerance)) if tolerance is not None else F.stddev_samp("value") * factor
    s = data.groupBy(*keys).agg(tol.alias("eps"), F.count("value").alias("n"), F.stddev_pop("value").alias("sd"))
    windows = staged(value_windows(data, s.select(*keys, "eps"), keys, cell))
    most = windows.agg(F.max("r")).first()[0] or 0
    levels = int(most + 1).bit_length()
    placed = staged(p.join(windows, [*keys, "value"]).select(*keys, "pos", F.struct("r", "lo", "hi").alias("x")))

    def vectors(w):
        return {f"x{j}": F.lead("x", j).over(w) for j in range(1, m + 1)}

    e = rolling(placed, keys, "pos", vectors, after=m).withColumnRenamed("x", "x0").filter(F.col(f"x{m}").isNotNull())
    total = None
    for side, dims in (("a", m + 1), ("b", m)):
        same = e.groupBy(*keys, *[f"x{j}" for j in range(dims)]).agg(F.count(F.lit(1)).cast("bigint").alias("w"))
        flat = same.select(*keys, "w", *[F.col(f"x{j}.{c}").alias(f"{c}{j}") for j in range(dims) for c in ("r", "lo", "hi")])
        one = box_matches(flat, keys, dims, levels).withColumnRenamed("total", side)
        total = one if total is None else total.join(one, keys)
    size = e.groupBy(*keys).agg(F.count(F.lit(1)).alias("templates"))
    ab = total.join(size, keys).select(*keys, *[(F.col(c) - F.col("templates")).cast("double").alias(c) for c in ("a", "b")])
    ok = (F.col("n") >= 20) & (F.col("sd") >= 1e-10) & (F.col("a") > 0) & (F.col("b") > 0)
    return s.join(ab, keys, "left").select(*keys, F.when(ok, -F.ln(F.col("a") / F.col("b"))).alias("value"))

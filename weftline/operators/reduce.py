"""Fewer channels: selection, spatial bins, principal components, clusters.

Every method returns the reduced panel and its linear mapping ``source, target, weight``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import clean
from weftline.operators.moments import gram, gram_sets
from weftline.panel import Panel


GRAM_ROWS = 4096


@dataclass(frozen=True)
class Reduced:
    panel: Panel
    mapping: DataFrame
    meta: dict = field(default_factory=dict)


def _mapping(panel: Panel, rows: Sequence[tuple[str, str, float]]) -> DataFrame:
    return panel.frame.sparkSession.createDataFrame(list(rows), "source string, target string, weight double")


def select_channels(panel: Panel, k: int, by: str = "variance", seed: int = 0) -> Reduced:
    kept = [r.channel for r in clean.top_channels(panel.long(), k, by, seed).select("channel").collect()]
    kept = [c for c in panel.channels if c in set(kept)]
    return Reduced(panel.select(kept), _mapping(panel, [(c, c, 1.0) for c in kept]), {"method": by, "k": len(kept)})


def combine(panel: Panel, mapping: DataFrame) -> DataFrame:
    """Long form of a linear mapping: sum of weight * value per (t, target); missing cells are skipped and reweighted."""
    j = panel.long().filter("value IS NOT NULL").join(mapping.withColumnRenamed("source", "channel"), "channel")
    total = F.sum(F.abs("weight"))
    return j.groupBy("t", F.col("target").alias("channel")).agg((F.sum(F.col("value") * F.col("weight")) / total).alias("value"))


def _group_mean(panel: Panel, groups: dict[str, list[str]], meta: dict) -> Reduced:
    """Mean over the channels of each group, as a narrow projection of the wide panel."""

    def mean(cols: list[str]) -> Column:
        total = sum((F.coalesce(panel.col(c), F.lit(0.0)) for c in cols), F.lit(0.0))
        n = sum((panel.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
        return total / F.when(n > 0, n)

    frame = panel.frame.select("t", *[mean(cols).alias(g) for g, cols in groups.items()])
    rows = [(c, g, 1.0 / len(cols)) for g, cols in groups.items() for c in cols]
    return Reduced(panel.with_frame(frame, list(groups)), _mapping(panel, rows), {**meta, "k": len(groups)})


def spatial_groups(coords: DataFrame, bin_size: int = 2) -> DataFrame:
    """``channel, target``: channels sharing a cell of ``bin_size``; cells are numbered in key order."""
    cell = [F.floor(F.col(c) / max(1, int(bin_size))).alias(f"b{c}") for c in "xyz"]
    keyed = coords.select("channel", *cell).filter("bx IS NOT NULL AND by IS NOT NULL AND bz IS NOT NULL")
    bins = keyed.select("bx", "by", "bz").distinct().withColumn("_g", F.lit(1))
    number = F.row_number().over(Window.partitionBy("_g").orderBy("bx", "by", "bz")) - 1
    named = bins.withColumn("target", F.format_string("bin_%04d", number)).drop("_g")
    return keyed.join(named, ["bx", "by", "bz"]).select("channel", "target")


def spatial(panel: Panel, coords: DataFrame, k: int | None = None, bin_size: int = 2) -> Reduced:
    rows = spatial_groups(coords, bin_size).collect()  # one row per channel column
    groups: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.target, panel.channels.index(r.channel) if r.channel in panel.channels else -1)):
        if r.channel in panel.channels:
            groups.setdefault(r.target, []).append(r.channel)
    out = _group_mean(panel, groups, {"method": "spatial", "bin_size": bin_size})
    if k is not None and len(groups) > k:
        kept = select_channels(out.panel, k).panel
        m = out.mapping.filter(F.col("target").isin(list(kept.channels)))
        return Reduced(kept, m, {**out.meta, "k": k})
    return out


def choose_k(eigenvalues: np.ndarray, n_features: int, target_n: int | None, target_var: float | None, priority: str = "auto") -> int:
    """Components to keep: enough for ``target_var``, or ``target_n``, or at most 10."""
    tv = target_var if target_var is not None and 0 < target_var <= 1 else None
    tn = target_n if target_n and target_n > 0 else None
    by_var = priority == "explained_variance" or (priority == "auto" and tv is not None)
    total = float(np.sum(eigenvalues))
    if by_var and tv is not None and total > 0:
        k = int(np.searchsorted(np.cumsum(eigenvalues / total), tv, side="left")) + 1
    elif by_var and total <= 0 and tn is None:
        k = 1
    else:
        k = tn if tn is not None else min(10, n_features)
    return max(1, min(k, n_features))


def standardized(panel: Panel) -> Panel:
    """Missing cells as 0, then zero mean and unit deviation (ddof 0) per channel."""
    row = panel.frame.agg(
        *[F.avg(F.coalesce(panel.col(c), F.lit(0.0))) for c in panel.channels],
        *[F.stddev_pop(F.coalesce(panel.col(c), F.lit(0.0))) for c in panel.channels],
    ).first()
    n = len(panel.channels)
    cols = []
    for i, c in enumerate(panel.channels):
        m, s = float(row[i] or 0.0), float(row[n + i] or 0.0)
        cols.append(((F.coalesce(panel.col(c), F.lit(0.0)) - F.lit(m)) / F.lit(s or 1.0)).alias(c))
    return panel.with_frame(panel.frame.select("t", *cols))


def _fixed_sign(v: np.ndarray) -> np.ndarray:
    """Each row's largest entry by size is positive."""
    at = np.abs(v).argmax(axis=1)
    return v * np.where(v[np.arange(len(v)), at] < 0, -1.0, 1.0)[:, None]


def truncate_mapping(mapping: DataFrame, top_k: int | None = None, min_abs: float | None = None) -> DataFrame:
    out = mapping
    if top_k:
        w = Window.partitionBy("target").orderBy(F.desc(F.abs("weight")), "source")
        out = out.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top_k).drop("_r")
    if min_abs is not None and min_abs >= 0:
        out = out.filter(F.abs("weight") >= min_abs)
    return out


def pca(
    panel: Panel, target_n: int | None = None, target_var: float | None = None, priority: str = "auto",
    mapping_topk: int | None = None, mapping_min_abs: float | None = None,
) -> Reduced:
    """Principal components of the standardised panel.

    Only the N x N Gram matrix (an aggregate) is decomposed on the driver; scores are a narrow
    projection.  Signs are fixed so that the largest weight of a component is positive.
    """
    z = standardized(panel)
    names = list(panel.channels)
    n, mean, g = gram_sets(z.frame, [z.col(c) for c in names], [range(len(names))])[0]
    val, vec = np.linalg.eigh(g)
    val, vec = np.clip(val[::-1], 0, None), vec[:, ::-1].T
    room = max(1, min(n, len(names)))
    k = choose_k(val, room, target_n, target_var, priority)
    comps = _fixed_sign(vec[:k])
    targets = [f"pc_{i + 1:04d}" for i in range(k)]
    x = F.array(*[z.col(c) for c in names])
    # one array product per component keeps the expression small
    cols = [
        F.aggregate(F.zip_with(x, F.lit([float(w) for w in comps[i]]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b).alias(t)
        for i, t in enumerate(targets)
    ]
    rows = [(c, t, float(comps[i, j])) for i, t in enumerate(targets) for j, c in enumerate(names)]
    share = (val / val.sum()).tolist() if val.sum() > 0 else []
    meta = {"method": "pca", "solver": "full", "k": k, "explained_var_top": share[:k], "explained_var": sum(share[:k])}
    mapping = truncate_mapping(_mapping(panel, rows), mapping_topk, mapping_min_abs)
    return Reduced(panel.with_frame(z.frame.select("t", *cols), targets), mapping, meta)


def pca_gram(long: DataFrame, length: int, target_n: int | None = None, target_var: float | None = None, priority: str = "auto"):
    """Components when channels far outnumber positions: scores and mapping in long form.

    Rows of the transposed panel are channels, so the Gram matrix is T x T and channels stay
    distributed.  Returns (scores ``t, channel, value``; mapping ``source, target, weight``; meta).
    """
    if length > GRAM_ROWS:
        raise ValueError(f"the time-side matrix takes at most {GRAM_ROWS} positions; use pca, which takes any number")
    stats = long.groupBy("channel").agg(
        F.avg(F.coalesce("value", F.lit(0.0))).alias("m"), F.stddev_pop(F.coalesce("value", F.lit(0.0))).alias("s")
    )
    z = long.join(stats, "channel").select(
        "channel", "t", ((F.coalesce("value", F.lit(0.0)) - F.col("m")) / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)).alias("z")
    )
    times = [f"t{i}" for i in range(length)]
    wide = z.groupBy("channel").agg(*[F.max(F.when(F.col("t") == i, F.col("z"))).alias(c) for i, c in enumerate(times)])
    n, mean, g = gram_sets(wide, [F.col(c) for c in times], [range(length)])[0]
    val, u = np.linalg.eigh(g + n * np.outer(mean, mean))
    val, u = np.clip(val[::-1], 0, None), u[:, ::-1]
    k = choose_k(val, max(1, min(n, length)), target_n, target_var, priority)
    u = _fixed_sign(u[:, :k].T).T
    s = np.sqrt(val[:k])
    spark = long.sparkSession
    scores = spark.createDataFrame(
        [(t, f"pc_{i + 1:04d}", float(u[t, i] * s[i])) for t in range(length) for i in range(k)], "t bigint, channel string, value double"
    )
    x = F.array(*[F.col(c) for c in times])
    weight = [
        F.aggregate(F.zip_with(x, F.lit([float(w) for w in u[:, i]]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) / F.lit(float(s[i] or 1.0))
        for i in range(k)
    ]
    cells = F.array(*[F.struct(F.lit(f"pc_{i + 1:04d}").alias("target"), w.alias("weight")) for i, w in enumerate(weight)])
    mapping = wide.select(F.col("channel").alias("source"), F.explode(cells).alias("c")).select("source", "c.target", "c.weight")
    share = (val / val.sum()).tolist() if val.sum() > 0 else []
    return scores, mapping, {"method": "pca", "solver": "gram", "k": k, "explained_var_top": share[:k]}


def kmeans(panel: Panel, k: int, seed: int = 0) -> Reduced:
    """Clusters of similar channels replaced by their means.

    Distances between channels follow from their products over all rows (missing cells count as 0),
    one channel by channel aggregate; its square root places each channel exactly.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if k >= len(panel.channels):
        return Reduced(panel, _mapping(panel, [(c, c, 1.0) for c in panel.channels]), {"method": "kmeans", "k": len(panel.channels)})
    n, means, g = gram(panel.frame, [F.coalesce(panel.col(c), F.lit(0.0)) for c in panel.channels])
    val, vec = np.linalg.eigh(g + n * np.outer(means, means))
    places = vec * np.sqrt(np.maximum(val, 0.0))
    rows = [(c, [float(x) for x in p]) for c, p in zip(panel.channels, places)]
    data = panel.frame.sparkSession.createDataFrame(rows, "channel string, p array<double>").select("channel", array_to_vector(F.col("p")).alias("features"))
    labels = KMeans(k=k, seed=seed, featuresCol="features").fit(data).transform(data).select("channel", "prediction").collect()
    groups: dict[str, list[str]] = {}
    for c in panel.channels:
        at = next(r.prediction for r in labels if r.channel == c)
        groups.setdefault(f"cluster_{at:04d}", []).append(c)
    return _group_mean(panel, dict(sorted(groups.items())), {"method": "kmeans", "seed": seed})


def reduce_channels(panel: Panel, method: str = "variance", target_n: int | None = None, coords: DataFrame | None = None, seed: int = 0, **args) -> Reduced:
    k = max(1, min(target_n or len(panel.channels), len(panel.channels)))
    if method in ("variance", "random"):
        return select_channels(panel, k, method, seed)
    if method == "spatial":
        if coords is None:
            raise ValueError("spatial reduction needs coordinates")
        return spatial(panel, coords, k, args.get("bin_size", 2))
    if method == "kmeans":
        return kmeans(panel, k, seed)
    if method in ("pca", "pca_full", "pca_gram", "pca_randomized"):
        return pca(panel, target_n, **args)
    raise ValueError(f"unknown reduction {method!r}")

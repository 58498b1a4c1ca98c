"""Counting metrics: transfer entropy, ordinal mutual information, entropies.

All are grouped counts of small integer codes.  Series are closed up over gaps first, as
the reference semantics ask, with block-wise position numbers.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.blocks import positions, rolling
from weftline.functions.quantiles import quantiles
from weftline.panel import Panel

PAIR = ["src", "dst"]
BINS = 8


def bin_edges(names: Sequence[str]) -> Column:
    """Inner edges from quantile columns: distinct, without the outer two; none if two or fewer."""
    distinct = F.array_sort(F.array_distinct(F.array(*names)))
    return F.when(F.size(distinct) > 2, F.slice(distinct, 2, F.size(distinct) - 2)).otherwise(
        F.array().cast("array<double>")
    )


def code_of(value: Column, edges: Column) -> Column:
    """Number of inner edges at or below the value (a value on an edge goes up)."""
    return F.size(F.filter(edges, lambda e: e <= value))


def quantile_grid(bins: int) -> dict[str, float]:
    return {f"_e{i}": i / bins for i in range(bins + 1)}


def pair_codes(points: DataFrame, keys: Sequence[str], bins: int = BINS, bounded: bool = False) -> DataFrame:
    """Equal-frequency bins ``sx, sy`` of both series of each pair (one quantile pass for both)."""
    keys = list(keys)
    sides = points.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.lit("x").alias("s"), F.col("x").alias("v")),
                F.struct(F.lit("y").alias("s"), F.col("y").alias("v")),
            )
        ).alias("p"),
    ).select(*keys, "p.s", "p.v")
    grid = quantile_grid(bins)
    edges = quantiles(sides, [*keys, "s"], "v", grid, bounded).select(*keys, "s", bin_edges(list(grid)).alias("e"))
    both = edges.groupBy(*keys).agg(
        F.max(F.when(F.col("s") == "x", F.col("e"))).alias("_ex"),
        F.max(F.when(F.col("s") == "y", F.col("e"))).alias("_ey"),
    )
    return (
        points.join(both, keys)
        .withColumn("sx", code_of(F.col("x"), F.col("_ex")))
        .withColumn("sy", code_of(F.col("y"), F.col("_ey")))
        .drop("_ex", "_ey")
    )


def channel_codes(panel: Panel, bins: int = BINS) -> DataFrame:
    """Codes of every channel of a panel without gaps: edges are computed once per channel.

    The edges (a few numbers per channel column) become literals of a narrow projection.
    """
    grid = quantile_grid(bins)
    rows = quantiles(panel.long(), ["channel"], "value", grid).select("channel", bin_edges(list(grid)).alias("e")).collect()
    edges = {r.channel: r.e for r in rows}
    empty = F.array().cast("array<double>")
    return panel.frame.select(
        "t",
        *[
            code_of(panel.col(c), F.array(*[F.lit(v) for v in edges[c]]) if edges.get(c) else empty).alias(c)
            for c in panel.channels
        ],
    )


def _marginals(counts: DataFrame, keys: Sequence[str], marginals: dict[str, list[str]], bound: int | None) -> DataFrame:
    """Add the count of each marginal to the joint counts ``c``.

    When a group's joint table has a proven small size all sums share one partitioning by
    group; otherwise each sum is shuffled on its own key.
    """
    out = counts.repartition(*keys) if bound is not None and bound <= 1 << 20 else counts
    return out.select(
        "*", *[F.sum("c").over(Window.partitionBy(*keys, *cols)).alias(name) for name, cols in marginals.items()]
    )


def _history(codes: Sequence[Column], bins: int) -> Column:
    """One key for the last codes; NULL until the history is full."""
    if len(codes) * math.log2(bins + 1) <= 62:
        key = F.lit(0).cast("bigint")
        for c in codes:
            key = key * (bins + 1) + c
        return key
    return F.when(codes[-1].isNotNull(), F.concat_ws(",", *[c.cast("string") for c in codes]))


def _te_from_counts(joint: DataFrame, keys: Sequence[str], states: int) -> DataFrame:
    t = _marginals(joint, keys, {"c_yh": ["sy", "hy"], "c_hh": ["hy", "hx"], "c_h": ["hy"]}, states)
    c = F.col("c")
    term = c * F.log2((c / F.col("c_hh")) / (F.col("c_yh") / F.col("c_h")))
    return t.groupBy(*keys).agg((F.sum(term) / F.sum("c")).alias("value"))


def transfer_entropy(
    points: DataFrame, lag: int = 1, bins: int = BINS, keys: Sequence[str] = PAIR, bounded: bool = False
) -> DataFrame:
    """Directed transfer entropy x -> y in bits with histories of length ``lag``.

    Works on pairwise-complete points; ``keys`` may include window columns (``bounded`` then
    says that every group has at most a window of rows).
    """
    keys = list(keys)
    lag = max(1, int(lag))
    points = points.select(*keys, "t", "x", "y")
    p = positions(pair_codes(points, keys, bins, bounded), keys, "t", "pos", rows=points)

    def history(w):
        return {h: _history([F.lag(c, k).over(w) for k in range(1, lag + 1)], bins) for c, h in (("sx", "hx"), ("sy", "hy"))}

    h = rolling(p.select(*keys, "pos", "sx", "sy"), keys, "pos", history, before=lag).filter("hx IS NOT NULL")
    return _te_from_counts(h.groupBy(*keys, "sy", "hy", "hx").agg(F.count(F.lit(1)).alias("c")), keys, bins ** (2 * lag + 1))


def te_complete(panel: Panel, lag: int = 1, bins: int = BINS, pairs=None) -> DataFrame:
    """Transfer entropy of a panel without gaps.

    Codes and histories are made once per channel; each row then expands to its pairs inside
    the counting stage, so only counts are shuffled.
    """
    lag = max(1, int(lag))
    codes = channel_codes(panel, bins)
    q = panel.col

    def history(w):
        return {f"{c}@h": _history([F.lag(q(c), k).over(w) for k in range(1, lag + 1)], bins) for c in panel.channels}

    h = rolling(codes, [], "t", history, before=lag, size=panel.block)
    now = F.array(*[q(c) for c in panel.channels]).alias("s")
    past = F.array(*[F.col(f"`{c}@h`") for c in panel.channels]).alias("h")
    index = panel.pair_index([(a, b, 0) for a, b in panel.pair_list(True, pairs)])
    flat = h.select(now, past, F.explode(index).alias("c")).select(
        "c.src", "c.dst", F.get("s", F.col("c.j")).alias("sy"), F.get("h", F.col("c.j")).alias("hy"), F.get("h", F.col("c.i")).alias("hx")
    ).filter("hx IS NOT NULL AND hy IS NOT NULL")
    return _te_from_counts(flat.groupBy("src", "dst", "sy", "hy", "hx").agg(F.count(F.lit(1)).alias("c")), PAIR, bins ** (2 * lag + 1))


def ordinal_code(values: Sequence[Column]) -> Column:
    """Rank pattern of the values as base-``order`` digits; equal values rank in time order."""
    m = len(values)
    code = F.lit(0)
    for i, v in enumerate(values):
        rank = F.lit(0)
        for j, u in enumerate(values):
            if j < i:
                rank = rank + (u <= v).cast("int")
            elif j > i:
                rank = rank + (u < v).cast("int")
        code = code * m + rank
    return code


def ordinal_mi(
    points: DataFrame, order: int = 3, delay: int = 1, keys: Sequence[str] = PAIR, min_n: int = 20
) -> DataFrame:
    """Mutual information (bits) of ordinal patterns of x and y; 0 below ``min_n`` patterns."""
    keys = list(keys)
    reach = (order - 1) * delay
    p = positions(points.select(*keys, "t", "x", "y"), keys, "t", "pos")

    def embed(w):
        out = {}
        for c in ("x", "y"):
            vals = [F.col(c), *[F.lead(c, k * delay).over(w) for k in range(1, order)]]
            out["o" + c] = F.when(vals[-1].isNotNull(), ordinal_code(vals))
        return out

    e = rolling(p, keys, "pos", embed, after=reach).filter("ox IS NOT NULL")
    joint = e.groupBy(*keys, "ox", "oy").agg(F.count(F.lit(1)).alias("c"))
    t = _marginals(joint, keys, {"cx": ["ox"], "cy": ["oy"], "n": []}, math.factorial(order) ** 2)
    term = F.col("c") / F.col("n") * F.log2(F.col("c") * F.col("n") / (F.col("cx") * F.col("cy")))
    mi = F.greatest(F.lit(0.0), F.sum(term))
    return t.groupBy(*keys).agg(F.when(F.max("n") >= min_n, mi).otherwise(F.lit(0.0)).alias("value"))


def shannon_entropy(long: DataFrame, bins: int = 32, keys: Sequence[str] = ("channel",)) -> DataFrame:
    """Entropy (bits) of an equal-width histogram with max(4, min(bins, n//2)) bins."""
    keys = list(keys)
    data = long.filter("value IS NOT NULL")
    s = data.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("n"))
    s = s.withColumn("b", F.greatest(F.lit(4), F.least(F.lit(bins), F.floor(F.col("n") / 2))))
    lo = F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo"))
    hi = F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi"))
    cell = F.least(F.floor((F.col("value") - lo) / (hi - lo) * F.col("b")), F.col("b") - 1)
    h = data.join(s, keys).groupBy(*keys, "n", cell.alias("cell")).agg(F.count(F.lit(1)).alias("c"))
    p = F.col("c") / (F.col("n") + 1e-12)
    return h.groupBy(*keys).agg(F.when(F.max("n") >= 10, -F.sum(p * F.log2(p))).alias("value"))


def permutation_entropy(
    long: DataFrame, order: int = 3, delay: int = 1, normalize: bool = True, keys: Sequence[str] = ("channel",)
) -> DataFrame:
    """Bandt-Pompe entropy of gap-closed values."""
    keys = list(keys)
    reach = (order - 1) * delay
    p = positions(long.filter("value IS NOT NULL"), keys, "t", "pos")

    def embed(w):
        vals = [F.col("value"), *[F.lead("value", k * delay).over(w) for k in range(1, order)]]
        return {"code": F.when(vals[-1].isNotNull(), ordinal_code(vals))}

    e = rolling(p, keys, "pos", embed, after=reach).filter("code IS NOT NULL")
    c = e.groupBy(*keys, "code").agg(F.count(F.lit(1)).alias("c"))
    q = F.col("c") / (F.col("n") + 1e-12)
    h = -F.sum(q * F.log2(q + 1e-12))
    if normalize:
        h = h / (math.log2(math.factorial(order)) + 1e-12)
    enough = F.max("n") + reach >= reach + order + 1
    return _marginals(c, keys, {"n": []}, math.factorial(order)).groupBy(*keys).agg(F.when(enough, h).alias("value"))


def te_full(panel: Panel, lag: int = 1, bins: int = BINS, pairs=None) -> DataFrame:
    if panel.complete:
        return te_complete(panel, lag, bins, pairs)
    return transfer_entropy(panel.pair_points(True, pairs), lag, bins)


def ordinal_full(panel: Panel, order: int = 3, delay: int = 1, pairs=None) -> DataFrame:
    return ordinal_mi(panel.pair_points(False, pairs), order, delay)


def ordinal_directed(panel: Panel, lag: int = 1, order: int = 3, delay: int = 1, pairs=None) -> DataFrame:
    return ordinal_mi(panel.pair_points(True, pairs, [max(1, lag)]), order, delay)

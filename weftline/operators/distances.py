"""Distance correlation of any number of points, exactly, without forming point pairs.

For one-dimensional x and y every sum over point pairs reduces to sorted prefix sums and
to C = sum over concordant pairs of (xj-xi)(yj-yi).  Points are cut into strips of bounded
size along x and along y.  C splits into pairs in the same x strip (sorted inside one
task), pairs in the same y strip but different x strips (likewise), and pairs whose strips
differ on both axes (from per-cell totals).  Heavy repeated values form strips of their
own, whose inner pairs contribute nothing, so they can be split freely.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.strips import add_splitters, strip_code
from weftline.operators.moments import residual_points
from weftline.panel import Panel
from weftline.session import spread

PAIR = ["src", "dst"]
STRIP = 65536


def concordant(x: np.ndarray, y: np.ndarray, level: np.ndarray | None = None) -> float:
    """Sum of (xj-xi)(yj-yi) over pairs with both differences positive, by merging runs.

    With ``level`` only pairs whose levels differ count (levels must follow the order of x).
    """
    m = len(x)
    if m < 2:
        return 0.0
    first = np.lexsort((y, x)) if level is None else np.lexsort((y, x, level))
    x, y = x[first], y[first]
    run = np.arange(m) if level is None else np.unique(level[first], return_inverse=True)[1]
    by_y = np.argsort(y, kind="stable")
    total = 0.0
    shift = 0
    while (run[-1] >> shift) > 0:
        block = run >> (shift + 1)
        left = ((run >> shift) & 1) == 0
        order = by_y[np.argsort(block[by_y], kind="stable")]
        lo, b = left[order], block[order]
        xs, ys = x[order], y[order]
        start = np.searchsorted(b, b, side="left")

        def below(w, lo=lo, start=start):
            c = np.concatenate([[0.0], np.cumsum(np.where(lo, w, 0.0))])
            return c[:-1] - c[start]

        n, sx, sy, sxy = below(np.ones(m)), below(xs), below(ys), below(xs * ys)
        hi = ~lo
        total += float(np.sum((xs * ys * n - xs * sy - ys * sx + sxy)[hi]))
        shift += 1
    return total


def _offsets(points: DataFrame, keys: list[str], strip: str, value: str, n: str, s: str, total: str) -> DataFrame:
    """Per strip: how many points lie below it and their sum, and the sum of all points."""
    sums = points.groupBy(*keys, strip).agg(F.count(F.lit(1)).alias("_c"), F.sum(value).alias("_s"))
    w = Window.partitionBy(*keys).orderBy(strip).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(
        *keys,
        strip,
        F.coalesce(F.sum("_c").over(w), F.lit(0)).alias(n),
        F.coalesce(F.sum("_s").over(w), F.lit(0.0)).alias(s),
        F.sum("_s").over(Window.partitionBy(*keys)).alias(total),
    )


def _row_sums(v: np.ndarray, n: float, below_n: float, below_s: float, total: float) -> np.ndarray:
    """Sum of |v_i - v_j| over all j, from ranks inside the strip and totals below it."""
    order = np.argsort(v, kind="stable")
    out = np.empty(len(v))
    vs = v[order]
    rank = below_n + np.arange(len(v))
    prefix = below_s + np.concatenate([[0.0], np.cumsum(vs)[:-1]])
    out[order] = vs * (2 * rank - n) + total - 2 * prefix
    return out


def dcor_points(points: DataFrame, keys: Sequence[str] = PAIR, min_n: int = 8, strip: int = STRIP) -> DataFrame:
    """Distance correlation per group of complete (x, y) points; 0 below ``min_n`` points."""
    keys = list(keys)
    centre = points.groupBy(*keys).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    base = points.join(centre, keys).select(
        *keys, "t", (F.col("x") - F.col("_mx")).alias("x"), (F.col("y") - F.col("_my")).alias("y")
    )
    cut = add_splitters(base, keys, ["x", "y"], strip)
    cut = cut.select(*keys, "t", "x", "y", "n", strip_code("x").alias("bx"), strip_code("y").alias("by"))
    # pieces of heavy-value strips share no inner work, so spread them over tasks
    parts = F.ceil(F.col("n") / strip)
    cut = cut.withColumn("px", F.when(F.col("bx") % 2 == 1, F.pmod(F.xxhash64("t"), parts)).otherwise(F.lit(0)))
    cut = cut.withColumn("py", F.when(F.col("by") % 2 == 1, F.pmod(F.xxhash64("t", F.lit(1)), parts)).otherwise(F.lit(0)))
    key_types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name in keys)

    x_in = cut.join(_offsets(cut, keys, "bx", "x", "_n", "_s", "_t"), [*keys, "bx"])
    x_schema = f"{key_types}, y double, by int, py bigint, n bigint, x double, bx int, a double, c double"

    def x_strip(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        row = pdf.iloc[0]
        if row["bx"] % 2:
            n, s = float(row["_n"]), float(row["_s"])
            a, c = x * (2 * n - row["n"]) + row["_t"] - 2 * s, 0.0
        else:
            a, c = _row_sums(x, float(row["n"]), float(row["_n"]), float(row["_s"]), float(row["_t"])), concordant(x, y)
        out = pdf[[*keys, "y", "by", "py", "n", "x", "bx"]].assign(a=a, c=0.0)
        out.iloc[0, out.columns.get_loc("c")] = c
        return out

    after_x = spread(x_in, *keys, "bx", "px").groupBy(*keys, "bx", "px").applyInPandas(x_strip, x_schema)
    y_in = after_x.join(_offsets(cut, keys, "by", "y", "_n", "_s", "_t"), [*keys, "by"])
    y_schema = f"{key_types}, n bigint, c double, aa double, bb double, ab double, a double, b double, xx double, yy double, xy double, x double, y double"

    def y_strip(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, a = (pdf[c].to_numpy() for c in ("x", "y", "a"))
        row = pdf.iloc[0]
        c = float(pdf["c"].sum())
        if row["by"] % 2:
            b = y * (2 * float(row["_n"]) - row["n"]) + row["_t"] - 2 * float(row["_s"])
        else:
            b = _row_sums(y, float(row["n"]), float(row["_n"]), float(row["_s"]), float(row["_t"]))
            c += concordant(x, y, pdf["bx"].to_numpy())
        out = pdf[keys].iloc[:1].assign(n=row["n"], c=c)
        for name, v in {"aa": a @ a, "bb": b @ b, "ab": a @ b, "a": a.sum(), "b": b.sum(), "xx": x @ x, "yy": y @ y, "xy": x @ y, "x": x.sum(), "y": y.sum()}.items():
            out[name] = float(v)
        return out

    sums = spread(y_in, *keys, "by", "py").groupBy(*keys, "by", "py").applyInPandas(y_strip, y_schema)

    # strips that differ on both axes: one row per occupied cell, at most (2 * 256 + 1)^2 per group
    cells = cut.groupBy(*keys, "bx", "by").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum(F.col("x") * F.col("y")).alias("xy")
    )

    def cross(pdf: pd.DataFrame) -> pd.DataFrame:
        i = np.unique(pdf["bx"].to_numpy(), return_inverse=True)[1]
        j = np.unique(pdf["by"].to_numpy(), return_inverse=True)[1]
        shape = (i.max() + 2, j.max() + 2)

        def below(col):
            g = np.zeros(shape)
            g[i + 1, j + 1] = pdf[col].to_numpy(dtype=float)
            return g.cumsum(0).cumsum(1)[i, j]

        n, x, y, xy = (pdf[c].to_numpy(dtype=float) for c in ("n", "x", "y", "xy"))
        c = float(np.sum(xy * below("n") - x * below("y") - y * below("x") + n * below("xy")))
        return pdf[keys].iloc[:1].assign(c=c)

    crossed = cells.groupBy(*keys).applyInPandas(cross, f"{key_types}, c double").withColumnRenamed("c", "_cc")
    names = ["c", "aa", "bb", "ab", "a", "b", "xx", "yy", "xy", "x", "y"]
    tot = sums.groupBy(*keys, "n").agg(*[F.sum(c).alias(c) for c in names]).join(crossed, keys)
    n = F.col("n").cast("double")
    conc = F.col("c") + F.col("_cc")
    signed = n * F.col("xy") - F.col("x") * F.col("y")
    prod = 2 * (2 * conc - signed)  # sum over ordered pairs of |xi-xj||yi-yj|

    def dcov2(pairs, ab, a, b):
        return pairs / (n * n) - 2 * ab / (n * n * n) + a * b / (n * n * n * n)

    vxy = dcov2(prod, F.col("ab"), F.col("a"), F.col("b"))
    vx = dcov2(2 * (n * F.col("xx") - F.col("x") * F.col("x")), F.col("aa"), F.col("a"), F.col("a"))
    vy = dcov2(2 * (n * F.col("yy") - F.col("y") * F.col("y")), F.col("bb"), F.col("b"), F.col("b"))
    ok = (F.col("n") >= min_n) & (vx > 1e-24) & (vy > 1e-24)
    value = F.when(ok, F.sqrt(F.greatest(F.lit(0.0), vxy) / F.sqrt(vx * vy))).otherwise(F.lit(0.0))
    return tot.select(*keys, value.alias("value"))


def dcor_full(panel: Panel, pairs=None) -> DataFrame:
    return dcor_points(panel.pair_points(False, pairs))


def dcor_directed(panel: Panel, lag: int = 1, pairs=None) -> DataFrame:
    return dcor_points(panel.pair_points(True, pairs, [max(1, lag)]))


def dcor_partial(panel: Panel, control=None, pairs=None) -> DataFrame:
    return dcor_points(residual_points(panel, False, control, pairs))

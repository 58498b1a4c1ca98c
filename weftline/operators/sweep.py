"""Sweeps over lag, window size and window position.

Window and lag are columns: each row is routed to the windows that contain it by
arithmetic on its position, and one grouped aggregate evaluates every configuration.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import distances, information, moments, neighbors, regress, spectral
from weftline.panel import Panel, clamped
from weftline.session import staged


@dataclass(frozen=True)
class PointMetric:
    """A pair metric computed from points: ``fn(points, keys, lag, bounded)``.

    ``shifts``: y is taken lag ahead.  ``history``: lag is a history length instead.  ``power``: a power of the
    partial correlation, which needs all channels at once and no points.
    """

    fn: Callable[..., DataFrame] | None
    directed: bool = False
    shifts: bool = False
    history: bool = False
    p_value: bool = False
    power: int = 0


def _squared(fn):
    return lambda p, keys, lag, bounded: moments.squared(fn(p, keys, lag, bounded))


def _corr(p, keys, lag, bounded):
    return moments.corr_points(p, keys)


def _corr_ahead(p, keys, lag, bounded):
    return moments.corr_points(p, keys, 4)


POINT_METRICS: dict[str, PointMetric] = {
    "correlation_full": PointMetric(_corr),
    "h2_full": PointMetric(_squared(_corr)),
    "correlation_directed": PointMetric(_corr_ahead, directed=True, shifts=True),
    "h2_directed": PointMetric(_squared(_corr_ahead), directed=True, shifts=True),
    "correlation_partial": PointMetric(None, power=1),
    "h2_partial": PointMetric(None, power=2),
    "coherence_full": PointMetric(lambda p, keys, lag, bounded: spectral.coherence_points(p, keys)),
    "granger_full": PointMetric(
        lambda p, keys, lag, bounded: regress.granger_points(p, lag, keys), directed=True, history=True, p_value=True
    ),
    "mutinf_full": PointMetric(lambda p, keys, lag, bounded: neighbors.mutual_information(p, keys)),
    "te_full": PointMetric(
        lambda p, keys, lag, bounded: information.transfer_entropy(p, lag, keys=keys, bounded=bounded),
        directed=True, history=True,
    ),
    "dcor_full": PointMetric(lambda p, keys, lag, bounded: distances.dcor_points(p, keys)),
    "dcor_directed": PointMetric(lambda p, keys, lag, bounded: distances.dcor_points(p, keys), directed=True, shifts=True),
    "ordinal_full": PointMetric(lambda p, keys, lag, bounded: information.ordinal_mi(p, keys=keys)),
    "ordinal_directed": PointMetric(
        lambda p, keys, lag, bounded: information.ordinal_mi(p, keys=keys), directed=True, shifts=True
    ),
}


def evenly(n: int, k: int) -> list[int]:
    """k indexes spread evenly over 0..n-1, rounded half to even; repeats are possible."""
    if n <= k:
        return list(range(n))
    if k == 1:
        return [0]
    return [round(i * (n - 1) / (k - 1)) for i in range(k)]


@dataclass(frozen=True)
class WindowGrid:
    """Starts first, first+stride, ... of windows of one size; ``chosen`` lists sampled start numbers."""

    size: int
    stride: int
    first: int
    count: int
    chosen: tuple[int, ...] | None = None

    @classmethod
    def plan(
        cls,
        length: int,
        size: int,
        stride: int | None = None,
        start_min: int | None = None,
        start_max: int | None = None,
        max_windows: int | None = None,
    ) -> WindowGrid:
        size = max(2, min(int(size), length))
        stride = max(1, int(stride if stride is not None else size // 5))
        first = max(0, start_min or 0)
        last = length - size if start_max in (None, 0) else min(length - size, int(start_max))
        last = max(first, last)
        count = (last - first) // stride + 1
        chosen = None
        if max_windows is not None and count > max_windows:
            chosen = tuple(sorted(set(evenly(count, max(1, max_windows)))))
        return cls(size, stride, first, count, chosen)

    def windows_of(self, t: Column, ahead: Column) -> Column:
        """Array of (window_size, start) for which t and t+ahead both lie inside."""
        lo = F.greatest(F.lit(0), F.ceil((t + ahead - self.size + 1 - self.first) / self.stride))
        hi = F.least(F.lit(self.count - 1), F.floor((t - self.first) / self.stride))
        ids = F.when(lo <= hi, F.sequence(lo.cast("bigint"), hi.cast("bigint")))
        if self.chosen is not None:
            keep = F.array(*[F.lit(i).cast("bigint") for i in self.chosen])
            ids = F.array_intersect(ids, keep)
        return F.transform(
            F.coalesce(ids, F.array().cast("array<bigint>")),
            lambda i: F.struct(F.lit(self.size).alias("window_size"), (i * self.stride + self.first).alias("start")),
        )


def window_points(
    panel: Panel, grids: Sequence[WindowGrid], directed: bool, lags: Sequence[int] = (0,), pairs=None, shifts: bool = False
) -> DataFrame:
    """Pair points routed to their windows: adds ``window_size`` and ``start``."""
    pts = panel.pair_points(directed, pairs, lags if shifts else (0,))
    homes = F.concat(*[g.windows_of(F.col("t"), F.col("lag")) for g in grids])
    return pts.select("*", F.explode(homes).alias("_w")).select(
        "src", "dst", "lag", F.col("_w.window_size").alias("window_size"), F.col("_w.start").alias("start"), "t", "x", "y"
    )


def window_moments(
    panel: Panel, grids: Sequence[WindowGrid], directed: bool, lags: Sequence[int], pairs=None, shifts: bool = False
) -> DataFrame:
    """Windowed correlation through panes.

    Rows first fold into sums per pane (the common step of all starts and sizes), keyed by the
    pane of t and the pane of t+lag; windows then combine panes.  A row meets its overlapping
    windows only as part of a pane total.  Values are shifted by the channel mean for accuracy.
    """
    step = math.gcd(*[g.size for g in grids], *[g.stride for g in grids], *[g.first for g in grids])
    row = panel.frame.agg(*[F.avg(panel.col(c)) for c in panel.channels]).first()
    mean = {c: (v if v is not None else 0.0) for c, v in zip(panel.channels, row)}
    centred = panel.with_frame(panel.frame.select("t", *[(panel.col(c) - F.lit(mean[c])).alias(c) for c in panel.channels]))
    pts = centred.pair_points(directed, pairs, lags if shifts else (0,))
    x, y = F.col("x"), F.col("y")
    first = F.floor(F.col("t") / step).cast("bigint")
    last = F.floor((F.col("t") + F.col("lag")) / step).cast("bigint")
    names = ("n", "sx", "sy", "sxx", "syy", "sxy")
    exprs = (F.lit(1.0), x, y, x * x, y * y, x * y)
    panes = pts.groupBy("src", "dst", "lag", first.alias("p"), last.alias("q")).agg(
        *[F.sum(e).alias(k) for k, e in zip(names, exprs)]
    )
    if not shifts:
        panes = panes.withColumn("lag", F.lit(lags[0]))
    homes = F.concat(*[g.windows_of(F.col("p") * step, (F.col("q") - F.col("p")) * step + (step - 1)) for g in grids])
    flat = panes.select("*", F.explode(homes).alias("_w")).select(
        F.col("_w.window_size").alias("window_size"), F.col("_w.start").alias("start"), "lag", "src", "dst", *names
    )
    s = flat.groupBy(*WINDOW_KEYS).agg(*[F.sum(k).alias(k) for k in names])
    n = F.col("n")
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    ok = (n >= (4 if shifts else 3)) & (vx > n * 1e-24) & (vy > n * 1e-24)
    r = clamped(cov / F.when(ok, F.sqrt(vx * vy)), -1.0, 1.0)
    return s.select(*WINDOW_KEYS, r.alias("value"))


WINDOW_KEYS = ["window_size", "start", "lag", "src", "dst"]
RUN = 64  # windows that one task takes from the same running totals


def _pane_sums(panel: Panel, step: int) -> DataFrame:
    """``pane, sums``: count, sums and cross products (upper triangle) of the complete rows of each pane."""
    chans = list(panel.channels)
    k = len(chans)
    row = panel.frame.agg(*[F.avg(panel.col(c)) for c in chans]).first()
    mean = np.array([v if v is not None else 0.0 for v in row])
    i, j = np.triu_indices(k)
    rows = panel.frame.dropna(how="any", subset=[f"`{c}`" for c in chans]).select(F.floor(F.col("t") / step).cast("bigint").alias("pane"), *[panel.col(c).alias(f"v{n}") for n, c in enumerate(chans)])

    def partial(batches):
        import pyarrow as pa

        for batch in batches:
            pane = batch.column("pane").to_numpy(zero_copy_only=False)
            v = np.column_stack([batch.column(f"v{n}").to_numpy(zero_copy_only=False) for n in range(k)]) - mean if len(pane) else np.zeros((0, k))
            names, who = np.unique(pane, return_inverse=True)
            sums = []
            for n in range(len(names)):
                x = v[who == n]
                sums.append(np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x)[i, j]]).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sums, pa.list_(pa.float64()))], names=["pane", "sums"])

    parts = rows.mapInArrow(partial, "pane bigint, sums array<double>")
    width = 1 + k + len(i)
    # a pane may lie in several tasks
    cells = parts.select("pane", F.posexplode("sums").alias("at", "s")).groupBy("pane", "at").agg(F.sum("s").alias("s"))
    joined = F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda x: x["s"])
    return cells.groupBy("pane").agg(joined.alias("sums")).filter(F.size("sums") == width)


def _run_of_windows(g: WindowGrid, step: int, k: int, power: int):
    """Partial correlations of a run of windows from its panes, by differences of running totals."""
    a, b = np.triu_indices(k, 1)
    i, j = np.triu_indices(k)
    chosen = None if g.chosen is None else set(g.chosen)

    def windows(pdf: pd.DataFrame) -> pd.DataFrame:
        lowest = int(pdf.run.iloc[0]) * RUN
        highest = min(lowest + RUN, g.count) - 1
        starts = np.array([g.first + w * g.stride for w in range(lowest, highest + 1) if chosen is None or w in chosen], dtype=np.int64)
        first, last = (g.first + lowest * g.stride) // step, (g.first + highest * g.stride + g.size) // step
        panes = np.zeros((last - first + 1, 1 + k + len(i)))
        panes[pdf.pane.to_numpy() - first + 1] = np.stack(pdf.sums.to_numpy())
        total = np.cumsum(panes, axis=0)
        s = total[(starts + g.size) // step - first] - total[starts // step - first]
        value = _partial_of(np.round(s[:, 0]), s[:, 1 : 1 + k], s[:, 1 + k :], i, j)[:, a, b] ** power
        return pd.DataFrame({"start": np.repeat(starts, len(a)), "i": np.tile(a, len(starts)), "j": np.tile(b, len(starts)), "value": value.ravel()})

    return windows


def window_partial(panel: Panel, grids: Sequence[WindowGrid], power: int = 1, pairs=None) -> DataFrame:
    """Partial correlation given all other channels in every window: ``window_size, start, lag, src, dst, value``.

    Rows fold into one Gram matrix per pane.  A task takes a run of consecutive windows: running totals over
    the panes give each window's matrix as a difference, whatever the windows share, and its precision
    matrix gives all pairs.  No value where a window has too few complete rows.
    """
    chans = list(panel.channels)
    k = len(chans)
    out = None
    for g in grids:
        step = math.gcd(g.size, g.stride, g.first)
        panes = staged(_pane_sums(panel, step))
        # runs of windows whose panes overlap a pane's place
        at = F.col("pane") * step
        low = F.greatest(F.lit(0), F.floor((at - g.size + 1 - g.first + g.stride - 1) / g.stride))
        high = F.least(F.lit(g.count - 1), F.floor((at - g.first) / g.stride))
        runs = F.when(low <= high, F.sequence(F.floor(low / RUN).cast("bigint"), F.floor(high / RUN).cast("bigint")))
        homes = panes.select("pane", "sums", F.explode(runs).alias("run"))
        names = F.from_json(F.lit(json.dumps(chans)), "array<string>")
        one = homes.groupBy("run").applyInPandas(_run_of_windows(g, step, k, power), "start bigint, i int, j int, value double").select(
            F.lit(g.size).alias("window_size"), "start", F.lit(1).alias("lag"), F.get(names, F.col("i")).alias("src"), F.get(names, F.col("j")).alias("dst"),
            F.when(~F.isnan("value"), F.col("value")).alias("value"),
        )
        out = one if out is None else out.unionByName(one)
    if pairs is None:
        return out
    wanted = out.sparkSession.createDataFrame(panel.pair_list(False, pairs), "src string, dst string")
    return out.join(wanted, ["src", "dst"], "left_semi").select(*WINDOW_KEYS, "value")


def _partial_of(n: np.ndarray, sums: np.ndarray, cross: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Partial correlation matrices of windows from their totals; NaN where a window has too few rows."""
    k = sums.shape[1]
    g = np.zeros((len(n), k, k))
    g[:, i, j] = cross
    g[:, j, i] = cross
    g -= sums[:, :, None] * sums[:, None, :] / np.maximum(n, 1)[:, None, None]
    d = np.sqrt(np.clip(np.einsum("wkk->wk", g), 0, None))
    d[d < 1e-12] = 1.0
    p = np.linalg.pinv(np.clip(g / (d[:, :, None] * d[:, None, :]), -1.0, 1.0))
    d = np.sqrt(np.abs(np.einsum("wkk->wk", p)))
    d[d < 1e-12] = 1.0
    out = -p / (d[:, :, None] * d[:, None, :])
    out[n <= k + 2] = np.nan
    return out


def window_edges(panel: Panel, variant: str, grids: Sequence[WindowGrid], lags: Sequence[int] = (1,), pairs=None) -> DataFrame:
    """Edges of every window (and lag) in one plan: ``window_size, start, lag, src, dst, value``."""
    m = _metric(variant)
    if m.power:
        return window_partial(panel, grids, m.power, pairs)
    if m.history:
        parts = []
        pts = window_points(panel, grids, m.directed, pairs=pairs)
        for lag in lags:
            parts.append(m.fn(pts.withColumn("lag", F.lit(lag)), WINDOW_KEYS, lag, True))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    lags = list(lags) if m.directed else [1]
    if variant.startswith(("correlation", "h2")):
        out = window_moments(panel, grids, m.directed, lags, pairs, m.shifts)
        return moments.squared(out) if variant.startswith("h2") else out
    pts = window_points(panel, grids, m.directed, lags, pairs, m.shifts)
    if not m.shifts:
        pts = pts.withColumn("lag", F.lit(lags[0]))
    return m.fn(pts, WINDOW_KEYS, lags[0], True)


def lag_edges(panel: Panel, variant: str, lags: Sequence[int], pairs=None) -> DataFrame:
    """Edges over the whole series for each lag: ``lag, src, dst, value``."""
    m = _metric(variant)
    keys = ["lag", "src", "dst"]
    if m.power:
        edges = moments.partial_correlation(panel, pairs=pairs)
        edges = moments.squared(edges) if m.power == 2 else edges
        return edges.select(F.lit(1).alias("lag"), "src", "dst", "value")
    if m.shifts:
        return m.fn(panel.pair_points(True, pairs, lags), keys, lags[0], False)
    if m.history:
        out = None
        pts = panel.pair_points(True, pairs).drop("lag")
        for lag in lags:
            one = m.fn(pts, ["src", "dst"], lag, False).withColumn("lag", F.lit(lag))
            out = one if out is None else out.unionByName(one)
        return out.select(*keys, "value")
    return m.fn(panel.pair_points(m.directed, pairs).withColumn("lag", F.lit(1)), keys, 1, False)


def _metric(variant: str) -> PointMetric:
    if variant not in POINT_METRICS:
        raise ValueError(f"{variant!r} is not a point metric")
    return POINT_METRICS[variant]


# -- scores ---------------------------------------------------------------------------------


def quality(edges: DataFrame, keys: Sequence[str], p_value: bool = False) -> DataFrame:
    """Mean strength of a matrix: mean |v|, or mean -log10(p) clipped to [1e-12, 1]."""
    v = F.col("value")
    finite = v.isNotNull() & ~F.isnan(v)
    score = -F.log10(clamped(v, 1e-12, 1.0)) if p_value else F.abs(v)
    return edges.groupBy(*keys).agg(F.avg(F.when(finite, score)).alias("metric"))


def pair_scores(edges: DataFrame, directed: bool, p_value: bool = False) -> DataFrame:
    """Strength of one pair: |v|, 1-p for p-values."""
    v = F.col("value")
    score = 1 - clamped(v, 0.0, 1.0) if p_value else F.abs(v)
    return edges.withColumn("score", score)


def best_lag(edges: DataFrame, p_value: bool = False, patience: int = 3) -> DataFrame:
    """One row ``lag, metric``: the lag a search stopping after ``patience`` misses would keep.

    The table has one row per lag, so the running windows are tiny.
    """
    q = quality(edges, ["lag"], p_value).withColumn("_g", F.lit(1))
    w = Window.partitionBy("_g").orderBy("lag")
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    low = F.lit(float("-inf"))
    m = F.coalesce(F.col("metric"), low)
    s = q.withColumn("_better", m > F.coalesce(F.max(m).over(upto), low))
    s = s.withColumn("_last", F.max(F.when(F.col("_better"), F.col("lag"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    miss = F.col("lag") - F.coalesce("_last", F.lit(0))
    s = s.withColumn("_stop", (miss >= patience) & (F.col("lag") >= 3))
    s = s.withColumn("_alive", ~F.coalesce(F.max("_stop").over(upto), F.lit(False)))
    seen = s.filter("_alive")
    top = F.max_by("lag", F.struct(m, -F.col("lag")))
    return seen.agg(top.alias("lag"), F.max("metric").alias("metric"))


def extremes(items: DataFrame, keys: Sequence[str], id_col: str, order: str, metric: str = "metric") -> DataFrame:
    """``best, median, worst`` id per group; ties: last best, first worst, the lower of two equally close to the median.

    Items are evaluated configurations (a few hundred per group), hence the plain percentile.
    """
    if not keys:
        return extremes(items.withColumn("_all", F.lit(0)), ["_all"], id_col, order, metric).drop("_all")
    keys = list(keys)
    ok = items.filter(F.col(metric).isNotNull() & ~F.isnan(metric))
    v, o = F.col(metric), F.col(order)
    med = ok.groupBy(*keys).agg(F.percentile(metric, F.lit(0.5)).alias("_med"))
    return ok.join(med, keys).groupBy(*keys).agg(
        F.max_by(id_col, F.struct(v, o)).alias("best"),
        F.min_by(id_col, F.struct(F.round(F.abs(v - F.col("_med")), 12), v, o)).alias("median"),
        F.min_by(id_col, F.struct(v, o)).alias("worst"),
    )


# -- scans -----------------------------------------------------------------------------------


def scan_positions(panel: Panel, variant: str, size: int | None = None, stride: int | None = None, lag: int = 1, pairs=None, **grid) -> DataFrame:
    """``id, window_size, lag, start, end, metric`` for each window position."""
    n = panel.length()
    size = size or min(200, max(10, n // 5))
    g = WindowGrid.plan(n, size, stride, **grid)
    q = quality(window_edges(panel, variant, [g], [lag], pairs), ["window_size", "start", "lag"], _metric(variant).p_value)
    if g.chosen is None:
        number = ((F.col("start") - g.first) / g.stride).cast("bigint")
    else:
        number = F.array_position(F.array(*[F.lit(i).cast("bigint") for i in g.chosen]), ((F.col("start") - g.first) / g.stride).cast("bigint")) - 1
    name = F.format_string("pos_w%d_l%d_i%d_s%d", F.col("window_size"), F.col("lag"), number, F.col("start"))
    return q.select(name.alias("id"), "window_size", "lag", "start", (F.col("start") + F.col("window_size")).alias("end"), "metric")


def scan_sizes(panel: Panel, variant: str, sizes: Sequence[int], stride: int | None = None, lag: int = 1, pairs=None, **grid) -> DataFrame:
    """Best window per size: ``id, window_size, lag, start, end, metric`` (earliest on ties)."""
    n = panel.length()
    grids = [WindowGrid.plan(n, w, stride, **grid) for w in sizes]
    q = quality(window_edges(panel, variant, grids, [lag], pairs), ["window_size", "start", "lag"], _metric(variant).p_value)
    best = q.groupBy("window_size", "lag").agg(
        F.max_by("start", F.struct("metric", -F.col("start"))).alias("start"), F.max("metric").alias("metric")
    )
    name = F.format_string("size_w%d_l%d", F.col("window_size"), F.col("lag"))
    return best.select(name.alias("id"), "window_size", "lag", "start", (F.col("start") + F.col("window_size")).alias("end"), "metric")


def scan_lags(panel: Panel, variant: str, lags: Sequence[int], pairs=None) -> DataFrame:
    q = quality(lag_edges(panel, variant, list(lags), pairs), ["lag"], _metric(variant).p_value)
    return q.select(F.format_string("lag_l%d", F.col("lag")).alias("id"), "lag", "metric")


def cube_edges(
    panel: Panel, variant: str, sizes: Sequence[int], lags: Sequence[int], stride: int | None = None, pairs=None,
    combo_limit: int | None = None, eval_limit: int | None = None, max_windows: int | None = None, **grid,
) -> DataFrame:
    """Edges of every (window size, lag, start) of the cube; limits, where given, thin out the grid evenly."""
    n = panel.length()
    lags = list(lags) if _metric(variant).directed else [1]
    combos = [(w, g) for w in sizes for g in lags]
    if combo_limit:
        combos = [combos[i] for i in evenly(len(combos), combo_limit)]
    per = max_windows
    if eval_limit and combos:
        share = max(1, eval_limit // len(combos))
        per = share if per is None else min(per, share)
    out = None
    by_lags: dict[tuple[int, ...], list[int]] = {}
    for w in dict.fromkeys(w for w, _ in combos):
        by_lags.setdefault(tuple(g for x, g in combos if x == w), []).append(w)
    for gs, ws in by_lags.items():
        grids = [WindowGrid.plan(n, w, stride, max_windows=per, **grid) for w in ws]
        one = window_edges(panel, variant, grids, list(gs), pairs)
        out = one if out is None else out.unionByName(one)
    return out


def cube_points(edges: DataFrame, p_value: bool = False) -> DataFrame:
    """``id, window_size, lag, start, end, metric`` of the cube; configurations without a score drop out."""
    q = quality(edges, ["window_size", "lag", "start"], p_value).filter("metric IS NOT NULL")
    name = F.format_string("cube_w%d_l%d_s%d", F.col("window_size"), F.col("lag"), F.col("start"))
    return q.select(name.alias("id"), "window_size", "lag", "start", (F.col("start") + F.col("window_size")).alias("end"), "metric")


def gallery(points: DataFrame, mode: str = "extremes", k: int = 1, limit: int = 60) -> DataFrame:
    """Selected configurations by rank of the metric: ends and middle, k from both ends, or deciles."""
    w = Window.partitionBy("_g").orderBy("metric", "id")
    r = points.withColumn("_g", F.lit(1)).withColumn("rank", F.row_number().over(w) - 1)
    r = r.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("_g")))
    i, n = F.col("rank"), F.col("n")
    want = (i == 0) | (i == F.floor(n / 2)) | (i == n - 1)
    if mode in ("extremes", "topbottom"):
        want = want | (i < k) | (i >= n - k)
    if mode == "quantiles":
        for q in (0.1, 0.25, 0.5, 0.75, 0.9):
            want = want | (i == F.bround(q * (n - 1)).cast("int"))
    picked = r.filter(want).withColumn("_p", F.row_number().over(w) - 1)
    picked = picked.withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy("_g")))
    slots = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda j: F.bround(j * (F.col("_m") - 1) / F.lit(max(1, limit - 1))).cast("int"))
    keep = (F.col("_m") <= limit) | F.array_contains(slots, F.col("_p"))
    return picked.filter(keep).select("id", "window_size", "lag", "start", "end", "metric", "rank")


def main_windows(panel: Panel, variant: str, sizes: Sequence[int], policy: str = "best", stride: int | None = None, lag: int = 1, pairs=None) -> DataFrame:
    """Main matrix from windows: the best window over all sizes, or the mean over each size's best."""
    n = panel.length()
    grids = [WindowGrid.plan(n, w, stride) for w in sizes]
    edges = window_edges(panel, variant, grids, [lag], pairs)
    q = quality(edges, ["window_size", "start"], _metric(variant).p_value)
    best = q.groupBy("window_size").agg(
        F.max_by("start", F.struct("metric", -F.col("start"))).alias("start"), F.max("metric").alias("metric")
    )
    if policy == "best":
        best = best.orderBy(F.desc("metric"), "window_size").limit(1)
    chosen = edges.join(best.select("window_size", "start"), ["window_size", "start"], "left_semi")
    return chosen.groupBy("src", "dst").agg(F.avg("value").alias("value"))


def main_cube(panel: Panel, variant: str, sizes: Sequence[int], lags: Sequence[int], stride: int | None = None, pairs=None, eval_limit: int | None = None, **grid) -> tuple[DataFrame, DataFrame]:
    """Main matrix from the strongest (window size, lag, start) of a cube: its edges, and the one row that names it."""
    edges = staged(cube_edges(panel, variant, sizes, lags, stride, pairs, eval_limit=eval_limit, **grid))
    keys = ["window_size", "lag", "start"]
    q = quality(edges, keys, _metric(variant).p_value).filter("metric IS NOT NULL")
    best = staged(q.orderBy(F.desc("metric"), *keys).limit(1))
    return edges.join(F.broadcast(best), keys, "left_semi").select("src", "dst", "value"), best

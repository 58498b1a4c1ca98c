"""Seasonal-trend decomposition by local regression (LOESS), for series of any length.

The series is an evenly spaced grid, so a local fit is made of five sums of kernel weights times values:
inside the series these are convolutions, near its ends each position has its own window.
One round takes two shuffles.  The first keys rows by season position (time modulo the period) and smooths
each such series over its cycles.  The second keys them by time block, with as many rows
copied over as the filters reach: moving averages and a local fit take the level out of the seasonal part,
and another local fit makes the trend.  Between rounds, bisquare weights follow from the residuals' exact
median.  No task ever holds more than a block and its reach.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.blocks import BLOCK
from weftline.functions.quantiles import quantiles
from weftline.operators.spectral import seasonality
from weftline.session import spread, staged

STATE = "channel string, t long, n long, period int, y double, w double, trend double, seasonal double"


def odd_above(x: float) -> int:
    """The least odd integer not below ``x``."""
    k = int(np.ceil(x))
    return k + 1 - k % 2


def trend_span(period: int, seasonal: int) -> int:
    """Default span of the trend: far enough not to follow the seasonal part."""
    return odd_above(1.5 * period / (1 - 1.5 / seasonal))


def low_pass_span(period: int) -> int:
    return odd_above(period + 1)


def _tricube(r: np.ndarray, h: float) -> np.ndarray:
    """1 within a thousandth of the bandwidth, 0 beyond 999 thousandths of it."""
    return np.where(r <= 0.001 * h, 1.0, np.where(r <= 0.999 * h, (1 - (r / max(h, 1e-300)) ** 3) ** 3, 0.0))


def _fit(s0, s1, s2, y0, y1, span: float) -> np.ndarray:
    """Value at 0 of the line through weighted points, or their mean where they lie too close; NaN without weight."""
    with np.errstate(all="ignore"):
        d, y = s1 / s0, y0 / s0
        c = s2 / s0 - d * d
        line = y - d / c * (y1 / s0 - d * y)
        return np.where(s0 > 0, np.where(np.sqrt(np.maximum(c, 0)) > 0.001 * span, line, y), np.nan)


def local_fits(y: np.ndarray, w: np.ndarray, first: int, n: int, width: int, at: np.ndarray) -> np.ndarray:
    """Degree-one local fits of width ``width`` at positions ``at`` of a series 0 .. n - 1.

    ``y`` and the weights ``w`` hold the positions from ``first`` on that the windows need.  ``at`` may
    hold -1 and n, one step beyond the ends.
    """
    half = (width + 1) // 2
    left = np.clip(at - half + 1, 0, max(n - width, 0))
    right = np.minimum(left + width, n) - 1
    bandwidth = np.maximum(at - left, right - at) + max(width - n, 0) // 2
    inner = (left == at - half + 1) & (right == at + half - 1) & (width <= n)
    out = np.full(len(at), np.nan)
    if inner.any():
        d = np.arange(1 - half, half)
        k = _tricube(np.abs(d), half - 1.0)
        # sums over j of k[j - i] f[j]
        sums = [np.correlate(f, g, "valid") for f, g in ((w, k), (w, k * d), (w, k * d * d), (w * y, k), (w * y, k * d))] if len(y) >= len(k) else []
        if sums:
            # sums[.][q] belongs to position first + half - 1 + q
            q = at[inner] - first - half + 1
            out[inner] = _fit(*(s[q] for s in sums), n - 1)
    for i in np.flatnonzero(~inner).tolist():
        j = np.arange(left[i], right[i] + 1)
        d = j - at[i]
        k = _tricube(np.abs(d), float(bandwidth[i])) * w[j - first]
        v = y[j - first]
        out[i] = _fit(k.sum(), (k * d).sum(), (k * d * d).sum(), (k * v).sum(), (k * v * d).sum(), n - 1)
    return out


def _homes(df: DataFrame, place: Column, reach: Column, size: Column, last: Column) -> DataFrame:
    """Each row once for every block whose reach covers it: ``blk``."""
    low = F.greatest(F.floor((place - reach) / size), F.lit(0).cast("long"))
    high = F.least(F.floor((place + reach) / size), F.floor(last / size))
    return df.withColumn("blk", F.explode(F.sequence(low.cast("long"), F.greatest(high, low).cast("long"))))


def _cycle_step(state: DataFrame, seasonal: int, block: int) -> DataFrame:
    """Smoothed season positions, one cycle longer at both ends: ``channel, t, n, period, y, w, c``."""
    t, p = F.col("t"), F.col("period")
    rows = state.withColumn("phase", F.pmod(t, p)).withColumn("cycle", F.floor(t / p))
    size = max(block, seasonal)
    cycles = F.floor((F.col("n") - 1 - F.col("phase")) / p)
    rows = _homes(rows, F.col("cycle"), F.lit(seasonal), F.lit(size), cycles)

    def smooth(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cycle")
        n, period, phase, blk = int(pdf.n.iloc[0]), int(pdf.period.iloc[0]), int(pdf.phase.iloc[0]), int(key[2])
        k = (n - 1 - phase) // period + 1
        first = int(pdf.cycle.iloc[0])
        own = np.arange(blk * size, min((blk + 1) * size, k))
        at = np.concatenate([[-1] if blk == 0 else [], own, [k] if own[-1] == k - 1 else []]).astype(np.int64)
        y = (pdf.y - pdf.trend).to_numpy()
        fits = local_fits(y, pdf.w.to_numpy(), first, k, seasonal, at)
        known = (at >= 0) & (at < k)
        fits = np.where(np.isnan(fits) & known, y[np.clip(at, 0, k - 1) - first], fits)
        # the steps beyond the ends fall back on their neighbours
        for i in np.flatnonzero(np.isnan(fits)):
            fits[i] = fits[1] if at[i] < 0 else fits[i - 1]
        out = pd.DataFrame({"channel": key[0], "t": at * period + phase, "n": n, "period": period, "c": fits})
        here = pdf.iloc[np.clip(at, 0, k - 1) - first]
        out["y"] = np.where(known, here.y.to_numpy(), np.nan)
        out["w"] = np.where(known, here.w.to_numpy(), np.nan)
        return out[["channel", "t", "n", "period", "y", "w", "c"]]

    dealt = spread(rows, "channel", "phase", "blk")
    return dealt.groupBy("channel", "phase", "blk").applyInPandas(smooth, "channel string, t long, n long, period int, y double, w double, c double")


def _time_step(rows: DataFrame, spans: DataFrame, block: int) -> DataFrame:
    """Seasonal part without its level, and the trend of what is left: the next state."""
    rows = rows.join(spans, "channel")
    reach = F.col("trend_span") + F.col("low_span") + F.col("period")
    size = F.greatest(F.lit(block), reach)
    rows = _homes(rows, F.col("t"), reach, size, F.col("n") - 1)

    def smooth(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        n, period, blk = int(pdf.n.iloc[0]), int(pdf.period.iloc[0]), int(key[1])
        tq, lq = int(pdf.trend_span.iloc[0]), int(pdf.low_span.iloc[0])
        size = max(block, tq + lq + period)
        t0 = int(pdf.t.iloc[0])
        c = pdf.c.to_numpy()
        level = c
        for width in (period, period, 3):
            level = np.convolve(level, np.full(width, 1 / width), "valid")
        first = t0 + period  # position of level[0]
        own = np.arange(blk * size, min((blk + 1) * size, n))
        # where the trend's windows need a seasonal part
        wide = np.arange(max(0, own[0] - tq), min(n, own[-1] + 1 + tq))
        low = local_fits(level, np.ones(len(level)), first, n, lq, wide)
        at = wide - t0
        seasonal = c[at] - np.where(np.isnan(low), level[wide - first], low)
        rest = pdf.y.to_numpy()[at] - seasonal
        trend = local_fits(rest, pdf.w.to_numpy()[at], int(wide[0]), n, tq, own)
        mine = own - int(wide[0])
        return pd.DataFrame({
            "channel": key[0], "t": own, "n": n, "period": period, "y": pdf.y.to_numpy()[own - t0], "w": pdf.w.to_numpy()[own - t0],
            "trend": np.where(np.isnan(trend), rest[mine], trend), "seasonal": seasonal[mine],
        })

    return spread(rows, "channel", "blk").groupBy("channel", "blk").applyInPandas(smooth, STATE)


def _weights(state: DataFrame) -> DataFrame:
    """Bisquare weights from residuals over six times their median."""
    held = state.withColumn("r", F.abs(F.col("y") - F.col("trend") - F.col("seasonal")))
    h = 6 * F.col("med")
    u = F.try_divide(F.col("r"), h)
    w = F.when(F.col("r") <= 0.001 * h, 1.0).when(F.col("r") <= 0.999 * h, F.pow(1 - u * u, 2)).otherwise(0.0)
    med = quantiles(held, ["channel"], "r", {"med": 0.5})
    return held.join(med, "channel").withColumn("w", w).select("channel", "t", "n", "period", "y", "w", "trend", "seasonal")


def periods(long: DataFrame, least_strength: float = 0.2) -> DataFrame:
    """``channel, period`` of channels with a clear autocorrelation peak."""
    found = seasonality(long)
    return found.filter((F.col("acf_strength") >= least_strength) & (F.col("acf_period") >= 2)).select("channel", F.col("acf_period").cast("int").alias("period"))


def decompose(long: DataFrame, period: int | None = None, seasonal: int = 7, robust: bool = True, inner: int | None = None, outer: int | None = None, least: int = 30, block: int = BLOCK) -> DataFrame:
    """``channel, t, y, trend, seasonal, w`` of the channels that have a period, no gap and ``least`` positions.

    ``period`` holds for all channels; without it each channel has its own, from its autocorrelation.
    """
    inner = (2 if robust else 5) if inner is None else inner
    outer = (15 if robust else 0) if outer is None else outer
    if seasonal < 3 or seasonal % 2 == 0:
        raise ValueError("the seasonal span is an odd number of at least 3 cycles")
    source = staged(long.select("channel", F.col("t").cast("long").alias("t"), F.col("value").cast("double").alias("y")))
    sizes = source.groupBy("channel").agg(F.count("*").alias("n"), F.count("y").alias("known"), F.max("t").alias("last"))
    sizes = sizes.filter((F.col("n") == F.col("known")) & (F.col("last") == F.col("n") - 1) & (F.col("n") >= least))
    own = sizes.withColumn("period", F.lit(period)) if period else sizes.join(periods(source.withColumnRenamed("y", "value")), "channel")
    own = staged(own.select("channel", "n", F.col("period").cast("int").alias("period")).filter("period >= 2"))
    distinct = [r[0] for r in own.select("period").distinct().collect()]  # lags of autocorrelations, few
    spans = own.sparkSession.createDataFrame([(p, trend_span(p, seasonal), low_pass_span(p)) for p in distinct], "period int, trend_span int, low_span int")
    spans = staged(own.join(spans, "period").select("channel", "trend_span", "low_span"))
    state = source.join(own, "channel").select("channel", "t", "n", "period", "y", F.lit(1.0).alias("w"), F.lit(0.0).alias("trend"), F.lit(0.0).alias("seasonal"))
    for round_ in range(outer + 1):
        if round_:
            state = _weights(state)
        for _ in range(inner):
            state = _time_step(_cycle_step(state, seasonal, block), spans, block)
        state = staged(state)
    return state.select("channel", "t", "y", "trend", "seasonal", "w")


def remove_seasonality(long: DataFrame, period: int | None = None, **options) -> DataFrame:
    """The panel without its seasonal parts; channels without a period, or with gaps, stay as they are."""
    parts = decompose(long, period, **options).select("channel", "t", F.col("seasonal").alias("_s"))
    return long.join(parts, ["channel", "t"], "left").select("t", "channel", (F.col("value") - F.coalesce("_s", F.lit(0.0))).alias("value"))

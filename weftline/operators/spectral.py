"""Spectra, peaks, autocorrelation and coherence.

A series of up to ``SINGLE`` points is transformed inside one task.  Longer ones use the
four-step factorisation n = n1 * n2: short transforms over strided groups, a twiddle factor,
short transforms over the other axis; two shuffles and groups of about sqrt(n) points.
Lengths without a usable factorisation go through a chirp convolution of power-of-two size.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.blocks import positions, rolling
from weftline.panel import Panel, clamped
from weftline.session import spread, staged

PAIR = ["src", "dst"]
SINGLE = 1 << 20
CHUNK = 1 << 16


def closed_up(long: DataFrame, keys: Sequence[str] = ("channel",)) -> DataFrame:
    """Non-null values with dense positions: ``keys, pos, value``."""
    data = long.filter("value IS NOT NULL").select(*keys, "t", "value")
    return positions(data, list(keys), "t", "pos", rows=data).select(*keys, "pos", "value")


def split(n: int, limit: int) -> tuple[int, int] | None:
    """n = n1 * n2 with both at most ``limit`` and n1 close to sqrt(n)."""
    for n1 in range(int(n**0.5), 0, -1):
        if n % n1 == 0:
            return (n1, n // n1) if n // n1 <= limit else None
    return None


def _stage(df: DataFrame, key: str, group: str, row: str, col: str, size: str, twiddle: bool, sign: int) -> DataFrame:
    """Transforms along ``row`` for each ``col``; several columns share a task."""
    schema = f"`{key}` string, n bigint, n1 bigint, n2 bigint, `{row}` bigint, `{col}` bigint, re double, im double"

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        m, n = int(first[size]), int(first["n"])
        cols, c = np.unique(pdf[col].to_numpy(), return_inverse=True)
        a = np.zeros((m, len(cols)), dtype=complex)
        a[pdf[row].to_numpy(), c] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        a = np.fft.fft(a, axis=0) if sign < 0 else np.fft.ifft(a, axis=0) * m
        k = np.arange(m)
        if twiddle:
            turns = (k[:, None] * cols[None, :]) % n
            a *= np.exp(sign * 2j * np.pi * turns / n)
        flat = a.ravel()
        return pd.DataFrame(
            {
                key: first[key], "n": n, "n1": int(first["n1"]), "n2": int(first["n2"]),
                row: np.repeat(k, len(cols)), col: np.tile(cols, m), "re": flat.real, "im": flat.imag,
            }
        )

    width = F.greatest(F.lit(1), F.floor(F.lit(CHUNK) / F.col(size)))
    return df.withColumn(group, F.floor(F.col(col) / width)).groupBy(key, "n", group).applyInPandas(kernel, schema)


def four_step(df: DataFrame, key: str, sign: int = -1) -> DataFrame:
    """``key, n, k, re, im`` from ``key, n, n1, n2, pos, re, im`` (unnormalised transform)."""
    first = df.select(key, "n", "n1", "n2", F.floor(F.col("pos") / F.col("n2")).alias("a"), F.pmod("pos", "n2").alias("b"), "re", "im")
    half = _stage(first, key, "g", "a", "b", "n1", True, sign)
    full = _stage(half, key, "g", "b", "a", "n2", False, sign)
    return full.select(key, "n", (F.col("a") + F.col("n1") * F.col("b")).alias("k"), "re", "im")


def _chirp(n: int, sign: int, index, negative: bool):
    angle = F.pmod(index * index, F.lit(2 * n)) * F.lit(np.pi / n * sign * (-1 if negative else 1))
    return F.cos(angle), F.sin(angle)


def _times(ar, ai, br, bi):
    return ar * br - ai * bi, ar * bi + ai * br


def chirp_transform(df: DataFrame, key: str, n: int, sign: int = -1) -> DataFrame:
    """Transform of awkward length n as a convolution of power-of-two length."""
    m = 1 << int(2 * n - 1).bit_length()
    n1, n2 = split(m, m)
    cr, ci = _chirp(n, sign, F.col("pos"), False)
    ar, ai = _times(F.col("re"), F.col("im"), cr, ci)
    sizes = [F.lit(v).cast("bigint").alias(c) for v, c in ((m, "n"), (n1, "n1"), (n2, "n2"))]
    a = four_step(df.select(key, *sizes, "pos", ar.alias("re"), ai.alias("im")), key)
    spark = df.sparkSession
    j = F.when(F.col("id") < n, F.col("id")).when(F.col("id") > m - n, F.lit(m) - F.col("id"))
    br, bi = _chirp(n, sign, j, True)
    zero = F.lit(0.0)
    chirp = spark.range(m).select(
        F.lit("").alias(key), *sizes, F.col("id").alias("pos"), F.coalesce(br, zero).alias("re"), F.coalesce(bi, zero).alias("im")
    )
    b = four_step(chirp, key).select("k", F.col("re").alias("br"), F.col("im").alias("bi"))
    pr, pi = _times(F.col("re"), F.col("im"), F.col("br"), F.col("bi"))
    prod = a.join(b, "k").select(key, *sizes, F.col("k").alias("pos"), pr.alias("re"), pi.alias("im"))
    back = four_step(prod, key, 1).filter(F.col("k") < n)
    kr, ki = _chirp(n, sign, F.col("k"), False)
    xr, xi = _times(F.col("re") / m, F.col("im") / m, kr, ki)
    return back.select(key, F.lit(n).cast("bigint").alias("n"), "k", xr.alias("re"), xi.alias("im"))


def transform(df: DataFrame, key: str, lengths: dict[str, int], single: int = SINGLE) -> DataFrame:
    """Discrete Fourier transform per key: ``key, n, k, re, im`` from ``key, pos, value``."""
    spark = df.sparkSession
    short = {k: n for k, n in lengths.items() if n <= single}
    parts = []
    if short:
        schema = f"`{key}` string, n bigint, k bigint, re double, im double"

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            v = np.empty(len(pdf))
            v[pdf["pos"].to_numpy()] = pdf["value"].to_numpy()
            x = np.fft.fft(v)
            return pd.DataFrame({key: pdf[key].iloc[0], "n": len(v), "k": np.arange(len(v)), "re": x.real, "im": x.imag})

        parts.append(df.filter(F.col(key).isin(list(short))).groupBy(key).applyInPandas(whole, schema))
    plans = {k: split(n, single) for k, n in lengths.items() if n > single}
    good = [(k, lengths[k], *p) for k, p in plans.items() if p]
    as_complex = df.select(key, "pos", F.col("value").alias("re"), F.lit(0.0).alias("im"))
    if good:
        sizes = spark.createDataFrame(good, f"`{key}` string, n bigint, n1 bigint, n2 bigint")
        parts.append(four_step(as_complex.join(sizes, key), key))
    for k in (k for k, p in plans.items() if not p):
        parts.append(chirp_transform(as_complex.filter(F.col(key) == k), key, lengths[k]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lengths_of(closed: DataFrame, key: str = "channel") -> dict[str, int]:
    """Points per channel (one number per channel column)."""
    return {r[0]: int(r[1]) for r in closed.groupBy(key).agg(F.count(F.lit(1))).collect()}


def _demeaned(closed: DataFrame) -> DataFrame:
    m = closed.groupBy("channel").agg(F.avg("value").alias("_m"))
    return closed.join(m, "channel").select("channel", "pos", (F.col("value") - F.col("_m")).alias("value"))


def spectrum(long: DataFrame, fs: float = 1.0, demean: bool = True, min_n: int = 8, single: int = SINGLE) -> DataFrame:
    """``channel, n, k, freq, amp, phase`` for 0 <= k <= (n-1)/2 of gap-closed values."""
    closed = staged(closed_up(long))
    lengths = {c: n for c, n in lengths_of(closed).items() if n >= min_n}
    base = _demeaned(closed) if demean else closed
    x = transform(base, "channel", lengths, single).filter(F.col("k") <= F.floor((F.col("n") - 1) / 2))
    amp = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    return x.select(
        "channel", "n", "k", (F.col("k") * F.lit(float(fs)) / F.col("n")).alias("freq"), amp.alias("amp"),
        F.atan2("im", "re").alias("phase"),
    )


def local_peaks(series: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Interior local maxima (the middle of a flat top): ``keys, order, value``.

    Runs of equal values count as one point; ``order`` is a dense integer.
    """
    keys = list(keys)
    r = rolling(series.select(*keys, order, value), keys, order, lambda w: {"_l": F.lag(value).over(w)}, before=1)
    starts = r.filter(F.col("_l").isNull() | (F.col(value) != F.col("_l"))).select(*keys, order, value)
    runs = positions(starts, keys, order, "_run", rows=starts)

    def around(w):
        return {"_p": F.lag(value).over(w), "_n": F.lead(value).over(w), "_next": F.lead(order).over(w)}

    e = rolling(runs, keys, "_run", around, before=1, after=1)
    top = e.filter((F.col(value) > F.col("_p")) & (F.col(value) > F.col("_n")))
    mid = F.floor((F.col(order) + F.col("_next") - 1) / 2).cast("bigint")
    return top.select(*keys, mid.alias(order), value)


def fft_peaks(long: DataFrame, fs: float = 1.0, top_k: int = 3, ratio: float = 0.2) -> DataFrame:
    """Strongest spectral peaks: ``channel, rank, freq, amp, period``."""
    s = staged(spectrum(long, fs).filter("k > 0"))
    return _top_peaks(s, fs, top_k, ratio)


def _top_peaks(s: DataFrame, fs: float, top_k: int, ratio: float) -> DataFrame:
    top = s.groupBy("channel").agg(F.max("amp").alias("_max"), F.max("n").alias("n"))
    # neighbours are searched among strictly positive frequencies only
    p = local_peaks(s.withColumn("k", F.col("k") - 1), ["channel"], "k", "amp").join(top, "channel")
    p = p.filter(F.col("amp") >= F.col("_max") * ratio)
    w = Window.partitionBy("channel").orderBy(F.desc("amp"), F.desc("k"))
    freq = (F.col("k") + 1) * F.lit(float(fs)) / F.col("n")
    ranked = p.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(1, top_k))
    return ranked.select("channel", "rank", freq.alias("freq"), "amp", (1 / freq).alias("period"))


def frequency_analysis(long: DataFrame, ratio: float = 0.2, fs: float = 1.0) -> DataFrame:
    """Peaks of the raw (not demeaned) amplitude spectrum including frequency 0: ``channel, freq, amp, period``."""
    s = staged(spectrum(long, fs, demean=False, min_n=1))
    top = s.groupBy("channel").agg(F.max("amp").alias("_max"), F.max("n").alias("n"))
    p = local_peaks(s, ["channel"], "k", "amp").join(top, "channel").filter(F.col("amp") >= F.col("_max") * ratio)
    freq = F.col("k") * F.lit(float(fs)) / F.col("n")
    return p.select("channel", freq.alias("freq"), "amp", (1 / freq).alias("period"))


def hurst_spectral(long: DataFrame, min_n: int = 50) -> DataFrame:
    """(1 - slope) / 2 of log power against log frequency."""
    s = spectrum(long, min_n=min_n).filter("k > 0 AND amp > 0")
    x, y = F.log10("freq"), F.log10(F.col("amp") * F.col("amp"))
    slope = F.try_divide(F.covar_pop(x, y), F.var_pop(x))
    return s.groupBy("channel").agg(((1 - slope) / 2).alias("value"))


# -- autocorrelation ----------------------------------------------------------------------


def autocorrelation(closed: DataFrame, lengths: dict[str, int], single: int = SINGLE) -> DataFrame:
    """Biased autocorrelation ``channel, n, lag, acf`` for all lags below n, by two transforms."""
    base = _demeaned(closed)
    short = {c: n for c, n in lengths.items() if n <= single}
    parts = []
    if short:

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            n = len(pdf)
            v = np.empty(n)
            v[pdf["pos"].to_numpy()] = pdf["value"].to_numpy()
            m = 1 << int(2 * n - 1).bit_length()
            a = np.fft.irfft(np.abs(np.fft.rfft(v, m)) ** 2, m)[:n]
            a = a / (a[0] + 1e-12)
            return pd.DataFrame({"channel": pdf["channel"].iloc[0], "n": n, "lag": np.arange(n), "acf": a})

        parts.append(
            base.filter(F.col("channel").isin(list(short)))
            .groupBy("channel")
            .applyInPandas(whole, "channel string, n bigint, lag bigint, acf double")
        )
    long_ones = {c: n for c, n in lengths.items() if n > single}
    if long_ones:
        rows = []
        for c, n in long_ones.items():
            m = 1 << int(2 * n - 1).bit_length()
            rows.append((c, n, m, *split(m, m)))
        sizes = base.sparkSession.createDataFrame(rows, "channel string, points bigint, n bigint, n1 bigint, n2 bigint")
        padded = base.join(sizes, "channel").select("channel", "n", "n1", "n2", "pos", F.col("value").alias("re"), F.lit(0.0).alias("im"))
        power = four_step(padded, "channel").select(
            "channel", F.col("k").alias("pos"), (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("re"), F.lit(0.0).alias("im")
        )
        back = four_step(power.join(sizes, "channel"), "channel", 1).join(sizes.select("channel", "points"), "channel")
        back = staged(back.filter(F.col("k") < F.col("points")).select("channel", F.col("points").alias("n"), F.col("k").alias("lag"), "re"))
        zero = back.filter("lag = 0").select("channel", F.col("re").alias("_0"))
        parts.append(back.join(zero, "channel").select("channel", "n", "lag", (F.col("re") / F.col("_0")).alias("acf")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def acf(long: DataFrame, max_lag: int | None = None) -> DataFrame:
    """``channel, lag, acf`` from lag 1; default reach max(5, n//2), below n."""
    closed = staged(closed_up(long))
    a = autocorrelation(closed, lengths_of(closed))
    reach = F.lit(max_lag) if max_lag is not None else F.greatest(F.lit(5), F.floor(F.col("n") / 2))
    return a.filter((F.col("lag") >= 1) & (F.col("lag") <= F.least(F.col("n") - 1, reach))).select("channel", "n", "lag", "acf")


def seasonality(long: DataFrame, fs: float = 1.0, max_period: int | None = None, min_n: int = 20) -> DataFrame:
    """Strongest autocorrelation peak (at least .1) and strongest spectral peak per channel."""
    a = staged(acf(long, max_period).filter(F.col("n") >= min_n))
    peaks = local_peaks(a.withColumn("lag", F.col("lag") - 1), ["channel"], "lag", "acf").filter("acf >= 0.1")
    best = peaks.groupBy("channel").agg(
        (F.max_by("lag", F.struct("acf", -F.col("lag"))) + 1).alias("acf_period"), F.max("acf").alias("acf_strength")
    )
    f = fft_peaks(long, fs, 1).select("channel", F.col("period").alias("fft_period"), F.col("freq").alias("fft_freq"))
    return a.select("channel").distinct().join(best, "channel", "left").join(f, "channel", "left")


# -- coherence ------------------------------------------------------------------------------


def cross_spectra(points: DataFrame, keys: Sequence[str] = PAIR, nperseg: int | None = None) -> DataFrame:
    """Welch sums per frequency bin: ``keys, nperseg, k, pxx, pyy, re, im``.

    Segments of max(8, min(64, n//2)) points, half overlapping, Hann window, mean removed.
    A task holds a run of consecutive segments, not a series.
    """
    keys = list(keys)
    pts = points.select(*keys, "t", "x", "y")
    size = pts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    seg = F.lit(nperseg) if nperseg is not None else F.greatest(F.lit(8), F.least(F.lit(64), F.floor(F.col("n") / 2)))
    size = size.filter("n > 3").withColumn("nperseg", F.least(seg, F.col("n")).cast("int"))
    size = size.withColumn("step", F.col("nperseg") - F.floor(F.col("nperseg") / 2))
    size = size.withColumn("segs", F.floor((F.col("n") - F.col("nperseg")) / F.col("step")) + 1)
    run = 256
    p = positions(pts, keys, "t", "pos", rows=pts).join(size, keys)
    lo = F.greatest(F.lit(0), F.ceil((F.col("pos") - F.col("nperseg") + 1) / F.col("step")))
    hi = F.least(F.col("segs") - 1, F.floor(F.col("pos") / F.col("step")))
    chunk = F.explode(F.sequence(F.floor(lo / run), F.floor(hi / run)))
    p = p.filter(lo <= hi).withColumn("chunk", chunk)
    kt = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pts.schema if f.name in keys)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        row = pdf.iloc[0]
        m, step = int(row["nperseg"]), int(row["step"])
        first = int(row["chunk"]) * run
        count = min(run, int(row["segs"]) - first)
        at = (np.arange(count) * step)[:, None] + np.arange(m)[None, :]
        hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(m) / m)

        def fourier(c):
            s = pdf[c].to_numpy()[at]
            return np.fft.rfft((s - s.mean(axis=1, keepdims=True)) * hann, axis=1)

        fx, fy = fourier("x"), fourier("y")
        cross = (np.conj(fx) * fy).sum(axis=0)
        out = pd.DataFrame(
            {
                "nperseg": m, "k": np.arange(fx.shape[1]), "pxx": (np.abs(fx) ** 2).sum(axis=0),
                "pyy": (np.abs(fy) ** 2).sum(axis=0), "re": cross.real, "im": cross.imag,
            }
        )
        for c in keys:
            out[c] = row[c]
        return out

    raw = spread(p, *keys, "chunk").groupBy(*keys, "chunk").applyInPandas(kernel, f"nperseg int, k int, pxx double, pyy double, re double, im double, {kt}")
    return raw.groupBy(*keys, "nperseg", "k").agg(*[F.sum(c).alias(c) for c in ("pxx", "pyy", "re", "im")])


def coherence_bins(points: DataFrame, keys: Sequence[str] = PAIR, fs: float = 1.0, nperseg: int | None = None) -> DataFrame:
    """``keys, k, freq, coh`` with coh clipped to [0, 1]; NULL where a spectrum is zero."""
    s = cross_spectra(points, keys, nperseg)
    c = F.try_divide(F.col("re") * F.col("re") + F.col("im") * F.col("im"), F.col("pxx") * F.col("pyy"))
    return s.select(*keys, "k", (F.col("k") * F.lit(float(fs)) / F.col("nperseg")).alias("freq"), clamped(c, 0.0, 1.0).alias("coh"))


def coherence_points(points: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    return coherence_bins(points, keys).groupBy(*keys).agg(F.coalesce(F.avg("coh"), F.lit(0.0)).alias("value"))


def coherence_full(panel: Panel, pairs=None) -> DataFrame:
    return coherence_points(panel.pair_points(False, pairs))


def coherence_partial(panel: Panel, control: Sequence[str] = (), pairs=None, extra=None) -> DataFrame:
    """On residuals if controls are given, else the plain coherence."""
    from weftline.operators.moments import residualize

    if not control and not extra:
        return coherence_full(panel, pairs)
    res = residualize(panel, control, extra)
    return coherence_full(res.select([c for c in res.channels if c not in control]), pairs)


def coherence_peaks(panel: Panel, fs: float = 1.0, pairs=None) -> DataFrame:
    """Frequency of the strongest coherence per pair: ``src, dst, freq, coh``."""
    b = coherence_bins(panel.pair_points(False, pairs), PAIR, fs)
    top = F.max_by(F.struct("freq", "coh"), F.struct("coh", -F.col("k")))
    return b.filter("coh IS NOT NULL").groupBy(*PAIR).agg(top.alias("m")).select(*PAIR, "m.freq", "m.coh")

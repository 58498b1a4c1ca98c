"""Seasonal-trend decomposition against loops over every window, on blocks much shorter than the series."""

import numpy as np
import pytest

from weftline.operators import stl
from weftline.plans.analysis import preprocess
from weftline.panel import Panel


def fit_at(y, w, width, i):
    """One local line fit, straight from its definition."""
    n, half = len(y), (width + 1) // 2
    left = max(min(i - half + 1, n - width), 0)
    right = min(left + width, n) - 1
    h = max(i - left, right - i) + max(width - n, 0) // 2
    weights = np.zeros(n)
    for j in range(left, right + 1):
        r = abs(j - i)
        if r <= 0.999 * h:
            weights[j] = (1.0 if r <= 0.001 * h else (1 - (r / h) ** 3) ** 3) * w[j]
    if weights.sum() <= 0:
        return None
    weights /= weights.sum()
    x = np.arange(n)
    a = (weights * x).sum()
    c = (weights * (x - a) ** 2).sum()
    if np.sqrt(c) > 0.001 * (n - 1):
        weights = weights * (1 + (i - a) / c * (x - a))
    return float((weights * y).sum())


def direct(y, period, seasonal, inner, outer):
    n = len(y)
    w, trend, season = np.ones(n), np.zeros(n), np.zeros(n)
    nt, nl = stl.trend_span(period, seasonal), stl.low_pass_span(period)
    for r in range(outer + 1):
        if r:
            res = np.abs(y - trend - season)
            h = 6 * np.median(res)
            w = np.array([1.0 if x <= 0.001 * h else (1 - (x / h) ** 2) ** 2 if x <= 0.999 * h else 0.0 for x in res])
        for _ in range(inner):
            c = np.zeros(n + 2 * period)
            for phase in range(period):
                sub, sw = (y - trend)[phase::period], w[phase::period]
                fits = [fit_at(sub, sw, seasonal, i) for i in range(-1, len(sub) + 1)]
                for k in range(1, len(sub) + 1):
                    fits[k] = sub[k - 1] if fits[k] is None else fits[k]
                fits[0] = fits[1] if fits[0] is None else fits[0]
                fits[-1] = fits[-2] if fits[-1] is None else fits[-1]
                for k, f in enumerate(fits):
                    c[k * period + phase] = f
            level = c
            for width in (period, period, 3):
                level = np.array([level[i : i + width].mean() for i in range(len(level) - width + 1)])
            low = np.array([fit_at(level, np.ones(n), nl, i) for i in range(n)])
            season = c[period:-period] - low
            rest = y - season
            fits = [fit_at(rest, w, nt, i) for i in range(n)]
            trend = np.array([rest[i] if f is None else f for i, f in enumerate(fits)])
    return trend, season, w


def series(n, period, seed, spikes=0):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    y = 0.02 * t + 3 * np.sin(2 * np.pi * t / period) + (t % period == 1) + rng.normal(size=n) * 0.2
    y[rng.integers(0, n, spikes)] += 40
    return y


def long(spark, **channels):
    rows = [(t, c, None if v is None else float(v)) for c, s in channels.items() for t, v in enumerate(s)]
    return spark.createDataFrame(rows, "t bigint, channel string, value double")


def columns(df, channel):
    p = df.filter(f"channel = '{channel}'").orderBy("t").toPandas()
    return p.trend.to_numpy(), p.seasonal.to_numpy(), p.w.to_numpy()


@pytest.mark.parametrize("block", [4, 10_000])
def test_equals_the_definition(spark, block):
    y = series(125, 6, 1, spikes=5)
    got = columns(stl.decompose(long(spark, a=y), 6, inner=2, outer=2, block=block), "a")
    for have, want in zip(got, direct(y, 6, 7, 2, 2)):
        np.testing.assert_allclose(have, want, atol=1e-9)


def test_short_series_and_windows_longer_than_it(spark):
    y, z = series(33, 12, 3), series(40, 9, 4)
    d = stl.decompose(long(spark, a=y), 12, robust=False, inner=2)
    for have, want in zip(columns(d, "a"), direct(y, 12, 7, 2, 0)):
        np.testing.assert_allclose(have, want, atol=1e-9)
    d = stl.decompose(long(spark, z=z), 30, robust=False, inner=2, seasonal=9)
    for have, want in zip(columns(d, "z"), direct(z, 30, 9, 2, 0)):
        np.testing.assert_allclose(have, want, atol=1e-9)


def test_constant_series_has_no_season(spark):
    d = stl.decompose(long(spark, c=[2.5] * 40), 5, outer=1).toPandas()
    assert np.allclose(d.seasonal, 0) and np.allclose(d.trend, 2.5)


def test_each_channel_has_its_own_period(spark):
    a, b = series(140, 7, 5), series(144, 12, 6)
    gap = [None if i == 20 else float(v) for i, v in enumerate(series(140, 7, 7))]
    src = long(spark, a=a, b=b, gap=gap, short=a[:20], noise=np.random.default_rng(2).normal(size=140))
    found = {r.channel: r.period for r in stl.periods(src).collect()}
    assert found["a"] == 7 and found["b"] == 12
    out = stl.remove_seasonality(src, robust=False, inner=1).toPandas()
    for name, y, p in (("a", a, 7), ("b", b, 12)):
        have = out[out.channel == name].sort_values("t").value.to_numpy()
        np.testing.assert_allclose(have, y - direct(y, p, 7, 1, 0)[1], atol=1e-9)
    # a gap, or too few positions: as it was
    left = out[out.channel == "short"].sort_values("t").value.to_numpy()
    np.testing.assert_allclose(left, a[:20])
    assert out[(out.channel == "gap") & (out.t == 20)].value.isna().all()
    np.testing.assert_allclose(out[(out.channel == "gap") & (out.t == 21)].value, gap[21])


def test_season_goes_in_the_cleaning_chain(spark):
    y = series(90, 5, 8)
    panel = Panel.from_long(long(spark, a=y), ["a"])
    out, report = preprocess(panel, near_constant=None, fill=True, interpolate=True, deseason=True, season_period=5, season_args={"outer": 1})
    have = np.array([r.a for r in out.frame.orderBy("t").collect()])
    np.testing.assert_allclose(have, y - direct(y, 5, 7, 2, 1)[1], atol=1e-9)
    assert "deseason:5" in report.steps


def test_empty(spark):
    assert stl.decompose(long(spark, a=[1.0, 2.0]), 5, inner=1, outer=0).count() == 0

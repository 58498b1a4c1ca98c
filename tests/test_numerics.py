"""Transforms, lag profiles, regressions and graph measures against direct numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.functions import special
from weftline.operators import diagnostics, graph, moments, regress, spectral
from weftline.panel import Panel


def long_of(spark, **series):
    rows = [(t, c, float(v)) for c, s in series.items() for t, v in enumerate(s)]
    return spark.createDataFrame(rows, "t bigint, channel string, value double")


def panel_of(spark, **series):
    pdf = pd.DataFrame({"t": np.arange(len(next(iter(series.values())))), **series})
    return Panel.from_wide(spark.createDataFrame(pdf), list(series))


def test_special():
    assert special.f_sf(3.0, 2, 10) == pytest.approx(0.09536743164062489, rel=1e-9)
    assert special.chi2_sf(5.0, 2) == pytest.approx(math.exp(-2.5), rel=1e-12)
    assert special.chi2_sf(1.0, 1) == pytest.approx(math.erfc(math.sqrt(0.5)), rel=1e-12)
    assert special.betainc(0.5, 0.5, 0.3) == pytest.approx(2 / math.pi * math.asin(math.sqrt(0.3)), rel=1e-12)
    assert special.digamma(np.array([1, 10, 100]))[1] == pytest.approx(2.251752589066721, abs=1e-12)


@pytest.mark.parametrize("n", [64, 60, 61])
def test_long_transform(spark, n):
    v = np.random.default_rng(n).normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"channel": "c", "pos": np.arange(n), "value": v}))
    got = spectral.transform(df, "channel", {"c": n}, single=16).toPandas().sort_values("k")
    want = np.fft.fft(v)
    np.testing.assert_allclose(got["re"], want.real, atol=1e-9)
    np.testing.assert_allclose(got["im"], want.imag, atol=1e-9)


def test_long_autocorrelation(spark):
    v = np.random.default_rng(1).normal(size=75)
    df = spark.createDataFrame(pd.DataFrame({"channel": "c", "pos": np.arange(75), "value": v}))
    got = spectral.autocorrelation(df, {"c": 75}, single=16).toPandas().sort_values("lag")["acf"]
    z = v - v.mean()
    want = np.correlate(z, z, "full")[74:]
    np.testing.assert_allclose(got, want / want[0], atol=1e-9)


def test_flat_top_peaks(spark):
    v = [0, 1, 3, 3, 3, 1, 2, 0, 5]
    got = spectral.local_peaks(long_of(spark, c=v).select("channel", "t", "value"), ["channel"], "t", "value")
    assert sorted(r.t for r in got.collect()) == [3, 6]


@pytest.mark.parametrize("size", [7, 1000])
def test_lag_profile(spark, size):
    v = np.random.default_rng(8).normal(size=60) + 3
    closed = long_of(spark, c=v).select("channel", F.col("t").alias("pos"), "value")
    p = regress.Profile(regress.lag_profile(closed, 5, centre=False, size=size).toPandas(), centred=False)
    x = np.column_stack([np.ones(56), *[v[4 - k : 60 - k] for k in range(4)]])
    np.testing.assert_allclose(p.gram(4, 3), x.T @ x, atol=1e-9)


def test_adf(spark):
    rng = np.random.default_rng(0)
    walk, noise = np.cumsum(rng.normal(size=400)), rng.normal(size=400)
    got = {r.channel: r for r in regress.adf(long_of(spark, walk=walk, noise=noise)).collect()}
    assert got["walk"].pvalue > 0.05 and got["noise"].pvalue < 0.01
    lag = int(got["walk"].used_lag)
    d = np.diff(walk)
    y = d[lag:]
    x = np.column_stack([np.ones(len(y)), walk[lag:-1], *[d[lag - k : len(d) - k] for k in range(1, lag + 1)]])
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    s2 = ((y - x @ b) ** 2).sum() / (len(y) - x.shape[1])
    assert got["walk"].stat == pytest.approx(b[1] / math.sqrt(s2 * np.linalg.inv(x.T @ x)[1, 1]), abs=1e-6)


def test_granger_direction(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=500)
    y = np.concatenate([rng.normal(size=2), 0.8 * x[:-2]]) + 0.3 * rng.normal(size=500)
    p = panel_of(spark, X=x, Y=y)
    for f in (regress.granger_full, regress.granger_partial):
        got = {(r.src, r.dst): r.value for r in f(p, 3).collect()}
        assert got[("X", "Y")] < 1e-6 and got[("Y", "X")] > 0.01


def test_gram_correlation_with_gaps(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(80, 4)) + 100
    a[rng.random(a.shape) < 0.1] = np.nan
    p = panel_of(spark, **{f"c{i}": a[:, i] for i in range(4)})
    for lag in (0, 2):
        wide = {(r.src, r.dst): r.value for r in moments.gram_correlation(p, lag).collect()}
        narrow = moments.lagged_correlation(p, [lag]) if lag else moments.correlation(p)
        for r in narrow.collect():
            assert wide[(r.src, r.dst)] == pytest.approx(r.value, abs=1e-12)


def test_partial_correlation_matches_residuals(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=300)
    p = panel_of(spark, X=0.8 * z + 0.3 * rng.normal(size=300), Y=0.6 * z + 0.3 * rng.normal(size=300), Z=z)
    a = {(r.src, r.dst): r.value for r in moments.partial_correlation(p).collect()}
    b = {(r.src, r.dst): r.value for r in moments.partial_correlation(p, ["Z"]).collect()}
    assert a[("X", "Y")] == pytest.approx(b[("X", "Y")], abs=1e-9)
    assert abs(a[("X", "Y")]) < 0.2


def random_graph(spark, directed, n=9, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(f"n{i}", f"n{j}", float(rng.integers(1, 5)) / 4) for i in range(n) for j in range(n) if (i != j if directed else i < j) and rng.random() < 0.4]
    e = spark.createDataFrame(rows, "src string, dst string, value double")
    return graph.threshold_edges(e, 0.1), spark.createDataFrame([(f"n{i}",) for i in range(n)], "name string"), rows


@pytest.mark.parametrize("directed", [False, True])
def test_graph_paths_agree(spark, directed):
    e, nodes, _ = random_graph(spark, directed)
    for f, col, tol in ((graph.betweenness, "betweenness", 1e-9), (graph.eigenvector, "eigenvector", 1e-4)):
        a = {r.name: r[col] for r in f(e, nodes, directed).collect()}
        b = {r.name: r[col] for r in f(e, nodes, directed, by_joins=True).collect()}
        assert a == pytest.approx(b, abs=tol)


def test_communities(spark):
    rows = [(f"a{i}", f"a{j}", 1.0) for i in range(4) for j in range(i + 1, 4)] + [(f"b{i}", f"b{j}", 1.0) for i in range(3) for j in range(i + 1, 3)] + [("a0", "b0", 1.0)]
    e = graph.threshold_edges(spark.createDataFrame(rows, "src string, dst string, value double"), 0.5)
    nodes = spark.createDataFrame([(f"a{i}",) for i in range(4)] + [(f"b{i}",) for i in range(3)], "name string")
    for joins in (False, True):
        got = {r.name: r.community for r in graph.communities(e, nodes, joins).collect()}
        assert {got[f"a{i}"] for i in range(4)} == {0} and {got[f"b{i}"] for i in range(3)} == {1}
    assert graph.is_connected(e, nodes)


def near_pairs(rows, kind, radius):
    d = lambda a, b: [abs(u - v) for u, v in zip(a[1:], b[1:])]
    hit = (lambda x: sum(x) == 1) if kind == "6" else (lambda x: max(x) <= radius)
    return sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and None not in a + b and hit(d(a, b)))


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize("radius", [1, 2, 3])
def test_neighbor_pairs_26(spark, tmp_path, radius, whole):
    """Against all pairs, with copies, a point without a coordinate and steps of a half; no points are broadcast."""
    rng = np.random.default_rng(radius)
    c = rng.integers(-5, 6, (90, 3)).tolist() if whole else (rng.integers(-10, 11, (90, 3)) / 2).tolist()
    rows = [(f"v{i:03d}", *x) for i, x in enumerate(c)]
    rows += [rows[3], rows[3], ("w", *rows[4][1:]), ("x", None, *rows[5][2:])]
    t = "long" if whole else "double"
    spark.createDataFrame(rows, f"channel string, x {t}, y {t}, z {t}").write.parquet(f"{tmp_path}/points")  # a file's size is known
    got = graph.neighbor_pairs(spark.read.parquet(f"{tmp_path}/points"), "26", radius)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == near_pairs(rows, "26", radius)


@pytest.mark.parametrize("whole", [True, False])
def test_neighbor_pairs_6(spark, tmp_path, whole):
    """Whole numbers send three copies of a point; steps of a half can reach any cell around."""
    rng = np.random.default_rng(6)
    c = rng.integers(-3, 4, (90, 3)).tolist() if whole else (rng.integers(-6, 7, (90, 3)) / 2).tolist()
    rows = [(f"v{i:03d}", *x) for i, x in enumerate(c)]
    rows += [rows[3], rows[3], ("w", *rows[4][1:]), ("x", None, *rows[5][2:])]
    t = "long" if whole else "double"
    spark.createDataFrame(rows, f"channel string, x {t}, y {t}, z {t}").write.parquet(f"{tmp_path}/points")  # a file's size is known
    got = graph.neighbor_pairs(spark.read.parquet(f"{tmp_path}/points"), "6")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and ("explode([[0,0,1],[0,1,0],[1,0,0]])" in plan) == whole
    assert sorted(map(tuple, got.collect())) == near_pairs(rows, "6", 1)


def test_fdr_edge_cases(spark):
    p = [0.01, 0.01, 0.04, 1.0, 0.5, None, float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, value double")
    got = {r.i: r.q for r in graph.fdr_bh(df).collect()}
    assert got[0] == got[1] == pytest.approx(0.025) and got[2] == pytest.approx(0.04 * 5 / 3)
    assert got[5] is None and got[6] is None and got[3] == 1.0


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_fdr_runs_from_the_top(spark, keys):
    """Against numpy over many buckets with ties; no frame ends at the group's end, which is quadratic."""
    p = np.random.default_rng(3).uniform(size=3000).round(3) ** 2
    pdf = pd.DataFrame({"i": np.arange(3000), "g": np.arange(3000) % 3, "value": p})
    got = graph.fdr_bh(spark.createDataFrame(pdf), keys=keys)
    assert "unboundedfollowing" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    for _, d in got.toPandas().sort_values("value").groupby("g" if keys else lambda _: 0):
        v = d["value"].to_numpy()
        q = v * len(v) / np.searchsorted(v, v, side="right")
        assert d["q"].to_numpy() == pytest.approx(np.minimum.accumulate(q[::-1])[::-1].clip(0, 1), rel=1e-12)


def test_hurst_sign(spark):
    noise = np.random.default_rng(0).normal(size=1000)
    long = long_of(spark, c=noise)
    fixed, compat = (diagnostics.hurst_aggvar(long, compat=c).first().value for c in (False, True))
    assert fixed == pytest.approx(0.5, abs=0.1) and compat == pytest.approx(2 - fixed, abs=1e-9)

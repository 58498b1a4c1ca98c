"""Distance and neighbour metrics with many small strips and cells against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.functions import kdcells
from weftline.functions.special import digamma
from weftline.operators import distances, neighbors


def points(spark, x, y):
    n = len(x)
    return spark.createDataFrame(pd.DataFrame({"src": "a", "dst": "b", "t": np.arange(n), "x": x, "y": y}))


def samples(kind, n=400):
    rng = np.random.default_rng(11)
    x = rng.normal(size=n)
    y = 0.5 * x + rng.normal(size=n)
    if kind == "ties":
        return np.round(x).astype(float), np.round(y).astype(float)
    if kind == "hot":
        return np.where(rng.random(n) < 0.4, 0.0, x), y
    if kind == "line":
        return x, 2 * x
    return x, y


def dcor(x, y):
    def centred(v):
        d = np.abs(v[:, None] - v[None, :])
        return d - d.mean(0) - d.mean(1)[:, None] + d.mean()

    a, b = centred(x), centred(y)
    return np.sqrt(max(0.0, (a * b).mean()) / np.sqrt((a * a).mean() * (b * b).mean()))


@pytest.mark.parametrize("kind", ["normal", "ties", "hot", "line"])
@pytest.mark.parametrize("strip", [8, 50, 100000])
def test_dcor(spark, kind, strip):
    x, y = samples(kind)
    got = distances.dcor_points(points(spark, x, y), strip=strip).first().value
    assert got == pytest.approx(dcor(x, y), abs=1e-9)


def ksg(x, y, k=5):
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, np.inf)
    eps = np.sort(d, axis=1)[:, k - 1][:, None]
    inside = lambda m: ((m < eps) | ((eps == 0) & (m == 0))).sum(axis=1) - 1
    nx, ny = inside(dx), inside(dy)
    return max(0.0, digamma(np.array([len(x)]))[0] + digamma(np.array([k]))[0] - np.mean(digamma(nx + 1) + digamma(ny + 1)))


@pytest.mark.parametrize("kind", ["normal", "ties", "hot", "line"])
@pytest.mark.parametrize("cell", [16, 100000])
def test_mutual_information(spark, kind, cell):
    x, y = samples(kind)
    got = neighbors.mutual_information(points(spark, x, y), cell=cell).first().value
    assert got == pytest.approx(ksg(x, y), abs=1e-9)


@pytest.mark.parametrize("metric", ["chebyshev", "euclidean"])
def test_nearest(spark, metric):
    rng = np.random.default_rng(2)
    p = rng.normal(size=(300, 3))
    p[:90, 0] = 0.25
    df = spark.createDataFrame(pd.DataFrame({"k": "g", "id": np.arange(300), "c": p.tolist(), "w": 1}), "k string, id bigint, c array<double>, w bigint")
    got = neighbors.nearest(df, ["k"], 3, metric, cell=12).toPandas().sort_values("id")
    diff = np.abs(p[:, None, :] - p[None, :, :])
    d = diff.max(axis=2) if metric == "chebyshev" else np.sqrt((diff**2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    np.testing.assert_allclose(got["eps"], np.sort(d, axis=1)[:, 2], atol=1e-12)
    np.testing.assert_array_equal(got["nn"], d.argmin(axis=1))


def test_sample_entropy(spark):
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=250), 1)
    df = spark.createDataFrame(pd.DataFrame({"t": np.arange(250), "channel": "c", "value": v}))
    got = neighbors.sample_entropy(df, tolerance=0.35, cell=20).first().value
    m = np.stack([v[:-2], v[1:-1], v[2:]], axis=1)
    d2 = np.abs(m[:, None, :2] - m[None, :, :2]).max(axis=2) < 0.35
    d3 = np.abs(m[:, None] - m[None, :]).max(axis=2) < 0.35
    n = len(m)
    assert got == pytest.approx(-np.log((d3.sum() - n) / (d2.sum() - n)), abs=1e-12)


def spread_points(n, seed, kind):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=n), rng.gamma(0.3, size=n)
    if kind == "ties":
        # one value of the first coordinate, and one of the second, hold a third of the points each
        x[rng.random(n) < 0.33] = 1.0
        y[rng.random(n) < 0.33] = y.max() + 1
    return [(k, [float(a), float(b)]) for k, (a, b) in enumerate(dict.fromkeys(zip(x.tolist(), y.tolist())))]


@pytest.mark.parametrize("kind", ["plain", "ties"])
def test_cells_keep_their_bound(spark, kind):
    largest = {}
    for n in (1500, 15000):
        pts = spark.createDataFrame(spread_points(n, 4, kind), "id bigint, c array<double>").withColumn("k", F.lit("g"))
        tree = kdcells.grow(pts, ["k"], 100)
        sizes = [r["count"] for r in tree.cells.groupBy("leaf").count().collect()]
        assert sum(sizes) == pts.count() and len(sizes) >= n / 100
        largest[n] = max(sizes)
    assert max(largest.values()) <= 100 and min(largest.values()) > 50


def test_counts_in_balls_that_hold_cells(spark):
    pts = spread_points(400, 9, "ties")
    rng = np.random.default_rng(1)
    eps = [float(e) for e in rng.choice([0.0, 0.05, 0.7, 30.0], len(pts))]
    p = spark.createDataFrame([("g", c, k % 3 + 1) for k, c in pts], "k string, c array<double>, w bigint")
    q = spark.createDataFrame([("g", k, c, e) for (k, c), e in zip(pts, eps)], "k string, id bigint, c array<double>, eps double")
    got = {r.id: r["count"] for r in neighbors.ball_counts(p, q, ["k"], cell=12).collect()}
    c, w = np.array([c for _, c in pts]), np.array([k % 3 + 1 for k, _ in pts])
    d = np.abs(c[:, None] - c[None]).max(axis=2)
    for k, e in enumerate(eps):
        assert got[k] == w[(d[k] < e) | ((e == 0) & (d[k] == 0))].sum()


@pytest.mark.parametrize("m", [1, 2])
def test_sample_entropy_counts_like_a_double_loop(spark, m):
    rng = np.random.default_rng(6)
    # sums of the tolerance and values round, a third of the values are one value, and one channel is constant
    series = {"a": np.round(rng.normal(size=130), 1), "b": np.where(rng.random(90) < 0.33, 0.3, rng.random(90) / 10), "c": np.full(40, 1.5), "d": rng.normal(size=19)}
    rows = [(t, c, float(x)) for c, v in series.items() for t, x in enumerate(v)]
    got = {r.channel: r.value for r in neighbors.sample_entropy(spark.createDataFrame(rows, "t bigint, channel string, value double"), m, tolerance=0.3, cell=2).collect()}
    assert got["c"] is None and got["d"] is None
    for c in "ab":
        v = series[c]
        x = np.stack([v[k : len(v) - m + k] for k in range(m + 1)], axis=1)
        close = np.abs(x[:, None] - x[None]) < 0.3
        b, a = close[:, :, :m].all(axis=2).sum() - len(x), close.all(axis=2).sum() - len(x)
        assert got[c] == pytest.approx(-np.log(a / b), abs=1e-12)


def test_nodes_make_up_windows(spark):
    rows = spark.range(12).withColumnRenamed("id", "lo").crossJoin(spark.range(13).withColumnRenamed("id", "hi"))
    for r in rows.select("lo", "hi", neighbors._covering(F.col("lo"), F.col("hi"), 5).alias("n")).collect():
        covered = [x for node in r.n for k, at in [(node >> 48, node & (1 << 48) - 1)] for x in range(at << k, at + 1 << k)]
        assert sorted(covered) == list(range(r.lo, r.hi))


def test_many_matches_cost_no_more_than_few(spark):
    """Rows handled grow like n log^2 n, however many pairs match."""

    def work(n, eps):
        u = np.random.default_rng(2).permutation(n)
        pdf = pd.DataFrame({"k": "g", "w": 1, **{f"{c}{d}": np.roll(u, d) + {"r": 0, "lo": -eps, "hi": eps + 1}[c] for d in range(3) for c in ("r", "lo", "hi")}})
        for d in range(3):
            pdf[f"lo{d}"], pdf[f"hi{d}"] = pdf[f"lo{d}"].clip(lower=0), pdf[f"hi{d}"].clip(upper=n)
        levels = int(n).bit_length()
        df = spark.createDataFrame(pdf)
        for d in range(2):
            df = df.withColumn(f"a{d}", F.size(neighbors._above(F.col(f"r{d}"), levels))).withColumn(f"q{d}", F.size(neighbors._covering(F.col(f"lo{d}"), F.col(f"hi{d}"), levels)))
        r = df.agg(F.sum(F.col("a0") * F.col("a1")), F.sum(2 * F.col("q0") * F.col("q1"))).first()
        return r[0] + r[1]

    # sixteen times the pairs
    assert work(4000, 4000 // 3) < 7 * work(1000, 1000 // 3)

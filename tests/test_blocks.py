"""Block-wise windows, totals, fills, quantiles and ranks against pandas on tiny blocks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.functions import blocks
from weftline.functions.quantiles import median_mad, quantiles
from weftline.functions.ranks import rank_column, value_ranks


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in ("a", "b"):
        v = rng.normal(size=101)
        v[rng.random(101) < 0.3] = np.nan
        rows += [(t, c, None if np.isnan(x) else float(x)) for t, x in enumerate(v)]
    pdf = pd.DataFrame(rows, columns=["t", "channel", "value"])
    return pdf, spark.createDataFrame(rows, "t bigint, channel string, value double")


def collected(df, col):
    p = df.toPandas().sort_values(["channel", "t"])
    return p[col].to_numpy(dtype=float)


def by_channel(pdf, fn):
    return np.concatenate([fn(g["value"]) for _, g in pdf.sort_values(["channel", "t"]).groupby("channel")])


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_rolling_mean(data, size):
    pdf, df = data
    got = blocks.rolling(df, ["channel"], "t", lambda w: {"m": F.avg("value").over(w.rowsBetween(-3, 2))}, 3, 2, size)
    want = by_channel(pdf, lambda s: np.array([np.nanmean(s.to_numpy(float)[max(0, i - 3) : i + 3]) if np.isfinite(s.to_numpy(float)[max(0, i - 3) : i + 3]).any() else np.nan for i in range(len(s))]))
    np.testing.assert_allclose(collected(got, "m"), want, atol=1e-12)


@pytest.mark.parametrize("size", [2, 5, 1000])
def test_running_sum_and_positions(data, size):
    pdf, df = data
    got = blocks.running_sum(df, ["channel"], "t", "value", "s", size)
    np.testing.assert_allclose(collected(got, "s"), by_channel(pdf, lambda s: np.nancumsum(s.to_numpy(float))), atol=1e-12)
    known = df.filter("value IS NOT NULL")
    pos = blocks.positions(known, ["channel"], "t", "p", size).toPandas().sort_values(["channel", "t"])
    for _, g in pos.groupby("channel"):
        assert list(g["p"]) == list(range(len(g)))


@pytest.mark.parametrize("size", [2, 5, 1000])
def test_nearest_known(data, size):
    pdf, df = data
    got = blocks.nearest_known(df, ["channel"], "t", "value", size)
    p, n = collected(got.withColumn("x", F.col("_prev.v")), "x"), collected(got.withColumn("x", F.col("_next.v")), "x")
    np.testing.assert_allclose(p, by_channel(pdf, lambda s: s.astype(float).ffill().to_numpy()))
    np.testing.assert_allclose(n, by_channel(pdf, lambda s: s.astype(float).bfill().to_numpy()))


@pytest.mark.parametrize("kind", ["normal", "ties", "hot", "two", "one"])
def test_quantiles_exact(spark, kind):
    rng = np.random.default_rng(5)
    v = {
        "normal": rng.normal(size=30000),
        "ties": rng.integers(0, 7, 5000).astype(float),
        "hot": np.where(rng.random(20000) < 0.4, 1.5, rng.normal(size=20000)),
        "two": np.array([1.0, 2.0]),
        "one": np.array([4.0]),
    }[kind]
    df = spark.createDataFrame(pd.DataFrame({"k": "g", "v": v}))
    probs = {f"p{i}": p for i, p in enumerate((0.0, 0.005, 0.25, 0.5, 0.731, 0.995, 1.0))}
    row = quantiles(df, ["k"], "v", probs).first()
    for n, p in probs.items():
        assert row[n] == pytest.approx(np.quantile(v, p), abs=1e-12)
    mm = median_mad(df, ["k"], "v").first()
    assert mm.med == pytest.approx(np.median(v), abs=1e-12)
    assert mm.mad == pytest.approx(np.median(np.abs(v - np.median(v))), abs=1e-12)


@pytest.mark.parametrize("ties", ["average", "min", "max", "dense", "first"])
def test_ranks(spark, ties):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"t": np.arange(3000), "channel": "c", "value": np.where(rng.random(3000) < 0.35, 2.0, rng.integers(0, 400, 3000)).astype(float)})
    got = rank_column(spark.createDataFrame(pdf), ["channel"], "value", ties).toPandas().sort_values("t")
    want = pdf["value"].rank(method=ties)
    np.testing.assert_array_equal(got["rank"].to_numpy(), want.to_numpy())
    r = value_ranks(spark.createDataFrame(pdf), [], "value").toPandas()
    assert r["cnt"].sum() == 3000 and r["rmax"].max() == 3000


def test_ranks_deal_groups_by_bucket(spark, tmp_path):
    """A group's values are spread over tasks from the join on, and no value is sent by its group's key alone."""
    import re

    x = np.random.default_rng(5).normal(size=40_000)
    spark.createDataFrame(pd.DataFrame({"g": np.arange(40_000) % 2, "v": x})).write.parquet(f"{tmp_path}/values")
    r = value_ranks(spark.read.parquet(f"{tmp_path}/values"), ["g"], "v")
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(g#\d+L?, _vb#\d+L?, ", plan)
    joined = plan[plan.index("REPARTITION_BY_COL"):].split("\n")
    assert next(line for line in joined if "Join [g#" in line).lstrip(" :+-").startswith("BroadcastHashJoin")
    got = r.toPandas().sort_values(["g", "v"])
    for g in (0, 1):
        d = got[got.g == g]
        assert (d.v.to_numpy() == np.sort(x[g::2])).all() and (d.rmin.to_numpy() == np.arange(1, 20_001)).all()

"""Streams against batches: buckets by event time, late events, correlation in sliding windows."""

import datetime as dt

import numpy as np
import pytest

from weftline.streaming import windows

T0 = dt.datetime(2024, 3, 1)


def stream_of(spark, folder, schema, batches):
    """A stream that reads one file a trigger, in the order of ``batches``."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/b{k:02d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def drained(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.table(name).toPandas()


def test_buckets(spark, tmp_path):
    rng = np.random.default_rng(3)
    schema = "ts timestamp, channel string, value double"

    def events(lo, hi, n=40):
        at = sorted(rng.uniform(lo, hi, n))
        return [(T0 + dt.timedelta(hours=float(h)), str(rng.choice(["a", "b", "other"])), float(rng.normal())) for h in at]

    batches = [events(0, 2), events(2, 4), events(4, 6)]
    late = [(T0 + dt.timedelta(minutes=5), "a", 1e6)]  # hours behind the watermark
    stream = stream_of(spark, tmp_path, schema, [*batches, late, events(6, 8)])
    got = drained(spark, windows.bucket_panel(stream, "ts", "channel", "value", ["a", "b"]), "buckets").sort_values("bucket")
    batch = spark.createDataFrame([e for b in batches for e in b], schema)
    want = windows.bucket_panel(batch, "ts", "channel", "value", ["a", "b"]).toPandas().set_index("bucket")
    # the first hours are closed by the watermark, without the late event
    assert len(got) >= 6 and got.bucket.is_unique
    for r in got.itertuples():
        if r.bucket in want.index:
            for c in ("a", "b"):
                assert getattr(r, c) == pytest.approx(want.loc[r.bucket, c], nan_ok=True)


def test_correlation_in_sliding_windows(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(size=60)
    y = 0.6 * x + rng.normal(size=60)
    z = np.where(np.arange(60) < 30, 1.0, x)
    rows = [(T0 + dt.timedelta(hours=k), float(x[k]), None if k % 7 == 0 else float(y[k]), float(z[k])) for k in range(60)]
    schema = "bucket timestamp, a double, b double, c double"
    stream = stream_of(spark, tmp_path, schema, [rows[:20], rows[20:40], rows[40:]])
    args = ("bucket", [("a", "b"), ("a", "c")], "12 hours", "6 hours")
    got = drained(spark, windows.window_correlation(stream, *args), "correlations")
    want = windows.window_correlation(spark.createDataFrame(rows, schema), *args).toPandas().set_index(["start", "src", "dst"]).value
    assert len(got) >= 12
    for r in got.itertuples():
        k = int((r.start.to_pydatetime() - T0).total_seconds() // 3600)
        at = [i for i in range(max(k, 0), min(k + 12, 60)) if r.dst == "c" or i % 7]
        u, v = x[at], (y if r.dst == "b" else z)[at]
        constant = len(at) < 3 or v.std() < 1e-12
        assert np.isnan(r.value) if constant else r.value == pytest.approx(np.corrcoef(u, v)[0, 1])
        assert r.value == pytest.approx(want[r.start, r.src, r.dst], nan_ok=True)

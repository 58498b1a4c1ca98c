"""Results do not change their meaning with the number of channels, windows or names."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline import Panel
from weftline.operators import reduce, regress, sweep
from weftline.plans import registry
from weftline.plans.config import build_run_spec


def wide(spark, values):
    names = [f"c{k:03d}" for k in range(values.shape[1])]
    return Panel.from_wide(spark.createDataFrame(pd.DataFrame({"t": range(len(values)), **dict(zip(names, values.T.astype(float)))})))


def test_granger_partial_is_one_autoregression_at_any_size(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 60))
    x[1:, 1] += 0.8 * x[:-1, 0]
    got = {(r.src, r.dst): r.value for r in regress.granger_partial(wide(spark, x), 1, pairs=[("c000", "c001"), ("c002", "c001"), ("c005", "c050")]).collect()}
    lagged, now = x[:-1] - x[:-1].mean(0), x[1:] - x[1:].mean(0)
    inv, df = np.linalg.inv(lagged.T @ lagged), len(now) - 61
    for a, b in ((0, 1), (2, 1), (5, 50)):
        beta = inv @ lagged.T @ now[:, b]
        rss = float(((now[:, b] - lagged @ beta) ** 2).sum())
        want = regress.f_sf(float(beta[a] ** 2 / (inv[a, a] * rss / df)), 1, 60 * df)
        assert got[f"c{a:03d}", f"c{b:03d}"] == pytest.approx(want, rel=1e-6, abs=1e-12)
    assert got["c000", "c001"] < 1e-20 and got["c005", "c050"] > 1e-4


def test_too_few_rows_have_no_value(spark):
    x = np.random.default_rng(1).normal(size=(20, 12))
    assert {r.value for r in regress.granger_partial(wide(spark, x), 2).collect()} == {None}


def test_all_pairs_unless_asked(spark):
    panel = Panel(None, tuple(f"c{k}" for k in range(600)))
    assert registry.choose_pairs(panel) is None and registry.choose_pairs(panel, "auto") is None
    assert len(registry.choose_pairs(panel, "random", count=7)) == 7
    with pytest.raises(ValueError):
        registry.choose_pairs(panel, "random")
    with pytest.raises(ValueError):
        registry.choose_pairs(panel, "neighbors")
    assert build_run_spec({}).pair_mode == "full" and build_run_spec({}).window_max_windows is None


def test_every_window_is_scanned(spark):
    x = np.random.default_rng(2).normal(size=(1100, 2))
    got = sorted((r.start, r.metric) for r in sweep.scan_positions(wide(spark, x), "correlation_full", 20, 1).collect())
    assert [s for s, _ in got] == list(range(1081))
    for s in (0, 7, 500, 1080):
        assert got[s][1] == pytest.approx(abs(np.corrcoef(x[s : s + 20].T)[0, 1]), rel=1e-9)


def test_unlisted_channels_stay(spark):
    rows = [(k // 3, ("click", "other", "view")[k % 3], float(k)) for k in range(30)]
    df = spark.createDataFrame(rows, "h long, event_type string, value double")
    assert Panel.from_buckets(df, F.col("h"), "event_type", "mean", "value").channels == ("click", "other", "view")


def test_kmeans_uses_every_row(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(900, 2))
    x = np.concatenate([base[:, [0]] + 0.05 * rng.normal(size=(900, 3)), base[:, [1]] + 0.05 * rng.normal(size=(900, 3))], axis=1)
    got = reduce.kmeans(wide(spark, x), 2, seed=1)
    groups = {}
    for r in got.mapping.collect():
        groups.setdefault(r.target, set()).add(r.source)
    assert sorted(map(sorted, groups.values())) == [["c000", "c001", "c002"], ["c003", "c004", "c005"]]
    with pytest.raises(ValueError):
        reduce.reduce_channels(wide(spark, x), "spatial", 2)


def test_files_of_a_folder_are_read_in_order(spark, tmp_path):
    from weftline.sources.tables import read_csv

    folder = tmp_path / "series.csv"
    folder.mkdir()
    at = 0
    for name, rows in (("a.csv", 5), ("b.csv", 50), ("c.csv", 20)):
        (folder / name).write_text("\n".join(f"{k},{k * 10}" for k in range(at, at + rows)) + "\n")
        at += rows
    got = read_csv(spark, str(folder), "no").orderBy("_row").collect()
    assert [r["_row"] for r in got] == list(range(75)) and [int(r["c1"]) for r in got] == list(range(75))


def test_window_cube_and_post_stage(spark, tmp_path):
    from weftline.plans.analysis import Analysis
    from weftline.sources import sinks

    rng = np.random.default_rng(6)
    x = rng.normal(size=(160, 3))
    x[72:112, 1] = x[70:110, 0] + 0.01 * rng.normal(size=40)
    spec = {"variants": "corr_directed", "window_cube": "full", "window_sizes_grid": "40", "window_stride": 10, "lag_grid": "1,2,3", "include_scans": "no", "lag_selection": "fixed"}
    a = Analysis(wide(spark, x), spec).prepare(interpolate=False, fill=False)
    a.run()
    got = {(r.src, r.dst): r.value for r in a.results["correlation_directed"].collect()}
    assert got["c000", "c001"] > 0.99 and a.contracts["correlation_directed"].lag == 2
    both = Analysis(wide(spark, x), {}).prepare(dimred={"method": "variance", "target_n": 2}, stage="both", normalize="zscore")
    assert len(both.panel.channels) == 2 and any(s.startswith("post:") for s in both.report.steps)
    out = sinks.write_reductions(wide(spark, x), str(tmp_path), [1, 2])
    assert spark.read.parquet(out[2] + "/series").count() == 160 and spark.read.option("header", True).csv(out[1] + "/mapping").count() == 1
    assert '"k": 2' in spark.read.text(out[2] + "/meta").first()[0]


def test_pieces_follow_the_session(spark):
    """With more shuffle partitions ranks and quantiles are cut finer, and stay exact."""
    from weftline.functions.quantiles import quantiles
    from weftline.functions.ranks import value_ranks

    x = np.random.default_rng(8).normal(size=6000)
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "v": x}))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "700")
    try:
        r = value_ranks(df, ["g"], "v").select("v", "rmin", "_vb").toPandas()
        q = quantiles(df, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 0.999}).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert (r.sort_values("v").rmin.to_numpy() == np.arange(1, 6001)).all() and r.groupby("_vb").size().max() < 40
    assert [q.a, q.b, q.c] == pytest.approx(np.quantile(x, [0.1, 0.5, 0.999]).tolist(), rel=1e-12)

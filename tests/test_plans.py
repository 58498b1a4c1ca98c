"""Loading, settings, formulas, runs and exports."""

import csv
import pathlib
import struct
import zipfile
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.panel import Panel
from weftline.plans import analysis, cli, config, formula, registry
from weftline.sources import binary, sinks, tables


def test_csv_header_rules(spark, tmp_path):
    (tmp_path / "h.csv").write_text("time,a,b\n1,10,20\n2,11,21\n")
    (tmp_path / "n.csv").write_text("1,10,20\n2,11,21\n")
    d = tables.read_csv(spark, str(tmp_path / "h.csv"))
    assert d.columns == ["_row", "time", "a", "b"] and d.count() == 2
    d = tables.read_csv(spark, str(tmp_path / "n.csv"), "no")
    assert d.columns == ["_row", "c1", "c2", "c3"] and d.count() == 2


def test_cells_in_one_column(spark, tmp_path):
    (tmp_path / "s.csv").write_text('"1;2;3"\n"4;5;6"\n"7;8;9"\n"1;1;1"\n')
    p = tables.load_panel(spark, str(tmp_path / "s.csv"), time_col="none", transpose="no")
    assert p.channels == ("c1", "c2", "c3") and p.frame.filter("t = 1").first().c2 == 5.0


def test_tidy_drops_time_and_sparse(spark, tmp_path):
    rows = ["stamp,a,b,c"] + [f"2020-01-{i + 1:02d},{(i * 7) % 5},{i if i == 0 else ''},{-i * i}" for i in range(20)]
    (tmp_path / "t.csv").write_text("\n".join(rows))
    p = tables.load_panel(spark, str(tmp_path / "t.csv"), "yes")
    assert p.channels == ("a", "c") and p.length() == 20


def test_data_column_is_not_time(spark, tmp_path):
    (tmp_path / "d.csv").write_text("x,y\n" + "\n".join(f"{(i * 37) % 11},{i % 3}" for i in range(30)))
    assert tables.load_panel(spark, str(tmp_path / "d.csv")).channels == ("x", "y")


def test_grid(spark):
    rows = [(0, 1, 2, 3, 10.0, 30.0, 20.0), (1, 1, 2, 3, 11.0, 31.0, 21.0), (2, 4, 5, 6, 12.0, 32.0, 22.0)]
    df = spark.createDataFrame(rows, ["_row", "x", "y", "z", "t0", "t10", "t2"])
    long, coords = tables.grid_to_long(df)
    got = {(r.channel, r.t): r.value for r in long.collect()}
    assert got[("v0000_x1_y2_z3", 1)] == 20.0 and got[("v0000_x1_y2_z3", 2)] == 30.0
    assert {r.channel: r.coord_duplicate for r in coords.collect()}["v0002_x4_y5_z6"] == 0


def mat_file(name: str, a: np.ndarray, compressed: bool) -> bytes:
    def element(kind, data):
        return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)

    body = element(6, struct.pack("<II", 6, 0)) + element(5, struct.pack("<ii", *a.shape)) + element(1, name.encode()) + element(9, a.astype("<f8").tobytes(order="F"))
    block = element(14, body)
    if compressed:
        z = zlib.compress(block)
        block = struct.pack("<II", 15, len(z)) + z
    return b"MATLAB 5.0".ljust(124, b" ") + struct.pack("<H", 0x0100) + b"IM" + block


@pytest.mark.parametrize("compressed", [False, True])
def test_mat(spark, tmp_path, compressed):
    a = np.arange(12.0).reshape(3, 4)
    (tmp_path / "m.mat").write_bytes(mat_file("conn", a, compressed))
    np.testing.assert_array_equal(binary.mat_matrix((tmp_path / "m.mat").read_bytes()), a)
    p = tables.load_panel(spark, str(tmp_path / "m.mat"), time_col="none", transpose="no")
    assert p.length() == 3 and len(p.channels) == 4


def test_workbook_round_trip(spark, tmp_path):
    path = str(tmp_path / "w.xlsx")
    sinks.write_workbook(path, {"data": (["a", "b"], [[1.5, 2], [3.5, None], [4.5, 6]])})
    d = tables.read_table(spark, path)
    assert d.columns == ["_row", "a", "b"]
    assert [r.a for r in d.orderBy("_row").collect()] == ["1.5", "3.5", "4.5"]


def test_settings():
    assert config.parse_user_input("") == {}
    assert config.parse_user_input("preset=causal; max_lag=10; window_sizes=128,256")["window_sizes"] == "128,256"
    assert config.parse_user_input('{"preset":"basic","max_lag":7}') == {"preset": "basic", "max_lag": 7}
    assert config.parse_user_input("{'a': 1}") == {"a": 1}
    assert config.parse_user_input("causal") == {"preset": "causal"}
    s = config.build_run_spec({"variants": "mutinf_full, te_directed", "window_sizes": "256,512", "window_stride": "64", "window_policy": "odd"})
    assert s.variants == ["mutinf_full", "te_directed"] and s.window_sizes == [256, 512] and s.window_stride == 64
    assert s.max_lag == 12 and s.window_policy == "best" and "main_windows=[256, 512]" in s.explain()
    assert config.as_list([("corr_full", "label"), ("te_directed", "label")]) == ["corr_full", "te_directed"]
    names, note = config.expand_variants(["basic", "te_directed", "basic"])
    assert names.count("correlation_full") == 1 and "te_full" in names and "basic" in note


def test_registry(spark):
    p = Panel.from_wide(spark.createDataFrame(pd.DataFrame({"t": [0, 1, 2, 3], "x": [0.0, 1.0, 3.0, 2.0], "y": [0.0, 1.0, 2.0, 5.0]})))
    assert len(registry.METHODS) == 22
    assert registry.is_p_value("granger_full") and registry.is_directed("ah_full") and not registry.is_directed("dcor_full")
    with pytest.raises(ValueError):
        registry.compute(p, "nothing_full")
    registry.register_column_metric("mean_gap", lambda: F.avg(F.abs(F.col("x") - F.col("y"))))
    registry.register_array_metric("last_gap", lambda x, y: x[-1] - y[-1])
    try:
        assert registry.compute(p, "mean_gap").first().value == pytest.approx(1.0)
        assert registry.compute(p, "last_gap").first().value == -3.0
    finally:
        registry.METHODS.pop("mean_gap")
        registry.METHODS.pop("last_gap")


def state_metric(spark, panel, parts, **kinds):
    registry.register_state_metric("own", *parts, **kinds)
    try:
        return {(r.src, r.dst): r.value for r in registry.compute(panel, "own", 2).collect()}
    finally:
        registry.METHODS.pop("own")


COVARIANCE = (
    lambda: np.zeros(4),
    lambda s, x, y: s + [len(x), x.sum(), y.sum(), x @ y],
    lambda a, b: a + b,
    lambda s: s[3] / s[0] - s[1] * s[2] / s[0] ** 2 if s[0] else None,
)


@pytest.mark.parametrize("block", [3, 10_000])
def test_metrics_with_a_state(spark, monkeypatch, block):
    from weftline.plans.catalog.tables import SIGN_CHANGES

    monkeypatch.setattr(registry, "MERGED", 4)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(200, 3))
    v[rng.random(v.shape) < 0.2] = np.nan
    v[:, 2] = np.nan
    pdf = pd.DataFrame(v, columns=["a", "b", "none"])
    pdf.insert(0, "t", np.arange(200))
    panel = Panel.from_wide(spark.createDataFrame(pdf).repartition(7), ["a", "b", "none"], block=block)
    both = np.isfinite(v[:, 0]) & np.isfinite(v[:, 1])
    x, y = v[both, 0], v[both, 1]
    got = state_metric(spark, panel, COVARIANCE)
    assert got["a", "b"] == pytest.approx(np.cov(x, y, ddof=0)[0, 1]) and got["a", "none"] is None and len(got) == 3
    got = state_metric(spark, panel, SIGN_CHANGES, ordered=True)
    assert got["a", "b"] == pytest.approx(np.count_nonzero(np.diff(np.sign(x - y))) / (len(x) - 1))
    got = state_metric(spark, panel, COVARIANCE, directed=True, shifts=True)
    x, y = v[:-2, 1], v[2:, 0]
    both = np.isfinite(x) & np.isfinite(y)
    assert got["b", "a"] == pytest.approx(np.cov(x[both], y[both], ddof=0)[0, 1]) and len(got) == 6


def test_a_state_over_many_rows(spark):
    n = 10_000_000
    df = spark.range(n).select(F.col("id").alias("t"), (F.col("id") % 1000).cast("double").alias("a"), ((F.col("id") * 7) % 1009).cast("double").alias("b"))
    got = state_metric(spark, Panel(df, ("a", "b")), COVARIANCE)
    t = np.arange(n)
    assert got["a", "b"] == pytest.approx(np.cov(t % 1000, t * 7 % 1009, ddof=0)[0, 1], rel=1e-9)


def test_identity_and_gaps(spark):
    p = Panel.from_wide(spark.createDataFrame(pd.DataFrame({"t": range(4), "a": [1, 2, np.nan, 4], "b": [1.0, 2.0, 3.0, 4.0], "k": [5.0] * 4})))
    got = {(r.src, r.dst): r.value for r in registry.compute(p, "correlation_full").collect()}
    assert got[("a", "b")] == pytest.approx(1.0) and got[("a", "k")] is None


def test_short_series_do_not_fail(spark):
    p = Panel.from_wide(spark.createDataFrame(pd.DataFrame({"t": [0, 1], "a": [1.0, 2.0], "b": [1.0, 2.0]})))
    assert {r.value for r in registry.compute(p, "granger_full", 5).collect()} == {1.0}
    assert {r.value for r in registry.compute(p, "mutinf_full").collect()} == {0.0}
    assert {r.value for r in registry.compute(p, "dcor_full").collect()} == {0.0}


def test_pairs():
    names = ["a", "b", "c-d"]
    assert registry.parse_pairs("a-b; b->a, 0-2; a-a; q-b; a-c-d", names) == [("a", "b"), ("b", "a"), ("a", "c-d")]
    from weftline.operators.graph import random_pairs

    assert len(random_pairs(["a", "b", "c"], 50)) == 3 and len(set(random_pairs([str(i) for i in range(50)], 40, 1))) == 40


def test_formulas(spark):
    texts = {"A": "sin(2*pi*t/50)", "B": "0.8*A + 0.01*t", "C": "clip(minimum(B, 1.5), -0.5, maximum(A, 0.5))", "D": "t % 7 + t // 3 - 2**3", "E": "where(t % 2, A, -B)"}
    got = formula.formula_dataset(spark, 120, specs=[formula.FormulaSpec(k, v) for k, v in texts.items()]).frame.toPandas().sort_values("t")
    t = np.arange(120)
    a = np.sin(2 * np.pi * t / 50)
    b = 0.8 * a + 0.01 * t
    want = {"A": a, "B": b, "C": np.clip(np.minimum(b, 1.5), -0.5, np.maximum(a, 0.5)), "D": t % 7 + t // 3 - 8, "E": np.where(t % 2, a, -b)}
    for k, v in want.items():
        np.testing.assert_allclose(got[k], v, atol=1e-12)


@pytest.mark.parametrize("text", ["t.real", "t[0]", "t > 1", "lambda: 1", "'a'", "unknown", "__import__('os')", "ar1(t)", "sin("])
def test_formula_rejects(spark, text):
    with pytest.raises(formula.UnsafeFormulaError):
        formula.formula_dataset(spark, 10, specs=[formula.FormulaSpec("A", text)])


def test_ar1_across_blocks(spark):
    df = spark.range(50).select(F.col("id").alias("t"), F.sin("id").alias("e"))
    got = [r.e for r in formula.autoregress(df, "e", 0.8, size=7).orderBy("t").collect()]
    x, want = 0.0, []
    for i in range(50):
        x = 0.8 * x + (0.0 if i == 0 else np.sin(i))
        want.append(x)
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_generators(spark):
    c = formula.coupled_system(spark, 600)
    assert c.frame.count() == 550 and c.channels[0] == "Source (X)"
    from weftline.operators.moments import lagged_correlation

    got = {(r.src, r.dst): r.value for r in lagged_correlation(c, [1], [("Source (X)", "Target (Y)"), ("Target (Y)", "Source (X)")]).collect()}
    assert got[("Source (X)", "Target (Y)")] > 0.6
    assert formula.chain_system(spark, 100).frame.count() == 50
    assert formula.random_walks(spark, 2, 30).frame.count() == 30
    assert formula.independent_ar1(spark, 2, 30).channels == ("AR1_1", "AR1_2")


def test_input_files(tmp_path):
    (tmp_path / "nested").mkdir()
    for n in ("a.csv", "b.xlsx", "nested/c.mat", "nested/ignore.txt"):
        (tmp_path / n).write_text("x")
    assert [pathlib.Path(p).name for p in tables.input_files(str(tmp_path))] == ["a.csv", "b.xlsx"]
    assert len(tables.input_files(str(tmp_path), True)) == 3


def test_command_line(spark, tmp_path):
    rng = np.random.default_rng(0)
    src = tmp_path / "in"
    src.mkdir()
    np.savetxt(src / "good.csv", rng.normal(size=(80, 3)), delimiter=",")
    (src / "bad.mat").write_bytes(b"nothing")
    out = str(tmp_path / "out")
    rows = cli.main([str(src), "--output-dir", out, "--batch-zip", "--p-alpha", "0.01", "--pvalue-correction", "fdr_bh", "--user-config", "variants=corr_full,corr_directed; window_sizes=30; window_sizes_grid=20,40; max_lag=3"], spark)
    assert [r["status"] for r in rows] == ["error", "ok"]
    with open(pathlib.Path(out) / "batch_manifest.csv") as f:
        assert csv.DictReader(f).fieldnames == list(sinks.MANIFEST)
    run = pathlib.Path(out) / "good"
    assert "correlation_directed" in (run / "report.html").read_text()
    assert (run / "manifest.json").exists() and (run / "report.xlsx").exists()
    assert any(n.endswith("batch_manifest.csv") for n in zipfile.ZipFile(out + ".zip").namelist())


def test_run_keeps_contracts(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=200)
    pdf = pd.DataFrame({"t": range(200), "X": x, "Y": np.r_[rng.normal(size=2), x[:-2]] + 0.1 * rng.normal(size=200)})
    a = analysis.Analysis(Panel.from_wide(spark.createDataFrame(pdf)), {"variants": "corr_directed,granger_full", "max_lag": 5, "pvalue_correction": "fdr_bh"})
    a.prepare()
    a.run()
    assert a.contracts["correlation_directed"].lag == 2
    got = {(r.src, r.dst): r.value for r in a.results["correlation_directed"].collect()}
    assert got[("X", "Y")] > 0.9
    assert a.contracts["granger_full"].correction == "fdr_bh"
    assert set(a.scans["correlation_directed"]) == {"window_pos", "window_size", "lag", "cube", "cube_edges", "gallery"}
    table, world = a.graph("correlation_directed", 0.5)
    assert world["density"] == 0.5 and not world["is_connected"]


def test_many_channels_use_explodes(spark, monkeypatch):
    from weftline import panel as panel_module

    rng = np.random.default_rng(2)
    a = rng.normal(size=(40, 4))
    a[3, 1] = np.nan
    p = Panel.from_wide(spark.createDataFrame(pd.DataFrame({"t": range(40), **{f"c{i}": a[:, i] for i in range(4)}})))
    few = {d: sorted(map(tuple, p.pair_points(d, None, (1, 2) if d else (0,)).collect())) for d in (False, True)}
    monkeypatch.setattr(panel_module, "MANY_CHANNELS", 2)
    many = {d: sorted(map(tuple, p.pair_points(d, None, (1, 2) if d else (0,)).collect())) for d in (False, True)}
    assert few == many

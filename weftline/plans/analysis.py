"""One analysis run: load, clean, measure, sweep, summarise, export."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import clean, diagnostics, graph, reduce, regress, stl, sweep
from weftline.panel import Panel
from weftline.plans import registry
from weftline.plans.config import RunSpec, build_run_spec, expand_variants
from weftline.session import staged


@dataclass
class Report:
    """What preprocessing did."""

    enabled: bool = True
    steps: list[str] = field(default_factory=list)
    dropped_channels: list[str] = field(default_factory=list)
    notes: dict[str, Any] = field(default_factory=dict)


@dataclass
class Contract:
    """How one result was computed."""

    variant: str
    channels: list[str]
    length: int
    lag: int
    lag_selection: str
    directed: bool
    p_value: bool
    controls: list[str]
    pairs: int | None
    preprocessing: list[str]
    correction: str = "none"
    warnings: list[str] = field(default_factory=list)

    def as_dict(self) -> dict:
        return asdict(self)

    def summary(self) -> str:
        return (
            f"{self.variant}: {len(self.channels)} channels x {self.length}, lag {self.lag} ({self.lag_selection}), "
            f"controls {','.join(self.controls) or '-'}, correction {self.correction}"
            + "".join(f"\n  warning: {w}" for w in self.warnings)
        )


def preprocess(
    panel: Panel,
    near_constant: float | None = 0.05,
    auto_log: bool = False,
    fill: bool = True,
    log: bool = False,
    outlier_rule: str | None = None,
    outlier_action: str = "mask",
    outlier_args: dict | None = None,
    interpolate: bool = True,
    ar_order: int = 0,
    deseason: bool = False,
    season_period: int | None = None,
    season_args: dict | None = None,
    normalize: str = "none",
) -> tuple[Panel, Report]:
    """The cleaning chain in its fixed order; each enabled step is one lazy transform."""
    rep = Report()
    long = panel.long()
    kept = list(panel.channels)
    if near_constant:
        good = {r.channel for r in clean.distinct_fraction(long).filter(F.col("uniq_frac") >= near_constant).select("channel").collect()}
        rep.dropped_channels = [c for c in kept if c not in good]
        kept = [c for c in kept if c in good]
        long = panel.select(kept).long()
        rep.steps.append("near_constant")
    chain: list[tuple[bool, str, Callable[[DataFrame], DataFrame]]] = [
        (auto_log, "auto_log", clean.auto_log),
        (fill, "fill_mean", clean.fill_mean),
        (log, "log", clean.log_positive),
        (bool(outlier_rule), f"outliers:{outlier_rule}:{outlier_action}", lambda d: clean.outliers(d, outlier_rule, outlier_action, **(outlier_args or {}))),
        (interpolate, "interpolate", clean.fill_linear),
        (ar_order > 0, f"prewhiten:{ar_order}", lambda d: regress.prewhiten(staged(d), ar_order)),
        (deseason, f"deseason:{season_period or 'auto'}", lambda d: stl.remove_seasonality(staged(d), season_period, **(season_args or {}))),
        (normalize not in ("none", "", None), f"normalize:{normalize}", lambda d: clean.normalize(d, normalize)),
    ]
    for on, name, step in chain:
        if on:
            long = step(long)
            rep.steps.append(name)
    complete = interpolate or (fill and not outlier_rule)
    out = Panel.from_long(long, kept, panel.block, complete)
    return Panel(staged(out.frame), out.channels, out.block, complete), rep


def auto_difference(panel: Panel, alpha: float = 0.05) -> tuple[Panel, list[str]]:
    """Difference and standardise channels whose unit-root test does not reject."""
    p = regress.adf(panel.long()).filter(F.col("pvalue") > alpha).select("channel").collect()
    names = sorted(r.channel for r in p)
    if not names:
        return panel, []
    out = Panel.from_long(clean.difference_standardized(panel.long(), names), panel.channels, panel.block, panel.complete)
    return Panel(staged(out.frame), out.channels, out.block, panel.complete), names


class Analysis:
    """A panel with its settings; every result is a DataFrame."""

    def __init__(self, panel: Panel, spec: RunSpec | dict | None = None, coords: DataFrame | None = None, progress: Callable[[str], None] | None = None):
        self.raw = panel
        self.panel = panel
        self.coords = coords
        self.spec = spec if isinstance(spec, RunSpec) else build_run_spec(spec or {})
        self.report = Report(enabled=False)
        self.results: dict[str, DataFrame] = {}
        self.contracts: dict[str, Contract] = {}
        self.scans: dict[str, dict[str, DataFrame]] = {}
        self.progress = progress or (lambda message: None)

    @classmethod
    def from_file(cls, spark: SparkSession, path: str, spec: RunSpec | dict | None = None, **load) -> Analysis:
        from weftline.sources.tables import load_panel

        return cls(load_panel(spark, path, **load), spec)

    def prepare(self, auto_diff: bool = False, dimred: dict | None = None, stage: str = "pre", **options) -> Analysis:
        """Clean, difference and reduce; ``stage`` (pre, post or both) tells on which side of the reduction to clean."""
        given = {**self.spec.preprocess_options, **options}
        stage = given.pop("stage", stage)
        if stage not in ("pre", "post", "both"):
            raise ValueError(f"unknown preprocessing stage {stage!r}")
        if self.spec.preprocess and (stage != "post" or not dimred):
            self.panel, self.report = preprocess(self.raw, **given)
        if auto_diff:
            self.panel, names = auto_difference(self.panel)
            self.report.notes["differenced"] = names
        if dimred:
            got = reduce.reduce_channels(self.panel, coords=self.coords, **dimred)
            self.panel = got.panel
            self.mapping = got.mapping
            self.report.notes["dimred"] = got.meta
            if self.spec.preprocess and stage != "pre":
                notes, steps = self.report.notes, self.report.steps
                self.panel, self.report = preprocess(self.panel, **given)
                self.report.notes.update(notes)
                self.report.steps = [*steps, *(f"post:{x}" for x in self.report.steps)]
        self.progress("prepared")
        return self

    def _options(self, variant: str) -> dict:
        s = self.spec
        base = {
            "lag": s.lag, "lag_selection": s.lag_selection, "max_lag": s.max_lag, "partial_mode": s.partial_mode,
            "pairwise_policy": s.pairwise_policy, "custom_controls": s.custom_controls or (), "control_strategy": s.control_strategy,
            "control_pca_k": s.control_pca_k, "pair_mode": s.pair_mode, "pair_count": s.pair_count, "window_sizes": s.window_sizes, "window_policy": s.window_policy,
        }
        return {**base, **((s.method_options or {}).get(variant) or {})}

    def choose_lag(self, variant: str, max_lag: int, pairs=None, **args) -> int:
        """Best lag by mean strength; one pass over all lags where the method allows it."""
        m = registry.method(variant)
        lags = list(range(1, max_lag + 1))
        if variant in sweep.POINT_METRICS:
            edges = sweep.lag_edges(self.panel, variant, lags, pairs)
        else:
            edges = None
            for lag in lags:
                one = registry.compute(self.panel, variant, lag, pairs=pairs, **args).withColumn("lag", F.lit(lag))
                edges = one if edges is None else edges.unionByName(one)
        row = sweep.best_lag(edges, m.p_value).first()
        return int(row.lag) if row and row.lag else 1

    def run(self, variants: Sequence[str] | None = None) -> dict[str, DataFrame]:
        names, _ = expand_variants(variants or self.spec.variants)
        for name in names:
            self.results[name] = self.run_one(name)
            self.progress(name)
        return self.results

    def run_one(self, variant: str) -> DataFrame:
        o = self._options(variant)
        m = registry.method(variant)
        pairs = registry.choose_pairs(self.panel, o["pair_mode"], o.get("pairs", ""), self.coords, count=o.get("pair_count"), directed=m.directed)
        args = {k: o[k] for k in ("partial_mode", "pairwise_policy", "custom_controls", "control_strategy", "control_pca_k")}
        notes = []
        lag = 1
        if m.supports_lag:
            lag = max(1, int(o["lag"]))
            if o["lag_selection"] == "optimize" and not m.p_value:
                lag = self.choose_lag(variant, int(o["max_lag"]), pairs, **args)
        s = self.spec
        if s.window_cube_level != "off" and variant in sweep.POINT_METRICS:
            # basic: every window at the chosen lag; full: every window and lag
            lags = s.lags() if s.window_cube_level == "full" else [lag]
            grid = {"start_min": s.window_start_min, "start_max": s.window_start_max, "max_windows": s.window_max_windows}
            edges, best = sweep.main_cube(self.panel, variant, s.sizes(), lags, s.window_stride, pairs, s.window_cube_eval_limit, **grid)
            if at := best.first():
                lag = int(at.lag)
                notes.append(f"main window cube: size {at.window_size}, lag {at.lag}, start {at.start}")
        elif o["window_sizes"] and o["window_policy"] in ("best", "mean") and variant in sweep.POINT_METRICS:
            edges = sweep.main_windows(self.panel, variant, o["window_sizes"], o["window_policy"], self.spec.window_stride, lag, pairs)
        else:
            edges = registry.compute(self.panel, variant, lag, o.get("control"), pairs, **args)
            if o["window_sizes"] and o["window_policy"] in ("best", "mean"):
                notes.append("window policy does not apply to this method")
        if m.p_value and self.spec.pvalue_correction == "fdr_bh":
            edges = registry.corrected(edges)
        self.contracts[variant] = Contract(
            variant, list(self.panel.channels), self.panel.length(), lag, o["lag_selection"] if m.supports_lag else "none",
            m.directed, m.p_value, list(o["custom_controls"] or ()), None if pairs is None else len(pairs), self.report.steps,
            self.spec.pvalue_correction if m.p_value else "none", notes,
        )
        if self.spec.include_scans and variant in sweep.POINT_METRICS:
            self.scans[variant] = self.scan(variant, lag, pairs)
        return edges

    def scan(self, variant: str, lag: int = 1, pairs=None) -> dict[str, DataFrame]:
        s = self.spec
        grid = {"start_min": s.window_start_min, "start_max": s.window_start_max, "max_windows": s.window_max_windows}
        out: dict[str, DataFrame] = {}
        if s.scan_window_pos:
            out["window_pos"] = sweep.scan_positions(self.panel, variant, s.window_size, s.window_stride, lag, pairs, **grid)
        if s.scan_window_size:
            out["window_size"] = sweep.scan_sizes(self.panel, variant, s.sizes(), s.window_stride, lag, pairs, **grid)
        if s.scan_lag and registry.is_directed(variant):
            out["lag"] = sweep.scan_lags(self.panel, variant, s.lags(), pairs)
        if s.scan_cube:
            edges = sweep.cube_edges(
                self.panel, variant, s.sizes(), s.lags(), s.window_stride, pairs, s.cube_combo_limit, s.cube_eval_limit, **grid
            )
            edges = staged(edges)
            points = sweep.cube_points(edges, registry.is_p_value(variant))
            out["cube"] = points
            out["cube_edges"] = edges
            out["gallery"] = sweep.gallery(points, s.cube_gallery_mode, s.cube_gallery_k, s.cube_gallery_limit)
        return out

    def summaries(self, alpha: float = 0.05, threshold: float = 0.2) -> DataFrame:
        """``variant, src, dst, value, flag`` over all results."""
        out = None
        for name, edges in self.results.items():
            one = graph.pair_flags(edges, threshold, alpha, registry.is_p_value(name)).withColumn("variant", F.lit(name))
            out = one if out is None else out.unionByName(one)
        return out.select("variant", "src", "dst", "value", "flag")

    def nodes(self) -> DataFrame:
        return self.panel.frame.sparkSession.createDataFrame([(c,) for c in self.panel.channels], "name string")

    def graph(self, variant: str, threshold: float = 0.2):
        m = registry.method(variant)
        return graph.topology(self.results[variant], self.nodes(), threshold, m.directed, m.p_value)

    def quality(self) -> DataFrame:
        return diagnostics.quality_table(self.raw.long(), self.coords)

    def diagnostics(self) -> DataFrame:
        return diagnostics.diagnostics(self.panel.long())

    def run_summary(self) -> str:
        lines = [self.spec.explain(), f"preprocessing: {', '.join(self.report.steps) or '-'}"]
        lines += [c.summary() for c in self.contracts.values()]
        return "\n".join(lines)

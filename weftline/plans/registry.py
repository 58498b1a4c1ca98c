"""Connectivity methods by name, their properties, and the dispatcher."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import distances, graph, information, moments, neighbors, regress, spectral
from weftline.panel import Panel
from weftline.plans.config import ALIASES
from weftline.session import spread, staged

MERGED = 64  # states merged at a time


@dataclass(frozen=True)
class Context:
    """What a method may use besides the panel."""

    lag: int = 1
    control: tuple[str, ...] | None = None
    pairs: tuple[tuple[str, str], ...] | None = None
    extra: dict[str, Column] = field(default_factory=dict)
    k: int = 5
    bins: int = 8


Builder = Callable[[Panel, Context], DataFrame]


@dataclass(frozen=True)
class Method:
    build: Builder
    directed: bool = False
    p_value: bool = False

    @property
    def supports_lag(self) -> bool:
        return self.directed


def _residual(panel: Panel, c: Context) -> Panel:
    """Residuals on shared regressors, or on named controls, which then leave the panel."""
    res = moments.residualize(panel, c.control or (), dict(c.extra))
    return res.select([x for x in res.channels if x not in (c.control or ())])


def _if_extra(with_extra: Builder, without: Builder) -> Builder:
    return lambda p, c: with_extra(_residual(p, c), c) if c.extra else without(p, c)


def _partial_corr(p: Panel, c: Context) -> DataFrame:
    return moments.partial_correlation(p, c.control, c.pairs, c.extra)


def _lagged(p: Panel, c: Context) -> DataFrame:
    return moments.lagged_correlation(p, [max(1, c.lag)], c.pairs).select("src", "dst", "value")


def _te_partial(p: Panel, c: Context) -> DataFrame:
    return information.transfer_entropy(moments.residual_points(p, True, c.control, c.pairs), c.lag, c.bins)


METHODS: dict[str, Method] = {
    "correlation_full": Method(lambda p, c: moments.correlation(p, c.pairs)),
    "correlation_partial": Method(_partial_corr),
    "correlation_directed": Method(_lagged, directed=True),
    "h2_full": Method(lambda p, c: moments.squared(moments.correlation(p, c.pairs))),
    "h2_partial": Method(lambda p, c: moments.squared(_partial_corr(p, c))),
    "h2_directed": Method(lambda p, c: moments.squared(_lagged(p, c)), directed=True),
    "mutinf_full": Method(lambda p, c: neighbors.mutinf_full(p, c.k, c.pairs)),
    "mutinf_partial": Method(
        _if_extra(lambda p, c: neighbors.mutinf_full(p, c.k, c.pairs), lambda p, c: neighbors.mutinf_partial(p, c.control, c.k, c.pairs))
    ),
    "coherence_full": Method(lambda p, c: spectral.coherence_full(p, c.pairs)),
    "coherence_partial": Method(lambda p, c: spectral.coherence_partial(p, c.control or (), c.pairs, dict(c.extra))),
    "granger_full": Method(lambda p, c: regress.granger_full(p, c.lag, c.pairs), directed=True, p_value=True),
    "granger_partial": Method(
        lambda p, c: regress.granger_partial(p, c.lag, c.control, c.pairs, dict(c.extra)), directed=True, p_value=True
    ),
    "te_full": Method(lambda p, c: information.te_full(p, c.lag, c.bins, c.pairs), directed=True),
    "te_partial": Method(
        _if_extra(lambda p, c: information.te_full(p, c.lag, c.bins, c.pairs), _te_partial), directed=True
    ),
    "dcor_full": Method(lambda p, c: distances.dcor_full(p, c.pairs)),
    "dcor_partial": Method(
        _if_extra(lambda p, c: distances.dcor_full(p, c.pairs), lambda p, c: distances.dcor_partial(p, c.control, c.pairs))
    ),
    "dcor_directed": Method(lambda p, c: distances.dcor_directed(p, c.lag, c.pairs), directed=True),
    "ordinal_full": Method(lambda p, c: information.ordinal_full(p, pairs=c.pairs)),
    "ordinal_directed": Method(lambda p, c: information.ordinal_directed(p, c.lag, pairs=c.pairs), directed=True),
    "ah_full": Method(lambda p, c: neighbors.ah_full(p, pairs=c.pairs), directed=True),
    "ah_partial": Method(lambda p, c: neighbors.ah_partial(p, c.lag, c.control, pairs=c.pairs), directed=True),
    "ah_directed": Method(lambda p, c: neighbors.ah_directed(p, c.lag, pairs=c.pairs), directed=True),
}

PAIRWISE = ("correlation_partial", "h2_partial", "mutinf_partial")


def method(name: str) -> Method:
    name = ALIASES.get(name, name)
    if name not in METHODS:
        raise ValueError(f"unknown method {name!r}")
    return METHODS[name]


def is_directed(name: str) -> bool:
    return method(name).directed


def is_p_value(name: str) -> bool:
    return method(name).p_value


def is_control_sensitive(name: str) -> bool:
    return name.endswith("_partial")


def register_metric(name: str, build: Builder, directed: bool = False, p_value: bool = False) -> None:
    """Add a method: ``build(panel, context)`` returns ``src, dst, value``."""
    METHODS[name] = Method(build, directed, p_value)


def register_column_metric(name: str, value: Callable[[], Column], directed: bool = False, shifts: bool = False) -> None:
    """Add a method given as an aggregate expression over the point columns x and y."""

    def build(p: Panel, c: Context) -> DataFrame:
        pts = p.pair_points(directed, c.pairs, [max(1, c.lag)] if shifts else (0,))
        return pts.groupBy("src", "dst").agg(value().alias("value"))

    register_metric(name, build, directed)


def register_state_metric(
    name: str, init: Callable, update: Callable, merge: Callable, finish: Callable, directed: bool = False, shifts: bool = False, ordered: bool = False
) -> None:
    """Add a method given as a mergeable state, a flat numpy array of doubles, so that no task needs a whole series.

    ``init() -> state``, ``update(state, x, y) -> state`` for a batch of complete points, ``merge(a, b) -> state``
    and ``finish(state) -> float``.  With ``ordered`` points come in time order and ``a`` lies before ``b``;
    otherwise in any order.  States of time blocks (or of tasks) are merged sixty-four at a time.
    """

    def build(p: Panel, c: Context) -> DataFrame:
        todo = p.pair_list(directed, c.pairs)
        rank = {x: i for i, x in enumerate(p.channels)}
        lag = max(1, c.lag) if shifts else 0
        frame = p.shifted([lag]) if lag else p.frame
        k = len(p.channels)
        values = [*p.channels, *(f"{x}@{lag}" for x in p.channels)] if lag else list(p.channels)
        rows = frame.select(F.floor(F.col("t") / p.block).cast("bigint").alias("blk"), "t", *[F.col(f"`{x}`").alias(f"v{i}") for i, x in enumerate(values)])
        if ordered:
            rows = spread(rows, "blk").sortWithinPartitions("blk", "t")
        slots = [(rank[a], rank[b] + (k if lag else 0)) for a, b in todo]
        width = len(values)

        def fold(batches):
            import pyarrow as pa
            from pyspark import TaskContext

            task = TaskContext.get().partitionId()
            states, at = None, None

            def out():
                return pa.RecordBatch.from_arrays(
                    [pa.array(range(len(slots)), pa.int32()), pa.array([at] * len(slots), pa.int64()), pa.array([np.asarray(x, float).tolist() for x in states], pa.list_(pa.float64()))], names=["pair", "blk", "state"]
                )

            for batch in batches:
                blk = batch.column("blk").to_numpy(zero_copy_only=False) if ordered else np.full(batch.num_rows, task)
                v = [batch.column(f"v{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(width)]
                cuts = np.flatnonzero(np.diff(blk)) + 1
                for lo, hi in zip([0, *cuts], [*cuts, len(blk)]):
                    if hi == lo:
                        continue
                    if at is not None and blk[lo] != at:
                        yield out()
                        states = None
                    at = int(blk[lo])
                    states = states or [init() for _ in slots]
                    for q, (i, j) in enumerate(slots):
                        x, y = v[i][lo:hi], v[j][lo:hi]
                        both = np.isfinite(x) & np.isfinite(y)
                        if both.any():
                            states[q] = update(states[q], x[both], y[both])
            if states:
                yield out()

        def joined(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("blk")
            state = np.asarray(pdf.state.iloc[0], float)
            for other in pdf.state.iloc[1:]:
                state = merge(state, np.asarray(other, float))
            return pd.DataFrame({"pair": pdf.pair.iloc[:1], "blk": pdf.blk.iloc[:1] // MERGED, "state": [np.asarray(state, float).tolist()]})

        schema = "pair int, blk bigint, state array<double>"
        states = staged(rows.mapInArrow(fold, schema))
        while (states.agg(F.max("blk")).first()[0] or 0) > 0:
            held = states.withColumn("part", F.floor(F.col("blk") / MERGED))
            states = staged(held.groupBy("pair", "part").applyInPandas(lambda pdf: joined(pdf.drop(columns="part")), schema))
        names = rows.sparkSession.createDataFrame([(q, a, b) for q, (a, b) in enumerate(todo)], "pair int, src string, dst string")

        def last(pdfs):
            for pdf in pdfs:
                yield pd.DataFrame({"pair": pdf.pair, "value": [finish(np.asarray(x, float)) for x in pdf.state]})

        return names.join(states.select("pair", "state").mapInPandas(last, "pair int, value double"), "pair", "left").select("src", "dst", "value")

    register_metric(name, build, directed)


def register_array_metric(name: str, fn: Callable, directed: bool = False, shifts: bool = False) -> None:
    """Add a method given as ``fn(x, y) -> float`` over whole series in time order.

    Such a function needs each pair's points in one place.  Where series are long, register a state metric.
    """

    def build(p: Panel, c: Context) -> DataFrame:
        pts = p.pair_points(directed, c.pairs, [max(1, c.lag)] if shifts else (0,))

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("t")
            return pdf[["src", "dst"]].iloc[:1].assign(value=float(fn(pdf["x"].to_numpy(), pdf["y"].to_numpy())))

        return pts.groupBy("src", "dst").applyInPandas(one, "src string, dst string, value double")

    register_metric(name, build, directed)


def compute(
    panel: Panel,
    name: str,
    lag: int = 1,
    control: Sequence[str] | None = None,
    pairs: Sequence[tuple[str, str]] | None = None,
    partial_mode: str = "global",
    pairwise_policy: str = "others",
    custom_controls: Sequence[str] = (),
    control_strategy: str = "none",
    control_pca_k: int = 0,
) -> DataFrame:
    """Edges ``src, dst, value`` of one method."""
    name = ALIASES.get(name, name)
    m = method(name)
    control = tuple(control) if control else None
    extra: dict[str, Column] = {}
    if name.endswith("_partial") and control is None and control_strategy != "none":
        panel, extra = moments.control_columns(panel, control_strategy, control_pca_k)
    elif partial_mode == "pairwise" and name in PAIRWISE:
        pts = moments.pairwise_partial_points(panel, lag, pairwise_policy, custom_controls, pairs)
        if name == "mutinf_partial":
            return neighbors.mutual_information(pts)
        out = moments.corr_points(pts)
        return moments.squared(out) if name == "h2_partial" else out
    ctx = Context(max(1, int(lag)), control, tuple(pairs) if pairs is not None else None, extra)
    return m.build(panel, ctx).select("src", "dst", "value")


def corrected(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """p-values replaced by Benjamini-Hochberg q-values."""
    return graph.fdr_bh(edges, "value", keys).drop("value").withColumnRenamed("q", "value").select(*keys, "src", "dst", "value")


def describe(spark) -> DataFrame:
    rows = [(n, m.directed, m.p_value, is_control_sensitive(n), m.supports_lag) for n, m in METHODS.items()]
    return spark.createDataFrame(rows, "variant string, directed boolean, p_value boolean, control_sensitive boolean, supports_lag boolean")


def parse_pairs(text: str, names: Sequence[str], directed: bool = True) -> list[tuple[str, str]]:
    """``a-b; a->b; 0-1`` with names or positions; unknown and self pairs are dropped."""
    known = set(names)

    def name_of(word: str) -> str | None:
        word = word.strip()
        if word in known:
            return word
        return names[int(word)] if word.isdigit() and int(word) < len(names) else None

    out: dict[tuple[str, str], None] = {}
    for part in text.replace(",", ";").split(";"):
        halves = part.split("->", 1) if "->" in part else None
        if halves is None:
            cut = next((i for i, ch in enumerate(part) if ch == "-" and name_of(part[:i]) and name_of(part[i + 1 :])), None)
            halves = [part[:cut], part[cut + 1 :]] if cut is not None else None
        if not halves:
            continue
        a, b = (name_of(h) for h in halves)
        if a and b and a != b:
            out[(a, b)] = None
    return list(out)


def choose_pairs(
    panel: Panel, mode: str = "full", text: str = "", coords: DataFrame | None = None, kind: str = "26", radius: int = 1,
    count: int | None = None, seed: int = 0, directed: bool = False,
) -> list[tuple[str, str]] | None:
    """The pair list for a mode; None means all pairs, whatever the number of channels.

    Random pairs and neighbours are taken only where asked for: ``count`` of the former, coordinates
    for the latter.
    """
    if mode in ("auto", "full"):
        return None
    if mode == "pairs":
        return parse_pairs(text, panel.channels, directed)
    if mode == "neighbors":
        if coords is None:
            raise ValueError("pair_mode=neighbors needs coordinates")
        return [tuple(r) for r in graph.neighbor_pairs(coords, kind, radius).collect()]  # bounded by channels x kind
    if not count:
        raise ValueError("pair_mode=random needs pair_count")
    return graph.random_pairs(panel.channels, count, seed, directed)

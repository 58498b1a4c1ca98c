"""Partial correlation in windows, against a precision matrix per window."""

import numpy as np
import pandas as pd
import pytest

from weftline.operators import sweep
from weftline.panel import Panel


@pytest.mark.parametrize("grid", [dict(size=20, stride=3), dict(size=13, stride=4, start_min=5, max_windows=5), dict(size=40)])
def test_windows_of_partial_correlation(spark, monkeypatch, grid):
    monkeypatch.setattr(sweep, "RUN", 3)
    rng = np.random.default_rng(8)
    v = rng.normal(size=(90, 4)) @ rng.normal(size=(4, 4)) + 1000
    v[17:29, 2] = np.nan
    names = list("abcd")
    pdf = pd.DataFrame(v, columns=names)
    pdf.insert(0, "t", np.arange(90))
    panel = Panel.from_wide(spark.createDataFrame(pdf).repartition(5), names)
    g = sweep.WindowGrid.plan(90, **grid)
    got = {(r.start, r.src, r.dst): r.value for r in sweep.window_edges(panel, "correlation_partial", [g]).collect()}
    starts = [g.first + k * g.stride for k in (range(g.count) if g.chosen is None else g.chosen)]
    assert len(got) == 6 * len(starts)
    for s in starts:
        w = v[s : s + g.size]
        w = w[np.isfinite(w).all(axis=1)]
        p = np.linalg.inv(np.corrcoef(w.T)) if len(w) > 6 else None
        for i in range(4):
            for j in range(i + 1, 4):
                have = got[s, names[i], names[j]]
                if p is None:
                    assert have is None
                else:
                    assert have == pytest.approx(-p[i, j] / np.sqrt(p[i, i] * p[j, j]), abs=1e-7)


def test_given_pairs_and_squares(spark):
    pdf = pd.DataFrame(np.random.default_rng(1).normal(size=(50, 4)), columns=list("abcd"))
    pdf.insert(0, "t", np.arange(50))
    panel = Panel.from_wide(spark.createDataFrame(pdf), list("abcd"))
    g = sweep.WindowGrid.plan(50, 25)
    r = {(x.start, x.src, x.dst): x.value for x in sweep.window_edges(panel, "correlation_partial", [g], pairs=[("c", "a")]).collect()}
    q = {(x.start, x.src, x.dst): x.value for x in sweep.window_edges(panel, "h2_partial", [g], pairs=[("a", "c")]).collect()}
    assert r.keys() == q.keys() and all(q[k] == pytest.approx(r[k] ** 2) for k in r)

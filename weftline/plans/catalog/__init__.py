"""Named queries over the shared tables, each with the SQL that states its meaning."""

from __future__ import annotations

import importlib

from weftline.plans.catalog.base import ORACLES, QUERIES

MODULES = ("cleaning", "moments", "information", "distances", "sweeps", "spectra", "regressions", "topology", "reductions", "diagnostics", "tables")


def load() -> tuple[dict, dict]:
    for m in MODULES:
        importlib.import_module(f"weftline.plans.catalog.{m}")
    return QUERIES, ORACLES

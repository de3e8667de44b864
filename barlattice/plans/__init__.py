"""Registered queries, one module per operator family."""

from __future__ import annotations

import importlib

MODULES = [
    "indicators", "signals", "metrics", "clean", "align", "sources", "calendar", "xsection", "returns", "overlays",
    "boards", "rebalance", "options", "pairs", "covariance", "ledger", "learning", "live", "extend",
]


def load_all() -> None:
    for m in MODULES:
        try:
            importlib.import_module(f"barlattice.plans.{m}")
        except ModuleNotFoundError as ex:
            if ex.name != f"barlattice.plans.{m}":
                raise

"""Queries over the supplied tables, by family."""

from __future__ import annotations

import importlib

FAMILIES = ["valuation", "dashboard", "scores", "secondary", "derive", "joins", "explorer", "charts", "functions", "nomenclature", "ingest", "privacy"]


def load_all() -> None:
    """Import every family, which registers its queries."""
    for family in FAMILIES:
        importlib.import_module(f"wardflow.bindings.q_{family}")

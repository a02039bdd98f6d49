"""Views over the given tables, derived corpora, and the query catalogue."""

from __future__ import annotations

import importlib

MODULES = (
    "queries_measure", "queries_rank", "queries_match", "queries_read", "queries_graph", "queries_stream",
)


def load_catalog():
    """All registered queries and their checking SQL."""
    for module in MODULES:
        importlib.import_module(f"marginalia.plans.{module}")
    from marginalia.plans import catalog

    return catalog.QUERIES, catalog.ORACLES

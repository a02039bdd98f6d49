"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

from __future__ import annotations

import importlib

MODULES = ("quality", "topk", "chat", "suffixes", "rules", "jaccard", "packing", "curriculum", "secrets", "toxicity", "merkle", "trie", "maintext")


def load_catalog():
    """All queries of this package and the SQL they are checked against."""
    for module in MODULES:
        importlib.import_module(f"marginalia.llm.{module}")
    from marginalia.llm import registry

    return registry.QUERIES, registry.ORACLES

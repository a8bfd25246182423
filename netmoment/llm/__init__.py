"""Operators for preparing training data for language models.

Nothing else in the library imports this subpackage; queries() and oracle_sql()
are what the entry module adds to its own.
"""

from __future__ import annotations

import importlib

_MODULES = ("jaccard_join", "sharding", "media", "html_extract", "license_scan", "mixing", "quality", "substring_dedup", "decontamination", "line_dedup", "centroids", "prefix_trie", "suffix_dedup")


def _gather(name: str) -> dict:
    found: dict = {}
    for m in _MODULES:
        found |= getattr(importlib.import_module(f"{__name__}.{m}"), name)
    return found


def queries() -> dict:
    """Callables of (spark, sf_dir) by query name."""
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name, for those that SQL can express."""
    return _gather("ORACLES")

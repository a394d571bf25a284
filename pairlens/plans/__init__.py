"""Registered queries of the engine."""

from __future__ import annotations

import importlib

#: Modules of this package that register queries when they are imported.
MODULES: tuple[str, ...] = ("metrics_queries", "stream_queries", "contract_queries", "record_queries", "run_queries", "wire_queries", "derive_queries", "audit_queries", "temporal_queries")


def load_queries() -> tuple[dict, dict]:
    from .registry import ORACLES, QUERIES

    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return QUERIES, ORACLES

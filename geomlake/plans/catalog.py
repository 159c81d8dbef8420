"""All queries of the library with their equivalent SQL."""

from __future__ import annotations

import importlib

from geomlake.plans import registry

FLAGSHIP = "rdm_label_summary"
MODULES = ("q_windows", "q_pairs", "q_geometry", "q_aggregates", "q_inference", "q_models", "q_tables")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"geomlake.plans.{name}")


def queries() -> dict[str, registry.Query]:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.SQL)

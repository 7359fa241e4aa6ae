"""Named queries over the driver tables, each with its SQL counterpart where one exists."""

from __future__ import annotations

from importlib import import_module

from .registry import REGISTRY, Query

MODULES = (
    "signature_queries", "quality_queries", "series_queries", "meteo_queries", "ingest_queries", "relation_queries", "storage_queries",
)


def load() -> dict[str, Query]:
    """Import every query module and return the registry in registration order."""
    for m in MODULES:
        import_module(f"{__name__}.{m}")
    return REGISTRY

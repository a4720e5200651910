"""Named queries: each applies one operator to the given tables."""

from __future__ import annotations

import importlib
import pkgutil

from rasterlake.registry import QUERIES, Query


def load_all() -> dict[str, Query]:
    """Import every module of this package and return the registry."""
    for info in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        importlib.import_module(f"{__name__}.{info.name}")
    return QUERIES

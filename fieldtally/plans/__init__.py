"""Ready-made queries over the driver's tables, with SQL counterparts."""

from __future__ import annotations

import importlib
import pkgutil

from .registry import ORACLES, QUERIES


def _load() -> None:
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if module.startswith("q_"):
            importlib.import_module(f"{__name__}.{module}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracles():
    _load()
    return dict(ORACLES)

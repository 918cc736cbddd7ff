"""Operators bound to the supplied tables, each with its SQL equivalent."""

from __future__ import annotations

import importlib
import pkgutil

from remitlens.plans.registry import ORACLES, QUERIES


def load_all() -> None:
    """Import every module of this package so that its queries are registered."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")


__all__ = ["ORACLES", "QUERIES", "load_all"]

"""Named queries over the test tables."""

from __future__ import annotations

import importlib
import pkgutil


def _load():
    from reuselake.plans import catalog

    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    return catalog


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)

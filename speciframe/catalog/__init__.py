"""Registered queries."""

from __future__ import annotations

import importlib

MODULES = ("naming", "text", "sampling", "evaluation", "sources", "streams")


def load():
    from . import base

    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return base.QUERIES, base.ORACLES

"""Operators bound to the given tables."""

from __future__ import annotations

import importlib

MODULES = ["cleaning", "joining", "summaries", "testing", "scoring", "texts", "governing", "reading", "streams", "modelling"]


def load():
    """All registered queries and SQL texts."""
    from cohortgrid.bindings import registry

    for name in MODULES:
        importlib.import_module(f"cohortgrid.bindings.{name}")
    return registry.QUERIES, registry.SQL

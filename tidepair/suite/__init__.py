"""Registered queries over the driver's tables, each with its SQL twin where one exists."""

import importlib

MODULES = ["scans", "joins", "statistics", "trading", "streams", "wide"]


def load():
    """Import every query module; returns the queries and their SQL twins by name."""
    from tidepair.suite import registry

    for name in MODULES:
        importlib.import_module(f"tidepair.suite.{name}")
    return registry.QUERIES, registry.SQL

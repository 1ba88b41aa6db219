"""Registered queries over the given tables, each with its SQL twin."""

from importlib import import_module

MODULES = ["basics", "statistics", "ingest", "association", "comparison", "outcome"]


def load() -> None:
    for name in MODULES:
        import_module(f"catalog.{name}")

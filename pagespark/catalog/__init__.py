"""Registered queries over the given tables, each with its SQL twin where one exists."""

from importlib import import_module

MODULES = ("geometry_q", "text_q", "joins_q", "tables_q", "structure_q")


def load_all() -> None:
    for name in MODULES:
        import_module(f"pagespark.catalog.{name}")

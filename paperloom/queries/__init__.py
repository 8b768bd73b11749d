"""The core's queries: each module has QUERIES (name to callable) and SQL (name to DuckDB text)."""

from importlib import import_module

NAMES = ["document", "tabular", "layout", "packed"]


def modules() -> list:
    return [import_module(f"paperloom.queries.{n}") for n in NAMES]

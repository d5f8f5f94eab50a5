"""Named queries over the given tables, each with SQL for the same result where SQL can say it."""

from __future__ import annotations

import importlib

MODULES = [
    "detections", "labels", "lines", "packs", "texts", "overlaps", "repeats", "readings",
    "screens", "timings", "streams", "sources",
]


def load() -> tuple[dict, dict[str, str]]:
    """(queries, SQL) of all catalogue modules."""
    queries, sql = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"{__name__}.{name}")
        queries.update(module.QUERIES)
        sql.update(module.SQL)
    return queries, sql

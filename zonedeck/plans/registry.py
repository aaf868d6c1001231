"""Name to query and name to check SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``check`` is SQL over the same tables with the same columns."""

    def keep(fn):
        QUERIES[name] = fn
        if check:
            CHECKS[name] = check.strip()
        return fn

    return keep

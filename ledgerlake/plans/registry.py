"""Where queries register themselves, with their oracles; the catalog imports them all."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "pooled_conformal"


def query(oracle: str | None = None):
    """Register a function (spark, sf_dir) under its name, with DuckDB SQL for the same rows."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add

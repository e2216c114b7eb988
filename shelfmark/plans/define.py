"""Registration of queries beside the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.catalog import Catalog, with_views

QUERIES: dict[str, Callable[[Catalog], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers fn(catalog) under a name, with its oracle in SQL over tables and views (None: it has no SQL form)."""

    def put(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = with_views(sql)
        return fn

    return put

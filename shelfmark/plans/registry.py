"""The engine's queries by name, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import mutations, projections, relational, scalars, sequences, vectors  # noqa: F401  (modules register their queries)
from ..sources import files  # noqa: F401
from ..sources.catalog import Catalog
from ..streaming import feed, ingest, live  # noqa: F401
from .define import ORACLES, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, path, f=fn: f(Catalog(spark, path))) for name, fn in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

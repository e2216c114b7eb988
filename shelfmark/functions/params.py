"""Limits that a caller may ask for, and how they are clamped."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def page_limit(asked: int | None, default: int, most: int) -> int:
    """List endpoints: none or 0 is the default, less is 1, more is the most."""
    return default if not asked else max(1, min(asked, most))


def page_limits(asked: Column, default: int, most: int) -> Column:
    """page_limit of a column of requests."""
    return F.when(F.coalesce(asked, F.lit(0)) == 0, default).otherwise(F.greatest(F.lit(1), F.least(asked, F.lit(most))))


def candidate_limit(asked: int | None, default: int, most: int) -> int:
    """Candidate endpoints: less than 1 is the default."""
    return default if asked is None or asked < 1 else min(asked, most)


def bins(asked: int | None, default: int = 20, least: int = 4, most: int = 50) -> int:
    return default if asked is None else max(least, min(asked, most))


def total_pages(total: int, size: int, least: int = 1) -> int:
    """Pages of a listing; `least` is 1 for review lists and 0 for galleries."""
    return max(least, math.ceil(total / size))


def has_more(offset: int, shown: int, total: int) -> bool:
    return offset + shown < total

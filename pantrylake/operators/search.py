"""Listing filters, paging and trending scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PAGE = 100


def listing_filter(df: DataFrame, text: str | None = None, text_columns: list[str] | None = None, equal: dict | None = None, at_least: dict | None = None) -> Column:
    """Conjunction of what is given: any-word contains over several columns, equality regardless of case, lower bounds.

    Values that are None ask for nothing.  The marks % and _ in a text keep their LIKE meaning; | separates words of
    which one, by position, goes with each column.
    """
    parts: list[Column] = [F.lit(True)]
    if text:
        words = text.split("|")
        words = words * len(text_columns) if len(words) == 1 else words
        parts.append(reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{w}%") for c, w in zip(text_columns, words, strict=True)]))
    for c, v in (equal or {}).items():
        if v is not None:
            parts.append(F.lower(F.col(c)) == v.lower() if isinstance(v, str) else F.col(c) == v)
    for c, v in (at_least or {}).items():
        if v is not None:
            parts.append(F.coalesce(F.col(c), F.lit(0)) >= v)
    return reduce(lambda a, b: a & b, parts)


def page(df: DataFrame, by: list[str], number: int = 1, size: int = 20) -> DataFrame:
    """A page, greatest first with nulls last; number is at least 1 and size from 1 to 100."""
    number, size = max(1, number), min(max(1, size), MAX_PAGE)
    return df.orderBy(*[F.desc_nulls_last(c) for c in by]).offset((number - 1) * size).limit(size)


def trending_score(stored: Column, average: Column, count: Column, created: Column, now: Column) -> Column:
    """A stored score, or else ten times the mean rating, one for each rating up to fifty, and five for the last thirty days."""
    fresh = F.when(created >= now - F.expr("INTERVAL 30 DAYS"), 5).otherwise(0)
    return F.coalesce(stored.cast("double"), F.coalesce(average, F.lit(0.0)) * 10 + F.least(F.coalesce(count, F.lit(0)), F.lit(50)) + fresh)

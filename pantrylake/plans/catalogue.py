"""All registered queries of the library's own operators."""

from __future__ import annotations

from pantrylake.plans import domain, quality, records, relational, text, vectors  # noqa: F401 - they register their queries
from pantrylake.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

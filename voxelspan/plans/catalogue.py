"""The registered queries of the analytics operators and their SQL."""

from __future__ import annotations

from . import accuracy, change, curation, geometry, inference, models, samples, statistics  # noqa: F401  (they register their queries)
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

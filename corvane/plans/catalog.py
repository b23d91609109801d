"""All queries of the core."""

from __future__ import annotations

from corvane.plans import problems, retrieval, storage, texts
from corvane.plans.registry import Query

_PARTS = [problems.registry, retrieval.registry, texts.registry, storage.registry]


def queries() -> dict[str, Query]:
    return {name: f for part in _PARTS for name, f in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.sql.items()}

"""The query catalogue: every query over the library's own operators, with its SQL."""

from __future__ import annotations

from codexloom.plans import answers, documents, indexes, knowledge, references, retrieval, stores, usage  # noqa: F401  (they register their queries)
from codexloom.plans.registry import ORACLE, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

"""The registered queries of the retrieval operators."""

from __future__ import annotations

from searchloom.plans import analytics_queries, curation_queries, io_queries, ranking_queries, report_queries  # noqa: F401
from searchloom.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

"""All queries of the engine itself and their SQL."""

from __future__ import annotations

from . import boundary_queries, eligibility_queries, evaluation_queries, event_queries, gate_queries, ledger_queries, lookup_queries, metric_queries, more_queries, queue_queries, review_queries, routing_queries, selection_queries, source_queries, stream_queries, study_queries  # noqa: F401  they register their queries
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

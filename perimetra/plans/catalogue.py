"""Every registered query of the core library, with the SQL that states the same result."""

from __future__ import annotations

from perimetra.plans import q_data, q_evaluation, q_events, q_evidence, q_more, q_retention, q_search, q_serving, q_stateful, q_text, q_tracks  # noqa: F401  they register their queries
from perimetra.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

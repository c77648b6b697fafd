"""All registered queries: importing an operator module registers its own."""

from quorumlake.operators import analytics, audit, events, flows, ordering, quality, readings, resolve, roster, rounds, texts, votes  # noqa: F401
from quorumlake.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]

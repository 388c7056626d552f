"""Named queries over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from tidewall.plans.common import Query


def all_queries() -> dict[str, Query]:
    from tidewall.plans import command_queries, flow_queries, policy_queries, text_queries

    return text_queries.QUERIES | policy_queries.QUERIES | command_queries.QUERIES | flow_queries.QUERIES


def queries():
    return {name: q.run for name, q in all_queries().items()}


def oracle_sql():
    return {name: q.sql for name, q in all_queries().items() if q.sql}

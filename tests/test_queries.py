"""The registered queries and their SQL fit together, with or without the text operators."""

from __future__ import annotations

import __spark_entry__ as entry


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_claim_query_has_sql():
    from claimloom.plans.oracle import ORACLE_SQL
    from claimloom.plans.queries import QUERIES

    assert set(QUERIES) == set(ORACLE_SQL)

"""Registered queries and their oracle SQL, gathered from the query modules."""

from __future__ import annotations

from weftline.plans.queries import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)

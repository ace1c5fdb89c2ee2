"""All registered queries and the SQL that says the same."""

from __future__ import annotations

from tidewright.plans import events, maintained, numbers, reviews, stored
from tidewright.plans.queries import QUERIES, SQL

#: Modules that register queries when they are imported.
REGISTERED = (events, maintained, numbers, reviews, stored)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)

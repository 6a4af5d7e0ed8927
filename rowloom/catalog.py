"""The registered queries and their SQL twins."""

from __future__ import annotations

from rowloom.plans import landed, more, rules  # noqa: F401  (they register their queries)
from rowloom.plans import queries as plans


def queries() -> dict:
    return dict(plans.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(plans.SQL)

"""Named queries of the engine and the SQL they are checked against."""

from __future__ import annotations

from plumbline.catalog import learning, mining, preparation, profiles  # noqa: F401  they register their queries
from plumbline.catalog.registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)

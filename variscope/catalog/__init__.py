"""Named queries of the library, by operator family."""

from __future__ import annotations

from variscope.catalog import views  # noqa: F401
from variscope.catalog import blocks, clauses, configs, messages, models, readers, relations, requirements, streams  # noqa: F401
from variscope.catalog.base import QUERIES, SQL, Tables, compose


def queries():
    def bind(fn):
        return lambda spark, sf: fn(Tables(spark, sf))

    return {name: bind(fn) for name, fn in QUERIES.items()}


def oracle_sql():
    return {name: compose(sql) for name, sql in SQL.items()}

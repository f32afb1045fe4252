"""Registered queries over the fixture tables and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenfold.plans import catalog, maintenance, pictures, reports, search, shapes, streams, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

for _module in (catalog, search, reports, text, shapes, maintenance, streams, pictures):
    for _name, (_query, _sql) in _module.REGISTRY.items():
        QUERIES[_name] = _query
        if _sql:
            ORACLE_SQL[_name] = _sql

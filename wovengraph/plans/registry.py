"""Named queries, each with the SQL that states its result."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wovengraph.plans.fixture import Graph, fixture_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def expand(sql: str) -> str:
    """Put the definitions of the fixture tables in front of the SQL."""
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.I)
    ctes = fixture_ctes(sql)
    if own:
        return f"WITH RECURSIVE {', '.join([*ctes, sql[own.end():]])}"
    return f"WITH RECURSIVE {', '.join(ctes)} {sql}" if ctes else sql


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Graph], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, path: fn(Graph(spark, path))
        if sql:
            ORACLES[name] = expand(sql)
        return fn

    return register

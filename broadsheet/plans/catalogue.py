"""Every core query by name, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from broadsheet.operators import timestamps
from broadsheet.plans import relational_queries, scalar_queries, timestamp_sql

Query = Callable[[SparkSession, str], DataFrame]
_ALL = scalar_queries.QUERIES | relational_queries.QUERIES


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _ALL.items()} | {"p5_found": timestamps.found}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql} | {"p5_found": timestamp_sql.SQL}

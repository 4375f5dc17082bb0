"""Registered queries with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Alerts and baskets as in sources.events.
ALERTS = """alerts AS (
  SELECT event_id AS row_id, CAST(floor(epoch(ts)) AS BIGINT) AS time, event_type AS signature, 'u' || user_id AS host,
    upper(substr(event_type, 1, 1)) || '-' || event_type AS short,
    CASE WHEN event_type = 'error' THEN 'attack' ELSE 'false_positive' END AS label, value
  FROM events
)"""
BASKETS = """lines AS (
  SELECT l_orderkey, l_returnflag, 'brand:' || p_brand AS b, 'type:' || p_type AS t,
    'size:' || CASE WHEN p_size <= 15 THEN 'small' WHEN p_size <= 35 THEN 'medium' ELSE 'large' END AS s
  FROM lineitem JOIN part ON l_partkey = p_partkey
), baskets AS (
  SELECT l_orderkey AS gid, CASE WHEN max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 1 THEN 'attack' ELSE 'benign' END AS group_label,
    count(*) AS n_lines
  FROM lines GROUP BY 1
), items AS (
  SELECT DISTINCT gid, group_label, item FROM baskets JOIN (SELECT l_orderkey, unnest([b, t, s]) AS item FROM lines) ON gid = l_orderkey
)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that gives the same rows where there is one."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of additions doesn't show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

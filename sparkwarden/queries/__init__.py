"""Queries over the test tables: each applies operators of the library to whole tables, with DuckDB SQL of the same result."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The role views of plans.tables, as SQL.
ROLES = """cases AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS action_date, CAST(o_totalprice AS DECIMAL(18,2)) AS fine, CAST(o_orderkey % 100 AS DECIMAL(18,2)) AS costs, o_orderpriority AS action_type, o_orderstatus AS result, o_custkey AS offender_id FROM orders),
notices AS (SELECT event_id AS id, CAST(ts AS DATE) AS action_date, event_type AS action_type, user_id AS offender_id FROM events),
offenders AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS industry, c_nationkey AS agency_id, CAST(c_acctbal AS DECIMAL(18,2)) AS balance FROM customer),
agencies AS (SELECT n_nationkey AS id, lower(n_name) AS code, n_name AS name, n_regionkey <> 0 AS enabled FROM nation),
offences AS (SELECT l_orderkey AS case_id, l_linenumber AS sequence, l_partkey AS legislation_id, l_suppkey AS part_no, CAST(l_extendedprice AS DECIMAL(18,2)) AS fine, l_returnflag AS flag FROM lineitem),
legislation AS (SELECT p_partkey AS id, p_name AS title, p_type AS type, p_size + 1960 AS year, p_brand AS number FROM part),
facts AS (SELECT 'case' AS record_type, id, action_date, action_type, offender_id, fine, costs, result FROM cases UNION ALL SELECT 'notice', id, action_date, action_type, offender_id, NULL, NULL, NULL FROM notices)"""


def query(sql: str | None = None, roles: bool = True) -> Callable[[Query], Query]:
    """Register a query under its name; sql follows the role views if it does not start with WITH."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"WITH {ROLES}{'' if sql.lstrip().startswith(',') else ' '}{sql}" if roles else sql
        return f

    return put


for _part in ("reports", "filtering", "shaping", "matching", "documents", "extraction", "coverage", "further", "stateful"):
    importlib.import_module(f"{__name__}.{_part}")

"""Collects queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..config import BLOCKING_RULES
from ..crm import STD_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def std(rest: str) -> str:
    """SQL over the standardized customer table; ``rest`` begins with more tables or with SELECT."""
    return STD_SQL + (" " if rest.lstrip().upper().startswith("SELECT") else ", ") + rest


def rule_sql(columns, select: str = "l.record_id AS record_id_l, r.record_id AS record_id_r", source: str = "std") -> str:
    on = " AND ".join(f"l.{c} = r.{c}" for c in columns)
    return f"SELECT {select} FROM {source} l JOIN {source} r ON {on} WHERE l.record_id < r.record_id"


def pairs_cte(rules=BLOCKING_RULES, name: str = "pairs") -> str:
    """``name`` (record_id_l, record_id_r, rule_no): every pair once, under its first rule."""
    union = " UNION ALL ".join(rule_sql(c, f"l.record_id AS record_id_l, r.record_id AS record_id_r, {k} AS rule_no") for k, (_, c) in enumerate(rules))
    return f"{name} AS (SELECT record_id_l, record_id_r, CAST(min(rule_no) AS INTEGER) AS rule_no FROM ({union}) GROUP BY ALL)"


def components_cte(edges: str, nodes: str, name: str = "comp") -> str:
    """``name`` (record_id, root): the least record each record reaches over ``edges`` (a, b)."""
    return (
        f"both_ways AS (SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges}), "
        f"reach AS (SELECT record_id, record_id AS r FROM {nodes} UNION SELECT reach.record_id, b AS r FROM reach JOIN both_ways ON a = reach.r), "
        f"{name} AS (SELECT record_id, min(r) AS root FROM reach GROUP BY 1)"
    )

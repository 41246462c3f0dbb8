"""Parameterised SQL over named DataFrames, and table look-ups."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

_MARKER = re.compile(r"(?<!:):([A-Za-z_]\w*)")


def run_sql(
    spark: SparkSession, query: str, inputs: Mapping[str, DataFrame] | None = None, params: Mapping[str, object] | None = None
) -> DataFrame:
    """``{name}`` in the query stands for an input frame, ``:name`` for a bound value.

    Parameters the query does not mention are left out; values are never spliced
    into the text.
    """
    wanted = set(_MARKER.findall(query))
    args = {k: v for k, v in (params or {}).items() if k in wanted}
    return spark.sql(query, args=args or None, **(inputs or {}))


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def scan(spark: SparkSession, name: str) -> DataFrame:
    """The table as it is now: streams write from sessions of their own, so the
    file list and schema this session may have cached are dropped first."""
    spark.catalog.refreshTable(name)
    return spark.read.table(name)


def scan_stream(spark: SparkSession, name: str) -> DataFrame:
    return spark.readStream.table(name)


def ensure_schema(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{name}`")

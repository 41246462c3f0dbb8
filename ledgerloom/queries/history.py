"""Versioned history of events per user, and latest-row queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import history as h
from ledgerloom.queries.base import Tables, query

_VERSIONS = """
SELECT user_id, ts, event_id, event_type, value, ts AS __START_AT, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS __END_AT
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1"""


def _history(t: Tables) -> DataFrame:
    return h.scd2(t.events, ["user_id"], "ts", tie=["event_id"], exclude=["props"])


@query(_VERSIONS)
def q_scd2(t: Tables) -> DataFrame:
    return _history(t)


@query(f"SELECT * FROM ({_VERSIONS}) WHERE __END_AT IS NULL")
def q_scd2_current(t: Tables) -> DataFrame:
    return h.current(_history(t))


@query(
    f"SELECT * FROM ({_VERSIONS}) WHERE __START_AT <= TIMESTAMP '2024-01-15' AND (__END_AT IS NULL OR __END_AT > TIMESTAMP '2024-01-15')"
)
def q_scd2_asof(t: Tables) -> DataFrame:
    return h.as_of(_history(t), F.lit("2024-01-15").cast("timestamp_ntz"))


@query(
    """SELECT l_returnflag, place, l_quantity, l_linestatus, place AS __START_AT, lead(place) OVER (PARTITION BY l_returnflag ORDER BY place) AS __END_AT
FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, place ORDER BY l_quantity DESC, l_linestatus DESC) AS rn FROM (
  SELECT l_returnflag, l_orderkey * 1000 + l_linenumber AS place, l_quantity, l_linestatus FROM lineitem)) WHERE rn = 1"""
)
def q_scd2_numbers(t: Tables) -> DataFrame:
    """A bigint sequence over three keys: every key is hot."""
    place = (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("place")
    return h.scd2(t.lineitem.select("l_returnflag", place, "l_quantity", "l_linestatus"), ["l_returnflag"], "place", tie=["l_quantity", "l_linestatus"])


@query(
    "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1"
)
def q_latest_per_key(t: Tables) -> DataFrame:
    return h.latest_per_key(t.orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])

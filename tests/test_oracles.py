"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    text, _, good = compare(spark, con, name, FOLDER, ORACLES.get(name))
    assert good, text


def test_oracles_name_queries():
    assert set(ORACLES) <= set(entry.queries())


def test_splits_hold_their_shares(spark):
    split = entry.queries()["q_stratified_split"](spark, "/root/testdata/sf0.01")
    got = split.groupBy("o_orderpriority").pivot("split", ["test", "train"]).count().collect()
    assert len(got) == 5
    for r in got:
        assert r["test"] == int(0.2 * (r["test"] + r["train"]) + 0.5)
    routes = entry.queries()["q_traffic_split"](spark, "/root/testdata/sf0.1").groupBy("route").count()
    n = {r["route"]: r["count"] for r in routes.collect()}
    assert abs(n["primary"] / sum(n.values()) - 0.7) < 0.05

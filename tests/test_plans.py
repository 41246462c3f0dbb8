"""Physical plans: what must and must not be in them."""

from __future__ import annotations

import re

import pytest

from ledgerloom.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(autouse=True)
def long_plan_text(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are when no side is small."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_cross_join_and_no_python(spark, no_broadcast, name):
    text = plan(QUERIES[name](spark, FOLDER))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "Scan ExistingRDD ["):
        assert bad not in text, bad


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_window_over_everything(spark, name):
    """A window without partition would pull all rows into one task."""
    text = plan(QUERIES[name](spark, FOLDER))
    for line in re.findall(r"windowspecdefinition\(([^)]*)", text):
        assert not line.startswith("specifiedwindowframe"), line
    assert "Exchange SinglePartition, REPARTITION" not in text


def scans(text: str, table: str) -> list[str]:
    return [x for x in text.splitlines() if "FileScan" in x and f"/{table}.parquet" in x]


def test_filters_reach_the_scan(spark):
    text = plan(QUERIES["q_param_sql"](spark, FOLDER))
    assert "EqualTo(c_mktsegment,BUILDING)" in text and "GreaterThanOrEqual(c_acctbal,1000.0)" in text
    text = plan(QUERIES["q_dq_drop"](spark, FOLDER))
    assert "GreaterThan(l_quantity,0.0)" in text and "IsNotNull(l_partkey)" in text
    assert "GreaterThan(c_custkey,41)" in plan(QUERIES["q_page_after"](spark, FOLDER))
    assert "c_acctbal" in scans(plan(QUERIES["q_customer_list"](spark, FOLDER)), "customer")[0].split("DataFilters")[1]


def test_only_needed_columns_are_read(spark):
    text = plan(QUERIES["q_agg_transactions"](spark, FOLDER))
    for line in scans(text, "lineitem"):
        assert "l_quantity" not in line and "l_partkey" not in line
    for line in scans(text, "orders"):
        assert "o_totalprice" not in line
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string,c_acctbal:double>" in plan(QUERIES["q_top_customers"](spark, FOLDER))


def test_top_n_is_not_a_global_sort(spark):
    for name in ("q_top_customers", "q_page", "q_page_after", "q_usage_audit", "q_top_runs"):
        text = plan(QUERIES[name](spark, FOLDER))
        assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text, name


def test_facts_shrink_before_the_join(spark, no_broadcast):
    """Line items are aggregated per order below the join with the owners."""
    lines = plan(QUERIES["q_agg_transactions"](spark, FOLDER)).splitlines()
    depth = {i: len(x) - len(x.lstrip(" :+-*()0123456789")) for i, x in enumerate(lines)}
    for scan in [i for i, x in enumerate(lines) if "FileScan" in x and "lineitem" in x]:
        above, level = [], depth[scan]
        for i in range(scan, -1, -1):
            if depth[i] < level:
                above.append(lines[i])
                level = depth[i]
        join = next(i for i, x in enumerate(above) if "SortMergeJoin [l_orderkey" in x)
        assert any("HashAggregate(keys=[l_orderkey" in x for x in above[:join])


def test_sides_of_the_wide_table_share_one_partitioning(spark, no_broadcast):
    """Customers are shuffled on party_id once, not once per join."""
    text = plan(QUERIES["q_customer360"](spark, FOLDER))
    on_party = re.findall(r"Exchange hashpartitioning\(party_id#\d+L, \d+\)", text)
    # accounts, loans, payments, cards, app, telco and the customers themselves
    assert len(on_party) == 7 and "FullOuter" not in text
    # Partial sums of the five sides with amounts meet by party and bins before.
    assert len(re.findall(r"Exchange hashpartitioning\(party_id#\d+L, _", text)) == 5


def test_history_never_windows_the_whole_key(spark):
    for name in ("q_scd2", "q_scd2_current", "q_scd2_asof"):
        text = plan(QUERIES[name](spark, FOLDER))
        windows = re.findall(r"windowspecdefinition\(([^)]*?), specified", text)
        raw = [w for w in windows if "ts#" in w.split(" ASC")[0]]
        assert raw and all("_seg#" in w for w in raw)

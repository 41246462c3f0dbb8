from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import Observation

from ledgerloom.operators import quality as q
from ledgerloom.plans import silver

COLUMNS = (
    "payment_transaction_id string, payment_amount double, currency_id string, instruction_status string, "
    "payment_rail_type string, sanctions_screening_status string, posting_date date, value_date date, _rescued_data string"
)


@pytest.fixture
def txns(spark):
    good = ["T1", 10.0, "MYR", "settled", "FPX", "CLEARED", "2024-01-02", "2024-01-01", None]
    bad = {0: None, 1: -5.0, 2: "XXX", 3: "lost", 4: "pigeon", 7: "2024-02-01", 8: '{"a":"b"}'}
    data = [tuple(good)]
    for i, v in bad.items():
        row = list(good)
        row[0] = f"B{i}"
        row[i] = v
        data.append(tuple(row))
    text = spark.createDataFrame(data, COLUMNS.replace(" date", " string"))
    return text.withColumns({c: text[c].cast("date") for c in ("posting_date", "value_date")})


def test_drop_rules_remove_and_warn_rules_mark(txns):
    kept = silver.transactions(txns)
    got = {r["payment_transaction_id"]: r[q.FAILED] for r in kept.collect()}
    assert got == {
        "T1": [],
        "B2": ["valid_currency"],
        "B3": ["valid_status"],
        "B4": ["valid_rail"],
        "B7": ["posting_after_value"],
        "B8": ["no_rescued_data"],
    }


def test_quarantine_is_the_complement(txns):
    rules = silver.TRANSACTION_RULES
    out = rules.quarantine(txns)
    assert {tuple(r[q.FAILED]) for r in out.collect()} == {("valid_txn_id",), ("positive_amount",)}
    assert rules.apply(txns).count() + out.count() == txns.count()


def test_metrics_count_every_rule(txns):
    got = {r["rule"]: (r["passed"], r["failed"]) for r in silver.TRANSACTION_RULES.metrics(txns).collect()}
    assert got["valid_txn_id"] == (7, 1) and got["valid_sanctions"] == (8, 0) and got["no_rescued_data"] == (7, 1)
    seen = Observation("dq")
    silver.TRANSACTION_RULES.observe(txns, seen).write.format("noop").mode("overwrite").save()
    assert seen.get["_rows"] == 8 and seen.get["_f1"] == 1


def test_fault_breakdown(txns):
    got = {r["fault"]: r["n_rows"] for r in q.fault_breakdown(txns, silver.TRANSACTION_FAULTS).collect()}
    assert got == {k: 1 for k in silver.TRANSACTION_FAULTS}


def test_null_fails_unless_allowed(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, "z")], "id int, v string")
    strict = q.RuleSet([q.Rule("v", q.one_of("v", ["a"]), "drop")])
    lax = q.RuleSet([q.Rule("v", q.one_of("v", ["a"], null_ok=True), "drop")])
    assert rows(strict.apply(df), "id") == [(2,)]
    assert rows(lax.apply(df), "id") == [(1,), (2,)]
    assert rows(strict.quarantine(df), "id") == [(1,), (3,)]


def test_fail_rule_and_bad_rules(spark):
    df = spark.createDataFrame([(1,), (-1,)], "v int")
    with pytest.raises(q.RuleViolation):
        q.RuleSet([q.Rule("pos", q.positive("v"), "fail")]).enforce(df)
    q.RuleSet([q.Rule("any", q.in_range("v", -5, 5), "fail")]).enforce(df)
    with pytest.raises(ValueError):
        q.Rule("x", "true", "explode")
    with pytest.raises(ValueError):
        q.RuleSet([q.Rule("x", "true"), q.Rule("x", "false")])


def test_required_columns_rows_and_formats(spark):
    df = spark.createDataFrame([("800101-01-1234",), ("bad",)], "ic string")
    with pytest.raises(ValueError, match="missing"):
        q.require_columns(df, ["ic", "other"])
    rules = q.RuleSet([q.Rule("ic", q.matches("ic", r"^[0-9]{6}-[0-9]{2}-[0-9]{4}$"), "drop")])
    assert rules.apply(df).count() == 1
    counts = spark.createDataFrame([("a", 5), ("b", 1)], "table_name string, n_rows int")
    q.require_rows(counts, {"a": 5})
    with pytest.raises(q.RuleViolation):
        q.require_rows(counts, {"b": 2, "c": 1})

from __future__ import annotations

import datetime as dt

import bank
import pytest
from conftest import drop_all, rows
from pyspark.sql import functions as F

from ledgerloom.operators import history as h
from ledgerloom.plans import features, gold, serving
from ledgerloom.plans.lakehouse import METRICS, Lakehouse, quarantine_of
from ledgerloom.plans.silver import FACTS
from ledgerloom.plans.silver import VERSIONED
from ledgerloom.schemas import FEATURES, FEEDS
from ledgerloom.sources.queries import scan


@pytest.fixture(scope="module")
def house(spark, tmp_path_factory):
    """The bank after two runs; the second brings new and late files."""
    landing, work = tmp_path_factory.mktemp("landing"), tmp_path_factory.mktemp("work")
    lake = Lakehouse(spark, str(landing), str(work), buckets=4)
    for write in (bank.write_first, bank.write_second):
        write(landing)
        lake.bronze()
        lake.silver()
    lake.gold(dt.date.fromisoformat(bank.AS_OF))
    yield lake
    names = {f.table for f in FEEDS.values()} | {v.silver for v in VERSIONED} | {f.silver for f in FACTS}
    for name in names | {METRICS, "silver_digital_activity", "gold_customer_360", "customer_features"}:
        drop_all(spark, name)


def one(house, party: int) -> dict:
    return scan(house.spark, "gold_customer_360").where(F.col("party_id") == f"P{party:08}").first().asDict()


def test_bronze_keeps_all_rows_and_new_columns(house):
    customers = scan(house.spark, "bronze_customer_master")
    assert customers.count() == 5 and rows(customers.where("occupation_code IS NOT NULL"), "cif_number") == [("CIF000002",)]
    assert rows(customers.where("_rescued_data IS NOT NULL"), "cif_number", "_rescued_data") == [
        ("CIF000004", '{"annual_income_amount":"lots"}')
    ]
    assert rows(customers, "postcode")[0] == ("01234",)


def test_silver_history_and_facts(house):
    versions = scan(house.spark, "silver_customers").where("cif_number = 'CIF000002'")
    assert rows(versions, "annual_income_amount", h.END) == [(150000.0, None), (90000.0, dt.datetime(2024, 1, 31))]
    late = scan(house.spark, "silver_deposit_accounts").where("deposit_account_id = 'A1'")
    assert rows(late, "current_balance", h.END) == [(1.0, dt.datetime(2024, 1, 1)), (100.25, None)]
    txns = scan(house.spark, "silver_transactions")
    assert rows(txns, "payment_transaction_id") == [("T1",), ("T2",), ("T3",), ("T4",), ("T5",), ("T8",)]
    assert txns.where("payment_transaction_id = 'T8'").first()["_dq_failed"] == ["valid_currency"]
    activity = scan(house.spark, "silver_digital_activity")
    assert rows(activity.groupBy("source").count()) == [("digital_banking", 5), ("telco", 3)]
    assert activity.where("source = 'telco' AND event_type IS NOT NULL").count() == 0


def test_dropped_rows_are_in_quarantine_and_every_run_is_counted(house):
    lost = scan(house.spark, quarantine_of("silver_transactions"))
    assert rows(lost, "payment_transaction_id", "payment_amount", "_dq_failed") == [("T7", -9.0, ["positive_amount"]), (None, 9.0, ["valid_txn_id"])]
    assert rows(scan(house.spark, quarantine_of("silver_digital_activity")), "event_id", "_dq_failed") == [("E6", ["valid_party_digital"])]
    counts = scan(house.spark, METRICS)
    mine = rows(counts.where("table_name = 'silver_transactions' and batch_id = 0"), "rule", "action", "passed", "failed")
    assert ("positive_amount", "drop", 7, 1) in mine and ("valid_currency", "warn", 7, 1) in mine and len(mine) == 8
    assert {r["table_name"] for r in counts.select("table_name").distinct().collect()} == {f.silver for f in FACTS} | {"silver_digital_activity"}
    assert counts.groupBy("table_name", "batch_id", "rule").count().where("count > 1").isEmpty()


def test_live_feeds_run_at_once(house, tmp_path):
    """Three JSON feeds as streams of their own; a backlog takes few files at a time."""
    from ledgerloom.streaming.ingest import _throttle

    bank._json(tmp_path / "telco_events", "x.json", [{"event_id": "S9", "party_id": "P00000001"}])
    bank._json(tmp_path / "digital_events", "x.json", [{"event_id": "E9", "party_id": "P00000001", "brand_new": "1"}])
    bank._json(tmp_path / "credit_bureau", "x.json", [{"cif_number": "CIF9"}])
    before = {f: scan(house.spark, FEEDS[f].table).count() for f in ("telco_events", "digital_events", "credit_bureau")}
    watched = Lakehouse(house.spark, str(tmp_path), str(tmp_path / "work")).live("1 second")
    assert len(watched.queries) == 3 and all(q.isActive for q in watched.queries.values())
    watched.process_all()
    assert watched.check() == []
    watched.stop()
    assert all(scan(house.spark, FEEDS[f].table).count() == n + 1 for f, n in before.items())
    assert rows(scan(house.spark, "bronze_digital_events").where("brand_new is not null"), "event_id") == [("E9",)]
    assert (_throttle(FEEDS["digital_events"], {"processingTime": "1 second"}), _throttle(FEEDS["digital_events"], None)) == (1, 1000)


def test_gold_columns_and_rows(house):
    df = scan(house.spark, "gold_customer_360")
    assert rows(df, "party_id") == [("P00000001",), ("P00000002",), ("P00000004",)]
    # The 73 columns of the wide table plus the average balance.
    assert len(df.columns) == 74


def test_gold_values(house):
    c = one(house, 1)
    assert (c["num_accounts"], c["total_deposit_balance_myr"], c["has_current_account"], c["has_savings_account"]) == (3, 300.75, True, True)
    assert c["has_fixed_deposit"] is False and c["avg_account_balance"] == pytest.approx(350.75 / 3)
    assert (c["num_loan_facilities"], c["total_loan_outstanding_myr"], c["monthly_loan_commitment_myr"]) == (2, 5000.0, 50.0)
    assert (c["txn_count_30d"], c["txn_count_90d"], c["txn_count_12m"]) == (2, 3, 4)
    assert (c["total_debit_30d_myr"], c["total_credit_30d_myr"], c["avg_txn_amount_myr"]) == (10.5, 20.0, pytest.approx(30.1))
    assert c["ctos_score"] == 720 and c["kb_monthly_commitment_myr"] == 12.5
    assert (c["mobile_sessions_30d"], c["product_views_last_30d"], c["last_product_category_viewed"]) == (4, 2, "home_loan")
    assert (c["digital_maturity_score"], c["digital_activity_score"], c["telco_data_consumption_gb_monthly"]) == (7.0, 5.8, 3.0)
    assert (c["age"], c["relationship_tenure_years"], c["has_credit_card"], c["owns_home_loan"]) == (34, 5, False, 1)


def test_gold_keeps_one_sided_customers(house):
    card_only, telco_only = one(house, 2), one(house, 4)
    assert (card_only["has_credit_card"], card_only["overseas_txn_flag"], card_only["card_spend_30d_myr"]) == (False, True, 15.0)
    assert (telco_only["has_credit_card"], telco_only["card_spend_30d_myr"], telco_only["num_accounts"]) == (True, 25.0, 0)
    assert (telco_only["digital_maturity_score"], telco_only["digital_activity_score"], telco_only["ctos_score"]) == (3.0, 1.8, None)
    assert telco_only["legal_name"] is None and telco_only["annual_income_amount"] is None


def test_feature_table(house):
    df = house.features()
    assert df.columns == ["party_id", "next_best_product", *FEATURES]
    got = {r["party_id"]: r for r in df.collect()}
    first, second, fourth = (got[f"P{n:08}"] for n in (1, 2, 4))
    assert (first["net_worth_band_encoded"], first["ccris_status_encoded"], first["last_product_category_viewed_encoded"]) == (3, 2, 2)
    assert (first["payment_conduct_score"], first["next_best_product"]) == (50.0, "CREDIT_CARD")
    assert (second["annual_income_amount"], second["payment_conduct_score"], second["next_best_product"]) == (150000.0, 50.0, "CREDIT_CARD")
    assert (fourth["ctos_score"], fourth["annual_income_amount"], fourth["last_product_category_viewed_encoded"]) == (600, 36000.0, -1)
    bureau = features.encode(scan(house.spark, "gold_customer_360"), conduct_from_bureau=True)
    assert rows(bureau, "payment_conduct_score") == [(0.0,), (4.0,), (4.0,)]


def test_app_queries(house):
    df = scan(house.spark, "gold_customer_360")
    pending = serving.list_customers(df, None).first()
    assert (pending["party_id"], pending["recommendation_1"], pending["confidence_1"]) == ("P00000001", "PENDING", "0")
    recs = house.spark.createDataFrame([("P00000002", "INSURANCE", 61.5)], "party_id string, recommendation_1 string, confidence_1 double")
    got = {r["party_id"]: (r["recommendation_1"], r["confidence_1"]) for r in serving.list_customers(df, recs, 2).collect()}
    assert got == {"P00000001": ("PENDING", "0"), "P00000002": ("INSURANCE", "61.5")}
    assert rows(serving.search_customers(df, "cif000002"), "party_id") == [("P00000002",)]
    assert rows(serving.customer(df, "P00000004"), "cif_number") == [("CIF000004",)]


LABELS = [
    ("CREDIT_CARD", dict(ctos_score=701, annual_income_amount=60001.0)),
    ("CREDIT_CARD", dict(ctos_score=701, annual_income_amount=60001.0, age=30, number_of_dependents=1)),
    ("HOME_LOAN", dict(ctos_score=700, annual_income_amount=60001.0, age=28, number_of_dependents=1)),
    ("HOME_LOAN", dict(age=45, number_of_dependents=2, annual_income_amount=48001.0, monthly_loan_commitment_myr=9000.0)),
    ("PERSONAL_LOAN", dict(age=46, number_of_dependents=1, annual_income_amount=48001.0, monthly_loan_commitment_myr=900.0)),
    ("PERSONAL_LOAN", dict(annual_income_amount=110000.0, net_worth_band_encoded=4, monthly_loan_commitment_myr=1900.0)),
    ("INVESTMENT", dict(annual_income_amount=110000.0, net_worth_band_encoded=3)),
    ("INSURANCE", dict(num_loan_facilities=1, payment_conduct_score=40.0)),
    ("NO_ACTION", dict(num_loan_facilities=1, payment_conduct_score=39.0)),
    ("NO_ACTION", dict(annual_income_amount=0.0, monthly_loan_commitment_myr=500.0)),
]


def test_label_rules(spark):
    base = dict(
        ctos_score=500, annual_income_amount=10000.0, has_credit_card=0, age=60, number_of_dependents=0, has_home_loan=0,
        monthly_loan_commitment_myr=0.0, net_worth_band_encoded=0, num_loan_facilities=0, payment_conduct_score=50.0,
    )
    df = spark.createDataFrame([{**base, **case, "want": want, "i": i} for i, (want, case) in enumerate(LABELS)])
    got = features.label(df).orderBy("i").collect()
    assert [r["next_best_product"] for r in got] == [want for want, _ in LABELS]


def test_transaction_options(spark):
    df = spark.createDataFrame(
        [("P", "2024-06-30", "DEBIT", 10.0, "settled"), ("P", "2024-06-30", "DEBIT", 5.0, "rejected"), ("P", "2024-05-31", "DEBIT", 1.0, "settled")],
        "party_id string, posting_date string, txn_type string, payment_amount double, instruction_status string",
    ).withColumn("posting_date", F.col("posting_date").cast("date"))
    cards = spark.createDataFrame([], "party_id string, posting_date date, txn_amount double, card_type string, is_overseas boolean")
    as_of = F.lit("2024-06-30").cast("date")
    assert gold.agg_transactions(df, cards, as_of).first()["total_debit_30d_myr"] == 16.0
    assert gold.agg_transactions(df, cards, as_of, settled_only=True).first()["total_debit_30d_myr"] == 11.0

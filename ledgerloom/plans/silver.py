"""Silver layer: versioned masters, rule-checked facts, unified digital activity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import schemas as S
from ledgerloom.operators import history, quality
from ledgerloom.operators.joins import union_tagged
from ledgerloom.operators.quality import Rule, RuleSet
from ledgerloom.sources.rescue import RESCUED
from ledgerloom.streaming.ingest import BATCH

_CLEAN = Rule("no_rescued_data", f"{RESCUED} IS NULL")


@dataclass(frozen=True)
class Versioned:
    """A master table kept with its history."""

    bronze: str
    silver: str
    keys: tuple[str, ...]
    sequence: str


#: Loans are sequenced by their modification time: the disbursement date never
#: changes, so it cannot order two versions.
VERSIONED = (
    Versioned("bronze_customer_master", "silver_customers", ("cif_number",), "record_updated_timestamp"),
    Versioned("bronze_core_banking_accounts", "silver_deposit_accounts", ("deposit_account_id",), "last_modified_timestamp"),
    Versioned("bronze_loans", "silver_loan_accounts", ("loan_account_id",), "last_modified_timestamp"),
)

TRANSACTION_RULES = RuleSet(
    [
        Rule("valid_txn_id", quality.not_null("payment_transaction_id"), "drop"),
        Rule("positive_amount", quality.positive("payment_amount"), "drop"),
        Rule("valid_currency", quality.one_of("currency_id", S.CURRENCIES)),
        Rule("valid_status", quality.one_of("instruction_status", S.TXN_STATUSES)),
        Rule("valid_rail", quality.one_of("payment_rail_type", S.PAYMENT_RAILS)),
        Rule("valid_sanctions", quality.one_of("sanctions_screening_status", S.SANCTIONS)),
        Rule("posting_after_value", quality.not_before("posting_date", "value_date")),
        _CLEAN,
    ]
)

CARD_RULES = RuleSet(
    [
        Rule("valid_card_txn_id", quality.not_null("card_instruction_id"), "drop"),
        Rule("positive_card_amount", quality.positive("txn_amount"), "drop"),
        Rule("valid_card_status", quality.one_of("instruction_status", S.CARD_STATUSES)),
        _CLEAN,
    ]
)

KYC_RULES = RuleSet(
    [
        Rule("valid_cif_kyc", quality.not_null("cif_number"), "drop"),
        Rule("valid_ctos_score", quality.in_range("ctos_score", 300, 850)),
        Rule("valid_payment_conduct", quality.one_of("payment_conduct_12m", S.PAYMENT_CONDUCT)),
        Rule("no_negative_outstanding", quality.in_range("total_outstanding_balance_myr", low=0)),
        Rule("valid_bankruptcy", quality.one_of("bankruptcy_status", S.BANKRUPTCY)),
        _CLEAN,
    ]
)

DIGITAL_RULES = RuleSet(
    [
        Rule("valid_party_digital", quality.not_null("party_id"), "drop"),
        Rule("valid_event_type", quality.one_of("event_type", S.EVENT_TYPES, null_ok=True)),
        _CLEAN,
    ]
)

#: The six kinds of bad transaction rows that the fault report names.
TRANSACTION_FAULTS = {
    "null_id": "payment_transaction_id IS NULL",
    "negative_amount": "payment_amount <= 0",
    "bad_currency": f"NOT coalesce({quality.one_of('currency_id', S.CURRENCIES)}, false)",
    "bad_status": f"NOT coalesce({quality.one_of('instruction_status', S.TXN_STATUSES)}, false)",
    "bad_rail": f"NOT coalesce({quality.one_of('payment_rail_type', S.PAYMENT_RAILS)}, false)",
    "posting_before_value": "posting_date < value_date",
}


def stamped(df: DataFrame) -> DataFrame:
    return df.withColumn("_silver_timestamp", F.current_timestamp())


def versions(bronze: DataFrame, spec: Versioned) -> DataFrame:
    """Full history of a master; rescued text and file columns are not part of a version."""
    skip = [c for c in (RESCUED, "_ingest_timestamp", BATCH) if c in bronze.columns]
    tie = ["_source_file"] if "_source_file" in bronze.columns else []
    return history.scd2(bronze, spec.keys, spec.sequence, tie=tie, exclude=skip)


@dataclass(frozen=True)
class Checked:
    """A fact table and the rules its rows must pass."""

    bronze: str
    silver: str
    rules: RuleSet


FACTS = (
    Checked("bronze_core_banking_txn", "silver_transactions", TRANSACTION_RULES),
    Checked("bronze_cards_txn", "silver_card_transactions", CARD_RULES),
    Checked("bronze_credit_bureau", "silver_kyc_compliance", KYC_RULES),
)


def transactions(bronze: DataFrame) -> DataFrame:
    return TRANSACTION_RULES.apply(stamped(bronze), annotate=True)


def card_transactions(bronze: DataFrame) -> DataFrame:
    return CARD_RULES.apply(stamped(bronze), annotate=True)


def kyc_compliance(bronze: DataFrame) -> DataFrame:
    return KYC_RULES.apply(stamped(bronze), annotate=True)


def digital_signals(digital: DataFrame, telco: DataFrame) -> DataFrame:
    """App events and telco signals in one table, unchecked; works on batches and streams."""
    telco = telco.withColumn("event_type", F.lit(None).cast("string"))
    return stamped(union_tagged({"digital_banking": digital, "telco": telco}))


def digital_activity(digital: DataFrame, telco: DataFrame) -> DataFrame:
    return DIGITAL_RULES.apply(digital_signals(digital, telco), annotate=True)


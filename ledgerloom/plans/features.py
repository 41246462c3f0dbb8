"""Model features and the rule-based next-best-product label."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.columns import col_or
from ledgerloom.functions.encoding import ordinal
from ledgerloom.operators.joins import with_defaults
from ledgerloom.operators.quality import require_columns
from ledgerloom.schemas import FEATURES

# Category codes. Each table takes the model's own vocabulary and
# the one the feeds use.
NET_WORTH = {
    "under_100k": 0, "100k_to_250k": 1, "250k_to_500k": 2, "500k_to_1m": 3, "1m_to_5m": 4, "over_5m": 5,
    "<100K": 0, "100K-500K": 1, "500K-1M": 3, "1M-5M": 4, ">5M": 5,
}
BUREAU_STATUS = {
    "clean": 0, "performing": 1, "watchlist": 2, "non_performing": 3, "default": 4,
    "1_dpd": 1, "30_dpd": 2, "60_dpd": 3, "90_dpd": 4,
}
EMPLOYMENT = {
    "employed": 0, "self_employed": 1, "business_owner": 2, "retired": 3, "unemployed": 4,
    "permanent_employee": 0, "contract": 0, "professional": 0,
}
PRODUCT_VIEWED = {
    "savings": 0, "credit_card": 1, "home_loan": 2, "personal_loan": 3, "investment": 4, "insurance": 5,
    "hire_purchase": 6, "fixed_deposit": 7, "remittance": 8, "none": 9, "investment_fund": 4,
}
CONDUCT_POINTS = {"clean": 4, "1_missed": 3, "2_missed": 2, "3+_missed": 1}

#: Value of a feature the customer has no data for (fixed values).
FEATURE_DEFAULTS = {
    "ctos_score": 600.0,
    "annual_income_amount": 36000.0,
    "total_deposit_balance_myr": 5000.0,
    "monthly_loan_commitment_myr": 0.0,
    "num_accounts": 1,
    "num_loan_facilities": 0,
    "txn_count_30d": 0,
    "avg_txn_amount_myr": 0.0,
    "digital_maturity_score": 5.0,
    "telco_arpu_myr": 50.0,
    "number_of_dependents": 0,
    "tenure_years": 1.0,
}

#: Label rules in priority order; the first that holds wins, else NO_ACTION.
LABEL_RULES = (
    ("CREDIT_CARD", "ctos_score > 700 AND annual_income_amount > 60000 AND has_credit_card = 0"),
    (
        "HOME_LOAN",
        "age BETWEEN 28 AND 45 AND number_of_dependents > 0 AND has_home_loan = 0 AND annual_income_amount > 48000",
    ),
    ("PERSONAL_LOAN", "try_divide(monthly_loan_commitment_myr, annual_income_amount) * 12 > 0.20D AND annual_income_amount > 0"),
    ("INVESTMENT", "net_worth_band_encoded >= 3 AND annual_income_amount > 100000"),
    ("INSURANCE", "num_loan_facilities > 0 AND payment_conduct_score >= 40"),
)
NO_RULE = "NO_ACTION"


def encode(gold: DataFrame, conduct_from_bureau: bool = False) -> DataFrame:
    """All feature columns (plus what the label rules need), NULLs filled.

    ``payment_conduct_score`` is the satisfaction score, or 50 without one;
    with ``conduct_from_bureau`` it is the 12-month payment conduct (1..4).
    """
    conduct = (
        ordinal(F.col("payment_conduct_12m"), CONDUCT_POINTS).cast("double")
        if conduct_from_bureau
        else F.coalesce(F.col("nps_score").cast("double"), F.lit(50.0))
    )
    encoded = gold.withColumns(
        {
            "tenure_years": F.col("relationship_tenure_years").cast("double"),
            "net_worth_band_encoded": ordinal(F.col("net_worth_band"), NET_WORTH),
            "ccris_status_encoded": ordinal(F.col("ccris_status"), BUREAU_STATUS),
            "employment_status_encoded": ordinal(F.col("employment_status"), EMPLOYMENT),
            "last_product_category_viewed_encoded": ordinal(F.col("last_product_category_viewed"), PRODUCT_VIEWED, -1),
            "is_shariah_preferred_int": F.coalesce(col_or(gold, "is_shariah_preferred", False).cast("int"), F.lit(0)),
            "payment_conduct_score": conduct,
            **{c: F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in ("has_credit_card", "has_home_loan", "has_personal_loan")},
        }
    )
    return with_defaults(encoded, FEATURE_DEFAULTS)


def label(features: DataFrame, rules: Sequence[tuple[str, str]] = LABEL_RULES, name: str = "next_best_product") -> DataFrame:
    chain = F.when(F.expr(rules[0][1]), F.lit(rules[0][0]))
    for value, predicate in rules[1:]:
        chain = chain.when(F.expr(predicate), F.lit(value))
    return features.withColumn(name, chain.otherwise(F.lit(NO_RULE)))


def customer_features(gold: DataFrame, key: str = "party_id", extra: Mapping[str, object] | None = None) -> DataFrame:
    """Key, label and the model features, one row per customer of ``gold``."""
    rows = label(encode(gold, **(extra or {})))
    require_columns(rows, [key, "next_best_product", *FEATURES])
    return rows.select(key, "next_best_product", *FEATURES)

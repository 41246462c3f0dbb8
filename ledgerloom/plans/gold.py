"""Per-domain aggregates and the wide customer-360 table.

Each aggregate is one row per ``party_id``; the wide table left-joins them to
the current customers. All joins but the bureau one share the ``party_id``
partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import scalars
from ledgerloom.functions.columns import col_or, flag, ref
from ledgerloom.operators import measures as m
from ledgerloom.operators.history import latest_per_key
from ledgerloom.operators.joins import full_align, star
from ledgerloom.operators.quality import Rule, RuleSet, not_null

#: Account types counted as each kind; Islamic twins belong to the same kind.
ACCOUNT_KINDS = {
    "has_current_account": ("DDA", "current_account_i"),
    "has_savings_account": ("savings", "savings_i"),
    "has_fixed_deposit": ("certificate_of_deposit",),
}
LOAN_KINDS = {
    "has_home_loan": "home_loan",
    "has_personal_loan": "personal_loan",
    "has_hire_purchase": "hire_purchase",
}

#: Identity columns taken from the customer master as they are.
IDENTITY = (
    "party_id cif_number legal_name first_name last_name national_id_number date_of_birth gender "
    "citizenship_country_code residency_status customer_segment lifestyle_segment employment_status employer_name "
    "annual_income_amount marital_status number_of_dependents education_level is_pep risk_rating kyc_status "
    "lifecycle_status digital_banking_enrollment_flag mobile_app_user_flag marketing_consent_flag net_worth_band "
    "nps_score preferred_language_code preferred_contact_method primary_state"
).split()

#: Output columns and the value of a customer without a row on that side
#: (None: stays NULL).
ACCOUNT_COLUMNS = {
    "num_accounts": 0,
    "total_deposit_balance_myr": 0.0,
    "has_current_account": False,
    "has_savings_account": False,
    "has_fixed_deposit": False,
    "avg_account_balance": None,
}
LOAN_COLUMNS = {
    "num_loan_facilities": 0,
    "total_loan_outstanding_myr": 0.0,
    "monthly_loan_commitment_myr": 0.0,
    "has_home_loan": False,
    "has_personal_loan": False,
    "has_hire_purchase": False,
}
TRANSACTION_COLUMNS = {
    "txn_count_30d": 0,
    "txn_count_90d": 0,
    "txn_count_12m": 0,
    "total_debit_30d_myr": 0.0,
    "total_credit_30d_myr": 0.0,
    "avg_txn_amount_myr": 0.0,
    "has_credit_card": False,
    "card_spend_30d_myr": 0.0,
    "overseas_txn_flag": False,
}
BUREAU_COLUMNS = {
    "ctos_score": None,
    "ccris_status": None,
    "total_credit_facilities": 0,
    "kb_monthly_commitment_myr": 0.0,
    "payment_conduct_12m": None,
    "legal_cases_count": 0,
    "bankruptcy_status": None,
    "credit_card_bureau_count": 0,
    "inquiry_count_last_6m": 0,
}
DIGITAL_COLUMNS = {
    "digital_activity_score": 5.0,
    "mobile_sessions_30d": 0,
    "product_views_last_30d": 0,
    "last_product_category_viewed": None,
    "telco_data_consumption_gb_monthly": 0.0,
    "telco_arpu_myr": 0.0,
    "digital_maturity_score": 5.0,
}
OWNED = {"owns_credit_card": "has_credit_card", "owns_home_loan": "has_home_loan", "owns_personal_loan": "has_personal_loan"}

GOLD_RULES = RuleSet(
    [
        Rule("gold_valid_cif", not_null("cif_number"), "drop"),
        Rule("gold_active_customer", "lifecycle_status = 'active'", "drop"),
        Rule("gold_has_name", not_null("legal_name")),
    ]
)


def agg_accounts(accounts: DataFrame) -> DataFrame:
    """Deposit holdings per customer, from current account rows."""
    balance = F.col("current_balance")
    return m.rollup(
        accounts,
        ["party_id"],
        [
            m.count_values("num_accounts", F.col("deposit_account_id")),
            m.total("total_deposit_balance_myr", balance, F.col("account_status") == "active"),
            *[m.any_true(name, F.col("account_type").isin(*types)) for name, types in ACCOUNT_KINDS.items()],
            m.mean("avg_account_balance", balance),
        ],
    )


def agg_loans(loans: DataFrame) -> DataFrame:
    active = F.col("loan_status") == "active"
    return m.rollup(
        loans,
        ["party_id"],
        [
            m.count_values("num_loan_facilities", F.col("loan_account_id")),
            m.total("total_loan_outstanding_myr", F.col("outstanding_principal_myr"), active),
            m.total("monthly_loan_commitment_myr", F.col("monthly_installment_myr"), active),
            *[m.any_true(name, F.col("loan_type") == kind) for name, kind in LOAN_KINDS.items()],
        ],
    )


def transaction_measures(as_of: Column, settled_only: bool = False) -> list[m.Measure]:
    """Counts in 30/90/365 days, debit and credit sums in 30 days, mean amount.

    A posting date after ``as_of`` counts as recent, as in a day difference.
    """
    day, amount = F.col("posting_date"), F.col("payment_amount")
    recent = scalars.within_days(day, as_of, 30)
    if settled_only:
        amount = F.when(F.col("instruction_status") == "settled", amount)
    return [
        m.count("txn_count_30d", recent),
        m.count("txn_count_90d", scalars.within_days(day, as_of, 90)),
        m.count("txn_count_12m", scalars.within_days(day, as_of, 365)),
        m.total("total_debit_30d_myr", amount, recent & (F.col("txn_type") == "DEBIT")),
        m.total("total_credit_30d_myr", amount, recent & (F.col("txn_type") == "CREDIT")),
        m.mean("avg_txn_amount_myr", amount),
    ]


def card_measures(as_of: Column, credit_only: bool = True) -> list[m.Measure]:
    """Spend in 30 days and any overseas use. ``credit_only``: debit and prepaid
    cards do not make a credit-card owner."""
    owner = m.any_true("has_credit_card", F.col("card_type") == "credit") if credit_only else m.present("has_credit_card")
    return [
        owner,
        m.total("card_spend_30d_myr", F.col("txn_amount"), scalars.within_days(F.col("posting_date"), as_of, 30)),
        m.any_true("overseas_txn_flag", F.col("is_overseas").cast("boolean")),
    ]


def agg_payments(txns: DataFrame, as_of: Column, settled_only: bool = False) -> DataFrame:
    return m.rollup(txns, ["party_id"], transaction_measures(as_of, settled_only))


def agg_cards(cards: DataFrame, as_of: Column, credit_only: bool = True) -> DataFrame:
    return m.rollup(cards, ["party_id"], card_measures(as_of, credit_only))


def agg_transactions(txns: DataFrame, cards: DataFrame, as_of: Column, settled_only: bool = False, credit_only: bool = True) -> DataFrame:
    """Payment and card behaviour; customers with only one of the two are kept."""
    return full_align(agg_payments(txns, as_of, settled_only), agg_cards(cards, as_of, credit_only), ["party_id"])


def agg_app(activity: DataFrame, as_of: Column) -> DataFrame:
    """App sessions and product views, from the unified activity table."""
    stamp = F.col("event_timestamp")
    recent = stamp >= F.date_sub(as_of, 30).cast("timestamp")
    viewed = F.col("event_type") == "view_product"
    category = F.col("product_category_viewed")
    return m.rollup(
        activity.where(F.col("source") == "digital_banking"),
        ["party_id"],
        [
            m.count("mobile_sessions_30d", recent),
            m.count("product_views_last_30d", viewed & recent),
            m.latest("last_product_category_viewed", category, [stamp, F.col("event_id")], viewed & category.isNotNull()),
        ],
    )


def agg_telco(activity: DataFrame) -> DataFrame:
    """Means of the telco signals, from the unified activity table."""
    return m.rollup(
        activity.where(F.col("source") == "telco"),
        ["party_id"],
        [
            m.mean("digital_maturity_score", F.col("digital_maturity_score")),
            m.mean("data_consumption_mb_monthly", F.col("data_consumption_mb_monthly")),
            m.mean("telco_arpu_myr", F.col("arpu_myr")),
        ],
    )


def digital_scores() -> dict[str, Column]:
    """Columns derived from app and telco figures of one customer."""
    return {
        "digital_activity_score": scalars.digital_score(F.col("mobile_sessions_30d"), F.col("digital_maturity_score")),
        "telco_data_consumption_gb_monthly": scalars.megabytes_to_gigabytes(F.col("data_consumption_mb_monthly")),
    }


def agg_digital(activity: DataFrame, as_of: Column) -> DataFrame:
    """App and telco engagement; customers with only one of the two are kept."""
    return full_align(agg_app(activity, as_of), agg_telco(activity), ["party_id"]).withColumns(digital_scores())


def latest_bureau(kyc: DataFrame) -> DataFrame:
    """Newest bureau pull per customer, in gold column names."""
    picked = latest_per_key(
        kyc.select(
            "cif_number",
            col_or(kyc, "bureau_pull_timestamp", F.lit(None).cast("timestamp")),
            *[col_or(kyc, c, F.lit(None).cast(t)) for c, t in (
                ("ctos_score", "int"),
                ("ccris_status", "string"),
                ("total_credit_facilities", "int"),
                ("monthly_total_commitment_myr", "double"),
                ("payment_conduct_12m", "string"),
                ("legal_cases_count", "int"),
                ("bankruptcy_status", "string"),
                ("credit_card_count", "int"),
                ("inquiry_count_last_6m", "int"),
            )],
        ),
        ["cif_number"],
        [F.col(c) for c in ("bureau_pull_timestamp", "ctos_score", "monthly_total_commitment_myr", "ccris_status", "payment_conduct_12m")],
    )
    return picked.withColumnsRenamed(
        {"monthly_total_commitment_myr": "kb_monthly_commitment_myr", "credit_card_count": "credit_card_bureau_count"}
    ).drop("bureau_pull_timestamp")


def customer_360(
    customers: DataFrame,
    accounts: DataFrame,
    loans: DataFrame,
    payments: DataFrame,
    cards: DataFrame,
    bureau: DataFrame,
    app: DataFrame,
    telco: DataFrame,
    as_of: Column,
    identity: Sequence[str] = IDENTITY,
    stamp: bool = True,
) -> DataFrame:
    """One row per active customer; every side must be unique on its key.

    Payments and cards, app and telco come as separate sides: left joins from
    the customers keep the partitioning on ``party_id``, a full join of two
    sides would lose it.
    """
    seen = lambda side, flag_name: side.withColumn(flag_name, F.lit(True))
    joined = star(
        customers,
        [
            (accounts, "party_id"),
            (loans, "party_id"),
            (payments, "party_id"),
            (cards, "party_id"),
            (seen(app, "_app"), "party_id"),
            (seen(telco, "_telco"), "party_id"),
            (bureau, "cif_number"),
        ],
    )
    engaged = F.col("_app").isNotNull() | F.col("_telco").isNotNull()
    joined = joined.withColumns({c: F.when(engaged, v) for c, v in digital_scores().items()})
    sides = {**ACCOUNT_COLUMNS, **LOAN_COLUMNS, **TRANSACTION_COLUMNS, **BUREAU_COLUMNS, **DIGITAL_COLUMNS}
    types = dict(joined.dtypes)
    filled = [
        F.expr(f"`{c}`" if v is None else f"coalesce(`{c}`, CAST('{v}' AS {types[c]})) AS `{c}`") for c, v in sides.items()
    ]
    wide = joined.select(
        *[ref(c) for c in identity],
        scalars.whole_years(F.col("date_of_birth").cast("date"), as_of).alias("age"),
        scalars.whole_years(F.col("relationship_start_date").cast("date"), as_of).alias("relationship_tenure_years"),
        col_or(customers, "is_shariah_preferred", False),
        *filled,
        *[flag(ref(has)).cast("int").alias(owns) for owns, has in OWNED.items()],
        *([F.current_timestamp().alias("gold_computed_at")] if stamp else []),
    )
    return GOLD_RULES.apply(wide)

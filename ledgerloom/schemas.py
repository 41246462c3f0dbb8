"""Feed schemas and value domains of the banking lakehouse.

Fixed values: the column names, types and enumerations below are the contract
of the landing feeds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import StructType

CUSTOMER_MASTER = """
cif_number string, party_id string, legal_name string, first_name string, last_name string,
national_id_number string, date_of_birth date, gender string, citizenship_country_code string,
residency_status string, mobile_number string, email_address string, mailing_address_line1 string,
mailing_address_line2 string, mailing_city string, primary_state string, postcode string, country_code string,
customer_segment string, lifestyle_segment string, employment_status string, employer_name string,
annual_income_amount double, marital_status string, number_of_dependents int, education_level string,
is_pep boolean, risk_rating string, kyc_status string, lifecycle_status string, relationship_start_date date,
record_updated_timestamp timestamp, digital_banking_enrollment_flag boolean, mobile_app_user_flag boolean,
marketing_consent_flag boolean, net_worth_band string, nps_score int, preferred_language_code string,
preferred_contact_method string, branch_code string, relationship_manager_id string,
is_shariah_preferred boolean, source_system string
"""

ACCOUNTS = """
deposit_account_id string, party_id string, cif_number string, iban string, account_type string,
account_status string, currency_id string, current_balance double, available_balance double,
interest_rate_pct double, overdraft_limit_myr double, account_open_date date, last_transaction_date date,
last_modified_timestamp timestamp, branch_code string, product_code string, is_joint_account boolean,
is_dormant boolean, kyc_verified_flag boolean, source_system string, is_shariah boolean,
statement_frequency string, e_statement_enrolled boolean, cheque_book_issued boolean,
debit_card_issued boolean, account_purpose string, relationship_manager_id string, freeze_flag boolean,
lien_amount_myr double, average_monthly_balance double
"""

LOANS = """
loan_account_id string, party_id string, cif_number string, loan_type string, loan_status string,
original_principal_myr double, outstanding_principal_myr double, interest_rate_pct double,
effective_rate_pct double, monthly_installment_myr double, tenure_months int, disbursement_date date,
maturity_date date, last_modified_timestamp timestamp, collateral_type string, collateral_value_myr double,
dpd int, npl_flag boolean, is_shariah boolean, source_system string
"""

TRANSACTIONS = """
payment_transaction_id string, party_id string, cif_number string, deposit_account_id string, txn_type string,
payment_amount double, currency_id string, payment_rail_type string, instruction_status string,
posting_date date, value_date date, description string, counterparty_name string, counterparty_account string,
mcc_code string, channel string, sanctions_screening_status string, fraud_flag boolean,
running_balance_myr double, reference_number string, source_system string
"""

CARDS = """
card_instruction_id string, party_id string, cif_number string, card_number_masked string, card_network string,
card_type string, merchant_name string, merchant_category_code string, merchant_country_code string,
txn_amount double, txn_currency string, billing_amount_myr double, posting_date date, instruction_status string,
is_overseas boolean, is_contactless boolean, reward_points_earned int, cashback_earned_myr double,
dispute_flag boolean, fraud_flag boolean, source_system string
"""

CREDIT_BUREAU = """
cif_number string, party_id string, report_date date, ctos_score int, ccris_status string,
total_credit_facilities int, total_outstanding_balance_myr double, monthly_total_commitment_myr double,
payment_conduct_12m string, legal_cases_count int, bankruptcy_status string, credit_card_count int,
home_loan_count int, personal_loan_count int, hire_purchase_count int, overdraft_count int,
inquiry_count_last_6m int, inquiry_count_last_12m int, oldest_facility_years int, credit_utilisation_pct double,
debt_to_income_ratio double, largest_single_facility_myr double, secured_debt_pct double,
unsecured_debt_pct double, bureau_pull_timestamp timestamp, bureau_provider string, consent_flag boolean,
consent_date date, aml_flag boolean, pep_flag boolean, sanction_flag boolean, data_source string
"""

TELCO_EVENTS = """
event_id string, cif_number string, party_id string, event_date date, telco_carrier string, data_plan string,
data_consumption_mb_monthly double, voice_minutes_monthly int, sms_count_monthly int, arpu_myr double,
device_class string, device_os string, digital_maturity_score double, roaming_flag boolean,
postpaid_flag boolean, tenure_months_with_carrier int, churn_risk_score double,
financial_inclusion_score double, app_usage_banking_mins double, location_cluster string,
consent_flag boolean, data_source string
"""

DIGITAL_EVENTS = """
event_id string, party_id string, cif_number string, session_id string, event_timestamp timestamp,
event_date date, event_type string, product_category_viewed string, channel string, device_type string,
page_url string, session_duration_sec int, is_authenticated boolean, source_system string
"""

INFERENCE_LOG = """
party_id string, predicted_label string, model_version string, scored_at timestamp, batch_id string
"""

CURRENCIES = ("MYR", "USD", "SGD", "EUR", "GBP")
TXN_STATUSES = ("settled", "pending", "rejected", "cancelled", "reversed")
CARD_STATUSES = ("settled", "pending", "disputed", "reversed")
PAYMENT_RAILS = ("FPX", "IBG", "DuitNow", "SWIFT", "ATM", "branch", "card", "internal")
SANCTIONS = ("CLEARED", "FLAGGED", "PENDING", "BLOCKED")
PAYMENT_CONDUCT = ("clean", "1_missed", "2_missed", "3+_missed")
BANKRUPTCY = ("none", "voluntary", "involuntary")
EVENT_TYPES = ("login", "view_product", "apply", "fund_transfer", "bill_pay", "investment", "logout")
NATIONAL_ID = r"^[0-9]{6}-[0-9]{2}-[0-9]{4}$"

#: Classes of the next-best-product label, in index order (alphabetical).
LABEL_CLASSES = ("CREDIT_CARD", "HOME_LOAN", "INSURANCE", "INVESTMENT", "NO_ACTION", "PERSONAL_LOAN")

#: Model features, in vector order.
FEATURES = (
    "tenure_years",
    "total_deposit_balance_myr",
    "num_accounts",
    "annual_income_amount",
    "net_worth_band_encoded",
    "ctos_score",
    "ccris_status_encoded",
    "payment_conduct_score",
    "age",
    "number_of_dependents",
    "employment_status_encoded",
    "monthly_loan_commitment_myr",
    "num_loan_facilities",
    "txn_count_30d",
    "avg_txn_amount_myr",
    "has_credit_card",
    "digital_maturity_score",
    "telco_arpu_myr",
    "is_shariah_preferred_int",
    "last_product_category_viewed_encoded",
)


@dataclass(frozen=True)
class Feed:
    """One landing feed: where it lands in bronze and how it is read."""

    name: str
    ddl: str
    fmt: str
    table: str
    #: Files per micro-batch of a live stream.
    max_files: int = 1000
    multi_line: bool = False
    #: Files per micro-batch when a backlog is drained.
    drain_files: int = 1000
    #: Folders below the landing root; several versions may feed one table.
    folders: tuple[str, ...] = ()

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.ddl)


FEEDS = {
    f.name: f
    for f in (
        Feed("customer_master", CUSTOMER_MASTER, "csv", "bronze_customer_master", folders=("batch_v1/customer_master", "batch_v2/customer_master")),
        Feed("accounts", ACCOUNTS, "csv", "bronze_core_banking_accounts", folders=("batch_v1/accounts",)),
        Feed("transactions", TRANSACTIONS, "csv", "bronze_core_banking_txn", folders=("batch_v1/transactions",)),
        Feed("loans", LOANS, "csv", "bronze_loans", folders=("batch_v1/loans",)),
        Feed("cards", CARDS, "csv", "bronze_cards_txn", folders=("batch_v1/cards",)),
        Feed("digital_events", DIGITAL_EVENTS, "json", "bronze_digital_events", max_files=1, folders=("digital_events",)),
        Feed("credit_bureau", CREDIT_BUREAU, "json", "bronze_credit_bureau", max_files=5, folders=("credit_bureau",)),
        Feed("telco_events", TELCO_EVENTS, "json", "bronze_telco_events", max_files=5, folders=("telco_events",)),
    )
}

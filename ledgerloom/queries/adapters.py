"""The test tables seen as banking feeds, in Spark and in SQL.

customer -> customers; orders -> accounts, loans and bureau pulls; lineitem
(owned through orders) -> payments and card rows; events -> app events
(click, view, signup) and telco signals (purchase, error).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import measures as m
from ledgerloom.operators.joins import full_align, union_tagged
from ledgerloom.plans import gold
from ledgerloom.queries.base import Tables, flags_as_int, sql_mean, sql_round, sql_sum

AS_OF_DAY = "2001-11-04"
EVENTS_DAY = "2024-01-31"


def as_of() -> Column:
    return F.lit(AS_OF_DAY).cast("date")


def events_as_of() -> Column:
    return F.lit(EVENTS_DAY).cast("date")


def _case(column: str, pairs: dict[str, str], other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + f" ELSE '{other}' END"


ACCOUNT_TYPE = _case(
    "o_orderpriority",
    {"1-URGENT": "DDA", "2-HIGH": "savings", "3-MEDIUM": "certificate_of_deposit", "4-NOT SPECIFIED": "savings_i"},
    "current_account_i",
)
LOAN_TYPE = _case("o_orderpriority", {"1-URGENT": "home_loan", "2-HIGH": "personal_loan", "3-MEDIUM": "hire_purchase"}, "overdraft")
CONDUCT = _case("o_orderpriority", {"1-URGENT": "clean", "2-HIGH": "1_missed", "3-MEDIUM": "2_missed"}, "3+_missed")
BUREAU_STATE = _case("o_orderstatus", {"F": "clean", "O": "30_dpd"}, "90_dpd")
EMPLOYMENT = _case(
    "c_mktsegment",
    {"MACHINERY": "permanent_employee", "BUILDING": "self_employed", "AUTOMOBILE": "contract", "FURNITURE": "retired"},
    "professional",
)
NET_WORTH = (
    "CASE WHEN c_acctbal < 1000 THEN '<100K' WHEN c_acctbal < 4000 THEN '100K-500K' WHEN c_acctbal < 7000 THEN '500K-1M' "
    "WHEN c_acctbal < 9000 THEN '1M-5M' ELSE '>5M' END"
)

#: Select lists both engines understand.
CUSTOMERS = [
    "c_custkey AS party_id",
    "replace(c_name, 'Customer#', 'CIF') AS cif_number",
    "c_name AS legal_name",
    "c_mktsegment AS customer_segment",
    "lower(c_mktsegment) AS lifestyle_segment",
    f"{EMPLOYMENT} AS employment_status",
    "(c_acctbal + 1000) * 12 AS annual_income_amount",
    "CAST(c_nationkey % 6 AS INT) AS number_of_dependents",
    "make_date(1950 + 2 * c_nationkey, 1, 1) AS date_of_birth",
    "make_date(1985 + c_nationkey % 15, 6, 15) AS relationship_start_date",
    "CASE WHEN c_acctbal >= 0 THEN 'active' ELSE 'dormant' END AS lifecycle_status",
    f"{NET_WORTH} AS net_worth_band",
    "CASE WHEN c_nationkey % 3 <> 0 THEN CAST(c_nationkey % 10 + 1 AS INT) END AS nps_score",
    "c_nationkey % 2 = 0 AS is_shariah_preferred",
]
ACCOUNTS = [
    "o_custkey AS party_id",
    "o_orderkey AS deposit_account_id",
    "CASE WHEN o_orderstatus = 'O' THEN 'active' ELSE 'closed' END AS account_status",
    f"{ACCOUNT_TYPE} AS account_type",
    "o_totalprice AS current_balance",
]
LOANS = [
    "o_custkey AS party_id",
    "o_orderkey AS loan_account_id",
    "CASE WHEN o_orderstatus = 'F' THEN 'active' ELSE 'settled' END AS loan_status",
    f"{LOAN_TYPE} AS loan_type",
    "o_totalprice AS outstanding_principal_myr",
    "CAST(floor(o_totalprice / 120) AS DOUBLE) AS monthly_installment_myr",
]
BUREAU = [
    "concat('CIF', lpad(CAST(o_custkey AS STRING), 9, '0')) AS cif_number",
    "o_orderdate AS bureau_pull_timestamp",
    "CAST(300 + floor(o_totalprice / 1000) AS INT) AS ctos_score",
    f"{BUREAU_STATE} AS ccris_status",
    "CAST(floor(o_totalprice / 120) AS DOUBLE) AS monthly_total_commitment_myr",
    f"{CONDUCT} AS payment_conduct_12m",
]
PAYMENTS = [
    "l_orderkey",
    "CAST(l_shipdate AS DATE) AS posting_date",
    "CASE l_returnflag WHEN 'R' THEN 'DEBIT' WHEN 'A' THEN 'CREDIT' ELSE 'OTHER' END AS txn_type",
    "l_extendedprice AS payment_amount",
]
CARDS = [
    "l_orderkey",
    "CAST(l_shipdate AS DATE) AS posting_date",
    "l_extendedprice AS txn_amount",
    "CASE WHEN l_tax > 0.05 THEN 'credit' ELSE 'debit' END AS card_type",
    "l_discount > 0.05 AS is_overseas",
]


def customers(t: Tables) -> DataFrame:
    return t.customer.selectExpr(*CUSTOMERS)


def accounts(t: Tables) -> DataFrame:
    return t.orders.selectExpr(*ACCOUNTS)


def loans(t: Tables) -> DataFrame:
    return t.orders.selectExpr(*LOANS)


def bureau(t: Tables) -> DataFrame:
    return t.orders.selectExpr(*BUREAU)


def activity(t: Tables) -> DataFrame:
    events = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("int")
    category = (
        F.when(k < 20, "home_loan").when(k < 40, "personal_loan").when(k < 60, "credit_card").when(k < 80, "insurance")
    )
    app = events.where(F.col("event_type").isin("click", "view", "signup")).select(
        "event_id",
        F.col("user_id").alias("party_id"),
        F.col("ts").alias("event_timestamp"),
        F.when(F.col("event_type") == "view", "view_product").otherwise(F.col("event_type")).alias("event_type"),
        category.alias("product_category_viewed"),
    )
    telco = events.where(F.col("event_type").isin("purchase", "error")).select(
        "event_id",
        F.col("user_id").alias("party_id"),
        F.col("value").alias("digital_maturity_score"),
        (F.col("value") * F.lit(1000.0)).alias("data_consumption_mb_monthly"),
        (F.col("value") * F.lit(2.0)).alias("arpu_myr"),
    )
    return union_tagged({"digital_banking": app, "telco": telco})


def agg_payments(t: Tables) -> DataFrame:
    """Line items shrink to one row per order before they meet the owner."""
    return _through_orders(t, t.lineitem.selectExpr(*PAYMENTS), gold.transaction_measures(as_of()))


def agg_cards(t: Tables) -> DataFrame:
    return _through_orders(t, t.lineitem.where(F.col("l_linestatus") == "F").selectExpr(*CARDS), gold.card_measures(as_of()))


def _through_orders(t: Tables, facts: DataFrame, measures: list[m.Measure]) -> DataFrame:
    owners = t.orders.select("o_orderkey", F.col("o_custkey").alias("party_id"))
    return m.rollup_through(facts, "l_orderkey", owners, "o_orderkey", "party_id", measures)


def agg_transactions(t: Tables) -> DataFrame:
    return full_align(agg_payments(t), agg_cards(t), ["party_id"])


IDENTITY = [
    "party_id", "cif_number", "legal_name", "date_of_birth", "customer_segment", "lifestyle_segment", "employment_status",
    "annual_income_amount", "number_of_dependents", "lifecycle_status", "net_worth_band", "nps_score",
]


def customer_360(t: Tables) -> DataFrame:
    return gold.customer_360(
        customers(t),
        gold.agg_accounts(accounts(t)),
        gold.agg_loans(loans(t)),
        agg_payments(t),
        agg_cards(t),
        gold.latest_bureau(bureau(t)),
        gold.agg_app(activity(t), events_as_of()),
        gold.agg_telco(activity(t)),
        as_of(),
        identity=IDENTITY,
        stamp=False,
    )


def comparable(df: DataFrame) -> DataFrame:
    return flags_as_int(df)


# ---------------------------------------------------------------- SQL twins


def _list(items: list[str]) -> str:
    return ", ".join(items).replace("AS STRING", "AS VARCHAR")


def _any(condition: str, name: str) -> str:
    return f"CAST(max(CASE WHEN {condition} THEN 1 ELSE 0 END) AS INTEGER) AS {name}"


def _total(value: str, condition: str, name: str) -> str:
    return f"coalesce({sql_sum(f'CASE WHEN {condition} THEN {value} END')}, 0.0::DOUBLE) AS {name}"


def _since(days: int) -> str:
    return f"posting_date >= DATE '{AS_OF_DAY}' - {days}"


AGG_ACCOUNTS = f"""
SELECT party_id, count(deposit_account_id) AS num_accounts,
  {_total('current_balance', "account_status = 'active'", 'total_deposit_balance_myr')},
  {_any("account_type IN ('DDA', 'current_account_i')", 'has_current_account')},
  {_any("account_type IN ('savings', 'savings_i')", 'has_savings_account')},
  {_any("account_type = 'certificate_of_deposit'", 'has_fixed_deposit')},
  {sql_mean('current_balance')} AS avg_account_balance
FROM (SELECT {_list(ACCOUNTS)} FROM orders) GROUP BY party_id"""

AGG_LOANS = f"""
SELECT party_id, count(loan_account_id) AS num_loan_facilities,
  {_total('outstanding_principal_myr', "loan_status = 'active'", 'total_loan_outstanding_myr')},
  {_total('monthly_installment_myr', "loan_status = 'active'", 'monthly_loan_commitment_myr')},
  {_any("loan_type = 'home_loan'", 'has_home_loan')},
  {_any("loan_type = 'personal_loan'", 'has_personal_loan')},
  {_any("loan_type = 'hire_purchase'", 'has_hire_purchase')}
FROM (SELECT {_list(LOANS)} FROM orders) GROUP BY party_id"""

AGG_TRANSACTIONS = f"""
SELECT coalesce(p.party_id, c.party_id) AS party_id, p.* EXCLUDE (party_id), c.* EXCLUDE (party_id) FROM (
  SELECT o_custkey AS party_id,
    count(*) FILTER (WHERE {_since(30)}) AS txn_count_30d,
    count(*) FILTER (WHERE {_since(90)}) AS txn_count_90d,
    count(*) FILTER (WHERE {_since(365)}) AS txn_count_12m,
    {_total('payment_amount', f"txn_type = 'DEBIT' AND {_since(30)}", 'total_debit_30d_myr')},
    {_total('payment_amount', f"txn_type = 'CREDIT' AND {_since(30)}", 'total_credit_30d_myr')},
    {sql_mean('payment_amount')} AS avg_txn_amount_myr
  FROM (SELECT {_list(PAYMENTS)} FROM lineitem) JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) p
FULL JOIN (
  SELECT o_custkey AS party_id,
    {_any("card_type = 'credit'", 'has_credit_card')},
    {_total('txn_amount', _since(30), 'card_spend_30d_myr')},
    {_any('is_overseas', 'overseas_txn_flag')}
  FROM (SELECT {_list(CARDS)} FROM lineitem WHERE l_linestatus = 'F') JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) c
ON p.party_id = c.party_id"""

AGG_DIGITAL = f"""
SELECT *,
  {sql_round("coalesce(mobile_sessions_30d, 0) * 0.4::DOUBLE + coalesce(digital_maturity_score, 5.0::DOUBLE) * 0.6::DOUBLE", 1, 17)} AS digital_activity_score,
  {sql_round("coalesce(data_consumption_mb_monthly, 0.0::DOUBLE) / 1024.0::DOUBLE", 2, 17)} AS telco_data_consumption_gb_monthly
FROM (
  SELECT coalesce(a.party_id, s.party_id) AS party_id, a.* EXCLUDE (party_id), s.* EXCLUDE (party_id) FROM (
    SELECT user_id AS party_id,
      count(*) FILTER (WHERE ts >= DATE '{EVENTS_DAY}' - 30) AS mobile_sessions_30d,
      count(*) FILTER (WHERE event_type = 'view' AND ts >= DATE '{EVENTS_DAY}' - 30) AS product_views_last_30d,
      arg_max(category, (ts, event_id)) FILTER (WHERE event_type = 'view' AND category IS NOT NULL) AS last_product_category_viewed
    FROM (SELECT *, CASE WHEN k < 20 THEN 'home_loan' WHEN k < 40 THEN 'personal_loan' WHEN k < 60 THEN 'credit_card'
            WHEN k < 80 THEN 'insurance' END AS category
          FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))
    WHERE event_type IN ('click', 'view', 'signup') GROUP BY 1) a
  FULL JOIN (
    SELECT user_id AS party_id, {sql_mean('value')} AS digital_maturity_score,
      {sql_mean('(value * 1000.0::DOUBLE)')} AS data_consumption_mb_monthly, {sql_mean('(value * 2.0::DOUBLE)')} AS telco_arpu_myr
    FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1) s
  ON a.party_id = s.party_id)"""

BUREAU_LATEST = f"""
SELECT cif_number, ctos_score, ccris_status, monthly_total_commitment_myr AS kb_monthly_commitment_myr, payment_conduct_12m
FROM (SELECT *, row_number() OVER (PARTITION BY cif_number ORDER BY bureau_pull_timestamp DESC, ctos_score DESC,
        monthly_total_commitment_myr DESC, ccris_status DESC, payment_conduct_12m DESC) AS rn
      FROM (SELECT {_list(BUREAU)} FROM orders)) WHERE rn = 1"""


def _zero(columns: str, value: str) -> str:
    return ", ".join(f"coalesce({c}, {value}) AS {c}" for c in columns.split())


CUSTOMER_360 = f"""
SELECT {', '.join('c.' + c for c in IDENTITY)},
  CAST(trunc(date_diff('day', date_of_birth, DATE '{AS_OF_DAY}') / 365.0) AS INTEGER) AS age,
  CAST(trunc(date_diff('day', relationship_start_date, DATE '{AS_OF_DAY}') / 365.0) AS INTEGER) AS relationship_tenure_years,
  CAST(is_shariah_preferred AS INTEGER) AS is_shariah_preferred,
  {_zero('num_accounts num_loan_facilities txn_count_30d txn_count_90d txn_count_12m mobile_sessions_30d product_views_last_30d', '0')},
  {_zero('total_deposit_balance_myr total_loan_outstanding_myr monthly_loan_commitment_myr total_debit_30d_myr total_credit_30d_myr '
         'avg_txn_amount_myr card_spend_30d_myr kb_monthly_commitment_myr telco_data_consumption_gb_monthly telco_arpu_myr', '0.0::DOUBLE')},
  {_zero('has_current_account has_savings_account has_fixed_deposit has_home_loan has_personal_loan has_hire_purchase has_credit_card overseas_txn_flag', '0')},
  {_zero('digital_activity_score digital_maturity_score', '5.0::DOUBLE')},
  avg_account_balance, ctos_score, ccris_status, payment_conduct_12m, last_product_category_viewed,
  CAST(0 AS INTEGER) AS total_credit_facilities, CAST(0 AS INTEGER) AS legal_cases_count,
  CAST(0 AS INTEGER) AS credit_card_bureau_count, CAST(0 AS INTEGER) AS inquiry_count_last_6m,
  CAST(NULL AS VARCHAR) AS bankruptcy_status,
  coalesce(has_credit_card, 0) AS owns_credit_card, coalesce(has_home_loan, 0) AS owns_home_loan,
  coalesce(has_personal_loan, 0) AS owns_personal_loan
FROM (SELECT {_list(CUSTOMERS)} FROM customer) c
LEFT JOIN ({AGG_ACCOUNTS}) acct ON c.party_id = acct.party_id
LEFT JOIN ({AGG_LOANS}) loan ON c.party_id = loan.party_id
LEFT JOIN ({AGG_TRANSACTIONS}) txn ON c.party_id = txn.party_id
LEFT JOIN ({AGG_DIGITAL}) dig ON c.party_id = dig.party_id
LEFT JOIN ({BUREAU_LATEST}) bur ON c.cif_number = bur.cif_number
WHERE c.cif_number IS NOT NULL AND c.lifecycle_status = 'active'"""

"""Features, labels, recommendations, splits and model versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.encoding import label_of, one_hot, top_two, uniform
from ledgerloom.operators import joins, measures, ranking
from ledgerloom.plans import features as f
from ledgerloom.plans.scoring import eval_log
from ledgerloom.queries import adapters as a
from ledgerloom.queries.base import Tables, flags_as_int, query, sql_round, sql_sum


def _codes(column: str, codes: dict[str, int], default: int = 0) -> str:
    whens = " ".join(f"WHEN '{k.lower()}' THEN {v}" for k, v in codes.items())
    return f"CASE lower({column}) {whens} ELSE {default} END"


_FEATURES = f"""
SELECT *, CAST(relationship_tenure_years AS DOUBLE) AS tenure_years,
  {_codes('net_worth_band', f.NET_WORTH)} AS net_worth_band_encoded,
  {_codes('ccris_status', f.BUREAU_STATUS)} AS ccris_status_encoded,
  {_codes('employment_status', f.EMPLOYMENT)} AS employment_status_encoded,
  {_codes('last_product_category_viewed', f.PRODUCT_VIEWED, -1)} AS last_product_category_viewed_encoded,
  is_shariah_preferred AS is_shariah_preferred_int, coalesce(CAST(nps_score AS DOUBLE), 50.0::DOUBLE) AS payment_conduct_score,
  coalesce(ctos_score, 600) AS score_filled
FROM ({a.CUSTOMER_360})"""
_LABEL = """CASE
  WHEN score_filled > 700 AND annual_income_amount > 60000 AND has_credit_card = 0 THEN 'CREDIT_CARD'
  WHEN age BETWEEN 28 AND 45 AND number_of_dependents > 0 AND has_home_loan = 0 AND annual_income_amount > 48000 THEN 'HOME_LOAN'
  WHEN annual_income_amount > 0 AND monthly_loan_commitment_myr / annual_income_amount * 12 > 0.20::DOUBLE THEN 'PERSONAL_LOAN'
  WHEN net_worth_band_encoded >= 3 AND annual_income_amount > 100000 THEN 'INVESTMENT'
  WHEN num_loan_facilities > 0 AND payment_conduct_score >= 40 THEN 'INSURANCE' ELSE 'NO_ACTION' END"""


@query(
    f"""SELECT party_id, {_LABEL} AS next_best_product, tenure_years, total_deposit_balance_myr, num_accounts, annual_income_amount,
  net_worth_band_encoded, score_filled AS ctos_score, ccris_status_encoded, payment_conduct_score, age, number_of_dependents,
  employment_status_encoded, monthly_loan_commitment_myr, num_loan_facilities, txn_count_30d, avg_txn_amount_myr, has_credit_card,
  digital_maturity_score, telco_arpu_myr, is_shariah_preferred_int, last_product_category_viewed_encoded FROM ({_FEATURES})"""
)
def q_features(t: Tables) -> DataFrame:
    return flags_as_int(f.customer_features(a.customer_360(t)))


@query(f"SELECT next_best_product, count(*) AS n FROM (SELECT {_LABEL} AS next_best_product FROM ({_FEATURES})) GROUP BY 1")
def q_label_rules(t: Tables) -> DataFrame:
    labelled = f.label(f.encode(a.customer_360(t)))
    return labelled.groupBy("next_best_product").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH s AS (SELECT o_custkey AS id, count(*) AS n_open, {sql_sum('o_totalprice')} AS open_value FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
w AS (SELECT o_custkey AS id, count(*) AS n_open, {sql_sum('o_totalprice')} AS open_value FROM orders WHERE o_totalprice > 300000 GROUP BY 1)
SELECT c_custkey AS id, CAST(coalesce(s.n_open, w.n_open, 0) AS DOUBLE) AS n_open, coalesce(s.open_value, w.open_value, 0.0::DOUBLE) AS open_value
FROM customer LEFT JOIN s ON c_custkey = s.id LEFT JOIN w ON c_custkey = w.id"""
)
def q_feature_lookup(t: Tables) -> DataFrame:
    """First from open orders, else from large orders, else 0."""
    orders = t.orders.withColumnRenamed("o_custkey", "id")
    build = lambda rows: measures.rollup(rows, ["id"], [measures.count("n_open"), measures.total("open_value", F.col("o_totalprice"))])
    return joins.lookup_with_fallback(
        t.customer.select(F.col("c_custkey").alias("id")),
        build(orders.where(F.col("o_orderstatus") == "O")),
        build(orders.where(F.col("o_totalprice") > 300000)),
        "id",
        ["n_open", "open_value"],
    )


@query("SELECT quality, toxic, lang, n_chars FROM labels LEFT JOIN documents USING (doc_id)")
def q_training_set(t: Tables) -> DataFrame:
    """Label rows with the features of their key, the key dropped."""
    return joins.lookup(t.labels, t.documents.select("doc_id", "lang", "n_chars"), "doc_id", drop_key=True)


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query(
    f"""WITH s AS (SELECT o_custkey AS party_id, label, count(*) FILTER (WHERE o_orderpriority = label) / CAST(count(*) AS DOUBLE) AS p
  FROM orders, (VALUES {', '.join(f"('{x}')" for x in _PRIORITIES)}) v(label) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY party_id ORDER BY p DESC, label) AS rn FROM s)
SELECT party_id, max(CASE WHEN rn = 1 THEN label END) AS recommendation_1, max(CASE WHEN rn = 1 THEN {sql_round('p * 100', 1, 16)} END) AS confidence_1,
  max(CASE WHEN rn = 2 THEN label END) AS recommendation_2, max(CASE WHEN rn = 2 THEN {sql_round('p * 100', 1, 16)} END) AS confidence_2
FROM r GROUP BY party_id"""
)
def q_top2(t: Tables) -> DataFrame:
    return _recommended(t)


def _recommended(t: Tables) -> DataFrame:
    """Share of each order priority as its probability."""
    n = F.count(F.lit(1)).cast("double")
    shares = t.orders.groupBy(F.col("o_custkey").alias("party_id")).agg(
        F.array(*[F.count_if(F.col("o_orderpriority") == p) / n for p in _PRIORITIES]).alias("probabilities")
    )
    return shares.select("party_id", *top_two(F.col("probabilities"), _PRIORITIES))


@query(
    "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN '1-URGENT' WHEN 'SMALL' THEN '2-HIGH' WHEN 'PROMO' THEN '3-MEDIUM' "
    "WHEN 'LARGE' THEN '4-NOT SPECIFIED' ELSE '1-URGENT' END AS decoded, "
    "CASE p_type WHEN 'ECONOMY' THEN 1.0::DOUBLE WHEN 'SMALL' THEN 0.0::DOUBLE WHEN 'PROMO' THEN 0.0::DOUBLE WHEN 'LARGE' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS p_first, "
    "0.2::DOUBLE AS p_unknown FROM part"
)
def q_class_fallback(t: Tables) -> DataFrame:
    """A model that returns bare class indices: one-hot vectors; without any answer, uniform ones."""
    index = (
        F.when(F.col("p_type") == "ECONOMY", 0).when(F.col("p_type") == "SMALL", 1).when(F.col("p_type") == "PROMO", 2)
        .when(F.col("p_type") == "LARGE", 3).otherwise(9)
    )
    rows = t.part.select("p_partkey", index.alias("i"))
    valid = F.when(F.col("i") < len(_PRIORITIES), F.col("i")).otherwise(0)
    return rows.select(
        "p_partkey",
        label_of(valid, _PRIORITIES).alias("decoded"),
        F.get(one_hot(F.col("i"), len(_PRIORITIES)), 0).alias("p_first"),
        F.get(uniform(len(_PRIORITIES)), 4).alias("p_unknown"),
    )


@query(
    """SELECT p_brand, coalesce(max(CASE WHEN p_type = 'ECONOMY' AND p_size >= 45 THEN p_partkey END),
  max(CASE WHEN p_type = 'SMALL' AND p_size >= 40 THEN p_partkey END), max(p_partkey)) AS version,
  CASE WHEN max(CASE WHEN p_type = 'ECONOMY' AND p_size >= 45 THEN 1 END) = 1 THEN 'champion'
  WHEN max(CASE WHEN p_type = 'SMALL' AND p_size >= 40 THEN 1 END) = 1 THEN 'dev' ELSE 'latest' END AS resolved_by FROM part GROUP BY 1"""
)
def q_resolve_version(t: Tables) -> DataFrame:
    """Brands as models, part keys as versions."""
    alias = F.when((F.col("p_type") == "ECONOMY") & (F.col("p_size") >= 45), "champion").when(
        (F.col("p_type") == "SMALL") & (F.col("p_size") >= 40), "dev"
    )
    return ranking.resolve_version(t.part.withColumn("alias", alias), "p_brand", "p_partkey", "alias")


@query(
    """WITH h AS (SELECT o_orderkey, o_orderpriority, CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '|42'), 1, 15) AS BIGINT) AS h FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY h, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM h)
SELECT o_orderkey, o_orderpriority, CASE WHEN n >= 2 AND r <= greatest(floor(n * 0.2::DOUBLE + 0.5), 1) THEN 'test' ELSE 'train' END AS split FROM r"""
)
def q_stratified_split(t: Tables) -> DataFrame:
    return ranking.stratified_split(t.orders.select("o_orderkey", "o_orderpriority"), ["o_orderkey"], "o_orderpriority")


@query(
    "SELECT conv_id, turn, CASE WHEN CAST('0x' || substr(md5(CAST(conv_id AS VARCHAR) || '|0'), 1, 15) AS BIGINT) % 100 < 70 "
    "THEN 'primary' ELSE 'secondary' END AS route FROM conversations"
)
def q_traffic_split(t: Tables) -> DataFrame:
    return ranking.traffic_split(t.conversations.select("conv_id", "turn"), ["conv_id"], "primary", "secondary")


@query(
    "SELECT CAST(event_id AS VARCHAR) AS request_id, CASE WHEN event_type IN ('view', 'error') THEN 'HOME_LOAN' WHEN event_type = 'click' THEN 'NO_ACTION' "
    "ELSE 'INSURANCE' END AS predicted_label, ts AS scored_at, 'realtime_endpoint' AS source FROM "
    "(SELECT * REPLACE (date_trunc('millisecond', ts) AS ts) FROM events) WHERE event_type <> 'signup'"
)
def q_eval_log(t: Tables) -> DataFrame:
    """Served responses that hold an index, a label, a probability array or nothing."""
    response = (
        F.when(F.col("event_type") == "view", '{"predictions": [1]}')
        .when(F.col("event_type") == "error", '{"predictions": ["HOME_LOAN"]}')
        .when(F.col("event_type") == "click", '{"predictions": [[0.1, 0.1, 0.1, 0.1, 0.5, 0.1]]}')
        .when(F.col("event_type") == "purchase", '{"predictions": [[0.1, 0.2, 0.3, 0.3, 0.05, 0.05]]}')
        .otherwise('{"error": "timeout"}')
    )
    log = t.events.select(
        F.col("event_id").cast("string").alias("request_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"),
        response.alias("response"),
    )
    classes = ("CREDIT_CARD", "HOME_LOAN", "INSURANCE", "INVESTMENT", "NO_ACTION", "PERSONAL_LOAN")
    return eval_log(log, classes).withColumn("scored_at", F.col("scored_at").cast("timestamp_ntz"))

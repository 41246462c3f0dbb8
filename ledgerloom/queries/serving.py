"""Queries of the relationship-manager app, and usage checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import measures, ranking
from ledgerloom.plans import documents, serving
from ledgerloom.queries.base import ORACLES, Tables, query, utc_ntz
from ledgerloom.queries.scoring import _recommended
from ledgerloom.streaming.ratelimit import over_limit

_TOP2 = ORACLES["q_top2"]


@query("SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND contains(lower(c_name), '#00000011') ORDER BY c_acctbal DESC, c_custkey")
def q_search(t: Tables) -> DataFrame:
    hits = ranking.search(t.customer, "R#00000011", ["c_name"], {"c_mktsegment": "BUILDING", "c_nationkey": None})
    return hits.orderBy(F.desc("c_acctbal"), "c_custkey")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 200")
def q_top_customers(t: Tables) -> DataFrame:
    return ranking.top(t.customer.select("c_custkey", "c_name", "c_acctbal"), "c_acctbal", "c_custkey", 200)


@query("SELECT * FROM customer ORDER BY lower(c_mktsegment) DESC, c_custkey LIMIT 25 OFFSET 25")
def q_page(t: Tables) -> DataFrame:
    return ranking.page(t.customer, "c_mktsegment", "c_custkey", 2, 25, descending=True, text=True)


@query("SELECT * FROM customer WHERE c_custkey > 41 ORDER BY c_custkey LIMIT 25")
def q_page_after(t: Tables) -> DataFrame:
    return ranking.page_after(t.customer, "c_custkey", 41, 25)


@query(
    f"""SELECT c_custkey AS party_id, c_acctbal AS total_deposit_balance_myr, coalesce(recommendation_1, 'PENDING') AS recommendation_1,
  coalesce(CAST(confidence_1 AS VARCHAR), '0') AS confidence_1 FROM customer LEFT JOIN ({_TOP2}) r ON c_custkey = r.party_id"""
)
def q_customers_with_recs(t: Tables) -> DataFrame:
    base = t.customer.select(F.col("c_custkey").alias("party_id"), F.col("c_acctbal").alias("total_deposit_balance_myr"))
    return serving.with_recommendations(base, _recommended(t))


@query(
    f"""SELECT c_custkey AS party_id, 'active' AS lifecycle_status, c_acctbal AS total_deposit_balance_myr, coalesce(recommendation_1, 'PENDING') AS recommendation_1,
  coalesce(CAST(confidence_1 AS VARCHAR), '0') AS confidence_1
FROM (SELECT * FROM customer WHERE c_acctbal >= 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 200) LEFT JOIN ({_TOP2}) r ON c_custkey = r.party_id"""
)
def q_customer_list(t: Tables) -> DataFrame:
    base = t.customer.select(
        F.col("c_custkey").alias("party_id"),
        F.when(F.col("c_acctbal") >= 0, "active").otherwise("dormant").alias("lifecycle_status"),
        F.col("c_acctbal").alias("total_deposit_balance_myr"),
    )
    return serving.list_customers(base, _recommended(t))


@query(
    """WITH u AS (SELECT CASE role WHEN 'assistant' THEN 'advice-primary' WHEN 'user' THEN 'advice-mobile' ELSE 'audit' END AS endpoint_name,
  1700000000000 + conv_id * 60000 + turn * 1000 AS timestamp_ms, role AS model_name, 'conv' || conv_id AS "user", length(text) AS n FROM conversations)
SELECT timestamp_ms, make_timestamp(timestamp_ms * 1000) AS request_time, sha256(endpoint_name || '|' || timestamp_ms || '|' || "user") AS request_id,
  model_name, "user", n AS prompt_tokens, n * 2 AS completion_tokens, n * 3 AS total_tokens, 'stop' AS finish_reason
FROM u WHERE starts_with(endpoint_name, 'advice') ORDER BY timestamp_ms DESC, request_id LIMIT 20"""
)
def q_usage_audit(t: Tables) -> DataFrame:
    n = F.length("text").cast("bigint")
    endpoint = F.when(F.col("role") == "assistant", "advice-primary").when(F.col("role") == "user", "advice-mobile").otherwise("audit")
    log = t.conversations.select(
        endpoint.alias("endpoint_name"),
        (F.lit(1700000000000) + F.col("conv_id") * 60000 + F.col("turn") * 1000).alias("timestamp_ms"),
        F.struct(F.col("role").alias("model_name"), F.concat(F.lit("conv"), "conv_id").alias("user")).alias("request_metadata"),
        F.struct(n.alias("prompt_tokens"), (n * 2).alias("completion_tokens"), (n * 3).alias("total_tokens")).alias("usage"),
        F.struct(F.lit("stop").alias("finish_reason")).alias("response_metadata"),
    )
    return serving.usage_audit(log, "advice").withColumn("request_time", utc_ntz(F.col("request_time")))


@query("SELECT user_id, date_trunc('minute', ts) AS period_start, count(*) AS calls FROM events GROUP BY ALL HAVING count(*) > 1")
def q_rate_limit(t: Tables) -> DataFrame:
    hits = over_limit(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "minute", 1)
    return hits.withColumn("period_start", F.col("period_start").cast("timestamp_ntz"))


@query("SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS period_start, count(*) AS calls FROM events GROUP BY ALL HAVING count(*) > 60")
def q_rate_limit_daily(t: Tables) -> DataFrame:
    hits = over_limit(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "event_type", "ts", "day", 60)
    return hits.withColumn("period_start", F.col("period_start").cast("timestamp_ntz"))


@query(
    f"""WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey AS party_id, 'Customer: ' || c_name || ' | Segment: ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' | Tenure: ' || coalesce(n, 0) || ' years | Income: MYR '
  || format('{{:,}}', CAST(round(CAST(c_acctbal * 12 AS DECIMAL(30, 8)), 0) AS BIGINT)) || ' | Product: ' || coalesce(recommendation_1, 'PENDING')
  || ' (' || CAST(CAST(round(CAST(coalesce(confidence_1, 0) AS DECIMAL(20, 8)), 0) AS BIGINT) AS VARCHAR) || '%)' AS context
FROM customer LEFT JOIN o ON c_custkey = o_custkey LEFT JOIN ({_TOP2}) r ON c_custkey = r.party_id WHERE c_acctbal >= 0"""
)
def q_prompt_context(t: Tables) -> DataFrame:
    orders = measures.rollup(t.orders.select(F.col("o_custkey").alias("party_id")), ["party_id"], [measures.count("relationship_tenure_years")])
    base = t.customer.where(F.col("c_acctbal") >= 0).select(
        F.col("c_custkey").alias("party_id"),
        F.col("c_name").alias("legal_name"),
        F.col("c_mktsegment").alias("lifestyle_segment"),
        (F.col("c_acctbal") * 12).alias("annual_income_amount"),
    )
    return documents.customer_context(base.join(orders, "party_id", "left").join(_recommended(t), "party_id", "left"))

"""Queries the relationship-manager app asks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.columns import ref
from ledgerloom.operators import ranking


def with_recommendations(customers: DataFrame, recommendations: DataFrame | None, key: str = "party_id") -> DataFrame:
    """Customers with their first recommendation; PENDING and 0 where there is none,
    also while the recommendation table does not exist yet."""
    if recommendations is None:
        return customers.withColumns({"recommendation_1": F.lit("PENDING"), "confidence_1": F.lit("0")})
    recs = recommendations.select(ref(key), "recommendation_1", F.col("confidence_1").cast("string"))
    return customers.join(recs, key, "left").withColumns(
        {
            "recommendation_1": F.coalesce("recommendation_1", F.lit("PENDING")),
            "confidence_1": F.coalesce("confidence_1", F.lit("0")),
        }
    )


def list_customers(gold: DataFrame, recommendations: DataFrame | None, n: int = 200) -> DataFrame:
    """The n largest active customers; only those n are joined."""
    active = gold.where(F.col("lifecycle_status") == "active")
    largest = ranking.top(active, "total_deposit_balance_myr", "party_id", n)
    return with_recommendations(largest, recommendations).orderBy(F.desc("total_deposit_balance_myr"), "party_id")


def search_customers(gold: DataFrame, text: str, n: int = 10) -> DataFrame:
    hits = ranking.search(
        gold.where(F.col("lifecycle_status") == "active"), text, ["legal_name", "cif_number"]
    )
    return ranking.top(hits, "total_deposit_balance_myr", "party_id", n)


def customer(gold: DataFrame, party_id: object) -> DataFrame:
    return gold.where(F.col("party_id") == F.lit(party_id))


def usage_audit(log: DataFrame, endpoint_prefix: str, n: int = 20) -> DataFrame:
    """Latest model calls of an endpoint family, nested fields flattened."""
    rows = log.where(F.col("endpoint_name").startswith(endpoint_prefix)).select(
        F.col("timestamp_ms"),
        F.timestamp_millis("timestamp_ms").alias("request_time"),
        F.sha2(F.concat_ws("|", "endpoint_name", "timestamp_ms", "request_metadata.user"), 256).alias("request_id"),
        "request_metadata.model_name",
        "request_metadata.user",
        "usage.prompt_tokens",
        "usage.completion_tokens",
        "usage.total_tokens",
        "response_metadata.finish_reason",
    )
    return rows.orderBy(F.desc("timestamp_ms"), "request_id").limit(n)

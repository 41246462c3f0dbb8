"""Distribution drift and the gates that read it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.columns import ref


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """value, share; the total is a scalar subquery over the counts."""
    counts = df.groupBy(ref(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("value", (F.col("n") / counts.agg(F.sum("n")).scalar()).alias("share"))


def js_distance(baseline: DataFrame, recent: DataFrame, column: str) -> DataFrame:
    """Jensen-Shannon distance (base 2, 0..1) between two samples of a column; one row."""
    p = frequencies(baseline, column).withColumnRenamed("share", "p")
    q = frequencies(recent, column).withColumnRenamed("share", "q")
    both = p.join(q.withColumnRenamed("value", "_v"), F.col("value").eqNullSafe(F.col("_v")), "full_outer").select(
        F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q")
    )
    middle = (F.col("p") + F.col("q")) / F.lit(2)

    def term(x: str) -> Column:
        return F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / middle)).otherwise(F.lit(0.0))

    divergence = F.sum((term("p") + term("q")) / F.lit(2))
    return both.agg(F.sqrt(F.greatest(divergence, F.lit(0.0))).alias("js_distance"))


def latest_metric(metrics: DataFrame, column_name: str, metric_name: str) -> DataFrame:
    """Newest row of a stored drift-metric table."""
    rows = metrics.where((F.col("column_name") == column_name) & (F.col("metric_name") == metric_name))
    return rows.orderBy(F.desc("window_start_time")).limit(1)


def drift_gate(distance: DataFrame, threshold: float = 0.15, force: bool = False, column: str = "js_distance") -> DataFrame:
    """One decision row (retrain, reason), also when there is no metric yet."""
    value = F.max(ref(column))
    shown = F.format_string("js_distance=%.4f_exceeds_" + str(threshold), F.col("_d"))
    over = F.col("_d") > F.lit(threshold)
    reason = (
        F.when(F.lit(force), "force_retrain_override")
        .when(F.col("_d").isNull(), "no_metrics_available")
        .when(over, shown)
        .otherwise("no_drift")
    )
    return distance.agg(value.alias("_d")).select(
        F.col("_d").alias("js_distance"),
        (F.lit(force) | F.coalesce(over, F.lit(False))).alias("retrain_needed"),
        reason.alias("drift_reason"),
    )


def quality_gate(scores: DataFrame, threshold: float = 0.30, column: str = "macro_f1") -> DataFrame:
    """approved / rejected against the minimum macro F1."""
    f1 = ref(column)
    ok = F.coalesce(f1 >= F.lit(threshold), F.lit(False))
    return scores.select(
        f1.alias("macro_f1"),
        F.when(ok, "approved").otherwise("rejected").alias("approval_status"),
        F.when(~ok, F.format_string("f1=%.4f < threshold=" + str(threshold), F.coalesce(f1, F.lit(0.0)))).alias("rejection_reason"),
    )


def challenger_gate(runs: DataFrame, champion: str, challenger: str, tolerance: float = 0.02) -> DataFrame:
    """Promote when the challenger loses at most ``tolerance`` macro F1. ``runs``: name, macro_f1."""
    best = lambda who: F.max(F.when(F.col("name") == who, F.col("macro_f1")))
    return runs.agg((best(challenger) - best(champion)).alias("f1_diff")).withColumn(
        "promote", F.coalesce(F.col("f1_diff") >= F.lit(-tolerance), F.lit(False))
    )

"""Profiling aggregates: frequencies, shares, statistics, histograms, metrics.

All are single partial/final aggregations unless noted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.columns import flag, ref
from ledgerloom.operators import measures as m
from ledgerloom.operators.joins import align_groups
from ledgerloom.operators.percentiles import exact_percentiles


def group_count(df: DataFrame, column: str, alias: str | None = None, count_name: str = "count") -> DataFrame:
    """Frequency table, most frequent first, value as tie-break."""
    name = alias or column
    return (
        df.groupBy(ref(column).alias(name))
        .agg(F.count(F.lit(1)).alias(count_name))
        .orderBy(F.desc(count_name), F.asc_nulls_last(name))
    )


def ownership(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Per flag the share in per cent (1 decimal) and the number of owners, plus the total."""
    owns = {f: ref(f).cast("int") for f in flags}
    pct = [F.round(F.avg(v) * F.lit(100), 1).alias(f"pct_{f}") for f, v in owns.items()]
    n = [F.coalesce(F.sum(v), F.lit(0)).cast("long").alias(f"n_{f}") for f, v in owns.items()]
    return df.agg(*pct, *n, F.count(F.lit(1)).alias("total_customers"))


def ownership_by(df: DataFrame, by: str, flags: Sequence[str]) -> DataFrame:
    return df.groupBy(by).agg(
        *[F.coalesce(F.sum(ref(f).cast("int")), F.lit(0)).cast("long").alias(f"n_{f}") for f in flags]
    )


def segment_means(df: DataFrame, by: str, values: Mapping[str, str]) -> DataFrame:
    """Per segment: row count and the mean of each value (result name -> column), from exact sums."""
    return m.rollup(df, [by], [m.count("n"), *[m.mean(name, ref(c)) for name, c in values.items()]])


def top_segment(means: DataFrame, by: str, metric: str) -> DataFrame:
    return means.orderBy(F.desc(metric), F.asc(by)).limit(1)


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: count, mean, stddev, min, max; one scan for all."""
    stats = []
    for c in columns:
        v = ref(c).cast("double")
        stats.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(v).alias("n"),
                F.avg(v).alias("mean"),
                F.stddev_samp(v).alias("stddev"),
                F.min(v).alias("min"),
                F.max(v).alias("max"),
            )
        )
    return df.agg(F.array(*stats).alias("_s")).select(F.inline("_s"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise Pearson correlation as (left, right, corr); one scan for all pairs."""
    pairs = [
        F.struct(F.lit(a).alias("left_column"), F.lit(b).alias("right_column"), F.corr(ref(a), ref(b)).alias("corr"))
        for a, b in combinations(columns, 2)
    ]
    return df.agg(F.array(*pairs).alias("_p")).select(F.inline("_p"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins 0..bins-1 between minimum and maximum, the maximum in the last.

    The bounds are a scalar subquery of one row; empty bins are left out.
    """
    value = ref(column).cast("double")
    rows = df.where(value.isNotNull())
    bounds = rows.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("b")).scalar()
    placed = rows.select(value.alias("_v"), bounds.alias("_b"))
    width = (F.col("_b.hi") - F.col("_b.lo")) / F.lit(bins)
    at = F.floor(F.coalesce(F.try_divide(F.col("_v") - F.col("_b.lo"), width), F.lit(0.0)))
    return (
        placed.select(F.least(at, F.lit(bins - 1)).cast("int").alias("bin"), "_b")
        .groupBy("bin", "_b")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("bin", (F.col("_b.lo") + F.col("bin") * width).alias("low"), "n")
    )


def quartiles(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Box-plot figures per group: quartiles (exact), minimum, maximum, count."""
    q = exact_percentiles(df, by, column, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    ends = df.groupBy(*by).agg(
        F.min(ref(column)).alias("low"), F.max(ref(column)).alias("high"), F.count(ref(column)).alias("n")
    )
    return align_groups(ends, q, by)


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, median) of numeric columns, each a group of one percentile run.

    A pass reads each row once and makes a narrow row of every column.
    """
    cells = [F.struct(F.lit(c).alias("column_name"), ref(c).cast("double").alias("v")) for c in columns]
    return exact_percentiles(df.select(F.inline(F.array(*cells))), ["column_name"], "v", {"median": 0.5})


def conditional_share(df: DataFrame, among: Column, eligible: Column) -> DataFrame:
    """Per cent of the rows in ``among`` that are also ``eligible``."""
    return df.where(among).agg(
        F.count(F.lit(1)).alias("n_among"),
        F.count_if(flag(eligible)).alias("n_eligible"),
        F.coalesce(
            F.try_divide(F.count_if(flag(eligible)) * F.lit(100.0), F.count(F.lit(1))), F.lit(0.0)
        ).alias("pct_eligible"),
    )


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    """label, n, share; the total is a scalar subquery over the label counts."""
    counts = df.groupBy(ref(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())


def table_stats(tables: Mapping[str, DataFrame], freshness: Mapping[str, str] | None = None) -> DataFrame:
    """table_name, n_rows, latest (text); one aggregate per table, unioned."""
    freshness = freshness or {}
    parts = []
    for name, df in tables.items():
        newest = F.max(ref(freshness[name])) if name in freshness else F.lit(None)
        parts.append(
            df.agg(F.count(F.lit(1)).alias("n_rows"), newest.cast("string").alias("latest")).select(
                F.lit(name).alias("table_name"), "n_rows", "latest"
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def portfolio_kpis(df: DataFrame, active: Column, balance: str, score: str, recommendation: str) -> DataFrame:
    """One row: active customers, total balance, mean score, per cent with an actionable recommendation."""
    real = ref(recommendation).isNotNull() & ~ref(recommendation).isin("PENDING", "NO_ACTION")
    sums = m.rollup(
        df.where(active),
        [],
        [m.count("active_customers"), m.total("total_balance", ref(balance)), m.total("score", ref(score).cast("long")), m.count("real", real)],
    )
    n = F.col("active_customers")
    return sums.select(
        n,
        "total_balance",
        F.coalesce(F.round(F.try_divide(F.col("score"), n)), F.lit(0.0)).alias("avg_score"),
        F.coalesce(F.round(F.try_divide(F.col("real") * F.lit(100), n)), F.lit(0.0)).alias("pct_recommended"),
    )


def daily_profile(df: DataFrame, at: str, keys: Sequence[str]) -> DataFrame:
    """Rows per day and key combination."""
    return df.groupBy(F.to_date(ref(at)).alias("day"), *[ref(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))


def latency_stats(df: DataFrame, by: Sequence[str], latency: str, failed: Column) -> DataFrame:
    """Per group: requests, errors, error per cent, mean and exact 95th percentile."""
    base = m.rollup(df, by, [m.count("requests"), m.count("errors", flag(failed)), m.mean("avg_latency", ref(latency))])
    p95 = exact_percentiles(df, by, latency, {"p95_latency": 0.95})
    return align_groups(base, p95, by).withColumn(
        "error_pct", F.col("errors") * F.lit(100.0) / F.col("requests")
    )


def latency_summary(rounds: DataFrame) -> DataFrame:
    """Totals over the rounds of ``latency_stats``: mean of means, worst p95, error rate."""
    return rounds.agg(
        F.sum("requests").alias("requests"),
        F.sum("errors").alias("errors"),
        F.avg("avg_latency").alias("avg_latency"),
        F.max("p95_latency").alias("p95_latency"),
        F.coalesce(F.try_divide(F.sum("errors") * F.lit(100.0), F.sum("requests")), F.lit(0.0)).alias("error_pct"),
    )


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(ref(actual).alias("actual"), ref(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_metrics(matrix: DataFrame, classes: Sequence[object] | None = None) -> DataFrame:
    """precision, recall, F1 and support per class; 0 where undefined.

    Each cell of the confusion matrix adds to its actual and its predicted class.
    """
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    cells = matrix.select(
        F.inline(
            F.array(
                F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed"), hit.cast("long").alias("hits")),
                F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("guessed"), F.lit(0).cast("long").alias("hits")),
            )
        )
    )
    if classes is not None:
        zero = F.lit(0).cast("long")
        kind = matrix.schema["actual"].dataType
        blanks = matrix.sparkSession.range(1).select(
            F.explode(F.array(*[F.lit(c).cast(kind) for c in classes])).alias("label"),
            zero.alias("support"),
            zero.alias("guessed"),
            zero.alias("hits"),
        )
        cells = cells.unionByName(blanks)
    sums = cells.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "guessed", "hits")])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(F.col("hits"), F.col("guessed")), ratio(F.col("hits"), F.col("support"))
    scored = sums.select("label", "support", p.alias("precision"), r.alias("recall"))
    both = F.col("precision") + F.col("recall")
    return scored.withColumn("f1", ratio(F.lit(2.0) * F.col("precision") * F.col("recall"), both))


def macro_f1(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.avg("f1").alias("macro_f1"), F.count(F.lit(1)).alias("n_classes"))

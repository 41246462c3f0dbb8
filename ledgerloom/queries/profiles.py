"""Profiling, drift and model-metric queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import drift, measures, profile, ranking
from ledgerloom.queries.base import Tables, query, rounded, sql_mean, sql_round, sql_sum


@query("SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1 ORDER BY 2 DESC, 1")
def q_group_count(t: Tables) -> DataFrame:
    return profile.group_count(t.customer, "c_mktsegment", "segment", "n")


_FLAGS = {"urgent": "1-URGENT", "high": "2-HIGH", "low": "5-LOW"}
_OWNERS = (
    "(SELECT c_custkey, c_mktsegment, "
    + ", ".join(f"max(CASE WHEN o_orderpriority = '{v}' AND o_totalprice > 250000 THEN 1 ELSE 0 END) AS {k}" for k, v in _FLAGS.items())
    + " FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL)"
)


def _owners(t: Tables) -> DataFrame:
    """Which customers placed a large order of each priority."""
    owned = measures.rollup(
        t.orders.where(F.col("o_totalprice") > 250000).select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority"),
        ["c_custkey"],
        [measures.any_true(k, F.col("o_orderpriority") == v) for k, v in _FLAGS.items()],
    )
    base = t.customer.select("c_custkey", "c_mktsegment").join(owned, "c_custkey", "left")
    return base.fillna({k: False for k in _FLAGS})


@query(
    "SELECT "
    + ", ".join(f"{sql_round(f'avg({k}) * 100', 1)} AS pct_{k}, CAST(sum({k}) AS BIGINT) AS n_{k}" for k in _FLAGS)
    + f", count(*) AS total_customers FROM {_OWNERS}"
)
def q_product_ownership(t: Tables) -> DataFrame:
    return profile.ownership(_owners(t), list(_FLAGS))


@query("SELECT c_mktsegment, " + ", ".join(f"CAST(sum({k}) AS BIGINT) AS n_{k}" for k in _FLAGS) + f" FROM {_OWNERS} GROUP BY 1")
def q_ownership_by_segment(t: Tables) -> DataFrame:
    return profile.ownership_by(_owners(t), "c_mktsegment", list(_FLAGS))


_SEGMENTS = f"""SELECT c_mktsegment, count(*) AS n, {sql_mean('c_acctbal')} AS avg_balance, {sql_mean('CAST(c_nationkey AS DOUBLE)')} AS avg_nation,
  {sql_mean('c_acctbal / 1e6::DOUBLE')} AS avg_share FROM customer GROUP BY 1"""


def _segments(t: Tables) -> DataFrame:
    rows = t.customer.withColumn("share", F.col("c_acctbal") / 1e6)
    return profile.segment_means(rows, "c_mktsegment", {"avg_balance": "c_acctbal", "avg_nation": "c_nationkey", "avg_share": "share"})


@query(_SEGMENTS)
def q_segment_profile(t: Tables) -> DataFrame:
    return _segments(t)


@query(f"SELECT * FROM ({_SEGMENTS}) ORDER BY avg_balance DESC, c_mktsegment LIMIT 1")
def q_top_segment(t: Tables) -> DataFrame:
    return profile.top_segment(_segments(t), "c_mktsegment", "avg_balance")


@query(
    "SELECT c_mktsegment, min(c_acctbal) AS low, max(c_acctbal) AS high, count(c_acctbal) AS n, "
    + ", ".join(f"{sql_round(f'quantile_cont(c_acctbal, {p})', 6)} AS {n}" for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)))
    + " FROM customer GROUP BY 1"
)
def q_segment_quartiles(t: Tables) -> DataFrame:
    return rounded(profile.quartiles(t.customer, ["c_mktsegment"], "c_acctbal"), 6, "q1", "median", "q3")


_STATS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS n, {sql_round(f'avg({c})', 8)} AS mean, "
        f"{sql_round(f'stddev_samp({c})', 6)} AS stddev, min({c}) AS min, max({c}) AS max FROM lineitem"
        for c in _STATS
    )
)
def q_describe(t: Tables) -> DataFrame:
    return rounded(rounded(profile.describe(t.lineitem, _STATS), 8, "mean"), 6, "stddev")


@query(
    " UNION ALL ".join(
        f"SELECT '{x}' AS left_column, '{y}' AS right_column, {sql_round(f'corr({x}, {y})', 6)} AS corr FROM lineitem"
        for i, x in enumerate(_STATS)
        for y in _STATS[i + 1 :]
    )
)
def q_correlation(t: Tables) -> DataFrame:
    return rounded(profile.correlations(t.lineitem, _STATS), 6, "corr")


@query(
    "WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) "
    "SELECT bin, lo + bin * ((hi - lo) / 30) AS low, count(*) AS n FROM ("
    "SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin, lo, hi FROM orders, b) GROUP BY bin, lo, hi"
)
def q_histogram(t: Tables) -> DataFrame:
    return profile.histogram(t.orders, "o_totalprice", 30)


@query(
    "WITH u AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') "
    "SELECT count(*) AS n_among, count(*) FILTER (WHERE c_acctbal > 7000) AS n_eligible, "
    "coalesce(count(*) FILTER (WHERE c_acctbal > 7000) * 100.0::DOUBLE / nullif(count(*), 0), 0.0::DOUBLE) AS pct_eligible "
    "FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM u)"
)
def q_conditional_share(t: Tables) -> DataFrame:
    urgent = measures.rollup(
        t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority"),
        ["c_custkey"],
        [measures.any_true("urgent", F.col("o_orderpriority") == "1-URGENT")],
    )
    rows = t.customer.join(urgent, "c_custkey", "left")
    return profile.conditional_share(rows, ~F.coalesce("urgent", F.lit(False)), F.col("c_acctbal") > 7000)


@query("SELECT o_orderpriority AS label, count(*) AS n, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM orders GROUP BY 1")
def q_label_dist(t: Tables) -> DataFrame:
    return profile.label_distribution(t.orders, "o_orderpriority")


@query(
    "WITH best AS (SELECT o_custkey, CASE max(o_orderpriority) WHEN '5-LOW' THEN 'NO_ACTION' ELSE 'CREDIT_CARD' END AS rec FROM orders GROUP BY 1) "
    f"SELECT count(*) AS active_customers, {sql_sum('c_acctbal')} AS total_balance, "
    f"{sql_round('CAST(sum(CASE WHEN c_nationkey > 3 THEN 300 + c_nationkey ELSE 0 END) AS DOUBLE) / count(*)', 0)} AS avg_score, "
    f"{sql_round('count(*) FILTER (WHERE rec = ' + chr(39) + 'CREDIT_CARD' + chr(39) + ') * 100.0::DOUBLE / count(*)', 0)} AS pct_recommended "
    "FROM customer LEFT JOIN best ON c_custkey = o_custkey WHERE c_acctbal >= 0"
)
def q_portfolio_kpis(t: Tables) -> DataFrame:
    worst = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("p"))
    rec = F.when(F.col("p") == "5-LOW", "NO_ACTION").when(F.col("p").isNotNull(), "CREDIT_CARD").otherwise("PENDING")
    rows = t.customer.join(worst, "c_custkey", "left").withColumns(
        {"rec": rec, "score": F.when(F.col("c_nationkey") > 3, F.col("c_nationkey") + 300)}
    )
    return profile.portfolio_kpis(rows, F.col("c_acctbal") >= 0, "c_acctbal", "score", "rec")


_CUT = "2024-01-16"
_JS = f"""
SELECT sqrt(greatest(sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2), 0)) AS js
FROM (SELECT coalesce(p, 0.0::DOUBLE) AS p, coalesce(q, 0.0::DOUBLE) AS q FROM
  (SELECT event_type, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM events WHERE ts < TIMESTAMP '{_CUT}' GROUP BY 1)
  FULL JOIN (SELECT event_type, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS q FROM events WHERE ts >= TIMESTAMP '{_CUT}' GROUP BY 1)
  USING (event_type))"""


def _drift(t: Tables) -> DataFrame:
    cut = F.lit(_CUT).cast("timestamp_ntz")
    return drift.js_distance(t.events.where(F.col("ts") < cut), t.events.where(F.col("ts") >= cut), "event_type")


@query(f"SELECT {sql_round('js', 6)} AS js_distance FROM ({_JS})")
def q_js_drift(t: Tables) -> DataFrame:
    return rounded(_drift(t), 6, "js_distance")


@query(
    f"SELECT {sql_round('js', 6)} AS js_distance, CAST(js > 0.15 AS INTEGER) AS retrain_needed, "
    f"CASE WHEN js > 0.15 THEN 'js_distance=' || printf('%.4f', js) || '_exceeds_0.15' ELSE 'no_drift' END AS drift_reason FROM ({_JS})"
)
def q_drift_gate(t: Tables) -> DataFrame:
    gate = drift.drift_gate(_drift(t), 0.15)
    return rounded(gate, 6, "js_distance").withColumn("retrain_needed", F.col("retrain_needed").cast("int"))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def q_daily_profile(t: Tables) -> DataFrame:
    return profile.daily_profile(t.events, "ts", ["event_type"])


_LATENCY = f"""
SELECT CAST(ts AS DATE) AS day, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors,
  {sql_mean('value')} AS avg_latency, quantile_cont(value, 0.95) AS p95_latency,
  count(*) FILTER (WHERE event_type = 'error') * 100.0::DOUBLE / count(*) AS error_pct FROM events GROUP BY 1"""


def _latency(t: Tables) -> DataFrame:
    calls = t.events.select(F.to_date("ts").alias("day"), "event_type", "value")
    return profile.latency_stats(calls, ["day"], "value", F.col("event_type") == "error")


@query(f"SELECT * REPLACE ({sql_round('p95_latency', 6)} AS p95_latency) FROM ({_LATENCY})")
def q_latency_stats(t: Tables) -> DataFrame:
    return rounded(_latency(t), 6, "p95_latency")


@query(
    "SELECT CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(errors) AS BIGINT) AS errors, "
    f"{sql_round('avg(avg_latency)', 6)} AS avg_latency, {sql_round('max(p95_latency)', 6)} AS p95_latency, "
    f"sum(errors) * 100.0::DOUBLE / sum(requests) AS error_pct FROM ({_LATENCY})"
)
def q_latency_summary(t: Tables) -> DataFrame:
    return rounded(profile.latency_summary(_latency(t)), 6, "avg_latency", "p95_latency")


_GUESS = "(SELECT quality AS actual, CASE WHEN n_chars >= 400 THEN 1 ELSE 0 END AS predicted FROM labels JOIN documents USING (doc_id))"
_CLASS_METRICS = f"""
SELECT label, CAST(count(*) FILTER (WHERE actual = label) AS BIGINT) AS support,
  coalesce(count(*) FILTER (WHERE actual = label AND predicted = label) / CAST(nullif(count(*) FILTER (WHERE predicted = label), 0) AS DOUBLE), 0.0::DOUBLE) AS precision,
  coalesce(count(*) FILTER (WHERE actual = label AND predicted = label) / CAST(nullif(count(*) FILTER (WHERE actual = label), 0) AS DOUBLE), 0.0::DOUBLE) AS recall
FROM {_GUESS}, (VALUES (0), (1), (2)) c(label) GROUP BY label"""
_WITH_F1 = f"SELECT *, coalesce(2.0::DOUBLE * precision * recall / nullif(precision + recall, 0), 0.0::DOUBLE) AS f1 FROM ({_CLASS_METRICS})"


def _matrix(t: Tables) -> DataFrame:
    """Label quality against a guess from the length of the document."""
    docs = t.documents.select("doc_id", F.when(F.col("n_chars") >= 400, 1).otherwise(0).alias("guess"))
    return profile.confusion(t.labels.join(docs, "doc_id"), "quality", "guess")


@query(f"SELECT actual, predicted, count(*) AS n FROM {_GUESS} GROUP BY ALL")
def q_confusion(t: Tables) -> DataFrame:
    return _matrix(t)


@query(f"SELECT label, support, {sql_round('precision', 6)} AS precision, {sql_round('recall', 6)} AS recall, {sql_round('f1', 6)} AS f1 FROM ({_WITH_F1})")
def q_class_metrics(t: Tables) -> DataFrame:
    """Class 2 never occurs: its figures are 0."""
    return rounded(profile.class_metrics(_matrix(t), [0, 1, 2]), 6, "precision", "recall", "f1")


@query(f"SELECT {sql_round('avg(f1)', 6)} AS macro_f1, count(*) AS n_classes FROM ({_WITH_F1})")
def q_macro_f1(t: Tables) -> DataFrame:
    return rounded(profile.macro_f1(profile.class_metrics(_matrix(t), [0, 1, 2])), 6, "macro_f1")


@query(
    f"SELECT {sql_round('m', 6)} AS macro_f1, CASE WHEN m >= 0.30 THEN 'approved' ELSE 'rejected' END AS approval_status, "
    f"CASE WHEN m < 0.30 THEN 'f1=' || printf('%.4f', m) || ' < threshold=0.3' END AS rejection_reason FROM (SELECT avg(f1) AS m FROM ({_WITH_F1}))"
)
def q_f1_gate(t: Tables) -> DataFrame:
    scores = profile.macro_f1(profile.class_metrics(_matrix(t), [0, 1, 2]))
    return rounded(drift.quality_gate(scores, 0.30), 6, "macro_f1")


def _guesses(t: Tables, name: str, chars: int) -> DataFrame:
    docs = t.documents.select("doc_id", F.when(F.col("n_chars") >= chars, 1).otherwise(0).alias("guess"))
    matrix = profile.confusion(t.labels.join(docs, "doc_id"), "quality", "guess")
    return profile.macro_f1(profile.class_metrics(matrix, [0, 1])).select(F.lit(name).alias("name"), "macro_f1")


def _f1_of(chars: int) -> str:
    hits = lambda c, cond: f"count(*) FILTER (WHERE {cond.format(c=c)})"
    f1 = lambda c: (
        f"coalesce(2.0::DOUBLE * {hits(c, 'y = {c} AND g = {c}')} / nullif({hits(c, 'y = {c}')} + {hits(c, 'g = {c}')}, 0), 0)"
    )
    return (
        f"(SELECT ({f1(0)} + {f1(1)}) / 2 FROM (SELECT quality AS y, CASE WHEN n_chars >= {chars} THEN 1 ELSE 0 END AS g "
        "FROM labels JOIN documents USING (doc_id)))"
    )


@query(
    f"SELECT {sql_round(f'{_f1_of(200)} - {_f1_of(400)}', 6)} AS f1_diff, CAST({_f1_of(200)} - {_f1_of(400)} >= -0.02 AS INTEGER) AS promote"
)
def q_challenger_gate(t: Tables) -> DataFrame:
    runs = _guesses(t, "champion", 400).unionByName(_guesses(t, "challenger", 200))
    gate = drift.challenger_gate(runs, "champion", "challenger")
    return rounded(gate, 6, "f1_diff").withColumn("promote", F.col("promote").cast("int"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, {sql_round(f'quantile_cont({c}, 0.5)', 6)} AS median FROM lineitem" for c in _STATS))
def q_medians(t: Tables) -> DataFrame:
    return rounded(profile.medians(t.lineitem, _STATS), 6, "median")


@query(f"SELECT l_partkey AS run_id, {sql_sum('l_extendedprice')} AS metric FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def q_top_runs(t: Tables) -> DataFrame:
    runs = measures.rollup(
        t.lineitem.select(F.col("l_partkey").alias("run_id"), "l_extendedprice"),
        ["run_id"],
        [measures.total("metric", F.col("l_extendedprice"))],
    )
    return ranking.top(runs, "metric", "run_id", 5)




@query(
    f"SELECT l_returnflag, {sql_round("sum(l_extendedprice * l_discount * l_tax)", 4)} AS tax_on_discount, "
    f"{sql_round("avg(l_discount * l_tax * 0.01::DOUBLE)", 9, 14)} AS small_mean, "
    f"{sql_round("sum(l_discount * 1e-9::DOUBLE) * 1e9::DOUBLE", 6)} AS tiny_total, "
    "sum(CASE WHEN l_linenumber = 7 THEN 'Infinity'::DOUBLE ELSE l_tax END) AS unbounded, "
    "CAST(isnan(sum(CASE WHEN l_linenumber = 6 THEN 'NaN'::DOUBLE ELSE l_tax END)) AS INTEGER) AS unknown FROM lineitem GROUP BY 1"
)
def q_small_amounts(t: Tables) -> DataFrame:
    """Sums and means of values far below a cent, far below 1e-8, and not finite."""
    price, discount, tax = (F.col(c).cast("double") for c in ("l_extendedprice", "l_discount", "l_tax"))
    sums = measures.rollup(
        t.lineitem,
        ["l_returnflag"],
        [
            measures.total("tax_on_discount", price * discount * tax),
            measures.mean("small_mean", discount * tax * 0.01),
            measures.total("tiny_total", discount * 1e-9),
            measures.total("unbounded", F.when(F.col("l_linenumber") == 7, float("inf")).otherwise(tax)),
            measures.total("unknown", F.when(F.col("l_linenumber") == 6, float("nan")).otherwise(tax)),
        ],
    )
    whole = sums.withColumns({"tiny_total": F.col("tiny_total") * 1e9, "unknown": F.isnan("unknown").cast("int")})
    return rounded(rounded(rounded(whole, 4, "tax_on_discount"), 9, "small_mean"), 6, "tiny_total")

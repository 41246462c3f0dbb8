"""Projection, column choice, prepare actions, parameterised SQL, set operations, upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import scalars
from ledgerloom.functions.columns import ref
from ledgerloom.operators import choose, joins
from ledgerloom.operators.prepare import prepare, project
from ledgerloom.queries.base import Tables, query
from ledgerloom.sinks import tables
from ledgerloom.sources.queries import run_sql
from ledgerloom.sources.rescue import rescue_columns
from pyspark.sql.types import StructType


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 1000.0")
def q_param_sql(t: Tables) -> DataFrame:
    return run_sql(
        t.spark,
        "SELECT c_custkey, c_name, c_acctbal FROM {customers} WHERE c_mktsegment = :segment AND c_acctbal >= :min_bal",
        inputs={"customers": t.customer},
        params={"segment": "BUILDING", "min_bal": 1000.0, "unused": 1},
    )


@query("SELECT upper(p_name) AS shout, p_size * 2 AS twice, * FROM part")
def q_expr_project(t: Tables) -> DataFrame:
    return project(t.part, ["upper(p_name) AS shout", "p_size * 2 AS twice"], keep_all=True)


@query("SELECT c_mktsegment AS segment, c_custkey, c_name AS customer_name, c_nationkey FROM customer")
def q_select_reorder(t: Tables) -> DataFrame:
    return choose.arrange(
        t.customer,
        [
            {"column": "c_mktsegment", "alias": "segment"},
            {"column": "c_name", "alias": "customer_name"},
            {"column": "c_acctbal", "checked": False},
        ],
        ordered=["c_mktsegment", "c_custkey"],
    )


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def q_select_bytype(t: Tables) -> DataFrame:
    return choose.pick(t.lineitem, choose.by_type("string", "timestamp"), keep=False)


@query("SELECT l_shipdate, l_suppkey FROM lineitem")
def q_select_byname(t: Tables) -> DataFrame:
    return choose.pick(t.lineitem, choose.by_name("regex", "^L_S(hip|upp)"))


@query("SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def q_select_byexpr(t: Tables) -> DataFrame:
    return choose.pick(t.lineitem, choose.by_expression("IsNumeric AND FieldNumber > 4"))


@query("SELECT *, p_retailprice * p_size AS stock_value FROM part")
def q_prep_formula(t: Tables) -> DataFrame:
    return prepare(t.part, [{"type": "formula", "target": "stock_value", "expression": "p_retailprice * p_size"}])


@query(
    "SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS level, "
    "TRY_CAST(o_orderstatus AS INTEGER) AS status FROM orders"
)
def q_prep_cast(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("level"), F.col("o_orderstatus").alias("status"))
    return prepare(
        rows,
        [
            {"type": "cast", "column": "level", "to": "int", "on_error": "error"},
            {"type": "cast", "column": "status", "to": "int"},
        ],
    )


@query(
    "SELECT p_partkey, CASE WHEN starts_with(lower(p_name), 'red') THEN 'crimson' ELSE p_name END AS p_name, "
    "CASE WHEN lower(p_type) = 'economy' THEN 'BASIC' ELSE p_type END AS p_type, "
    "CASE WHEN regexp_matches(CAST(p_size AS VARCHAR), '^1.$') THEN 99 ELSE p_size END AS p_size, "
    "CASE WHEN contains(p_brand, '#2') THEN 'two' WHEN ends_with(lower(p_brand), '9') THEN 'nine' ELSE p_brand END AS p_brand FROM part"
)
def q_prep_replace(t: Tables) -> DataFrame:
    return prepare(
        t.part.select("p_partkey", "p_name", "p_type", "p_size", "p_brand"),
        [
            {"type": "replace_value", "column": "p_name", "match_mode": "prefix", "match": "RED", "with": "crimson"},
            {"type": "replace_value", "column": "p_type", "match": "economy", "with": "BASIC"},
            {"type": "replace_value", "column": "p_size", "match_mode": "regex", "match": "^1.$", "with": "99"},
            {"type": "replace_value", "column": "p_brand", "match_mode": "contains", "match": "#2", "with": "two", "case_sensitive": True},
            {"type": "replace_value", "column": "p_brand", "match_mode": "suffix", "match": "9", "with": "nine"},
            {"type": "trim", "column": "p_name", "side": "both", "enabled": False},
        ],
    )


@query(
    "SELECT c_custkey, coalesce(CASE WHEN c_acctbal >= 0 THEN c_acctbal END, 0.0::DOUBLE) AS balance, "
    "coalesce(CASE WHEN c_nationkey > 5 THEN c_mktsegment END, 'none') AS segment FROM customer"
)
def q_prep_fill_null(t: Tables) -> DataFrame:
    rows = t.customer.select(
        "c_custkey",
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
        F.when(F.col("c_nationkey") > 5, F.col("c_mktsegment")).alias("segment"),
    )
    return prepare(
        rows,
        [
            {"type": "fill_null", "column": "balance", "with": "0"},
            {"type": "fill_null", "column": "segment", "with": "none"},
        ],
    )


@query(
    "SELECT p_partkey, upper(p_name) AS p_name, lower(p_brand) AS p_brand, "
    "upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS p_type FROM part"
)
def q_prep_text_case(t: Tables) -> DataFrame:
    return prepare(
        t.part.select("p_partkey", "p_name", "p_brand", "p_type"),
        [
            {"type": "text_case", "column": "p_name", "case": "upper"},
            {"type": "text_case", "column": "p_brand", "case": "lower"},
            {"type": "text_case", "column": "p_type", "case": "title"},
        ],
    )


@query(
    "SELECT p_partkey, p_name AS both_sides, p_name || '  ' AS left_side, '  ' || p_name AS right_side FROM part"
)
def q_prep_trim(t: Tables) -> DataFrame:
    padded = F.concat(F.lit("  "), "p_name", F.lit("  "))
    rows = t.part.select("p_partkey", *[padded.alias(c) for c in ("both_sides", "left_side", "right_side")])
    return prepare(
        rows,
        [
            {"type": "trim", "column": "both_sides"},
            {"type": "trim", "column": "left_side", "side": "left"},
            {"type": "trim", "column": "right_side", "side": "right"},
        ],
    )


@query("SELECT c_custkey, regexp_replace(c_name, '[#0]+', '-', 'g') AS c_name FROM customer")
def q_prep_regex_replace(t: Tables) -> DataFrame:
    return prepare(
        t.customer.select("c_custkey", "c_name"),
        [{"type": "regex_replace", "column": "c_name", "pattern": "[#0]+", "replacement": "-"}],
    )


@query(
    "SELECT p_partkey, regexp_extract(p_brand, 'Brand#([0-9]+)', 1) AS brand_no, regexp_extract(p_brand, '[0-9]+$') AS p_brand FROM part"
)
def q_prep_extract(t: Tables) -> DataFrame:
    return prepare(
        t.part.select("p_partkey", "p_brand"),
        [
            {"type": "extract", "column": "p_brand", "pattern": "Brand#([0-9]+)", "group": "1", "target": "brand_no"},
            {"type": "extract", "column": "p_brand", "pattern": "[0-9]+$"},
        ],
    )


@query(
    "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS day, "
    "CAST(o_orderdate AS TIMESTAMP) AS moment FROM orders"
)
def q_prep_parse_date(t: Tables) -> DataFrame:
    """Open orders carry a date that does not parse; it becomes NULL."""
    rows = t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", "not a date").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("day"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("moment"),
    )
    parsed = prepare(
        rows,
        [
            {"type": "parse_date", "column": "day", "kind": "date", "format": "dd/MM/yyyy"},
            {"type": "parse_date", "column": "moment", "kind": "timestamp", "format": "yyyy-MM-dd HH:mm", "on_error": "error"},
        ],
    )
    return parsed.withColumn("moment", F.col("moment").cast("timestamp_ntz"))


@query(
    "SELECT conv_id, turn, CASE WHEN role = 'user' THEN '''=' || text WHEN role = 'system' THEN '''@' || text ELSE text END AS text "
    "FROM conversations"
)
def q_neutralize(t: Tables) -> DataFrame:
    mark = F.when(F.col("role") == "user", "=").when(F.col("role") == "system", "@").otherwise("")
    return t.conversations.select("conv_id", "turn", scalars.neutralize_formula(F.concat(mark, "text")).alias("text"))


@query(
    "SELECT 'digital' AS source, event_id AS id, ts AS seen_at, event_type, CAST(NULL AS DOUBLE) AS balance FROM events "
    "UNION ALL SELECT 'telco', c_custkey, CAST(NULL AS TIMESTAMP), CAST(NULL AS VARCHAR), c_acctbal FROM customer"
)
def q_union_sources(t: Tables) -> DataFrame:
    digital = t.events.select(F.col("event_id").alias("id"), F.col("ts").alias("seen_at"), "event_type")
    telco = t.customer.select(
        F.col("c_custkey").alias("id"), F.lit(None).cast("string").alias("event_type"), F.col("c_acctbal").alias("balance")
    )
    return joins.union_tagged({"digital": digital, "telco": telco})


@query(
    "SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, CAST(NULL AS DOUBLE) AS balance, CAST(NULL AS VARCHAR) AS segment FROM customer "
    "UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal, 'supplier' FROM supplier"
)
def q_schema_evolve(t: Tables) -> DataFrame:
    """Three-column rows and five-column rows of one feed."""
    first = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    second = t.supplier.select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        F.col("s_nationkey").alias("nation"),
        F.col("s_acctbal").alias("balance"),
        F.lit("supplier").alias("segment"),
    )
    target = tables.widened(first.schema, second.schema)
    return tables.aligned(first, target).unionAll(tables.aligned(second, target))


@query(
    "SELECT o_orderkey, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_totalprice END AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, "
    "CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '{\"o_totalprice\":\"ABOUT ' || o_orderkey || '\",\"grade\":\"' || o_orderstatus || '\"}' "
    "ELSE '{\"grade\":\"' || o_orderstatus || '\"}' END AS _rescued_data FROM orders"
)
def q_rescue(t: Tables) -> DataFrame:
    """Prices of unspecified orders are text, and ``grade`` is not in the schema."""
    raw = t.orders.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.concat(F.lit("ABOUT "), "o_orderkey"))
        .otherwise(F.col("o_totalprice").cast("string"))
        .alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
        F.col("o_orderstatus").alias("grade"),
    )
    return rescue_columns(raw, StructType.fromDDL("o_orderkey bigint, o_totalprice double, o_orderdate date"))


@query(
    "WITH s AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal + 1 AS c_acctbal, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' "
    "UNION ALL SELECT -1 - s_suppkey, s_name, s_nationkey, s_acctbal, 'NEW' FROM supplier) "
    "SELECT * FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM s) UNION ALL SELECT * FROM s"
)
def q_merge_upsert(t: Tables) -> DataFrame:
    """One segment is updated; suppliers come in as new customers."""
    changed = t.customer.where(F.col("c_mktsegment") == "BUILDING").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    new = t.supplier.select(
        (F.lit(-1) - F.col("s_suppkey")).alias("c_custkey"),
        F.col("s_name").alias("c_name"),
        F.col("s_nationkey").alias("c_nationkey"),
        F.col("s_acctbal").alias("c_acctbal"),
        F.lit("NEW").alias("c_mktsegment"),
    )
    return joins.upsert(t.customer, changed.unionByName(new), ["c_custkey"])


@query("SELECT DISTINCT n_regionkey, n_name FROM nation ORDER BY n_regionkey, n_name")
def q_distinct_sorted(t: Tables) -> DataFrame:
    return t.nation.select("n_regionkey", "n_name").distinct().orderBy("n_regionkey", "n_name")


@query(
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS by_path, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, "
    "CAST(json_extract_string(props, '$.k') AS BIGINT) AS by_variant FROM events"
)
def q_json_props(t: Tables) -> DataFrame:
    """One field three ways: path, parsed struct expanded, variant."""
    parsed = t.events.select(
        "event_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("by_path"),
        F.from_json("props", "k bigint").alias("s"),
        F.expr("try_variant_get(parse_json(props), '$.k', 'bigint')").alias("by_variant"),
    )
    return parsed.select("event_id", "by_path", "s.*", "by_variant")


@query(
    "SELECT o_orderkey, CAST(trunc(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-11-04') / 365.0) AS INTEGER) AS tenure_years, "
    "CAST(o_orderdate AS DATE) AS order_day, CAST(o_orderdate AS DATE) >= DATE '2001-11-04' - 90 AS recent FROM orders"
)
def q_date_math(t: Tables) -> DataFrame:
    day, as_of = F.col("o_orderdate").cast("date"), F.lit("2001-11-04").cast("date")
    return t.orders.select(
        "o_orderkey",
        scalars.whole_years(day, as_of).alias("tenure_years"),
        day.alias("order_day"),
        scalars.within_days(day, as_of, 90).alias("recent"),
    )


@query(
    "WITH s AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN CAST(300 + floor(c_acctbal / 18) AS INTEGER) END AS score FROM customer) "
    "SELECT c_custkey, score, least(100.0::DOUBLE, greatest(0.0::DOUBLE, (coalesce(score, 0) - 300) / 5.5::DOUBLE)) AS gauge, "
    "CASE WHEN score IS NULL THEN 'none' WHEN score >= 700 THEN 'good' WHEN score >= 600 THEN 'fair' ELSE 'poor' END AS band FROM s"
)
def q_score_band(t: Tables) -> DataFrame:
    score = F.when(F.col("c_acctbal") >= 0, (F.lit(300) + F.floor(F.col("c_acctbal") / 18)).cast("int"))
    rows = t.customer.select("c_custkey", score.alias("score"))
    return rows.withColumns({"gauge": scalars.score_gauge(F.col("score")), "band": scalars.score_band(F.col("score"))})


@query(
    """
WITH v AS (SELECT p_partkey, p_name, p_type, p_retailprice * p_size * p_partkey AS amount FROM part)
SELECT p_partkey, CASE
    WHEN amount >= 1e9 THEN 'MYR ' || printf('%.1fB', CAST(round(CAST(amount / 1e9 AS DECIMAL(30, 12)), 1) AS DOUBLE))
    WHEN amount >= 1e6 THEN 'MYR ' || printf('%.1fM', CAST(round(CAST(amount / 1e6 AS DECIMAL(30, 12)), 1) AS DOUBLE))
    WHEN amount >= 1e3 THEN 'MYR ' || printf('%.0fK', CAST(round(CAST(amount / 1e3 AS DECIMAL(30, 12)), 0) AS DOUBLE))
    ELSE 'MYR ' || CAST(CAST(round(CAST(amount AS DECIMAL(30, 8)), 0) AS BIGINT) AS VARCHAR) END AS money,
  array_to_string(list_transform(list_filter(string_split(p_name, ' '), lambda x: length(x) > 0)[1:2], lambda x: upper(x[1])), '') AS initials,
  upper(p_type[1]) || lower(p_type[2:]) || ' Range' AS label
FROM v"""
)
def q_humanize(t: Tables) -> DataFrame:
    amount = F.col("p_retailprice") * F.col("p_size") * F.col("p_partkey")
    return t.part.select(
        "p_partkey",
        scalars.humanize_money(amount).alias("money"),
        scalars.initials(ref("p_name")).alias("initials"),
        scalars.pretty_label(F.concat("p_type", F.lit("_range"))).alias("label"),
    )

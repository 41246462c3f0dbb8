"""Data-quality rules over line items, and key checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import joins, profile, quality
from ledgerloom.operators.quality import Rule, RuleSet
from ledgerloom.queries.base import Tables, query

RULES = RuleSet(
    [
        Rule("positive_quantity", quality.positive("l_quantity"), "drop"),
        Rule("enough_quantity", quality.in_range("l_quantity", low=3), "drop"),
        Rule("discount_range", quality.in_range("l_discount", 0.01, 0.09)),
        Rule("known_flag", quality.one_of("l_returnflag", ["A", "R"])),
        Rule("shipped_after_order", quality.not_before("l_shipdate", "o_orderdate")),
        Rule("status_format", quality.matches("l_linestatus", "^[F]$")),
        Rule("has_part", quality.not_null("l_partkey"), "drop"),
    ]
)

_INPUT = """(SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_returnflag, l_linestatus, l_shipdate, o_orderdate
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey)"""
_TESTS = {
    "positive_quantity": "l_quantity > 0",
    "enough_quantity": "(l_quantity IS NULL OR l_quantity >= 3)",
    "discount_range": "(l_discount IS NULL OR (l_discount >= 0.01 AND l_discount <= 0.09))",
    "known_flag": "l_returnflag IN ('A', 'R')",
    "shipped_after_order": "l_shipdate >= o_orderdate",
    "status_format": "regexp_matches(l_linestatus, '^[F]$')",
    "has_part": "l_partkey IS NOT NULL",
}
_DROPS = ("positive_quantity", "enough_quantity", "has_part")
_KEEP = " AND ".join(f"coalesce({_TESTS[n]}, false)" for n in _DROPS)


def _failed(names) -> str:
    items = ", ".join(f"CASE WHEN NOT coalesce({_TESTS[n]}, false) THEN '{n}' END" for n in names)
    return f"array_to_string(list_filter([{items}], lambda x: x IS NOT NULL), ',')"


_COLUMNS = "l_orderkey, l_linenumber, l_quantity, l_discount"


def _lines(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", "o_orderdate")
    lines = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate"
    )
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*_COLUMNS.split(", "), F.array_join(quality.FAILED, ",").alias("failed_rules"))


@query(f"SELECT {_COLUMNS}, {_failed(_TESTS)} AS failed_rules FROM {_INPUT}")
def q_dq_flags(t: Tables) -> DataFrame:
    return _shown(RULES.annotate(_lines(t)))


@query(f"SELECT {_COLUMNS} FROM {_INPUT} WHERE {_KEEP}")
def q_dq_drop(t: Tables) -> DataFrame:
    return RULES.apply(_lines(t)).select(*_COLUMNS.split(", "))


@query(f"SELECT {_COLUMNS}, {_failed(_DROPS)} AS failed_rules FROM {_INPUT} WHERE NOT ({_KEEP})")
def q_dq_quarantine(t: Tables) -> DataFrame:
    return _shown(RULES.quarantine(_lines(t)))


@query(
    " UNION ALL ".join(
        f"SELECT '{n}' AS rule, '{'drop' if n in _DROPS else 'warn'}' AS action, count(*) FILTER (WHERE coalesce({test}, false)) AS passed, "
        f"count(*) FILTER (WHERE NOT coalesce({test}, false)) AS failed, "
        f"count(*) FILTER (WHERE NOT coalesce({test}, false)) * 100.0::DOUBLE / count(*) AS failed_pct FROM {_INPUT}"
        for n, test in _TESTS.items()
    )
)
def q_dq_metrics(t: Tables) -> DataFrame:
    return RULES.metrics(_lines(t))


@query(
    "SELECT 'fast' AS fault, count(*) FILTER (WHERE l_quantity < 10) AS n_rows, count(*) FILTER (WHERE l_quantity < 10) * 100.0::DOUBLE / count(*) AS pct FROM lineitem "
    "UNION ALL SELECT 'untaxed', count(*) FILTER (WHERE l_tax = 0), count(*) FILTER (WHERE l_tax = 0) * 100.0::DOUBLE / count(*) FROM lineitem"
)
def q_fault_breakdown(t: Tables) -> DataFrame:
    return quality.fault_breakdown(t.lineitem, {"fast": "l_quantity < 10", "untaxed": "l_tax = 0"})


@query(
    "WITH child AS (SELECT event_id, user_id * 20 AS user_id FROM events) "
    "SELECT 'with_parent' AS side, count(*) AS n FROM child WHERE user_id IN (SELECT c_custkey FROM customer) "
    "UNION ALL SELECT 'orphan', count(*) FROM child WHERE user_id NOT IN (SELECT c_custkey FROM customer)"
)
def q_ref_integrity(t: Tables) -> DataFrame:
    child = t.events.select("event_id", (F.col("user_id") * 20).alias("user_id"))
    known, orphans = joins.referential_split(child, t.customer, "user_id", "c_custkey")
    return known.agg(F.count(F.lit(1)).alias("n")).select(F.lit("with_parent").alias("side"), "n").unionByName(
        orphans.agg(F.count(F.lit(1)).alias("n")).select(F.lit("orphan").alias("side"), "n")
    )


@query(
    "SELECT value FROM (VALUES ('0-IMMEDIATE'), ('1-URGENT'), ('5-LOW'), ('9-NEVER')) v(value) "
    "WHERE value NOT IN (SELECT o_orderpriority FROM orders)"
)
def q_missing_classes(t: Tables) -> DataFrame:
    return joins.missing_values(t.orders, "o_orderpriority", ["0-IMMEDIATE", "1-URGENT", "5-LOW", "9-NEVER"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def q_pk_violations(t: Tables) -> DataFrame:
    return joins.key_violations(t.lineitem, ["l_orderkey", "l_linenumber"])


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(
    " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS n_rows, "
        + ("strftime(max(ts), '%Y-%m-%d %H:%M:%S')" if n == "events" else "CAST(NULL AS VARCHAR)")
        + f" AS latest FROM {n}"
        for n in _TABLES
    )
)
def q_table_stats(t: Tables) -> DataFrame:
    frames = {n: getattr(t, n) for n in _TABLES}
    frames["events"] = t.events.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))
    return profile.table_stats(frames, {"events": "ts"})

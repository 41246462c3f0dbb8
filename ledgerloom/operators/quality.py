"""Declarative row rules: warn, drop, quarantine, fail, and their counts.

A rule passes only when its predicate is true; NULL is a failure.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.columns import flag

ACTIONS = ("warn", "drop", "fail")
FAILED = "_dq_failed"


class RuleViolation(ValueError):
    """Raised by ``RuleSet.enforce``."""


@dataclass(frozen=True)
class Rule:
    name: str
    predicate: str
    action: str = "warn"

    def __post_init__(self) -> None:
        if self.action not in ACTIONS:
            raise ValueError(f"rule {self.name}: action {self.action!r} is not one of {ACTIONS}")

    @property
    def passes(self) -> Column:
        return flag(F.expr(self.predicate))


class RuleSet:
    def __init__(self, rules: Iterable[Rule]):
        self.rules: tuple[Rule, ...] = tuple(rules)
        names = [r.name for r in self.rules]
        if len(set(names)) != len(names):
            raise ValueError("rule names must be unique")

    def _failed(self, actions: Sequence[str]) -> Column:
        names = [F.when(~r.passes, F.lit(r.name)) for r in self.rules if r.action in actions]
        return F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")

    def _keeps(self) -> Column:
        """Conjunction of the plain drop predicates. A filter treats NULL as
        false by itself, and bare predicates can be pushed into the scan."""
        ok = F.lit(True)
        for r in self.rules:
            if r.action == "drop":
                ok = ok & F.expr(r.predicate)
        return ok

    def annotate(self, df: DataFrame) -> DataFrame:
        """Every row, with the names of the rules it fails."""
        return df.withColumn(FAILED, self._failed(ACTIONS))

    def apply(self, df: DataFrame, annotate: bool = False) -> DataFrame:
        """Rows that pass all drop rules; works on streams as well."""
        return (self.annotate(df) if annotate else df).where(self._keeps())

    def quarantine(self, df: DataFrame) -> DataFrame:
        """The rows ``apply`` removes, with the drop rules they fail."""
        return df.where(~flag(self._keeps())).withColumn(FAILED, self._failed(("drop",)))

    def _counts(self) -> list[Column]:
        return [F.count(F.lit(1)).alias("_rows")] + [
            F.count_if(~r.passes).alias(f"_f{i}") for i, r in enumerate(self.rules)
        ]

    def _dropped(self) -> Column:
        return F.count_if(~flag(self._keeps())).alias("_dropped")

    def metrics(self, df: DataFrame) -> DataFrame:
        """rule, action, passed, failed, failed_pct; one scan for all rules."""
        return self._report(df.agg(*self._counts()))

    def observed(self, spark: SparkSession, counts: Mapping[str, int]) -> DataFrame:
        """The same from counts that ``observe`` brought."""
        return self._report(spark.range(1).select(*[F.lit(n).cast("long").alias(c) for c, n in counts.items()]))

    def _report(self, one: DataFrame) -> DataFrame:
        entries = F.array(
            *[
                F.struct(F.lit(r.name).alias("rule"), F.lit(r.action).alias("action"), F.col(f"_f{i}").alias("failed"))
                for i, r in enumerate(self.rules)
            ]
        )
        return one.select("_rows", F.inline(entries)).select(
            "rule",
            "action",
            (F.col("_rows") - F.col("failed")).alias("passed"),
            "failed",
            F.coalesce(F.try_divide(F.col("failed") * F.lit(100.0), F.col("_rows")), F.lit(0.0)).alias("failed_pct"),
        )

    def observe(self, df: DataFrame, observation: Observation | str) -> DataFrame:
        """Attach the counts, and that of the rows ``apply`` removes, to a run without a second pass."""
        return df.observe(observation, *self._counts(), self._dropped())

    def enforce(self, df: DataFrame) -> None:
        """Runs one aggregate; raises when a fail rule is broken."""
        hard = [r for r in self.rules if r.action == "fail"]
        if not hard:
            return
        row = df.agg(*[F.count_if(~r.passes).alias(f"_f{i}") for i, r in enumerate(hard)]).first()
        broken = {r.name: row[f"_f{i}"] for i, r in enumerate(hard) if row[f"_f{i}"]}
        if broken:
            raise RuleViolation(f"rows breaking a fail rule: {broken}")


# Predicates as SQL text, so that rule sets stay readable and serialisable.


def not_null(column: str) -> str:
    return f"`{column}` IS NOT NULL"


def positive(column: str) -> str:
    return f"`{column}` > 0"


def one_of(column: str, values: Sequence[str], null_ok: bool = False) -> str:
    listed = ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
    test = f"`{column}` IN ({listed})"
    return f"({test} OR `{column}` IS NULL)" if null_ok else test


def in_range(column: str, low: float | None = None, high: float | None = None) -> str:
    """NULL passes, as in every range rule of the feeds."""
    bounds = [f"`{column}` >= {low}"] * (low is not None) + [f"`{column}` <= {high}"] * (high is not None)
    return f"(`{column}` IS NULL OR ({' AND '.join(bounds)}))"


def not_before(later: str, earlier: str) -> str:
    return f"`{later}` >= `{earlier}`"


def matches(column: str, pattern: str) -> str:
    text = pattern.replace("\\", "\\\\").replace("'", "\\'")
    return f"`{column}` RLIKE '{text}'"


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def require_rows(counts: DataFrame, minimum: dict[str, int]) -> None:
    """Runs the (one row per table) count query; raises below a table's minimum."""
    got = {r["table_name"]: r["n_rows"] for r in counts.collect()}
    short = {t: got.get(t, 0) for t, n in minimum.items() if got.get(t, 0) < n}
    if short:
        raise RuleViolation(f"tables below their minimum row count: {short}")


def fault_breakdown(df: DataFrame, faults: dict[str, str]) -> DataFrame:
    """Rows and per cent that show each named fault (a SQL predicate)."""
    # A predicate that is NULL shows no fault: a fault passes as a rule unless its predicate is true.
    rules = RuleSet(Rule(name, f"NOT coalesce(({predicate}), false)") for name, predicate in faults.items())
    return rules.metrics(df).select(F.col("rule").alias("fault"), F.col("failed").alias("n_rows"), F.col("failed_pct").alias("pct"))



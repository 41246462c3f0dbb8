"""Named measures that can be rolled up in one step or in two.

A measure knows how to aggregate raw rows, how to merge partial results and how
to finish. ``rollup`` aggregates rows by their keys; ``rollup_through`` reduces a
large fact table on its own key *before* it is joined to the table that names
the owner, so a key with very many rows never crosses the join.

Sums are exact (see ``operators.exact``): rows are first aggregated by keys and
bins of exponents, which are one or two per key for amounts of like size, then
the few partial rows of a key meet place by place. Sums of whole numbers and
decimals need no bins.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import DecimalType, IntegralType

from ledgerloom.functions.columns import flag, ref
from ledgerloom.operators import exact


@dataclass(frozen=True)
class Measure:
    """``finish`` gets the exact sums of ``values`` as doubles, then the merged ``parts``."""

    name: str
    parts: tuple[tuple[Column, Callable[[Column], Column]], ...]
    finish: Callable[..., Column]
    values: tuple[Column, ...] = ()


def count(name: str, when: Column | None = None) -> Measure:
    rows = F.count(F.lit(1)) if when is None else F.count_if(when)
    return Measure(name, ((rows, F.sum),), lambda n: F.coalesce(n, F.lit(0)).cast("long"))


def count_values(name: str, value: Column) -> Measure:
    return Measure(name, ((F.count(value), F.sum),), lambda n: F.coalesce(n, F.lit(0)).cast("long"))


def total(name: str, value: Column, when: Column | None = None) -> Measure:
    """Exact sum of the values that satisfy the condition, 0.0 when there are none."""
    picked = value if when is None else F.when(when, value)
    return Measure(name, (), lambda s: F.coalesce(s, F.lit(0.0)), (picked,))


def mean(name: str, value: Column) -> Measure:
    """Exact sum over the number of values; NULL when there are none."""
    return Measure(name, ((F.count(value), F.sum),), lambda s, n: F.try_divide(s, n.cast("double")), (value,))


def any_true(name: str, condition: Column) -> Measure:
    return Measure(name, ((F.max(flag(condition)), F.max),), lambda b: F.coalesce(b, F.lit(False)))


def latest(name: str, value: Column, order: Sequence[Column], when: Column | None = None) -> Measure:
    """Value of the last qualifying row; the order must end in a tie-break."""
    rank = F.struct(*order) if when is None else F.when(when, F.struct(*order))
    newest = F.max(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), value.alias("value"))))
    return Measure(name, ((newest, F.max),), lambda pair: pair["value"])


def present(name: str) -> Measure:
    """True for every key that occurs at all."""
    return Measure(name, ((F.max(F.lit(True)), F.max),), lambda b: b)


class _Partials:
    """Column names of partial results: parts, whole sums, and bins with their digits."""

    def __init__(self, df: DataFrame, measures: Sequence[Measure]):
        self.measures = measures
        self.parts = [(f"_{k}_{i}", part, merge) for k, m in enumerate(measures) for i, (part, merge) in enumerate(m.parts)]
        values = [(f"_{k}_{i}v", v) for k, m in enumerate(measures) for i, v in enumerate(m.values)]
        kinds = {f.name: f.dataType for f in df.select(*[v.alias(n) for n, v in values]).schema} if values else {}
        self.binned = [(n, v.cast("double")) for n, v in values if not isinstance(kinds[n], (IntegralType, DecimalType))]
        for name, value in values:
            kind = kinds[name]
            if isinstance(kind, (IntegralType, DecimalType)):
                scale = kind.scale if isinstance(kind, DecimalType) else 0
                self.parts.append((name, F.sum(value.cast(f"decimal(38,{scale})")), F.sum))
        self.bins = [f"{n}b" for n, _ in self.binned]
        self.digits = [f"{n}d{j}" for n, _ in self.binned for j in range(exact.DIGITS)]

    def first(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        """One row per keys and bins."""
        df = exact.with_digits(df.withColumns(dict(self.binned)), [n for n, _ in self.binned]) if self.binned else df
        parts = [part.alias(name) for name, part, _ in self.parts]
        return self._by(df, keys, [*parts, *[F.sum(d).alias(d) for d in self.digits]])

    def again(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Rows of ``first`` under other keys."""
        return self._by(df, keys, [*[merge(F.col(n)).alias(n) for n, _, merge in self.parts], *[F.sum(d).alias(d) for d in self.digits]])

    def _by(self, df: DataFrame, keys: Sequence[str], aggregates: list[Column]) -> DataFrame:
        # A column that is always there, for measures without parts.
        return df.groupBy(*[ref(k) for k in keys], *self.bins).agg(*aggregates, F.lit(True).alias("_seen"))

    def last(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        """One row per keys with the finished measures."""
        found = df
        if self.binned:
            found = self._settled(df, keys)
        done = {n: F.col(n).cast("double") for n, _, _ in self.parts} | {n: exact.nearest(n) for n, _ in self.binned}
        finished = []
        for k, m in enumerate(self.measures):
            sums = [done[f"_{k}_{i}v"] for i in range(len(m.values))]
            finished.append(m.finish(*sums, *[F.col(f"_{k}_{i}") for i in range(len(m.parts))]).alias(m.name))
        return found.select(*[ref(k) for k in keys], *finished)

    def _settled(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        """One row per keys: parts merged, and the places of every sum as an array."""
        own = [ref(k) for k in keys]
        # Row -1 has the parts, the others a place of a sum each.
        parts = f"struct({', '.join([*[n for n, _, _ in self.parts], 'true AS _seen'])}) AS _parts"
        rows = [f"struct(-1 AS _i, CAST(NULL AS INT) AS _place, CAST(NULL AS BIGINT) AS _digit, {parts})"]
        for i, (n, _) in enumerate(self.binned):
            rows += [f"struct({i} AS _i, {n}b + {j} AS _place, {n}d{j} AS _digit, NULL AS _parts)" for j in range(exact.DIGITS)]
        # The partial rows of a key meet once; both aggregations below use that partitioning.
        spread = df.repartition(*own) if own else df
        merged = (
            spread.select(*own, F.expr(f"inline(array({', '.join(rows)}))"))
            .where("_i < 0 or _place is not null")
            .groupBy(*own, "_i", "_place")
            .agg(F.sum("_digit").alias("_digit"), *[merge(F.col(f"_parts.{n}")).alias(n) for n, _, merge in self.parts])
        )
        place = F.struct(F.col("_place").alias("place"), F.col("_digit").alias("digit"))
        return merged.groupBy(*own).agg(
            *[merge(F.col(n)).alias(n) for n, _, merge in self.parts],
            # At most a hundred places for each sum.
            *[F.collect_list(F.when(F.col("_i") == i, place)).alias(n) for i, (n, _) in enumerate(self.binned)],
        )


def rollup(df: DataFrame, keys: Sequence[str], measures: Sequence[Measure]) -> DataFrame:
    """Measures per key; without keys one row, also for no rows."""
    partials = _Partials(df, measures)
    return partials.last(partials.first(df, keys), keys)


def rollup_through(
    fact: DataFrame,
    fact_key: str,
    bridge: DataFrame,
    bridge_key: str,
    owner: str,
    measures: Sequence[Measure],
) -> DataFrame:
    """Measures per ``owner`` for facts that only carry ``fact_key``.

    ``bridge`` maps each ``bridge_key`` (unique) to its owner. Facts shrink to
    one row per key (and bins) first; measures may therefore use fact columns only.
    """
    partials = _Partials(fact, measures)
    owned = partials.first(fact, [fact_key]).join(
        bridge.select(F.col(bridge_key).alias("_bridge"), F.col(owner)), F.col(fact_key) == F.col("_bridge")
    )
    return partials.last(partials.again(owned, [owner]), [owner])

"""Join shapes: star of left joins, aligned full joins, look-ups, key checks.

No side is ever broadcast by hint. AQE broadcasts a side whose measured size is
below ``spark.sql.autoBroadcastJoinThreshold`` and splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.columns import ref


def full_align(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join on shared key names; keys of either side survive."""
    return left.join(right, list(keys), "full_outer")


def align_groups(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Left join of two grouped results; NULL group values match each other."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in by})
    on = F.lit(True)
    for k in by:
        on = on & ref(k).eqNullSafe(ref(f"_r_{k}"))
    return left.join(other, on, "left").drop(*[f"_r_{k}" for k in by])


def star(base: DataFrame, sides: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Left-join sides that are unique on their key, each key kept once.

    Sides joined on the same key reuse the partitioning of the first shuffle.
    """
    for side, key in sides:
        overlap = (set(side.columns) & set(base.columns)) - {key}
        base = base.join(side.drop(*overlap), key, "left")
    return base


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Replace NULLs per column, the type of the column kept."""
    types = dict(df.dtypes)
    return df.withColumns(
        {c: F.coalesce(ref(c), F.lit(v).cast(types[c])) for c, v in defaults.items() if c in types}
    )


def lookup(keys: DataFrame, features: DataFrame, key: str, drop_key: bool = False) -> DataFrame:
    """Attach the feature row of each key; keys without features keep NULLs."""
    out = keys.join(features, key, "left")
    return out.drop(key) if drop_key else out


def lookup_with_fallback(
    keys: DataFrame, first: DataFrame, second: DataFrame, key: str, columns: Sequence[str], default: float = 0.0
) -> DataFrame:
    """Each column from ``first``, else from ``second``, else the default, as double."""

    def side(df: DataFrame, tag: str) -> DataFrame:
        have = [c for c in columns if c in df.columns]
        return df.select(ref(key), *[ref(c).cast("double").alias(f"{tag}_{c}") for c in have])

    a, b = side(first, "_a"), side(second, "_b")
    joined = keys.select(ref(key)).join(a, key, "left").join(b, key, "left")

    def pick(c: str) -> Column:
        found = [ref(t) for t in (f"_a_{c}", f"_b_{c}") if t in joined.columns]
        return F.coalesce(*found, F.lit(default)).alias(c)

    return joined.select(ref(key), *[pick(c) for c in columns])


def referential_split(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a parent, rows without). NULL keys count as without."""
    known = parent.select(ref(parent_key).alias("_parent"))
    on = ref(child_key) == F.col("_parent")
    return child.join(known, on, "left_semi"), child.join(known, on, "left_anti")


def missing_values(df: DataFrame, column: str, expected: Sequence[str]) -> DataFrame:
    """Expected category values that do not occur."""
    have = df.select(ref(column).alias("value")).where(F.col("value").isin(list(expected))).distinct()
    wanted = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in expected])).alias("value"))
    return wanted.join(have, "value", "left_anti")


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are NULL or occur more than once, with their row count."""
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | ref(k).isNull()
    counts = df.groupBy(*[ref(k) for k in keys]).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.where((F.col("n_rows") > 1) | null_key)


def require_unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    """Runs one aggregate; raises when a key is NULL or repeated."""
    n = key_violations(df, keys).count()
    if n:
        raise ValueError(f"{what}: {n} key value(s) of {list(keys)} are NULL or repeated")


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], check: bool = True) -> DataFrame:
    """Target rows replaced by the source row of the same key, new keys added.

    ``check`` first runs ``require_unique`` on the source.
    """
    if not keys:
        raise ValueError("upsert: at least one key column is required")
    if check:
        require_unique(source, keys, "upsert source")
    kept = target.join(source.select(*[ref(k) for k in keys]), list(keys), "left_anti")
    return kept.select(*target.columns).unionByName(source.select(*target.columns))


def union_tagged(sources: Mapping[str, DataFrame], tag: str = "source") -> DataFrame:
    """Union by name with a source column; columns a source lacks become NULL."""
    frames = [df.withColumn(tag, F.lit(name)) for name, df in sources.items()]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out

"""Top-n, pages, searches, version choice, traffic split, stratified split."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.columns import ref
from ledgerloom.functions.scalars import contains_ignore_case
from ledgerloom.operators.sizes import settle


def top(df: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """n rows with the highest value; ties by key. Runs as a per-task top-n, then a merge."""
    return df.orderBy(F.desc(by), F.asc(key)).limit(n)


def some(df: DataFrame, n: int) -> DataFrame:
    """Any n rows, for a look at the data."""
    return df.limit(n)


def sample(df: DataFrame, keys: Sequence[str], share: float, seed: int = 42) -> DataFrame:
    """A share of the rows by key hash: the same rows on every run and cluster."""
    return df.where(F.pmod(_slot(keys, seed), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))


def page(
    df: DataFrame, sort: str, key: str, number: int, size: int = 25, descending: bool = False, text: bool = False
) -> DataFrame:
    """Page ``number`` (from 1) by a chosen column; text ignores case, numbers read NULL as 0."""
    value = F.lower(ref(sort)) if text else F.coalesce(ref(sort), F.lit(0))
    return df.orderBy(value.desc() if descending else value.asc(), F.asc(key)).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, key: str, last_key: object, size: int = 25) -> DataFrame:
    """Next page by key: the filter reaches the scan, so deep pages cost no more than the first."""
    return df.where(ref(key) > F.lit(last_key)).orderBy(key).limit(size)


def search(df: DataFrame, text: str = "", in_columns: Sequence[str] = (), facets: Mapping[str, object] | None = None) -> DataFrame:
    """Case-insensitive substring in any of the columns, and equal facets; empty parts are skipped."""
    for name, value in (facets or {}).items():
        if value not in (None, ""):
            df = df.where(ref(name) == F.lit(value))
    if text and in_columns:
        hit = F.lit(False)
        for c in in_columns:
            hit = hit | contains_ignore_case(ref(c), text)
        df = df.where(hit)
    return df


def resolve_version(versions: DataFrame, model: str, version: str, alias: str, order: Sequence[str] = ("champion", "dev")) -> DataFrame:
    """Per model the version with the first alias that exists, else the highest version."""
    picks = [F.max(F.when(ref(alias) == a, ref(version))) for a in order]
    via = F.lit("latest")
    for a, p in reversed(list(zip(order, picks))):
        via = F.when(p.isNotNull(), F.lit(a)).otherwise(via)
    return versions.groupBy(model).agg(
        F.coalesce(*picks, F.max(ref(version))).alias("version"), via.alias("resolved_by")
    )


def _slot(keys: Sequence[str], seed: int) -> Column:
    """Uniform pseudo-random bigint of 60 bits that depends on the key and the seed only, the same in any SQL engine."""
    text = F.concat_ws("|", *[F.coalesce(ref(k).cast("string"), F.lit("")) for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def traffic_split(df: DataFrame, keys: Sequence[str], first: str, second: str, first_pct: int = 70, seed: int = 0) -> DataFrame:
    slot = F.pmod(_slot(keys, seed), F.lit(100))
    return df.withColumn("route", F.when(slot < first_pct, first).otherwise(second))


def stratified_split(df: DataFrame, keys: Sequence[str], label: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split`` = train/test with the share held inside every class.

    Rows are placed by a hash of their key. The cut of each class is the exact
    rank in hash order; a class with fewer than two rows trains only. Ranks
    come from counts per hash slice, so no class is sorted in one task. The cuts
    (one row per class) are computed here, in one job.
    """
    h = _slot(keys, seed)
    rows = df.withColumn("_h", h).withColumn("_s", F.shiftrightunsigned(F.col("_h"), 48).cast("int"))
    counts = rows.groupBy(ref(label).alias("_l"), "_s").agg(F.count(F.lit(1)).alias("_n"))
    # One array of slice counts per class: at most 4096 entries.
    per_class = counts.groupBy("_l").agg(
        F.sum("_n").alias("_total"), F.sort_array(F.collect_list(F.struct("_s", "_n"))).alias("_slices")
    )
    want = F.when(F.col("_total") >= 2, F.greatest(F.floor(F.col("_total") * F.lit(test_share) + F.lit(0.5)), F.lit(1))).otherwise(0)
    walk = F.aggregate(
        "_slices",
        F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).alias("at"), F.lit(0).cast("long").alias("left")),
        lambda acc, x: F.when(
            (acc["at"] < 0) & (acc["seen"] + x["_n"] >= F.col("_want")),
            F.struct((acc["seen"] + x["_n"]).alias("seen"), x["_s"].alias("at"), (F.col("_want") - acc["seen"]).alias("left")),
        ).otherwise(F.struct((acc["seen"] + x["_n"]).alias("seen"), acc["at"].alias("at"), acc["left"].alias("left"))),
    )
    cuts = per_class.withColumn("_want", want.cast("long")).select("_l", F.col("_want"), walk.alias("_cut"))
    small = settle(cuts.select("_l", "_want", F.col("_cut.at").alias("_at"), F.col("_cut.left").alias("_left")))
    joined = rows.join(small, ref(label).eqNullSafe(F.col("_l")))
    edge = joined.where(F.col("_s") == F.col("_at")).withColumn(
        "_r", F.row_number().over(W.partitionBy("_l", "_s").orderBy("_h", *[ref(k) for k in keys]))
    )
    rest = joined.where(F.col("_s") != F.col("_at")).withColumn("_r", F.lit(0))
    test = (F.col("_want") > 0) & ((F.col("_s") < F.col("_at")) | ((F.col("_s") == F.col("_at")) & (F.col("_r") <= F.col("_left"))))
    out = edge.unionByName(rest).withColumn("split", F.when(test, "test").otherwise("train"))
    return out.select(*df.columns, "split")

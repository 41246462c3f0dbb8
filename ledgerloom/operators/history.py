"""Slowly changing dimensions (type 2) and latest-row operators.

Rules: exact duplicates collapse; of several rows with one (key, sequence) the
last by the tie columns, then by a hash of the payload, is kept; a version ends
where the next one of its key starts (half-open); rows with a NULL key or NULL
sequence are not history and are returned by ``rejects``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, TimestampNTZType, TimestampType

from ledgerloom.functions.columns import ref
from ledgerloom.session import shared_dir

START, END = "__START_AT", "__END_AT"
Segment = Callable[[Column], Column]


def segment_of(kind: DataType) -> Segment | None:
    """Segments that bound both levels of ``following`` for any amount of rows; None where the type alone gives none.

    Points are distinct per key. A minute holds at most 60 million microseconds,
    and a century 53 million minutes; a year holds 366 dates.
    """
    if isinstance(kind, TimestampType):
        return lambda seq: F.floor(F.unix_seconds(seq) / F.lit(60))
    if isinstance(kind, TimestampNTZType):
        # Wall-clock minutes, without a detour over the session's time zone.
        return lambda seq: F.unix_date(F.to_date(seq)).cast("long") * 1440 + F.hour(seq) * 60 + F.minute(seq)
    if isinstance(kind, DateType):
        return lambda seq: F.year(seq)
    return None


def by_width(width: int) -> Segment:
    """Segments of a numeric sequence."""
    return lambda seq: F.floor(seq / F.lit(width))


def usable(keys: Sequence[str], seq: str) -> Column:
    """Rows that have a place in a history."""
    ok = ref(seq).isNotNull()
    for k in keys:
        ok = ok & ref(k).isNotNull()
    return ok


def following(df: DataFrame, keys: Sequence[str], seq: str, segment: Segment | None = None) -> DataFrame:
    """Distinct (keys, seq) with ``_next``, the next sequence value of the key.

    A plain ``lead`` over the key would sort a hot key in one task. Here each
    key is cut into segments of the sequence: ``lead`` runs inside a segment,
    and the last row of a segment takes the first value of the key's next
    segment from a table that holds one row per (key, segment). Moments and
    dates have segments by their type, other sequences (numbers, decimals,
    texts) are cut where their rows are (see ``_following_by_ranges``).
    """
    segment = segment or segment_of(df.schema[seq].dataType)
    if segment is None:
        return _following_by_ranges(df, keys, seq)
    points = df.select(*[ref(k) for k in keys], ref(seq)).distinct().withColumn("_seg", segment(ref(seq)))
    inside = W.partitionBy(*[ref(k) for k in keys], "_seg").orderBy(ref(seq))
    across = W.partitionBy(*[ref(k) for k in keys]).orderBy("_seg")
    openers = (
        points.groupBy(*[ref(k) for k in keys], "_seg")
        .agg(F.min(ref(seq)).alias("_first"))
        .withColumn("_open", F.lead("_first").over(across))
        .drop("_first")
    )
    return (
        points.withColumn("_in", F.lead(ref(seq)).over(inside))
        .join(openers, [*keys, "_seg"])
        .select(*[ref(k) for k in keys], ref(seq), F.coalesce("_in", "_open").alias("_next"))
    )


def _following_by_ranges(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """``following`` for sequences of any ordered type.

    Points are range-partitioned over (keys, sequence), so a hot key is spread
    over as many ranges as its rows need, whatever their values. ``lead`` runs
    inside a range; the last point of a key in a range takes the key's first
    point in the next one, from a table of the points at the two ends of each range.
    The ranges are kept in the shared folder, so that both steps see the same
    ones. Runs a job.
    """
    shared_dir(df.sparkSession)
    own = [ref(k) for k in keys]
    ranged = df.select(*own, ref(seq)).repartitionByRange(*own, ref(seq)).withColumn("_range", F.spark_partition_id())
    points = ranged.groupBy("_range", *own, ref(seq)).agg(F.lit(True).alias("_seen"))
    inside = W.partitionBy("_range").orderBy(*own, ref(seq))
    after = F.lead(F.struct(*own, ref(seq).alias("_value"))).over(inside)
    same = F.lit(True)
    for k in keys:
        same = same & (F.col("_after")[k] == ref(k))
    kept = (
        points.withColumn("_after", after)
        .withColumn("_first", F.lag(F.lit(True)).over(inside).isNull())
        .select(*own, ref(seq), F.when(same, F.col("_after._value")).alias("_in"), (F.col("_first") | F.col("_after").isNull()).alias("_end"))
        .checkpoint()
    )
    # At most two points of a range; of those of a key the next in order is the one that follows.
    along = W.partitionBy(*own).orderBy(ref(seq))
    ends = kept.where("_end").withColumn("_in", F.coalesce("_in", F.lead(ref(seq)).over(along)))
    return kept.where("not _end").unionByName(ends).select(*own, ref(seq), F.col("_in").alias("_next"))


def scd2(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    tie: Sequence[str] = (),
    exclude: Sequence[str] = (),
    segment: Segment | None = None,
    collapse_unchanged: bool = False,
) -> DataFrame:
    """All versions of each key with ``__START_AT`` and ``__END_AT``.

    The wide rows are shuffled once, on (keys, seq); ends are worked out on the
    key and sequence columns alone and joined back on that same partitioning.
    """
    rows = df.where(usable(keys, seq)).drop(*exclude)
    payload = [c for c in rows.columns if c not in (*keys, seq)]
    body = F.struct(*[ref(c) for c in payload]) if payload else F.struct(F.lit(1).alias("_none"))
    fingerprint = F.xxhash64(*[ref(c) for c in payload]) if payload else F.lit(0)
    order = F.struct(*[ref(t) for t in tie], fingerprint.alias("_print"))
    versions = rows.groupBy(*[ref(k) for k in keys], ref(seq)).agg(F.max_by(body, order).alias("_row"))
    ends = following(rows, keys, seq, segment)
    if collapse_unchanged:
        prints = versions.withColumn("_print", F.sha2(F.to_json("_row"), 256)).drop("_row")
        previous = prints.join(ends, [*keys, seq]).select(
            *[ref(k) for k in keys], F.col("_next").alias(seq), F.col("_print").alias("_before")
        )
        changed = (
            prints.join(previous.where(ref(seq).isNotNull()), [*keys, seq], "left")
            .where(F.col("_before").isNull() | (F.col("_before") != F.col("_print")))
            .select(*[ref(k) for k in keys], ref(seq))
        )
        versions = versions.join(changed, [*keys, seq], "left_semi")
        ends = following(changed, keys, seq, segment)
    out = versions.join(ends, [*keys, seq])
    restored = [F.col("_row")[c].alias(c) for c in payload]
    return out.select(
        *[ref(k) for k in keys], ref(seq), *restored, ref(seq).alias(START), F.col("_next").alias(END)
    )


def rejects(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    return df.where(~usable(keys, seq))


def current(history: DataFrame) -> DataFrame:
    return history.where(F.col(END).isNull())


def as_of(history: DataFrame, moment: Column) -> DataFrame:
    return history.where((F.col(START) <= moment) & (F.col(END).isNull() | (moment < F.col(END))))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key; ``order`` must end in a tie-break.

    ``max_by`` keeps one row per key on the map side, so copies of a hot key
    are dropped before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*[ref(k) for k in keys]).agg(
        F.max_by(F.struct(*[ref(c) for c in rest]), F.struct(*order)).alias("_row")
    )
    return best.select(*[ref(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])

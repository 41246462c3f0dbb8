"""Incremental ingest of landing feeds into bronze tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.schemas import Feed
from ledgerloom.sinks import tables
from ledgerloom.sources.files import read_csv_files, read_json_text, stream_file_names, stream_json_lines
from ledgerloom.sources.rescue import RESCUED

BATCH = "_batch"


def append_once(table: str, checkpoint: str, build: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], bool]:
    """Append ``build(batch)`` as a partition of its stream and batch, unless that partition is there.

    ``foreachBatch`` is at-least-once: a batch that wrote but did not reach the
    checkpoint is replayed, as the first batch after a restart. Its partition is
    one folder that was moved into place when it was complete, so it is enough to
    look for that folder: no row of the table is read, however large it is.
    The function tells whether it wrote.
    """
    first = True
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def run(batch: DataFrame, batch_id: int) -> bool:
        nonlocal first
        mark = f"{stream}-{batch_id}"
        may_exist, first = first, False
        if may_exist and tables.has_partition(batch.sparkSession, table, BATCH, mark):
            return False
        tables.put_partitions(build(batch).withColumn(BATCH, F.lit(mark)), table, BATCH)
        return True

    return run


def start(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], object], trigger: dict | None = None) -> StreamingQuery:
    """``trigger`` defaults to draining what is there and stopping."""
    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(each)
        .start()
    )


def ingest_csv(
    spark: SparkSession, feed: Feed, folder: str, checkpoint: str, table: str | None = None, trigger: dict | None = None, widen: bool = True
) -> StreamingQuery:
    """New CSV files -> bronze. Unknown columns become table columns (as text)
    when ``widen`` is set, else they stay in ``_rescued_data``.

    File names per micro-batch are bounded by ``feed.max_files``.
    """

    def read(batch: DataFrame) -> DataFrame:
        paths = sorted(r["path"] for r in batch.collect())
        rows = read_csv_files(batch.sparkSession, paths, feed.schema, feed.multi_line)
        return promote_unknown(rows, feed) if widen else rows

    names = stream_file_names(spark, folder, "*.csv", _throttle(feed, trigger))
    return start(names, checkpoint, append_once(table or feed.table, checkpoint, read), trigger)


def promote_unknown(rows: DataFrame, feed: Feed) -> DataFrame:
    """Turn unknown columns found in ``_rescued_data`` into columns of their own.

    Runs one small job: the distinct unknown names of the batch.
    """
    known = [n.lower() for n in feed.schema.fieldNames()]
    entries = F.from_json(RESCUED, "map<string,string>")
    names = (
        rows.where(F.col(RESCUED).isNotNull())
        .select(F.explode(F.map_keys(entries)).alias("name"))
        .where(~F.lower("name").isin(known) & F.col("name").rlike(r"\A[A-Za-z]\w*\z"))
        .distinct()
    )
    spellings: dict[str, list[str]] = {}
    for name in sorted(r["name"] for r in names.collect()):
        spellings.setdefault(name.lower(), []).append(name)
    if not spellings:
        return rows
    listed = F.array(*[F.lit(n) for same in spellings.values() for n in same])
    rest = F.map_filter(entries, lambda k, v: ~F.array_contains(listed, k))
    # Spellings that differ in letter case are one column.
    promoted = {same[0]: F.coalesce(*[F.try_element_at(entries, F.lit(n)) for n in same]) for same in spellings.values()}
    return rows.withColumns(promoted).withColumn(RESCUED, F.when(F.size(rest) > 0, F.to_json(rest)))


def _throttle(feed: Feed, trigger: dict | None) -> int:
    """Files per micro-batch: the feed's own number for a live stream, many for a drain."""
    return feed.max_files if trigger and "availableNow" not in trigger else max(feed.max_files, feed.drain_files)


def ingest_json(
    spark: SparkSession, feed: Feed, folder: str, checkpoint: str, table: str | None = None, trigger: dict | None = None, widen: bool = True
) -> StreamingQuery:
    """New JSON files -> bronze. Fields the schema doesn't know become columns
    (as text) when ``widen`` is set: the table gets them before the batch that
    brings them is written, rows of earlier batches read NULL.
    """

    def read(batch: DataFrame) -> DataFrame:
        rows = read_json_text(batch, feed.schema, feed.multi_line)
        return promote_unknown(rows, feed) if widen else rows

    lines = stream_json_lines(spark, feed, folder, _throttle(feed, trigger))
    return start(lines, checkpoint, append_once(table or feed.table, checkpoint, read), trigger)


def append_stream(stream: DataFrame, table: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .toTable(table)
    )


def running(spark: SparkSession) -> list[str]:
    return [q.name or str(q.id) for q in spark.streams.active]


def stop_all(spark: SparkSession) -> None:
    for q in spark.streams.active:
        q.stop()

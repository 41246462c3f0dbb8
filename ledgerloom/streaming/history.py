"""Incremental slowly changing dimensions (type 2) from a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.functions.columns import quoted, ref
from ledgerloom.operators import history
from ledgerloom.session import shared_dir
from ledgerloom.sinks import tables
from ledgerloom.sources.queries import scan
from ledgerloom.streaming.ingest import start

BUCKET, VERSION = "_key_bucket", "_version"


class HistoryWriter:
    """Keeps a history up to date and rewrites only what a batch changes.

    The history is a view over three tables. ``<table>__open`` has the open
    version of every key, partitioned by a hash of the key; ``<table>__closed``
    has the closed ones, partitioned by the number of the write that closed
    them; ``<table>__dead`` names closed versions that a later write replaced.

    A batch in order closes open versions: the open rows of its key buckets are
    written again, closed rows are only added, none is read. Keys with a row at
    or before their open version (late rows, replays) get their closed versions
    read and derived again; versions that changed are named dead and added anew,
    so closed files are never rewritten but by ``compact``.

    All outputs of a batch are staged in the shared folder first. A run that
    dies redoes the rest from the staged copy: closed and dead rows overwrite the
    partition of their write, open rows that of their bucket. One writer per table
    at a time; a reader may see a batch half applied.
    """

    def __init__(
        self,
        table: str,
        keys: Sequence[str],
        seq: str,
        tie: Sequence[str] = (),
        exclude: Sequence[str] = (),
        buckets: int = 64,
        segment: history.Segment | None = None,
        staging: str | None = None,
    ):
        self.table, self.keys, self.seq = table, list(keys), seq
        self.tie, self.exclude, self.buckets, self.segment = list(tie), list(exclude), buckets, segment
        self.staging = staging
        self.open, self.closed, self.dead = f"{table}__open", f"{table}__closed", f"{table}__dead"

    def _root(self, spark: SparkSession) -> str:
        return self.staging or f"{shared_dir(spark)}/history-{self.table.replace('.', '-')}"

    def write(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stage = f"{self._root(spark)}/batch-{batch_id}"
        if not tables.exists(spark, f"{stage}/done/_SUCCESS"):
            self._finish_compaction(spark)
            self._keep_rejects(batch, batch_id)
            self._derive(batch, stage)
        self._apply(spark, stage)
        tables.remove(spark, f"{self._root(spark)}/batch-{batch_id - 1}")

    def _keep_rejects(self, batch: DataFrame, batch_id: int) -> None:
        """Rows without key or sequence have no place in a history: they are kept as JSON (at least once, if a run dies here)."""
        lost = history.rejects(batch, self.keys, self.seq)
        if not lost.isEmpty():
            kept = lost.select(F.to_json(F.struct(*[ref(c) for c in lost.columns])).alias("row"), F.lit(batch_id).cast("long").alias("batch_id"))
            kept.write.mode("append").saveAsTable(f"{self.table}_rejects")

    def _bucket(self):
        return F.pmod(F.xxhash64(*[ref(k) for k in self.keys]), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def _prepare(self, rows: DataFrame) -> None:
        """Tables with the columns of ``rows``, and the view over them."""
        spark = rows.sparkSession
        begin = rows.select("*", ref(self.seq).alias(history.START))
        number = F.lit(0).cast("long").alias(VERSION)
        layouts = {
            self.open: (begin.select("*", self._bucket()), BUCKET),
            self.closed: (begin.select("*", ref(self.seq).alias(history.END), number), VERSION),
            self.dead: (begin.select(*[ref(k) for k in self.keys], history.START, number), VERSION),
        }
        new = not spark.catalog.tableExists(self.open)
        for name, (frame, by) in layouts.items():
            if not spark.catalog.tableExists(name):
                frame.limit(0).write.partitionBy(by).saveAsTable(name)
        wider = [tables.evolve(spark, name, rows.schema) for name in (self.open, self.closed)]
        if new or any(wider) or not spark.catalog.tableExists(self.table):
            self._view(spark)

    def _view(self, spark: SparkSession) -> None:
        end = quoted(history.END)
        columns = ", ".join(quoted(c) for c in scan(spark, self.open).columns if c != BUCKET)
        kind = spark.table(self.closed).schema[history.END].dataType.simpleString()
        same = " AND ".join(f"c.{quoted(k)} = d.{quoted(k)}" for k in (*self.keys, history.START))
        spark.sql(
            f"CREATE OR REPLACE VIEW {self.table} AS SELECT {columns}, {end} FROM {self.closed} c "
            f"LEFT ANTI JOIN {self.dead} d ON {same} AND c.{VERSION} < d.{VERSION} "
            f"UNION ALL SELECT {columns}, CAST(NULL AS {kind}) FROM {self.open}"
        )

    def _live(self, spark: SparkSession) -> DataFrame:
        """Closed versions that no later write replaced."""
        dead = scan(spark, self.dead).withColumnsRenamed({c: f"_d_{c}" for c in (*self.keys, history.START, VERSION)})
        on = F.col(VERSION) < F.col(f"_d_{VERSION}")
        for k in (*self.keys, history.START):
            on = on & (ref(k) == ref(f"_d_{k}"))
        return scan(spark, self.closed).join(dead, on, "left_anti").drop(VERSION)

    def _number(self, spark: SparkSession) -> int:
        """One more than the number of any write so far; partitions are listed, no row is read."""
        found = [r[0] for t in (self.closed, self.dead) for r in spark.sql(f"SHOW PARTITIONS {t}").collect()]
        return 1 + max((int(p.partition("=")[2]) for p in found), default=0)

    def _derive(self, batch: DataFrame, stage: str) -> None:
        spark = batch.sparkSession
        rows = batch.where(history.usable(self.keys, self.seq)).drop(*self.exclude)
        self._prepare(rows)
        rows.write.mode("overwrite").parquet(f"{stage}/new")
        new = spark.read.schema(rows.schema).parquet(f"{stage}/new")
        # At most ``buckets`` numbers; they prune the partitions to read.
        touched = [r[0] for r in new.select(self._bucket()).distinct().collect()]
        bucket = scan(spark, self.open).where(F.col(BUCKET).isin(touched)).drop(BUCKET)
        keys = new.groupBy(*[ref(k) for k in self.keys]).agg(F.min(ref(self.seq)).alias("_earliest"))
        begun = bucket.select(*[ref(k) for k in self.keys], history.START)
        keys.join(begun, self.keys, "left").withColumn("_late", F.coalesce(F.col("_earliest") <= F.col(history.START), F.lit(False))).write.mode(
            "overwrite"
        ).parquet(f"{stage}/keys")
        keys = spark.read.parquet(f"{stage}/keys")
        known = bucket.join(keys, self.keys, "left_semi").drop(history.START)
        late = keys.where("_late").select(*[ref(k) for k in self.keys])
        before = None
        if not late.isEmpty():
            before = self._live(spark).join(late, self.keys, "left_semi")
            known = known.unionByName(before.drop(history.START, history.END))
        merged = known.unionByName(new, allowMissingColumns=True)
        history.scd2(merged, self.keys, self.seq, self.tie, segment=self.segment).write.mode("overwrite").parquet(f"{stage}/versions")
        versions = spark.read.parquet(f"{stage}/versions")
        ended = versions.where(F.col(history.END).isNotNull())
        if before is not None:
            names = [c for c in versions.columns if c != history.END]
            mark = F.sha2(F.to_json(F.struct(*[ref(c) for c in (*names, history.END)])), 256)
            at = [*self.keys, history.START, "_mark"]
            marked, was = ended.withColumn("_mark", mark), before.withColumn("_mark", mark)
            gone = was.join(marked, at, "left_anti").select(*[ref(k) for k in self.keys], history.START)
            ended = marked.join(was, at, "left_anti").drop("_mark")
            gone.write.mode("overwrite").parquet(f"{stage}/dead")
        ended.write.mode("overwrite").parquet(f"{stage}/closed")
        current = versions.where(F.col(history.END).isNull()).drop(history.END)
        others = bucket.join(keys, self.keys, "left_anti")
        others.unionByName(current, allowMissingColumns=True).write.mode("overwrite").parquet(f"{stage}/open")
        # Written last: the number of this write, and the mark that all of it is staged.
        spark.range(1).select(F.lit(self._number(spark)).cast("long").alias(VERSION)).write.mode("overwrite").parquet(f"{stage}/done")

    def _apply(self, spark: SparkSession, stage: str) -> None:
        number = spark.read.parquet(f"{stage}/done").first()[0]
        for name, part in ((self.closed, "closed"), (self.dead, "dead")):
            if tables.exists(spark, f"{stage}/{part}"):
                self._put(spark.read.parquet(f"{stage}/{part}").withColumn(VERSION, F.lit(number).cast("long")), name)
        # Splits large buckets over tasks and packs small ones together.
        self._put(spark.read.parquet(f"{stage}/open").select("*", self._bucket()).hint("rebalance", BUCKET), self.open)

    def _put(self, rows: DataFrame, table: str) -> None:
        tables.put_partitions(rows, table, BUCKET if table == self.open else VERSION, evolving=False)

    def compact(self, spark: SparkSession) -> None:
        """Rewrite the closed versions without the dead ones, as one write; afterwards nothing is dead."""
        self._finish_compaction(spark)
        folder = f"{self._root(spark)}/compact"
        self._live(spark).withColumn(VERSION, F.lit(self._number(spark)).cast("long")).write.mode("overwrite").parquet(folder)
        self._finish_compaction(spark)

    def _finish_compaction(self, spark: SparkSession) -> None:
        folder = f"{self._root(spark)}/compact"
        if not tables.exists(spark, f"{folder}/_SUCCESS"):
            return
        # Dead rows have smaller numbers than the rewritten ones, so they mean nothing from here on.
        live = spark.read.parquet(folder)
        spark.sql(f"TRUNCATE TABLE {self.closed}")
        self._put(live, self.closed)
        spark.sql(f"TRUNCATE TABLE {self.dead}")
        tables.remove(spark, folder)


def scd2_stream(stream: DataFrame, writer: HistoryWriter, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Staged copies live and die with the checkpoint, so that batch numbers of
    another run are never mistaken for this one's."""
    writer.staging = writer.staging or f"{checkpoint}/staged"
    return start(stream, checkpoint, writer.write, trigger)

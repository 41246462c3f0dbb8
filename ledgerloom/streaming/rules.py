"""Row rules on a stream: kept rows, quarantined rows and counts per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.quality import RuleSet
from ledgerloom.streaming.ingest import append_once, start


def apply_rules(
    stream: DataFrame,
    rules: RuleSet,
    target: str,
    checkpoint: str,
    quarantine: str | None = None,
    metrics: str | None = None,
    trigger: dict | None = None,
    annotate: bool = False,
) -> StreamingQuery:
    """Kept rows go to ``target``, dropped ones to ``quarantine`` with the rules they fail, counts of every batch to ``metrics``.

    The counts are observed while the kept rows are written, so a batch is read
    once; only if rows were dropped are they picked from the cached batch. Each
    output skips batches it already holds, so a replay adds and counts nothing twice.
    """

    observing: list[Observation] = []
    keep = append_once(target, checkpoint, lambda df: rules.apply(rules.observe(df, observing[-1]), annotate))
    part = append_once(quarantine, checkpoint, rules.quarantine) if quarantine else None
    tell = append_once(metrics, f"{checkpoint}#{target}", lambda df: df) if metrics else None

    def each(batch: DataFrame, batch_id: int) -> None:
        # Lost cached blocks are read again.
        batch.persist()
        try:
            if batch.isEmpty():
                return
            rules.enforce(batch)
            observing[:] = [Observation(f"{target}-{batch_id}")]
            counts = observing[0].get if keep(batch, batch_id) else None
            if part and (counts is None or counts["_dropped"]):
                part(batch, batch_id)
            if tell:
                report = rules.metrics(batch) if counts is None else rules.observed(batch.sparkSession, counts)
                tell(report.select(F.lit(target).alias("table_name"), F.lit(batch_id).cast("long").alias("batch_id"), "*"), batch_id)
        finally:
            batch.unpersist()

    return start(stream, checkpoint, each, trigger)

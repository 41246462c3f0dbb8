"""Broadcasts that are allowed only after their size has been checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import shared_dir

#: Rows a broadcast summary may have; summaries are a few numbers wide.
MAX_ROWS = 20_000


def settle(summary: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Compute a summary once, into the shared checkpoint folder.

    Runs a job. The result is marked for broadcast when it has at most
    ``max_rows`` rows; a larger one is joined by shuffle (AQE splits hot keys).
    """
    shared_dir(summary.sparkSession)
    kept = summary.checkpoint()
    return F.broadcast(kept) if kept.limit(max_rows + 1).count() <= max_rows else kept

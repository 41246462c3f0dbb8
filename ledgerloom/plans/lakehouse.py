"""One run of the banking lakehouse: landing files -> bronze -> silver -> gold -> features.

Every step is incremental up to silver: only files and rows that are new since
the last run are read. Gold and features are recomputed from silver.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.history import current
from ledgerloom.plans import features, gold, silver
from ledgerloom.schemas import FEEDS
from ledgerloom.sinks import tables
from ledgerloom.sources.queries import scan, scan_stream, table_exists
from ledgerloom.sources.rescue import RESCUED
from ledgerloom.streaming import ingest
from ledgerloom.streaming.history import HistoryWriter, scd2_stream
from ledgerloom.streaming.rules import apply_rules
from ledgerloom.streaming.supervise import Supervisor

#: Counts of every rule and micro-batch, of all tables with rules.
METRICS = "silver_rule_metrics"


def quarantine_of(table: str) -> str:
    return f"{table}_quarantine"


@dataclass
class Lakehouse:
    """``landing`` holds the feed folders, ``work`` the checkpoints; both on shared storage."""

    spark: SparkSession
    landing: str
    work: str
    buckets: int = 64

    def _wait(self, queries: list[StreamingQuery]) -> None:
        for q in queries:
            q.awaitTermination()

    def _feeds(self, trigger: dict | None = None) -> dict[str, list[Callable[[], StreamingQuery]]]:
        """Per bronze table, how to start a stream for each of its folders that exists."""
        found: dict[str, list[Callable[[], StreamingQuery]]] = {}
        for feed in FEEDS.values():
            begin = ingest.ingest_csv if feed.fmt == "csv" else ingest.ingest_json
            for folder in feed.folders:
                path = f"{self.landing}/{folder}"
                if tables.exists(self.spark, path):
                    run = partial(begin, self.spark, feed, path, f"{self.work}/bronze/{folder}", trigger=trigger)
                    found.setdefault(feed.table, []).append(run)
        return found

    def bronze(self) -> None:
        """Drain every feed folder that exists: tables at once, folders of one table one after the other."""
        waiting = list(self._feeds().values())
        while waiting:
            self._wait([folders.pop(0)() for folders in waiting])
            waiting = [folders for folders in waiting if folders]

    def live(self, every: str = "30 seconds", restarts: int = 3) -> Supervisor:
        """Every feed folder as a stream of its own, all at once, restarted when it fails; ``stop`` ends them.

        Backlogs are best drained by ``bronze`` before: a live stream takes few files at a time.
        """
        feeds = self._feeds({"processingTime": every})
        return Supervisor({f"{t}-{i}": run for t, runs in feeds.items() for i, run in enumerate(runs)}, restarts).start()

    def silver(self) -> None:
        """Versions of the masters, checked facts, unified digital activity; all at once.

        Rows that fail a drop rule go to the table's quarantine, counts of every rule to ``silver_rule_metrics``.
        """
        spark, running = self.spark, []
        for spec in silver.VERSIONED:
            if table_exists(spark, spec.bronze):
                writer = HistoryWriter(
                    spec.silver,
                    spec.keys,
                    spec.sequence,
                    tie=["_source_file"],
                    exclude=[RESCUED, "_ingest_timestamp", ingest.BATCH],
                    buckets=self.buckets,
                )
                running.append(scd2_stream(scan_stream(spark, spec.bronze), writer, f"{self.work}/{spec.silver}"))
        checked = [(scan_stream(spark, c.bronze), c.silver, c.rules) for c in silver.FACTS if table_exists(spark, c.bronze)]
        if table_exists(spark, "bronze_digital_events") and table_exists(spark, "bronze_telco_events"):
            both = silver.digital_signals(scan_stream(spark, "bronze_digital_events"), scan_stream(spark, "bronze_telco_events"))
            checked.append((both, "silver_digital_activity", silver.DIGITAL_RULES))
        if checked and not table_exists(spark, METRICS):
            # Made before the streams start, since all of them write to it.
            layout = "table_name string, batch_id bigint, rule string, action string, passed bigint, failed bigint, failed_pct double"
            tables.create_empty(spark, METRICS, f"{layout}, {ingest.BATCH} string", partition_by=[ingest.BATCH])
        for stream, target, rules in checked:
            stamped = stream if "_silver_timestamp" in stream.columns else silver.stamped(stream)
            running.append(apply_rules(stamped, rules, target, f"{self.work}/{target}", quarantine_of(target), METRICS, annotate=True))
        self._wait(running)

    def gold(self, as_of: dt.date | None = None) -> DataFrame:
        """Rebuild ``gold_customer_360`` as of a day (default: today)."""
        spark = self.spark
        day: Column = F.lit(as_of) if as_of else F.current_date()
        activity = scan(spark, "silver_digital_activity")
        wide = gold.customer_360(
            current(scan(spark, "silver_customers")),
            gold.agg_accounts(current(scan(spark, "silver_deposit_accounts"))),
            gold.agg_loans(current(scan(spark, "silver_loan_accounts"))),
            gold.agg_payments(scan(spark, "silver_transactions"), day),
            gold.agg_cards(scan(spark, "silver_card_transactions"), day),
            gold.latest_bureau(scan(spark, "silver_kyc_compliance")),
            gold.agg_app(activity, day),
            gold.agg_telco(activity),
            day,
        )
        tables.overwrite(wide, "gold_customer_360")
        tables.describe_table(spark, "gold_customer_360", "One row per active customer", {"quality": "gold"})
        return scan(spark, "gold_customer_360")

    def features(self) -> DataFrame:
        """Rebuild the feature table, its primary key checked."""
        rows = features.customer_features(scan(self.spark, "gold_customer_360"))
        tables.save_features(rows, "customer_features", ["party_id"], "Next-best-product features and label")
        return scan(self.spark, "customer_features")

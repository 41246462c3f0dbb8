"""One run of the next-best-product model: train, publish, score, log, measure drift, decide.

Tables are written after each step, so a run that dies is taken up at the step
it died in; scoring again adds a batch to the log and never changes an old one.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import drift
from ledgerloom.plans import model, scoring
from ledgerloom.session import shared_dir
from ledgerloom.sinks import tables
from ledgerloom.sources.queries import scan, table_exists

DRIFT_DDL = "column_name string, metric_name string, metric_value double, window_start_time timestamp"


@dataclass
class Advisor:
    """``models`` is the folder of fitted models, on shared storage; the rest are table names."""

    spark: SparkSession
    models: str
    spec: model.Spec = model.Spec()
    name: str = "next_best_product"
    features: str = "customer_features"
    runs: str = "model_runs"
    versions: str = "model_versions"
    recommended: str = "gold_product_recommendations"
    log: str = "inference_log"
    drift: str = "drift_metrics"
    evaluation: str = "eval_log"

    def train(self, min_f1: float = 0.30, early_stop: bool = False) -> Row:
        """Fit, log both runs, publish the better one; it is champion if its macro F1 suffices.

        Returns version, macro_f1, approval_status, rejection_reason.
        """
        spark = self.spark
        winner, runs = model.train(scan(spark, self.features), self.spec, early_stop)
        for run in runs:
            model.log_run(spark, run, self.runs, run.n_train, run.n_test)
        score = spark.range(1).select(F.lit(float(winner.macro_f1)).alias("macro_f1"))
        verdict = drift.quality_gate(score, min_f1)
        approved = verdict.first()["approval_status"] == "approved"
        version = 1
        if table_exists(spark, self.versions):
            known = scan(spark, self.versions).where(F.col("model") == self.name)
            version += known.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
        model.publish(spark, winner.model, self.models, self.name, version, self.versions, "champion" if approved else None)
        return verdict.select(F.lit(version).alias("version"), "*").first()

    def score(self, at: dt.datetime | None = None) -> DataFrame:
        """Score every customer once; append the log and replace the recommendations, which are returned."""
        spark = self.spark
        version, fitted = model.resolve(spark, self.versions, self.name)
        shared_dir(spark)
        scored = scoring.score(fitted, scan(spark, self.features), self.spec).checkpoint()
        moment = F.lit(at or dt.datetime.now())
        tables.append(scoring.inference_log(scored, str(version), moment, self.spec), self.log)
        tables.overwrite(scoring.recommendations(scored, self.spec), self.recommended)
        return scan(spark, self.recommended)

    def measure_drift(self) -> None:
        """Store the distance of the newest scoring from the one before; nothing, when there is none before."""
        spark = self.spark
        tables.create_empty(spark, self.drift, DRIFT_DDL)
        log = scan(spark, self.log)
        last = [r[0] for r in log.select("scored_at").distinct().orderBy(F.desc("scored_at")).limit(2).collect()]
        if len(last) < 2:
            return
        newest, before = (log.where(F.col("scored_at") == F.lit(t)) for t in last)
        distance = drift.js_distance(before, newest, "predicted_label").select(
            F.lit("predicted_label").alias("column_name"),
            F.lit("js_distance").alias("metric_name"),
            F.col("js_distance").alias("metric_value"),
            F.lit(last[0]).alias("window_start_time"),
        )
        tables.append(distance, self.drift)

    def decide(self, threshold: float = 0.15, force: bool = False) -> Row:
        """js_distance, retrain_needed, drift_reason from the newest stored distance."""
        tables.create_empty(self.spark, self.drift, DRIFT_DDL)
        newest = drift.latest_metric(scan(self.spark, self.drift), "predicted_label", "js_distance")
        return drift.drift_gate(newest, threshold, force, column="metric_value").first()

    def evaluate(self, payloads: DataFrame | None = None, request_id: str = "request_id") -> DataFrame:
        """Rebuild the evaluation log from served requests or, when there are none, from the batch log."""
        if payloads is not None and not payloads.isEmpty():
            rows = scoring.eval_log(payloads, self.spec.classes, request_id)
        else:
            rows = scoring.eval_log_from_batch(scan(self.spark, self.log))
        tables.overwrite(rows, self.evaluation)
        return scan(self.spark, self.evaluation)

    def run(self, payloads: DataFrame | None = None, force: bool = False, early_stop: bool = False) -> Row:
        """Train when there is no model yet, score, log, and train and score again when the predictions drifted.

        Returns the decision.
        """
        if not table_exists(self.spark, self.versions):
            self.train(early_stop=early_stop)
        self.score()
        self.measure_drift()
        self.evaluate(payloads)
        decision = self.decide(force=force)
        if decision["retrain_needed"]:
            self.train(early_stop=early_stop)
            self.score()
        return decision

"""Batch scoring, recommendations and the inference and evaluation logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.columns import ref
from ledgerloom.functions.encoding import label_of, ranked, top_two
from ledgerloom.functions.scalars import epoch_millis
from ledgerloom.plans.model import Spec, probabilities


def score(model: PipelineModel, features: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """key, probabilities for every customer; the label column is not needed."""
    rows = features.select(spec.key, F.lit(spec.classes[0]).alias(spec.label), *[ref(c).cast("double").alias(c) for c in spec.features])
    scored = model.transform(rows)
    return scored.select(spec.key, probabilities(scored, len(spec.classes)).alias("probabilities"))


def score_with(features: DataFrame, predict: Callable[[pd.DataFrame], pd.DataFrame], spec: Spec = Spec()) -> DataFrame:
    """Hook for a model from outside Spark: ``predict`` gets Arrow batches of the
    features and returns one probability column per class, in class order."""
    columns, key = list(spec.features), spec.key

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = predict(batch[columns])
            yield pd.DataFrame({key: batch[key], "probabilities": list(p.to_numpy(dtype=float))})

    kind = features.schema[key].dataType.simpleString()
    rows = features.select(key, *[ref(c).cast("double").alias(c) for c in columns])
    return rows.mapInPandas(run, f"`{key}` {kind}, probabilities array<double>")


def recommendations(scored: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """The two best products per customer with their confidence in per cent."""
    return scored.select(spec.key, *top_two(F.col("probabilities"), spec.classes))


def inference_log(scored: DataFrame, version: str, scored_at: Column | None = None, spec: Spec = Spec()) -> DataFrame:
    at = F.current_timestamp() if scored_at is None else scored_at
    best = F.get(ranked(F.col("probabilities"), spec.classes), 0)["label"]
    return scored.select(
        ref(spec.key),
        best.alias("predicted_label"),
        F.lit(version).alias("model_version"),
        at.alias("scored_at"),
        F.concat(F.lit("batch_"), F.date_format(at, "yyyy-MM-dd")).alias("batch_id"),
    )


def eval_log(payloads: DataFrame, classes: Sequence[str], request_id: str = "request_id") -> DataFrame:
    """request_id, predicted_label, scored_at, source from a served-request log.

    The first prediction may be a label or class index, taken as it is, or an
    array of class probabilities, of which the highest counts. Requests without
    a prediction are left out.
    """
    first = payloads.withColumn("_first", F.get_json_object("response", "$.predictions[0]")).where(
        F.col("_first").isNotNull()
    )
    listed = F.when(F.col("_first").startswith("["), F.from_json("_first", "array<double>"))
    parsed = first.withColumn("_p", listed)
    # Position of the first maximum: ties go to the earlier class.
    best = F.try_element_at(F.array(*[F.lit(c) for c in classes]), F.array_position("_p", F.array_max("_p")).cast("int"))
    return parsed.select(
        ref(request_id).alias("request_id"),
        F.when(F.col("_p").isNotNull(), best).otherwise(label_of(F.col("_first"), classes)).alias("predicted_label"),
        epoch_millis(F.col("timestamp_ms")).alias("scored_at"),
        F.lit("realtime_endpoint").alias("source"),
    ).where(F.col("predicted_label").isNotNull())


def eval_log_from_batch(log: DataFrame) -> DataFrame:
    """The same table from the batch inference log; ids are a hash of the row and its moment."""
    return log.select(
        F.sha2(F.concat_ws("|", "party_id", "batch_id", "model_version", F.unix_micros("scored_at")), 256).alias("request_id"),
        "predicted_label",
        "scored_at",
        F.lit("batch").alias("source"),
    )

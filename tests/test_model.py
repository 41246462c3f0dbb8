from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerloom.functions.encoding import ordinal
from ledgerloom.plans import features, model, scoring
from ledgerloom.plans.advisor import Advisor
from ledgerloom.schemas import FEATURES, LABEL_CLASSES
from ledgerloom.sources.queries import scan

SMALL = model.Spec(trees=10, tree_depth=6, boost_rounds=4, boost_depth=3)


@pytest.fixture(scope="module")
def rows_of_features(spark):
    """600 customers whose label follows the rules; one class never occurs."""
    pick = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n))
    base = spark.range(600).select(
        F.concat(F.lit("P"), "id").alias("party_id"),
        (pick(1, 400) + 450).cast("int").alias("ctos_score"),
        (pick(2, 120) * 1000.0).alias("annual_income_amount"),
        pick(3, 2).cast("int").alias("has_credit_card"),
        (pick(4, 50) + 20).cast("int").alias("age"),
        pick(5, 3).cast("int").alias("number_of_dependents"),
        F.lit(0).alias("has_home_loan"),
        (pick(6, 20) * 100.0).alias("monthly_loan_commitment_myr"),
        F.lit(0).alias("net_worth_band_encoded"),
        pick(7, 2).cast("int").alias("num_loan_facilities"),
        F.lit(50.0).alias("payment_conduct_score"),
    )
    labelled = features.label(base)
    extra = [F.lit(0).alias(c) for c in FEATURES if c not in base.columns]
    return labelled.select("party_id", "next_best_product", *[c for c in FEATURES if c in base.columns], *extra).cache()


@pytest.fixture(scope="module")
def trained(rows_of_features):
    return model.train(rows_of_features, SMALL)


def test_absent_class_is_topped_up(rows_of_features):
    have = {r[0] for r in rows_of_features.select("next_best_product").distinct().collect()}
    assert set(LABEL_CLASSES) - have == {"INVESTMENT"}
    more = model.top_up(rows_of_features, SMALL)
    filler = more.where("next_best_product = 'INVESTMENT'").collect()
    assert more.count() == 602 and [r["party_id"] for r in sorted(filler)] == ["filler-INVESTMENT-0", "filler-INVESTMENT-1"]
    ages = sorted(r["age"] for r in rows_of_features.select("age").collect())
    assert filler[0]["age"] == int(np.median(ages))


def test_split_and_weights(rows_of_features):
    train, test = model.split(rows_of_features, SMALL)
    assert train.count() + test.count() == 600 and train.join(test, "party_id").count() == 0
    weighted = model.balanced(train, SMALL).groupBy("next_best_product").agg(F.sum("weight").alias("w")).collect()
    assert len({round(r["w"], 6) for r in weighted}) == 1


def test_training_picks_the_better_run(trained):
    winner, runs = trained
    assert [r.name for r in runs] == ["rf_baseline", "boosted_challenger"]
    assert winner.macro_f1 == max(r.macro_f1 for r in runs) and winner.macro_f1 >= 0.30
    assert {r["label"] for r in winner.metrics.collect()} == set(LABEL_CLASSES)


def test_importances(trained, rows_of_features):
    forest = trained[1][0].model
    ranked = model.importances(forest, SMALL)
    assert abs(sum(v for _, v in ranked) - 1.0) < 1e-6 and ranked[0][1] >= ranked[-1][1]
    drops = dict(model.permutation_importance(forest, rows_of_features, SMALL, ["annual_income_amount", "telco_arpu_myr"]))
    assert drops["annual_income_amount"] > 0.0 and drops["telco_arpu_myr"] == 0.0


def test_shuffling_keeps_the_values(rows_of_features):
    mixed = model.shuffled(rows_of_features, "party_id", "age", 42, slices=4)
    assert mixed.count() == 600
    assert rows(mixed, "age") == rows(rows_of_features, "age")
    moved = mixed.select("party_id", F.col("age").alias("new")).join(rows_of_features, "party_id").where("new <> age").count()
    assert moved > 300


def test_the_permutation_is_of_all_rows(spark):
    two = spark.range(200).select("id", F.when(F.col("id") < 100, 0).otherwise(1).alias("v"))
    for slices in (1, 7, 4096):
        places = [r[0] for r in model._places(two, "id", 3, slices).select("_place").collect()]
        assert sorted(places) == list(range(1, 201))
        mixed = model.shuffled(two, "id", "v", 3, slices)
        assert mixed.count() == 200 and mixed.agg(F.sum("v")).first()[0] == 100
        assert 20 < mixed.where("id < 100").agg(F.sum("v")).first()[0] < 80


def test_advisor_runs_from_features_to_decision(spark, rows_of_features, table, tmp_path):
    names = {n: table(n) for n in ("features", "runs", "versions", "recommended", "log", "drift", "evaluation")}
    rows_of_features.write.saveAsTable(names["features"])
    tiny = model.Spec(trees=3, tree_depth=4, boost_rounds=2, boost_depth=2)
    advisor = Advisor(spark, str(tmp_path), tiny, **names)
    first = advisor.run(early_stop=True)
    assert (first["retrain_needed"], first["drift_reason"]) == (False, "no_metrics_available")
    assert scan(spark, names["recommended"]).count() == scan(spark, names["evaluation"]).count() == 600
    assert {(r["n_train"] + r["n_test"]) for r in scan(spark, names["runs"]).collect()} == {602}
    again = advisor.run()
    assert (again["retrain_needed"], again["drift_reason"], again["js_distance"]) == (False, "no_drift", 0.0)
    log = scan(spark, names["log"])
    assert log.count() == 1200 and scoring.eval_log_from_batch(log).select("request_id").distinct().count() == 1200
    served = spark.createDataFrame([("r1", '{"predictions": ["HOME_LOAN"]}', 1_700_000_000_000)], "request_id string, response string, timestamp_ms long")
    assert [tuple(r)[:2] for r in advisor.evaluate(served).collect()] == [("r1", "HOME_LOAN")]
    assert advisor.decide(force=True)["drift_reason"] == "force_retrain_override"


@pytest.mark.parametrize("which", [0, 1])
def test_scores_are_probabilities(trained, rows_of_features, which):
    scored = scoring.score(trained[1][which].model, rows_of_features, SMALL)
    p = np.array([r["probabilities"] for r in scored.collect()])
    assert p.shape == (600, 6) and np.allclose(p.sum(axis=1), 1.0) and (p >= 0).all()
    recs = scoring.recommendations(scored, SMALL)
    assert recs.columns == ["party_id", "recommendation_1", "confidence_1", "recommendation_2", "confidence_2"]
    assert recs.where("confidence_1 < confidence_2 OR recommendation_1 = recommendation_2").count() == 0


def test_outside_model(spark, rows_of_features):
    def predict(batch: pd.DataFrame) -> pd.DataFrame:
        high = (batch["ctos_score"] > 700).astype(float)
        return pd.DataFrame({"a": high, "b": 1 - high, **{c: 0.0 * high for c in "cdef"}})

    recs = scoring.recommendations(scoring.score_with(rows_of_features, predict, SMALL), SMALL)
    got = rows(recs.join(rows_of_features, "party_id").select("recommendation_1", (F.col("ctos_score") > 700).alias("h")).distinct())
    assert got == [("CREDIT_CARD", True), ("HOME_LOAN", False)]


def test_logs(spark, trained, rows_of_features, table):
    scored = scoring.score(trained[0].model, rows_of_features, SMALL)
    at = F.lit("2024-05-06 07:08:09").cast("timestamp")
    log = scoring.inference_log(scored, "3", at, SMALL)
    first = log.first()
    assert (first["model_version"], first["batch_id"]) == ("3", "batch_2024-05-06") and first["predicted_label"] in LABEL_CLASSES
    assert scoring.eval_log_from_batch(log).select("request_id").distinct().count() == 600
    name = table()
    for run in trained[1]:
        model.log_run(spark, run, name, 480, 120)
    top = model.top_runs(scan(spark, name), 1).first()
    assert top["macro_f1"] == trained[0].macro_f1 and top["n_train"] == 480


def test_registry_resolves_and_loads(spark, trained, rows_of_features, table, tmp_path):
    winner, runs = trained
    versions = table()
    forest, boosted = (r.model for r in runs)
    model.publish(spark, boosted, str(tmp_path), "nbp", 1, versions)
    assert model.resolve(spark, versions, "nbp")[0] == 1
    model.publish(spark, forest, str(tmp_path), "nbp", 2, versions, "dev")
    assert model.resolve(spark, versions, "nbp")[0] == 2
    model.publish(spark, boosted, str(tmp_path), "nbp", 3, versions, "champion")
    model.publish(spark, forest, str(tmp_path), "nbp", 4, versions)
    version, loaded = model.resolve(spark, versions, "nbp")
    assert version == 3
    assert rows(scoring.recommendations(scoring.score(loaded, rows_of_features, SMALL), SMALL)) == rows(
        scoring.recommendations(scoring.score(boosted, rows_of_features, SMALL), SMALL)
    )
    with pytest.raises(LookupError):
        model.resolve(spark, versions, "other")


def test_encoding_ignores_case_and_defaults(spark):
    df = spark.createDataFrame([("UNDER_100K",), (">5m",), ("1M-5M",), ("?",), (None,)], "v string")
    assert [r[0] for r in df.select(ordinal(F.col("v"), features.NET_WORTH, -1)).collect()] == [0, 5, 4, -1, -1]

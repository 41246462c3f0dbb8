from __future__ import annotations

import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerloom.functions import scalars
from ledgerloom.functions.encoding import label_of, one_hot, top_two, uniform
from ledgerloom.functions.replies import reply_text
from ledgerloom.operators import choose, drift, joins, measures, percentiles, profile, ranking, sizes
from ledgerloom.operators.percentiles import exact_percentiles
from ledgerloom.operators.prepare import prepare


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([("Ab", 1, "x"), (None, 2, "y")], "`a.b` string, n int, `we``ird` string")


def test_prepare_handles_odd_names(odd):
    out = prepare(
        odd,
        [
            {"type": "text_case", "column": "a.b", "case": "upper"},
            {"type": "fill_null", "column": "a.b", "with": "none"},
            {"type": "replace_value", "column": "we`ird", "match": "X", "with": "z"},
            {"type": "cast", "column": "n", "to": "string"},
        ],
    )
    assert [tuple(r) for r in out.collect()] == [("AB", "1", "z"), ("none", "2", "y")]


@pytest.mark.parametrize(
    "action, message",
    [
        ({"type": "explode"}, "unknown type"),
        ({"type": "trim", "column": "nope"}, "no column"),
        ({"type": "trim"}, "required"),
        ({"type": "trim", "column": "n", "side": "top"}, "not one of"),
        ({"type": "text_case", "column": "n", "case": "camel"}, "not one of"),
        ({"type": "replace_value", "column": "n", "match_mode": "fuzzy"}, "not one of"),
        ({"type": "extract", "column": "n", "pattern": "x", "group": "two"}, "whole number"),
        ({"type": "parse_date", "column": "n", "kind": "week"}, "not one of"),
        ({"type": "formula", "target": "x"}, "required"),
        ("trim", "mapping"),
    ],
)
def test_prepare_rejects(odd, action, message):
    with pytest.raises(ValueError, match=message):
        prepare(odd, [action])


def test_strict_casts_fail_at_run_time(spark):
    df = spark.createDataFrame([("x",)], "v string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        prepare(df, [{"type": "cast", "column": "v", "to": "int", "on_error": "error"}]).collect()
    with pytest.raises(Exception):
        prepare(df, [{"type": "parse_date", "column": "v", "format": "yyyy", "on_error": "error"}]).collect()
    lenient = prepare(df, [{"type": "parse_date", "column": "v", "kind": "timestamp"}])
    assert rows(lenient) == [(None,)]


def test_choose(odd, spark):
    assert choose.pick(odd, choose.by_name("contains", ".")).columns == ["a.b"]
    assert choose.pick(odd, choose.by_name("startsWith", "A.", case_sensitive=True)).columns == []
    assert choose.pick(odd, choose.by_name("endsWith", "IRD")).columns == ["we`ird"]
    # Spark's own syntax: possessive quantifiers, letter classes, POSIX names.
    assert choose.pick(odd, choose.by_name("regex", r"^\p{Lower}++[.`]")).columns == ["a.b", "we`ird"]
    assert choose.pick(odd, choose.by_name("regex", r"^\p{Upper}$", case_sensitive=True)).columns == []
    assert choose.pick(odd, choose.by_type("integer"), keep=False).columns == ["a.b", "we`ird"]
    assert choose.pick(odd, choose.by_expression("Category = 'string' AND FieldNumber = 3")).columns == ["we`ird"]
    assert choose.pick(odd, choose.by_expression(" ")).columns == []
    twice = odd.select("n", F.col("n"))
    assert choose.pick(twice, choose.by_type("integer")).columns == ["n", "n"]
    kinds = spark.sql("SELECT 1.5BD AS d, true AS b, current_date() AS day, current_timestamp() AS ts, X'01' AS bin, 1D AS f, array(1) AS arr")
    got = {r["Name"]: r["Category"] for r in choose.describe_columns(kinds).collect()}
    assert got == {"d": "decimal", "b": "boolean", "day": "date", "ts": "timestamp", "bin": "binary", "f": "float", "arr": None}
    with pytest.raises(ValueError):
        choose.by_name("sounds like", "x")


def test_arrange(odd):
    edits = [{"column": "n", "alias": "num"}, {"column": "a.b", "checked": False}]
    assert choose.arrange(odd, edits).columns == ["num", "we`ird"]
    assert choose.arrange(odd, edits, ["we`ird", "gone"]).columns == ["we`ird", "num"]
    assert choose.arrange(odd, edits, mode="select").columns == ["num"]
    assert choose.arrange(odd, [], mode="select").columns == odd.columns
    with pytest.raises(ValueError):
        choose.arrange(odd, [], mode="other")


@pytest.mark.parametrize("bound", [1, 1_000_000])
def test_percentiles_of_infinities_and_nan(spark, bound):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([("a", v) for v in (-inf, 1.0, 2.0, inf, nan)] + [("b", inf), ("c", -1.7e308), ("c", 1.7e308), ("d", nan), ("d", nan), ("d", nan)], "g string, v double")
    out = {r["g"]: tuple(r)[1:] for r in exact_percentiles(df, ["g"], "v", {"lo": 0.0, "mid": 0.5, "p75": 0.75}, bound=bound).collect()}
    assert all(math.isnan(x) for x in out["d"])
    assert out["a"] == (-inf, 2.0, inf) and out["b"] == (inf, inf, inf) and out["c"][0] == -1.7e308


@pytest.mark.parametrize("bound", [20, 1_000_000])
def test_percentiles_match_numpy(spark, bound):
    """A hot group, heavy ties, outliers, a NULL group, NULL values."""
    rng = random.Random(5)
    data = [("hot", round(rng.gauss(0, 50), 2)) for _ in range(4000)]
    data += [("ties", float(rng.randrange(3))) for _ in range(500)] + [("one", 7.5), ("same", 2.0), ("same", 2.0)]
    data += [("tail", 10.0 ** rng.randrange(12)) for _ in range(300)] + [(None, float(i)) for i in range(10)] + [("hot", None)]
    df = spark.createDataFrame(data, "g string, v double")
    wanted = {"low": 0.0, "p05": 0.05, "mid": 0.5, "p95": 0.95, "top": 1.0}
    out = {r["g"]: r for r in exact_percentiles(df, ["g"], "v", wanted, bound=bound, pivots=8).collect()}
    for g in {d[0] for d in data}:
        values = [v for k, v in data if k == g and v is not None]
        for name, p in wanted.items():
            assert math.isclose(out[g][name], np.quantile(values, p), rel_tol=1e-9, abs_tol=1e-9), (g, name)
    everything = exact_percentiles(df, [], "v", {"mid": 0.5}).first()["mid"]
    assert everything == np.quantile([v for _, v in data if v is not None], 0.5)


def test_an_outlier_leaves_no_large_part(spark, monkeypatch):
    """20,000 epoch seconds and a zero: pivots lie where the rows are."""
    df = spark.range(20_000).select((F.lit(1.7e9) + F.col("id")).alias("v")).unionByName(spark.createDataFrame([(0.0,)], "v double"))
    parts = []
    kept = percentiles._placed
    monkeypatch.setattr(percentiles, "_placed", lambda rows, state, uncut: parts.append(state.select(F.inline("_parts"))) or kept(rows, state, uncut))
    got = exact_percentiles(df, [], "v", {"q1": 0.25, "mid": 0.5, "p95": 0.95}, bound=500).first()
    values = [0.0, *(1.7e9 + i for i in range(20_000))]
    assert tuple(got) == tuple(np.quantile(values, [0.25, 0.5, 0.95]))
    assert max(r["n"] for r in parts[-1].collect()) <= 500 and len(parts) <= 4


def test_medians_read_the_input_once_a_pass(spark, tmp_path):
    spark.range(100).select(*[(F.col("id") * k).alias(f"c{k}") for k in range(1, 9)]).write.parquet(str(tmp_path / "t"))
    out = profile.medians(spark.read.parquet(str(tmp_path / "t")), [f"c{k}" for k in range(1, 9)])
    assert {r["column_name"]: r["median"] for r in out.collect()} == {f"c{k}": 49.5 * k for k in range(1, 9)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_percentiles_beyond_the_broadcast_bound(spark, monkeypatch):
    df = spark.range(3000).select((F.col("id") % 7).alias("g"), F.pmod(F.xxhash64("id"), F.lit(9973)).cast("double").alias("v"))
    small = rows(exact_percentiles(df, ["g"], "v", {"m": 0.5}))
    monkeypatch.setattr(percentiles, "settle", lambda summary: sizes.settle(summary, 0))
    assert rows(exact_percentiles(df, ["g"], "v", {"m": 0.5})) == small


def test_rollup_through_equals_direct(spark):
    fact = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 97).alias("k"), (F.col("id") / 7).cast("decimal(12,2)").alias("x")
    )
    bridge = spark.range(97).select(F.col("id").alias("k"), (F.col("id") % 5).alias("owner"))
    ms = [
        measures.count("n"),
        measures.count("big", F.col("x") > 300),
        measures.total("sum", F.col("x"), F.col("x") > 10),
        measures.mean("avg", F.col("x")),
        measures.any_true("any", F.col("x") > 714),
        measures.latest("last", F.col("x"), [F.col("x")]),
        measures.present("there"),
        measures.count_values("vals", F.col("x")),
    ]
    direct = measures.rollup(fact.join(bridge, "k"), ["owner"], ms)
    via = measures.rollup_through(fact, "k", bridge, "k", "owner", ms)
    assert rows(direct) == rows(via)


def test_joins(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id int, v string")
    side = spark.createDataFrame([(1, "x", 5)], "id int, v string, n int")
    assert rows(joins.star(base, [(side, "id")])) == [(1, "a", 5), (2, "b", None), (None, "c", None)]
    known, orphans = joins.referential_split(base, side, "id", "id")
    assert rows(known, "v") == [("a",)] and rows(orphans, "v") == [("b",), ("c",)]
    with pytest.raises(ValueError):
        joins.require_unique(base, ["id"], "base")
    merged = joins.upsert(base.where("id IS NOT NULL"), spark.createDataFrame([(2, "B"), (3, "C")], base.schema), ["id"])
    assert rows(merged) == [(1, "a"), (2, "B"), (3, "C")]
    with pytest.raises(ValueError, match="repeated"):
        joins.upsert(base, spark.createDataFrame([(2, "B"), (2, "C")], base.schema), ["id"])
    with pytest.raises(ValueError, match="key"):
        joins.upsert(base, base, [])
    assert rows(joins.missing_values(base, "v", ["a", "z"])) == [("z",)]
    assert rows(joins.with_defaults(base, {"id": 9})) == [(1, "a"), (2, "b"), (9, "c")]


def test_stratified_split_is_exact_and_stable(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, "big").when(F.col("id") < 999, "mid").otherwise("single").alias("y"))
    split = ranking.stratified_split(df, ["id"], "y", 0.2, 42)
    got = {tuple(r) for r in split.groupBy("y", "split").count().collect()}
    assert got == {("big", "test", 180), ("big", "train", 720), ("mid", "test", 20), ("mid", "train", 79), ("single", "train", 1)}
    again = ranking.stratified_split(df.repartition(7), ["id"], "y", 0.2, 42)
    assert rows(split, "id", "split") == rows(again, "id", "split")
    assert rows(split, "id", "split") != rows(ranking.stratified_split(df, ["id"], "y", 0.2, 7), "id", "split")


def test_search_and_pages(spark):
    df = spark.createDataFrame([(1, "50% Off"), (2, "500 off"), (3, "a_b"), (4, "axb"), (5, None)], "id int, name string")
    find = lambda q: [r[0] for r in rows(ranking.search(df, q, ["name"]), "id")]
    assert find("50% off") == [1] and find("A_B") == [3] and find("OFF") == [1, 2] and len(find("")) == 5
    assert rows(ranking.search(df, "", [], {"id": 4, "name": ""}), "id") == [(4,)]
    page = lambda n: [r["id"] for r in ranking.page(df, "name", "id", n, 2, text=True).collect()]
    assert page(1) + page(2) + page(3) == [5, 1, 2, 3, 4]
    assert [r["id"] for r in ranking.page_after(df, "id", 3, 5).collect()] == [4, 5]


def test_samples(spark):
    df = spark.range(20000)
    part = ranking.sample(df, ["id"], 0.1)
    assert abs(part.count() - 2000) < 200
    assert rows(part) == rows(ranking.sample(df.repartition(5), ["id"], 0.1))
    assert ranking.some(df, 7).count() == 7


def test_scalar_edges(spark):
    df = spark.createDataFrame(
        [(999.4, "mary  ann lee", "=1+1"), (1500.0, "x", "-2"), (None, "", "fine"), (2.5e6, None, "\tz"), (3.04e9, "é b", None)],
        "m double, name string, cell string",
    )
    got = df.select(
        scalars.humanize_money(F.col("m")), scalars.initials(F.col("name")), scalars.neutralize_formula(F.col("cell"))
    ).collect()
    assert [tuple(r) for r in got] == [
        ("MYR 999", "MA", "'=1+1"),
        ("MYR 2K", "X", "'-2"),
        ("-", "??", "fine"),
        ("MYR 2.5M", "??", "'\tz"),
        ("MYR 3.0B", "ÉB", None),
    ]
    one = spark.range(1)
    ratio = one.select(scalars.debt_ratio(F.lit(100.0), F.lit(0.0)), scalars.debt_ratio(F.lit(100.0), F.lit(6000.0))).first()
    assert ratio[0] is None and math.isclose(ratio[1], 0.2)
    gauge = one.select(*[scalars.score_gauge(F.lit(s)) for s in (100, 300, 575, 850, 900)], scalars.score_gauge(F.lit(None).cast("int"))).first()
    assert list(gauge) == [0.0, 0.0, 50.0, 100.0, 100.0, 0.0]


def test_ranking_of_probabilities(spark):
    classes = ("A", "B", "C")
    df = spark.createDataFrame([([0.2, 0.4, 0.4],), ([1.0, 0.0, 0.0],)], "p array<double>")
    assert [tuple(r) for r in df.select(*top_two(F.col("p"), classes)).collect()] == [("B", 40.0, "C", 40.0), ("A", 100.0, "B", 0.0)]
    one = spark.range(1)
    row = one.select(one_hot(F.lit(1), 3), one_hot(F.lit(8), 3), uniform(4), *[label_of(F.lit(x), classes) for x in ("2", "2.0", "B", "7")]).first()
    assert list(row) == [[0.0, 1.0, 0.0], [1.0, 0.0, 0.0], [0.25] * 4, "C", "C", "B", None]


def test_reply_text(spark):
    letter = "Let me think\\n\\nSubject: Hello\\nDear Ann,\\nWarm regards\\nBank\\nmore"
    replies = [
        ('{"choices":[{"message":{"content":" hi "}}]}', "hi"),
        ('{"choices":[{"message":{"content":"  ","reasoning_content":"' + letter + '"}}]}', "Subject: Hello\nDear Ann,\nWarm regards"),
        ('{"choices":[{"message":{"reasoning_content":"' + "\\n".join(str(i) for i in range(20)) + '"}}]}', "\n".join(str(i) for i in range(5, 20))),
        ('{"predictions":["p","q"]}', "p"),
        ("{}", ""),
        ("not json", ""),
    ]
    df = spark.createDataFrame([(a,) for a, _ in replies], "r string")
    assert [r["reply_text"] for r in reply_text(df, "r").collect()] == [b for _, b in replies]


def test_drift_and_gates(spark):
    frame = lambda s: spark.createDataFrame([(c,) for c in s], "v string")
    same = drift.js_distance(frame("aabb"), frame("ab"), "v").first()[0]
    apart = drift.js_distance(frame("aa"), frame("bb"), "v").first()[0]
    assert math.isclose(same, 0.0, abs_tol=1e-9) and math.isclose(apart, 1.0)
    metric = lambda v: spark.createDataFrame(v, "js_distance double")
    gate = lambda df, **k: tuple(drift.drift_gate(df, **k).first())[1:]
    assert gate(metric([(0.2,)])) == (True, "js_distance=0.2000_exceeds_0.15")
    assert gate(metric([(0.1,)])) == (False, "no_drift")
    assert gate(metric([])) == (False, "no_metrics_available")
    assert gate(metric([(0.1,)]), force=True) == (True, "force_retrain_override")
    stored = spark.createDataFrame(
        [("predicted_label", "js_distance", 0.5, "2024-01-01"), ("predicted_label", "js_distance", 0.1, "2024-01-02"), ("x", "js_distance", 0.9, "2024-01-03")],
        "column_name string, metric_name string, metric_value double, window_start_time string",
    )
    latest = drift.latest_metric(stored, "predicted_label", "js_distance")
    assert drift.drift_gate(latest, column="metric_value").first()["retrain_needed"] is False
    scores = spark.createDataFrame([(0.29,), (0.3,), (None,)], "macro_f1 double")
    assert [r["approval_status"] for r in drift.quality_gate(scores).collect()] == ["rejected", "approved", "rejected"]
    runs = lambda a, b: spark.createDataFrame([("champion", a), ("challenger", b)], "name string, macro_f1 double")
    assert drift.challenger_gate(runs(0.5, 0.49), "champion", "challenger").first()["promote"]
    assert not drift.challenger_gate(runs(0.5, 0.4), "champion", "challenger").first()["promote"]


def test_metrics_of_classes(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "y string, p string")
    got = {r["label"]: tuple(r)[1:] for r in profile.class_metrics(profile.confusion(df, "y", "p"), ["a", "b", "c", "d"]).collect()}
    assert got["a"] == (2, 0.5, 0.5, 0.5) and got["b"] == (1, 0.5, 1.0, 2 / 3) and got["c"] == (1, 0.0, 0.0, 0.0) and got["d"] == (0, 0.0, 0.0, 0.0)


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (None,)], "v double")
    assert rows(profile.histogram(df, "v", 10)) == [(0, 5.0, 2)]


def test_resolve_version(spark):
    df = spark.createDataFrame(
        [("m", 1, "champion"), ("m", 3, None), ("n", 1, "dev"), ("n", 2, None), ("o", 9, None), ("o", 10, None)],
        "model string, version int, alias string",
    )
    assert rows(ranking.resolve_version(df, "model", "version", "alias")) == [("m", 1, "champion"), ("n", 1, "dev"), ("o", 10, "latest")]


def test_labels_faults_and_small_means(spark):
    from ledgerloom.functions.encoding import label_of
    from ledgerloom.operators.profile import latency_stats  # noqa: F401
    from ledgerloom.operators.quality import fault_breakdown
    from ledgerloom.operators import measures
    from pyspark.sql import functions as F

    index = spark.createDataFrame([("-1",), ("-2",), ("1",), ("Infinity",), ("NaN",), ("1e12",), ("B",), (None,)], "i string")
    assert [r[0] for r in index.select(label_of(F.col("i"), ["A", "B"])).collect()] == [None, None, "B", None, None, None, "B", None]
    amounts = spark.createDataFrame([(None,), (-1.0,), (5.0,), (5.0,)], "a double")
    assert fault_breakdown(amounts, {"negative": "a < 0"}).first()["n_rows"] == 1
    small = spark.createDataFrame([(0.0042,), (0.0039,), (0.0021,)], "v double")
    assert abs(measures.rollup(small, [], [measures.mean("m", F.col("v"))]).first()["m"] - 0.0034) < 1e-12

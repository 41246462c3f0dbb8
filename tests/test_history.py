from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerloom.operators import history as h
from ledgerloom.sources.queries import scan
from ledgerloom.streaming.history import HistoryWriter, scd2_stream


def at(day: int, hour: int = 0) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour)


def frame(spark, data):
    return spark.createDataFrame(data, "id string, ts timestamp, v string, src string")


def test_versions_close_at_the_next_start(spark):
    out = h.scd2(frame(spark, [("a", at(0), "x", "f1"), ("a", at(30), "y", "f2"), ("b", at(1), "z", "f1")]), ["id"], "ts")
    assert rows(out, "id", "v", h.START, h.END) == [
        ("a", "x", at(0), at(30)),
        ("a", "y", at(30), None),
        ("b", "z", at(1), None),
    ]
    assert rows(h.current(out), "id", "v") == [("a", "y"), ("b", "z")]
    assert rows(h.as_of(out, F.lit("2024-01-15").cast("timestamp")), "id", "v") == [("a", "x"), ("b", "z")]
    assert rows(h.as_of(out, F.lit(at(30)).cast("timestamp")), "id", "v") == [("a", "y"), ("b", "z")]


def test_duplicates_ties_and_rejects(spark):
    data = [
        ("a", at(0), "x", "f1"),
        ("a", at(0), "x", "f1"),
        ("a", at(0), "later file", "f2"),
        (None, at(0), "x", "f1"),
        ("b", None, "x", "f1"),
    ]
    df = frame(spark, data)
    assert rows(h.scd2(df, ["id"], "ts", tie=["src"]), "id", "v", h.END) == [("a", "later file", None)]
    assert h.rejects(df, ["id"], "ts").count() == 2


def test_unchanged_versions(spark):
    df = frame(spark, [("a", at(i), v, "s") for i, v in enumerate("xxyyx")])
    assert h.scd2(df, ["id"], "ts").count() == 5
    merged = h.scd2(df, ["id"], "ts", collapse_unchanged=True)
    assert rows(merged, "v", h.START, h.END) == [("x", at(0), at(2)), ("x", at(4), None), ("y", at(2), at(4))]


def test_hot_key_matches_brute_force(spark):
    rng = random.Random(3)
    data = [("hot", at(rng.randrange(400), rng.randrange(24)), str(i), "s") for i in range(900)]
    data += [(f"k{i % 40}", at(rng.randrange(400)), str(i), "s") for i in range(400)]
    got = rows(h.following(frame(spark, data), ["id"], "ts"))
    want = []
    for key in {d[0] for d in data}:
        times = sorted({d[1] for d in data if d[0] == key})
        want += [(key, a, b) for a, b in zip(times, times[1:] + [None])]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_numeric_sequence(spark):
    df = spark.createDataFrame([(1, s) for s in (5, 105, 106, 999)], "id int, seq bigint")
    out = h.scd2(df, ["id"], "seq", segment=h.by_width(100))
    assert rows(out, h.START, h.END) == [(105, 106), (106, 999), (5, 105), (999, None)]


def test_segments_by_type(spark):
    dates = spark.sql("SELECT 1 AS id, date_add(DATE '2023-12-30', i) AS d FROM (SELECT explode(sequence(0, 3)) AS i)")
    got = rows(h.following(dates, ["id"], "d"), "d", "_next")
    assert [b for _, b in got] == [dt.date(2023, 12, 31), dt.date(2024, 1, 1), dt.date(2024, 1, 2), None]
    big = spark.createDataFrame([(1, s) for s in (-3, 5, 999_999, 1_000_000, 5_000_000)], "id int, seq bigint")
    assert sorted(rows(h.following(big, ["id"], "seq"), "seq", "_next")) == [(-3, 5), (5, 999_999), (999_999, 1_000_000), (1_000_000, 5_000_000), (5_000_000, None)]
    texts = spark.createDataFrame([(1, x) for x in ("b", "", "é", "a", "b")], "id int, s string")
    assert rows(h.following(texts, ["id"], "s"), "s", "_next") == [("", "a"), ("a", "b"), ("b", "é"), ("é", None)]


@pytest.mark.parametrize(
    "expression",
    ["1700000000000000 + id * 7919 * 1000003", "cast(id / 7000000.0 as decimal(20,6))", "cast(-id as double) / 3", "concat('k', lpad(id, 6, '0'))"],
)
def test_a_hot_key_of_any_sequence_is_spread(spark, expression):
    """5,000 points of one key: many ranges, each a part of them, whatever the values."""
    df = spark.range(5000).select(F.lit("hot").alias("id"), F.expr(expression).alias("seq"))
    df = df.unionByName(df.where("rand(3) < 0.1")).unionByName(spark.range(40).select(F.concat(F.lit("k"), (F.col("id") % 9).cast("string")).alias("id"), F.expr(expression).alias("seq")))
    data = sorted({tuple(r) for r in df.collect()})
    want = [(k, s, data[i + 1][1] if i + 1 < len(data) and data[i + 1][0] == k else None) for i, (k, s) in enumerate(data)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = h.following(df.repartition(5), ["id"], "seq")
        assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(want, key=str)
        ranges = df.repartitionByRange("id", "seq").groupBy(F.spark_partition_id()).count()
        assert ranges.count() >= 12 and max(r["count"] for r in ranges.collect()) < 1500
        # Only the ends of the ranges meet by key.
        assert out.where("id = 'hot'").count() == len({s for k, s in data if k == "hot"})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_wall_clock_sequence_in_a_zone_with_summer_time(spark):
    """02:30 does not exist on that night in Berlin; the order must not care."""
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        times = [dt.datetime(2024, 3, 31, h, m) for h, m in ((1, 59), (2, 30), (3, 15), (3, 45))]
        df = spark.createDataFrame([(1, str(x)) for x in times], "id int, s string").select("id", F.col("s").cast("timestamp_ntz").alias("t"))
        assert rows(h.following(df, ["id"], "t"), "t", "_next") == list(zip(times, times[1:] + [None]))
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_latest_per_key(spark):
    df = frame(spark, [("a", at(0), "x", "1"), ("a", at(2), "y", "1"), ("a", at(2), "z", "2"), ("b", at(1), None, "1")])
    assert rows(h.latest_per_key(df, ["id"], [F.col("ts"), F.col("src")]), "id", "v") == [("a", "z"), ("b", None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_incremental_equals_batch(spark, table, tmp_path, seed):
    """Any split into micro-batches, late rows and replays included."""
    rng = random.Random(seed)
    data = [(f"k{rng.randrange(12)}", at(rng.randrange(60)), f"v{i % 7}", f"f{i:03}") for i in range(120)]
    name = table(f"h{seed}")
    writer = HistoryWriter(name, ["id"], "ts", tie=["src"], buckets=4, staging=str(tmp_path / "stage"))
    parts = [data[:50], data[50:90], data[90:]]
    for i, part in enumerate(parts):
        writer.write(frame(spark, part), i)
    writer.write(frame(spark, parts[2]), 2)
    want = h.scd2(frame(spark, data), ["id"], "ts", tie=["src"])
    assert rows(scan(spark, name), *want.columns) == rows(want)


@pytest.mark.parametrize("broken", ["__closed", "__dead", "__open"])
def test_half_applied_batches_are_repaired(spark, table, tmp_path, broken):
    name = table()
    writer = HistoryWriter(name, ["id"], "ts", buckets=2, staging=str(tmp_path / "stage"))
    writer.write(frame(spark, [("a", at(0), "x", "s"), ("a", at(9), "z", "s"), ("b", at(0), "x", "s")]), 0)
    batch = frame(spark, [("a", at(5), "y", "s"), ("b", at(2), "w", "s")])
    put = writer._put

    def lost(rows, target):
        if target.endswith(broken):
            raise RuntimeError("lost")
        put(rows, target)

    writer._put = lost
    with pytest.raises(RuntimeError):
        writer.write(batch, 1)
    writer._put = put
    for _ in range(2):
        writer.write(batch, 1)
        assert rows(scan(spark, name), "id", "v", h.END) == [("a", "x", at(5)), ("a", "y", at(9)), ("a", "z", None), ("b", "w", None), ("b", "x", at(2))]


def files(spark, name):
    return {f: os.path.getmtime(f.removeprefix("file:")) for f in scan(spark, name).inputFiles()}


def test_a_batch_rewrites_no_closed_row(spark, table, tmp_path):
    """A hundred keys on a history of many: late rows change what they must, files of closed versions stay."""
    name = table()
    writer = HistoryWriter(name, ["id"], "seq", buckets=8, staging=str(tmp_path / "stage"))
    first = spark.range(200_000).select((F.col("id") % 5000).alias("id"), (F.col("id") * 10).alias("seq"), F.lit("v").alias("v"))
    writer.write(first, 0)
    closed = files(spark, f"{name}__closed")
    in_order = spark.range(100).select("id", (F.lit(9_000_000) + F.col("id")).alias("seq"), F.lit("new").alias("v"))
    scanned = writer._live
    writer._live = lambda session: pytest.fail("closed versions were read")
    writer.write(in_order, 1)
    writer._live = scanned
    late = spark.range(100).select("id", (F.col("id") * 10 + 5).alias("seq"), F.lit("late").alias("v"))
    writer.write(late, 2)
    after = files(spark, f"{name}__closed")
    assert closed.items() <= after.items()
    assert scan(spark, f"{name}__closed").where("_version > 1").count() == 100 + 200 and scan(spark, f"{name}__dead").count() == 100
    want = h.scd2(first.unionByName(in_order).unionByName(late), ["id"], "seq")
    got = scan(spark, name).select(*want.columns)
    assert got.count() == want.count() == 200_200 and got.exceptAll(want).isEmpty()
    writer.compact(spark)
    assert scan(spark, f"{name}__dead").isEmpty() and scan(spark, name).select(*want.columns).exceptAll(want).isEmpty()
    assert scan(spark, name).count() == 200_200
    writer.write(late, 3)
    assert scan(spark, name).count() == 200_200


def test_compaction_that_died_is_finished(spark, table, tmp_path):
    name = table()
    writer = HistoryWriter(name, ["id"], "ts", tie=["src"], buckets=2, staging=str(tmp_path / "stage"))
    writer.write(frame(spark, [("a", at(0), "x", "1"), ("a", at(9), "z", "1")]), 0)
    writer.write(frame(spark, [("a", at(5), "y", "1"), ("a", at(0), "w", "2")]), 1)
    put, writer._put = writer._put, lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        writer.compact(spark)
    writer._put = put
    writer.write(frame(spark, [("a", at(12), "q", "1")]), 2)
    assert rows(scan(spark, name), "v", h.END) == [("q", None), ("w", at(5)), ("y", at(9)), ("z", at(12))]


def test_new_columns_reach_every_version(spark, table, tmp_path):
    name = table()
    writer = HistoryWriter(name, ["id"], "ts", buckets=2, staging=str(tmp_path / "stage"))
    writer.write(frame(spark, [("a", at(0), "x", "s"), ("a", at(9), "z", "s"), ("c", at(1), "k", "s")]), 0)
    writer.write(frame(spark, [("a", at(5), "y", "s"), ("b", at(1), "n", "s")]).withColumn("extra", F.lit(7)), 1)
    assert rows(scan(spark, name), "id", "v", "extra", h.END) == [("a", "x", None, at(5)), ("a", "y", 7, at(9)), ("a", "z", None, None), ("b", "n", 7, None), ("c", "k", None, None)]


def test_stream(spark, table, tmp_path):
    src, name = tmp_path / "src", table()
    writer = HistoryWriter(name, ["id"], "ts", buckets=2, staging=str(tmp_path / "stage"))
    for v, day in (("new", 9), ("old", 1)):
        frame(spark, [("a", at(day), v, "s")]).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema("id string, ts timestamp, v string, src string").parquet(str(src))
        scd2_stream(stream, writer, str(tmp_path / "cp")).awaitTermination()
    assert rows(scan(spark, name), "v", h.END) == [("new", None), ("old", at(9))]

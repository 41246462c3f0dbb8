from __future__ import annotations

import glob
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerloom.schemas import INFERENCE_LOG
from ledgerloom.sinks import export, tables
from ledgerloom.sources.queries import scan, table_exists


def test_append_adds_columns_and_aligns_by_name(spark, table):
    name = table()
    tables.append(spark.createDataFrame([(1, "a")], "id int, v string"), name)
    tables.append(spark.createDataFrame([("b", 2, 0.5)], "v string, id int, extra double"), name)
    tables.append(spark.createDataFrame([(3,)], "ID int"), name)
    assert rows(scan(spark, name), "id", "v", "extra") == [(1, "a", None), (2, "b", 0.5), (3, None, None)]


def test_overwrite_replaces_the_schema(spark, table):
    name = table()
    tables.overwrite(spark.createDataFrame([(1, "a")], "id int, v string"), name)
    tables.overwrite(spark.createDataFrame([(True,)], "flag boolean"), name)
    assert scan(spark, name).columns == ["flag"]
    tables.drop(spark, name)
    assert not table_exists(spark, name)


def test_merge(spark, table):
    name = table()
    tables.merge(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), name, ["id"])
    for _ in range(2):
        tables.merge(spark.createDataFrame([(2, "B"), (3, "C")], "id int, v string"), name, ["id"])
    assert rows(scan(spark, name)) == [(1, "a"), (2, "B"), (3, "C")]
    with pytest.raises(ValueError):
        tables.merge(scan(spark, name), name, [])
    with pytest.raises(ValueError, match="repeated"):
        tables.merge(spark.createDataFrame([(2, "x"), (2, "y")], "id int, v string"), name, ["id"])


def test_merge_is_completed_after_a_crash(spark, table, monkeypatch):
    name = table()
    tables.merge(spark.createDataFrame([(1, "a")], "id int, v string"), name, ["id"])

    def lost(*_):
        spark.sql(f"TRUNCATE TABLE {name}")
        raise RuntimeError("lost half-way")

    with monkeypatch.context() as patch:
        patch.setattr(tables, "_copy_over", lost)
        with pytest.raises(RuntimeError):
            tables.merge(spark.createDataFrame([(2, "b")], "id int, v string"), name, ["id"])
    assert scan(spark, name).count() == 0
    tables.merge(spark.createDataFrame([(3, "c")], "id int, v string"), name, ["id"])
    assert rows(scan(spark, name)) == [(1, "a"), (2, "b"), (3, "c")]


def test_feature_table_needs_a_key(spark, table):
    name = table()
    tables.save_features(spark.createDataFrame([(1, 0.5)], "id int, f double"), name, ["id"], "it's a table")
    assert spark.sql(f"SHOW TBLPROPERTIES {name}").where("key = 'primary_key'").first()["value"] == "id"
    with pytest.raises(ValueError):
        tables.save_features(spark.createDataFrame([(None, 0.5)], "id int, f double"), name, ["id"])
    log = table("log")
    tables.create_empty(spark, log, INFERENCE_LOG, "scores")
    assert len(scan(spark, log).columns) == 5 and scan(spark, log).count() == 0


def test_single_file_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "=SUM(A1)"), (2, 'say "hi"')], "id int, v string")
    path = str(tmp_path / "out")
    export.single_file(df, path)
    assert len(glob.glob(path + "/*.csv")) == 1
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    assert rows(back, "v") == [("'=SUM(A1)",), ('say "hi"',)]
    export.single_file(df.select("v", "id"), path, append=True)
    assert spark.read.option("header", True).csv(path).count() == 4
    with pytest.raises(ValueError, match="differ"):
        export.single_file(df.withColumnRenamed("v", "w"), path, append=True)
    with pytest.raises(ValueError, match="appending"):
        export.single_file(df, path, append=True, max_rows=5)
    with pytest.raises(ValueError, match="more than"):
        export.single_file(df, str(tmp_path / "x"), max_rows=1)
    with pytest.raises(ValueError, match="not one of"):
        export.single_file(df, str(tmp_path / "x"), "excel")
    export.single_file(df, str(tmp_path / "j"), "json", append=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_an_upsert_rewrites_only_its_buckets(spark, table):
    name = table()
    first = spark.range(1000).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    tables.merge_buckets(first, name, ["k"], buckets=16)
    files = lambda: {f: os.path.getmtime(f.removeprefix("file:")) for f in scan(spark, name).inputFiles()}
    before = files()
    tables.merge_buckets(spark.createDataFrame([(5, "new", 1.5)], "k long, v string, extra double"), name, ["k"])
    after = files()
    assert len(before) == 16 and len(before.items() & after.items()) == 15
    got = {r["k"]: (r["v"], r["extra"]) for r in scan(spark, name).collect()}
    assert len(got) == 1000 and got[5] == ("new", 1.5) and got[6] == ("old", None)
    tables.merge_buckets(spark.createDataFrame([(2000, "added")], "k long, v string"), name, ["k"])
    assert scan(spark, name).count() == 1001
    with pytest.raises(ValueError):
        tables.merge_buckets(first, name, [])


def test_a_bucket_upsert_that_died_is_completed(spark, table, monkeypatch):
    name = table()
    tables.merge_buckets(spark.range(50).select(F.col("id").alias("k"), F.lit("old").alias("v")), name, ["k"], buckets=4)
    put = tables.put_partitions
    monkeypatch.setattr(tables, "put_partitions", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        tables.merge_buckets(spark.createDataFrame([(1, "first")], "k long, v string"), name, ["k"])
    monkeypatch.setattr(tables, "put_partitions", put)
    tables.merge_buckets(spark.createDataFrame([(2, "second")], "k long, v string"), name, ["k"])
    got = {r["k"]: r["v"] for r in scan(spark, name).collect()}
    assert len(got) == 50 and (got[1], got[2], got[3]) == ("first", "second", "old")

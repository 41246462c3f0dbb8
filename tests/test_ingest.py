from __future__ import annotations

from ledgerloom.sources.files import read_csv_files

import json
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.operators import quality
from ledgerloom.schemas import FEEDS, Feed
from ledgerloom.sinks import tables
from ledgerloom.sources import files
from ledgerloom.sources.queries import ensure_schema, run_sql, scan, scan_stream, table_exists
from ledgerloom.streaming import ingest, ratelimit, rules

FEED = Feed("t", "id string, amount double, day date, ok boolean", "csv", "bronze_t", max_files=2)


def put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / name
    path.write_text(text)
    return str(path)


def test_rescue_keeps_every_row(spark, tmp_path):
    """20 clean rows, a bad amount, a bad date, an unknown column."""
    clean = "".join(f"T{i:06},{i}.5,2024-01-0{i % 9 + 1},true\n" for i in range(1, 21))
    first = put(tmp_path, "a.csv", "id,amount,day,ok\n" + clean + "T000021,TWO HUNDRED,2024-01-01,true\nT000022,5.0,not-a-date,\n")
    second = put(tmp_path, "b.csv", "ok,id,fraud_score,amount\nfalse,T000023,0.95,7.0\n")
    df = files.read_csv_files(spark, [first, second], FEED.schema)
    assert df.count() == 23
    got = {r["id"]: r for r in df.where("_rescued_data IS NOT NULL").collect()}
    assert {k: json.loads(r["_rescued_data"]) for k, r in got.items()} == {
        "T000021": {"amount": "TWO HUNDRED"},
        "T000022": {"day": "not-a-date"},
        "T000023": {"fraud_score": "0.95"},
    }
    assert got["T000021"]["amount"] is None and got["T000022"]["day"] is None
    assert got["T000023"]["ok"] is False and got["T000023"]["amount"] == 7.0
    assert {r[0].rsplit("/", 1)[1] for r in df.select("_source_file").distinct().collect()} == {"a.csv", "b.csv"}


def test_incremental_csv_evolves_and_reads_each_file_once(spark, table, tmp_path):
    name, landing, cp = table(), tmp_path / "in", str(tmp_path / "cp")
    put(landing, "v1.csv", "id,amount\n" + "".join(f"a{i},1.0\n" for i in range(100)))
    ingest.ingest_csv(spark, FEED, str(landing), cp, name).awaitTermination()
    assert scan(spark, name).count() == 100
    put(landing, "v2.csv", "id,amount,occupation_code,is_shariah_preferred\n" + "".join(f"b{i},2.0,OC{i},true\n" for i in range(50)))
    ingest.ingest_csv(spark, FEED, str(landing), cp, name).awaitTermination()
    ingest.ingest_csv(spark, FEED, str(landing), cp, name).awaitTermination()
    df = scan(spark, name)
    assert df.count() == 150
    assert df.where("occupation_code IS NULL").count() == 100
    assert df.where("is_shariah_preferred = 'true' AND _rescued_data IS NULL").count() == 50


def test_two_folders_feed_one_table(spark, table, tmp_path):
    name = table()
    for part in ("v1", "v2"):
        put(tmp_path / part, "x.csv", f"id,amount\n{part},1.0\n")
        ingest.ingest_csv(spark, FEED, str(tmp_path / part), str(tmp_path / f"cp-{part}"), name).awaitTermination()
    assert rows(scan(spark, name), "id") == [("v1",), ("v2",)]


def test_replayed_batch_is_skipped(spark, table):
    name = table()
    batch = spark.createDataFrame([(1,), (2,)], "v int")
    for restart in ((0, 1), (1, 2), (2,)):
        write = ingest.append_once(name, "cp", lambda df: df)
        for batch_id in restart:
            write(batch, batch_id)
    ingest.append_once(name, "other", lambda df: df)(batch, 0)
    assert scan(spark, name).count() == 8


def test_json_lines_and_documents(spark, table, tmp_path):
    lines = [{"id": "1", "amount": 2.5, "day": "2024-01-01"}, {"id": "2", "amount": "many", "extra": {"a": 1}}]
    put(tmp_path / "l", "a.json", "\n".join(json.dumps(x) for x in lines) + "\n\nnot json\n")
    feed = Feed("j", FEED.ddl, "json", "j", max_files=1)
    name = table("lines")
    ingest.ingest_json(spark, feed, str(tmp_path / "l"), str(tmp_path / "cp1"), name).awaitTermination()
    got = rows(scan(spark, name), "id", "amount", "extra", "_rescued_data")
    assert got == [("1", 2.5, None, None), ("2", None, '{"a":1}', '{"amount":"many"}'), (None, None, None, '{"_malformed":"not json"}')]
    fixed = table("fixed")
    ingest.ingest_json(spark, feed, str(tmp_path / "l"), str(tmp_path / "cp3"), fixed, widen=False).awaitTermination()
    assert rows(scan(spark, fixed), "id", "_rescued_data")[1] == ("2", '{"amount":"many","extra":"{\\"a\\":1}"}')

    docs = Feed("d", FEED.ddl, "json", "d", multi_line=True)
    put(tmp_path / "m", "one.json", json.dumps(lines[0], indent=2))
    put(tmp_path / "m", "many.json", json.dumps(lines, indent=2))
    name = table("docs")
    ingest.ingest_json(spark, docs, str(tmp_path / "m"), str(tmp_path / "cp2"), name).awaitTermination()
    assert rows(scan(spark, name), "id", "amount") == [("1", 2.5), ("1", 2.5), ("2", None)]
    batch = files.read_feed(spark, docs, [str(tmp_path / "m" / "many.json")])
    assert batch.count() == 2


def test_throttle_splits_batches(spark, table, tmp_path):
    name = table()
    for i in range(3):
        put(tmp_path / "in", f"{i}.csv", f"id,amount\nx{i},1\n")
    ingest.ingest_csv(spark, Feed("t", FEED.ddl, "csv", "t", max_files=1, drain_files=1), str(tmp_path / "in"), str(tmp_path / "cp"), name).awaitTermination()
    assert scan(spark, name).select("_batch").distinct().count() == 3


def test_feed_schemas_parse():
    assert [len(FEEDS[n].schema) for n in ("customer_master", "accounts", "loans", "transactions", "cards")] == [43, 30, 20, 21, 21]
    assert [len(FEEDS[n].schema) for n in ("digital_events", "credit_bureau", "telco_events")] == [14, 32, 22]
    assert [FEEDS[n].max_files for n in ("digital_events", "credit_bureau", "telco_events")] == [1, 5, 5]


def test_rules_on_a_stream(spark, table, tmp_path):
    src = table("src")
    tables.append(spark.createDataFrame([("a", 1.0), (None, 2.0), ("c", -1.0)], "id string, amount double"), src)
    rule_set = quality.RuleSet([quality.Rule("id", quality.not_null("id"), "drop"), quality.Rule("amt", quality.positive("amount"))])
    out, bad, counts = table("out"), table("bad"), table("counts")
    for _ in range(2):
        rules.apply_rules(scan_stream(spark, src), rule_set, out, str(tmp_path / "cp"), bad, counts).awaitTermination()
    assert scan(spark, out).count() == 2 and scan(spark, bad).count() == 1
    assert rows(scan(spark, counts), "rule", "failed") == [("amt", 1), ("id", 1)]


def test_rate_limit_stream_matches_batch(spark, tmp_path):
    calls = spark.range(200).select(
        (F.col("id") % 3).alias("user"), F.timestamp_seconds(F.col("id") * 7 + 1700000000).alias("at")
    )
    calls.write.parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "calls"))
    query = (
        ratelimit.over_limit_stream(stream, "user", "at", "1 minute", 2, "0 seconds")
        .writeStream.format("memory").queryName("limits").outputMode("append").trigger(availableNow=True)
        .option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    query.awaitTermination()
    want = set(rows(ratelimit.over_limit(calls, "user", "at", "minute", 2)))
    got = set(rows(spark.table("limits")))
    newest = max(r[1] for r in want)
    assert got <= want and {r for r in want if r[1] < newest} <= got


def test_rate_source_status_and_stop(spark, table, tmp_path):
    name = table()
    query = ingest.append_stream(files.rate(spark), name, str(tmp_path / "cp"), {"processingTime": "1 second"})
    assert len(ingest.running(spark)) == 1
    ingest.stop_all(spark)
    assert not query.isActive and ingest.running(spark) == []


def test_events_from_json_text(spark, table, tmp_path):
    ddl = "user string, n bigint"
    assert files.example_schema(spark, '{"user": "a", "n": 1}') == "STRUCT<n: BIGINT, user: STRING>"
    name = table()
    events = files.rate(spark, 50).select(
        F.to_json(F.struct(F.lit("u").alias("user"), F.col("value").alias("n"))).alias("body"), "timestamp"
    )
    query = ingest.append_stream(files.expand_json(events, "body", ddl, ("timestamp",)), name, str(tmp_path / "cp"), {"processingTime": "1 second"})
    query.processAllAvailable()
    while not query.lastProgress or not query.lastProgress["numInputRows"]:
        query.awaitTermination(1)
    query.stop()
    df = scan(spark, name)
    assert df.columns == ["user", "n", "timestamp"] and df.where("user = 'u' AND n >= 0").count() == df.count() > 0


def test_sql_source_and_catalog(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y' OR '1'='1")], "id int, name string")
    got = run_sql(spark, "SELECT id FROM {d} WHERE name = :n", {"d": df}, {"n": "y' OR '1'='1", "other": 1})
    assert rows(got) == [(2,)]
    assert not table_exists(spark, "no_such_table")
    ensure_schema(spark, "side")
    assert spark.catalog.databaseExists("side")


def test_documents_and_inference(spark, tmp_path):
    put(tmp_path / "docs", "a.txt", "hello")
    put(tmp_path / "docs", "b.bin", "no")
    assert rows(files.read_documents(spark, str(tmp_path / "docs"), "*.txt"), "length") == [(5,)]
    path = put(tmp_path, "x.csv", "a,b\n1,x\n")
    assert dict(files.read_csv_inferred(spark, path).dtypes) == {"a": "int", "b": "string"}


def test_odd_file_names_and_blank_text(spark, tmp_path):
    paths = [put(tmp_path, n, f"id,amount\n' {i} ',{'  ' if i else '1.5'}\n") for i, n in enumerate(["a[1].csv", "b {x}*.csv"])]
    df = files.read_csv_files(spark, paths, FEED.schema)
    assert rows(df, "id", "amount", "_rescued_data") == [("' 0 '", 1.5, None), ("' 1 '", None, None)]


def test_empty_csv_batch(spark, tmp_path):
    empty = put(tmp_path, "e.csv", "")
    assert files.read_csv_files(spark, [empty], StructType.fromDDL("a int")).count() == 0
    with pytest.raises(Exception):
        files.read_csv_files(spark, [str(tmp_path / "absent.csv")], StructType.fromDDL("a int"))


def test_no_row_field_or_column_is_lost(spark, tmp_path):
    schema = StructType.fromDDL("id int, amt double, note string")
    files = {
        "blank": "\n  \nid,amt,note\n1,2.5,a\n",
        "surplus": "id,amt,note\n2,3.5,b,EXTRA\n",
        "case": "ID,Amt,note\n3,4.5,c\n",
        "empty": "\n\n",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text)
    got = {r["id"]: r for r in read_csv_files(spark, [str(tmp_path / f"{n}.csv") for n in files], schema).collect()}
    assert set(got) == {1, 2, 3} and got[3]["amt"] == 4.5
    assert "EXTRA" in got[2]["_rescued_data"] and got[1]["_rescued_data"] is None


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "q.csv").write_text('id,note\n1,"a\nb"\n')
    got = read_csv_files(spark, [str(tmp_path / "q.csv")], StructType.fromDDL("id int, note string"), multi_line=True).collect()
    assert [(r["id"], r["note"]) for r in got] == [(1, "a\nb")]


def test_json_fields_become_columns(spark, table, tmp_path):
    """Version 1 and version 2 documents in one table; restarts lose and repeat nothing."""
    name, landing, cp = table(), tmp_path / "in", str(tmp_path / "cp")
    feed = Feed("j", "id string, amount double", "json", "j", max_files=1, drain_files=1)
    run = lambda: ingest.ingest_json(spark, feed, str(landing), cp, name).awaitTermination()
    put(landing, "v1.json", "\n".join(json.dumps({"id": f"a{i}", "amount": 1.0}) for i in range(5)))
    run()
    put(landing, "v2.json", "\n".join(json.dumps({"id": f"b{i}", "amount": 2.0, "Channel": "app", "channel": None, "score": i}) for i in range(3)))
    put(landing, "v3.json", json.dumps({"id": "c0", "CHANNEL": "web", "amount": "x"}))
    run()
    run()
    got = {r["id"]: r for r in scan(spark, name).collect()}
    assert len(got) == scan(spark, name).count() == 9
    column = next(c for c in scan(spark, name).columns if c.lower() == "channel")
    assert [got[i][column] for i in ("a0", "b0", "c0")] == [None, "app", "web"]
    assert got["b2"]["score"] == "2" and got["a1"]["score"] is None and got["c0"]["_rescued_data"] == '{"amount":"x"}'


def test_quoted_line_breaks_on_a_stream(spark, table, tmp_path):
    name = table()
    put(tmp_path / "in", "q.csv", 'id,amount\n"a\nb",1.5\nc,2.5\n')
    feed = Feed("t", "id string, amount double", "csv", "t", multi_line=True)
    ingest.ingest_csv(spark, feed, str(tmp_path / "in"), str(tmp_path / "cp"), name).awaitTermination()
    assert rows(scan(spark, name), "id", "amount") == [("a\nb", 1.5), ("c", 2.5)]


def test_headers_that_differ_in_case_do_not_stop_the_feed(spark, table, tmp_path):
    name = table()
    put(tmp_path / "in", "a.csv", "id,extra\n1,x\n")
    put(tmp_path / "in", "b.csv", "id,EXTRA\n2,y\n")
    put(tmp_path / "in", "c.csv", "ID,id,Extra,eXtra\n3,4,z,w\n")
    ingest.ingest_csv(spark, FEED, str(tmp_path / "in"), str(tmp_path / "cp"), name).awaitTermination()
    df = scan(spark, name)
    column = [c for c in df.columns if c.lower() == "extra"]
    got = {r["id"]: r for r in df.collect()}
    assert len(column) == 1 and {i: r[column[0]] for i, r in got.items()} == {"1": "x", "2": "y", "4": "z"}
    assert "3" in str(got["4"]) and "w" in str(got["4"])


def test_a_replay_reads_no_target_row(spark, table, tmp_path, monkeypatch):
    """A batch whose partition is there is skipped by its folder alone; a half-written one is written again."""
    name = table()
    batch = spark.createDataFrame([(1,), (2,)], "v int")
    assert ingest.append_once(name, "cp", lambda df: df)(batch, 7)
    monkeypatch.setattr(tables, "scan", lambda *a: pytest.fail("the target was read"))
    assert not ingest.append_once(name, "cp", lambda df: df)(batch, 7)
    monkeypatch.undo()
    assert ingest.append_once(name, "cp", lambda df: df)(batch, 8)
    where = tables.location(spark, name)
    mark = sorted(r[0] for r in spark.sql(f"SHOW PARTITIONS {name}").collect())[-1]
    tables.remove(spark, f"{where}/{mark}")
    assert ingest.append_once(name, "cp", lambda df: df)(batch, 8)
    assert rows(scan(spark, name), "v") == [(1,), (1,), (2,), (2,)]


def test_rules_read_a_batch_once(spark, table, tmp_path):
    """Counts come with the write of the kept rows; a replay after a crash between the outputs completes them."""
    src, out, bad, counts = (table(s) for s in ("src", "out", "bad", "counts"))
    tables.append(spark.createDataFrame([("a", 1.0), (None, 2.0), ("c", -1.0), (None, -3.0)], "id string, amount double"), src)
    rule_set = quality.RuleSet([quality.Rule("id", quality.not_null("id"), "drop"), quality.Rule("amt", quality.positive("amount"))])
    run = lambda cp: rules.apply_rules(scan_stream(spark, src), rule_set, out, str(tmp_path / cp), bad, counts, annotate=True).awaitTermination()
    run("cp")
    want = [("amt", "warn", 2, 2, 50.0), ("id", "drop", 2, 2, 50.0)]
    assert rows(scan(spark, counts), "rule", "action", "passed", "failed", "failed_pct") == want
    assert rows(scan(spark, bad), "amount", "_dq_failed") == [(-3.0, ["id"]), (2.0, ["id"])]
    assert rows(scan(spark, out), "id", "_dq_failed") == [("a", []), ("c", ["amt"])]
    for lost in (bad, counts):
        spark.sql(f"DROP TABLE {lost}")
    (tmp_path / "cp" / "commits" / "0").unlink()
    (tmp_path / "cp" / "commits" / ".0.crc").unlink(missing_ok=True)
    run("cp")
    assert scan(spark, out).count() == 2 and scan(spark, bad).count() == 2
    assert rows(scan(spark, counts), "rule", "action", "passed", "failed", "failed_pct") == want


def test_types_follow_all_rows_and_misfits_are_rescued(spark, tmp_path):
    lines = [f"{i},{i * 0.5},2024-01-{i % 28 + 1:02},2024-01-01 10:00:0{i % 10},{'true' if i % 2 else 'false'},x{i},{i % 2},{10 + i}d" for i in range(999)]
    lines.append("many,bad,never,,maybe,,7,")
    path = put(tmp_path, "x.csv", "n,d,day,at,ok,name,bit,code\n" + "\n".join(lines) + "\n")
    df = files.read_csv_inferred_rescued(spark, [path])
    kinds = dict(df.dtypes)
    assert [kinds[c] for c in ("n", "d", "day", "at", "ok", "name", "bit", "code")] == ["int", "double", "date", "timestamp", "boolean", "string", "int", "string"]
    assert df.count() == 1000 and df.where("n is null").count() == 1
    assert json.loads(df.where("_rescued_data is not null").first()["_rescued_data"]) == {"n": "many", "d": "bad", "day": "never", "ok": "maybe"}
    strict = dict(files.read_csv_inferred_rescued(spark, [path], tolerance=0.0).dtypes)
    assert (strict["n"], strict["bit"], strict["at"]) == ("string", "int", "timestamp")


def test_a_supervisor_restarts_what_fails(spark, table, tmp_path):
    from pyspark.errors import StreamingQueryException

    from ledgerloom.streaming.supervise import Supervisor

    src = table("src")
    tables.append(spark.createDataFrame([(1,)], "v int"), src)
    failures = iter([True, False])

    def each(batch, batch_id):
        if next(failures, False):
            raise RuntimeError("lost")

    good = lambda: ingest.start(scan_stream(spark, src), str(tmp_path / "good"), each, {"processingTime": "1 second"})
    bad = lambda: ingest.start(scan_stream(spark, src), str(tmp_path / "bad"), lambda b, i: 1 / 0, {"processingTime": "1 second"})
    watched = Supervisor({"good": good}).start()
    while watched.queries["good"].isActive:
        time.sleep(0.2)
    assert watched.check() == ["good"]
    watched.process_all()
    assert watched.queries["good"].isActive and watched.check() == []
    watched.stop()
    hopeless = Supervisor({"bad": bad}, restarts=1).start()
    with pytest.raises(StreamingQueryException):
        hopeless.watch(60, 0.2)
    hopeless.stop()

"""Archives and their index: round trips and plain sorting."""

from __future__ import annotations

import gzip
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import warc

SCHEMA = "page_id long, url string, html string, at timestamp, urlkey string, digest string, payload string, archive string"


@given(st.lists(st.lists(st.integers(0, 20)).map(sorted), max_size=9))
@settings(max_examples=300, deadline=None)
def test_loser_tree_merges(runs):
    places = list(warc.LoserTree(runs))
    assert [runs[r][i] for r, i in places] == sorted(x for run in runs for x in run)
    assert len(set(places)) == len(places)


@given(st.lists(st.binary(max_size=300), max_size=6), st.integers(1, 50))
@settings(max_examples=100, deadline=None)
def test_members_are_found_by_length(blocks, step):
    packed = [warc._member([("WARC-Type", "resource")], b) for b in blocks]
    for padding in (b"", b"\0"):
        got = list(warc.members(b"".join(packed) + padding, step))
        assert [length for _, length, _ in got] == [len(p) for p in packed]
        assert [r.partition(b"\r\n\r\n")[2][:-4] for _, _, r in got] == blocks


def test_damage_is_noticed():
    record = warc.page_record(1, "http://a.b/", b"x" * 200, hashlib.sha256(b"x" * 200).hexdigest(), 0, None)
    with pytest.raises(ValueError):
        list(warc.members(record[:-20]))
    wrong = warc.page_record(1, "http://a.b/", b"x" * 200, "0" * 64, 0, None)
    with pytest.raises(ValueError):
        warc.parse_capture(gzip.decompress(wrong))


@pytest.mark.parametrize(
    "url, key",
    [
        (None, ""),
        ("http://www.Example.com", "com,example)/"),
        ("https://a.b.example.com:443/x?b=2&a=1#f", "com,example,b,a)/x?a=1&b=2"),
        ("http://example.com:8080/é", "com,example:8080)/é"),
        ("http://[::1", "http://[::1"),
    ],
)
def test_url_keys(url, key):
    assert warc.url_key(url) == key


PAGES = [
    (1, "http://b.com/2", "x" * 200, "2024-01-02 00:00:00"),
    (2, "http://b.com/1", "x" * 200, "2024-01-01 00:00:00"),
    (3, "http://a.com/", "x" * 99, None),
    (4, "http://a.com/", "x" * 99, "2023-01-01 00:00:00.123456"),
    (5, None, None, None),
    (6, "", "", "1950-01-01 00:00:00"),
    (None, "http://a.com/ \r\nWARC-Type: evil", "x" * 200, None),
    (0, "http://b.com/2", "é" * 50, "2024-01-01 00:00:00"),
    (7, "http://b.com/2", "é" * 50, "2024-01-01 00:00:00"),
    (8, "http://c.com/", "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n\0\0 end" * 9, "2024-01-01 00:00:00"),
    (1, "http://b.com/2", "x" * 200, "2024-01-02 00:00:00"),
    (9, "http://d.com/", "long " * 300_000, "2024-01-01 00:00:00"),
    (None, "http://n.com/", "only nulls " * 20, None),
    (None, "http://n.com/", "only nulls " * 20, None),
]


@pytest.mark.parametrize("archive_bytes, range_rows, parts", [(1, 3, 3), (500, 5, 1), (1 << 25, 100_000, 4)])
def test_round_trip(spark, tmp_path, archive_bytes, range_rows, parts):
    df = spark.createDataFrame([(i, u, h, t) for i, u, h, t in PAGES], "page_id long, url string, html string, at string")
    df = df.withColumn("at", F.col("at").cast("timestamp")).withColumns({c: F.lit("k") for c in ("urlkey", "digest", "payload", "archive")})
    folder = str(tmp_path / "w")
    warc.write(df.repartition(parts), folder, captured=F.col("at"), archive_bytes=archive_bytes)
    got = sorted((r.asDict() for r in warc.history(warc.read(spark, folder), range_rows).collect()), key=lambda r: r["position"])
    assert [r["position"] for r in got] == list(range(len(PAGES)))
    order = [(r["urlkey"], r["captured"], r["page_id"] is not None, r["page_id"] or 0) for r in got]
    assert order == sorted(order)
    firsts = {}
    for i, _, h, _ in PAGES:
        if i is not None and len((h or "").encode()) >= 100:
            firsts[h] = min(i, firsts.get(h, i))
    want = []
    for i, u, h, _ in PAGES:
        raw, first = (h or "").encode(), firsts.get(h)
        again = first is not None and (i is None or i > first)
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    fields = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(([r[f] for f in fields] for r in got), key=str) == sorted(map(list, want), key=str)
    assert {r["captured"] for r in got if r["page_id"] == 4} == {1672531200123456}
    assert {r["uri"] for r in got if r["page_id"] is None} == {"http://a.com/%20%0D%0AWARC-Type:%20evil", "http://n.com/"}
    # Every capture can be read alone from its archive.
    for r in got:
        path = next(p for p in (tmp_path / "w").rglob(r["archive"]))
        record = gzip.decompress(path.read_bytes()[r["offset"] : r["offset"] + r["length"]])
        assert warc.parse_capture(record)[5] == r["payload_bytes"]


def test_one_url_with_most_captures(spark, tmp_path):
    rows = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("http://hot.com/").alias("url"), F.lit("same " * 40).alias("html"), F.timestamp_seconds(F.lit(9000) - F.col("id")).alias("at"))
    warc.write(rows.repartition(4), str(tmp_path / "w"), captured=F.col("at"))
    merged = warc.history(warc.read(spark, str(tmp_path / "w")), 400)
    got = [(r["page_id"], r["record_type"]) for r in merged.orderBy("position").collect()]
    assert got == [(i, "revisit" if i else "response") for i in range(2999, -1, -1)]


def test_empty(spark, tmp_path):
    warc.write(spark.createDataFrame([], SCHEMA), str(tmp_path / "w"))
    assert warc.history(warc.read(spark, str(tmp_path / "w"))).count() == 0

r"""WARC archives of pages, and their capture index by an external merge.

Writing: every page becomes one record, a gzip member of its own, so that an
archive can be read from any offset. Of records with equal payloads of at least
``MIN_REVISIT`` bytes the one with the smallest id is a response; the others
revisit it and hold the HTTP headers only. Records are packed into archives of
about ``ARCHIVE_BYTES`` by the task that has the rows; Spark's text writer commits
them (one archive to a file, a NUL at the end, which gzip allows as padding), so
a lost executor leaves no half archive and any store that Spark writes to will do.

Reading: each archive is parsed by lengths, never by searching for separators;
payloads are held against their digests. The captures of an archive are sorted
by URL key and time: a run. Runs are cut at common bounds (a range partitioning
over key, time, id and place, so a URL with any number of captures is cut as
well), and every range merges its pieces with a loser tree. Ranges in order,
and rows in a range in order, are the history of all captures. A range holds
about ``RANGE_ROWS`` rows of metadata, whatever the input.

NULL payloads are empty, NULL URLs have no target and the key '', control
characters and blanks of a URL are percent-encoded in the header, NULL times are
the epoch. Payloads of any length are written and read whole. Repeated rows are
captures of their own: all rows with a group's smallest id are responses. A NULL
id is larger than any other; of equal payloads without any id all are responses.
An empty table gives no archive and an empty index.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.columns import ref
from ledgerloom.llm.common import query, staged, table
from ledgerloom.session import shared_dir

#: Smaller payloads are never revisited.
MIN_REVISIT = 100
#: Compressed bytes after which an archive is closed; rows of metadata merged in one range.
ARCHIVE_BYTES, RANGE_ROWS = 32 << 20, 100_000
#: Time of the first page in the query; page n was captured n seconds later.
FIRST_CAPTURE = 1_700_000_000

VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
CAPTURE = (
    "urlkey string, captured long, page_id long, uri string, record_type string, payload_bytes long, "
    "payload_digest string, refers_to long, archive string, offset long, length long"
)
_FIELDS = [f.split()[0] for f in CAPTURE.split(", ")]
_ORDER = ["urlkey", "captured", "page_id", "archive", "offset"]


def url_key(url: str | None) -> str:
    """Sort key of a URL: host reversed, without scheme, ``www`` and default port, query sorted; '' for NULL."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url
    tail = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    query = "&".join(sorted(parts.query.split("&")))
    return f"{','.join(reversed(host.split('.')))}{tail}){parts.path or '/'}{'?' + query if query else ''}"


def _member(fields: Sequence[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member; fields without a value are left out."""
    head = "".join(f"{name}: {value}\r\n" for name, value in [*fields, ("Content-Length", len(block))] if value is not None)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, captured: int, refers_to: int | None) -> bytes:
    """A response, or a revisit of ``refers_to``, as a gzip member."""
    uri = None if url is None else "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url)
    name = hashlib.md5(f"{page_id}|{url}|{digest}|{captured}".encode()).hexdigest()
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(name)}>"),
        ("WARC-Date", (_EPOCH + timedelta(microseconds=captured)).strftime("%Y-%m-%dT%H:%M:%S.%fZ")),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Profile", None if refers_to is None else PROFILE),
        ("WARC-Refers-To", None if refers_to is None else f"<urn:page:{refers_to}>"),
        ("Page-Id", page_id),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _member(fields, http + payload if refers_to is None else http)


def warc_info() -> bytes:
    return _member([("WARC-Type", "warcinfo"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")


def members(data: bytes, step: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of every gzip member; NUL bytes may follow the last one."""
    at, view = 0, memoryview(data)
    while at < len(data) and data[at]:
        unpacker, parts, end = zlib.decompressobj(31), [], at
        while not unpacker.eof:
            if end >= len(data):
                raise ValueError(f"archive ends inside the record at {at}")
            parts.append(unpacker.decompress(view[end : end + step]))
            end = min(end + step, len(data))
        end -= len(unpacker.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


def _header(lines: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines.decode().split("\r\n")[1:])}


def parse_capture(record: bytes) -> tuple | None:
    """urlkey, captured, page_id, uri, record_type, payload_bytes, payload_digest, refers_to of a record; None for other kinds."""
    end = record.index(b"\r\n\r\n")
    fields = _header(record[:end])
    block = record[end + 4 : end + 4 + int(fields["content-length"])]
    if record[end + 4 + len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length and its content differ")
    if fields["warc-type"] not in ("response", "revisit"):
        return None
    cut = block.index(b"\r\n\r\n")
    size, payload = int(_header(block[:cut])["content-length"]), block[cut + 4 :]
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    if fields["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload and its digest differ")
    moment = datetime.strptime(fields["warc-date"], "%Y-%m-%dT%H:%M:%S.%fZ").replace(tzinfo=timezone.utc)
    page, first, uri = fields.get("page-id"), fields.get("warc-refers-to"), fields.get("warc-target-uri")
    return (
        url_key(uri),
        (moment - _EPOCH) // timedelta(microseconds=1),
        int(page) if page else None,
        uri,
        fields["warc-type"],
        size,
        digest,
        int(first.removeprefix("<urn:page:").rstrip(">")) if first else None,
    )


class LoserTree:
    """Merges ascending runs: every inner node keeps the loser of its match, so one path to the root finds the next row."""

    def __init__(self, runs: Sequence[Sequence]):
        self.runs, self.k = runs, len(runs)
        self.at = [0] * self.k
        self.losers = [0] * max(1, self.k)
        self.winner = self._play(1) if self.k > 1 else 0

    def _beats(self, a: int, b: int) -> bool:
        """Run ``a`` comes before ``b``; runs that have ended come last, equal heads in the order of runs."""
        if self.at[b] == len(self.runs[b]):
            return True
        if self.at[a] == len(self.runs[a]):
            return False
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return x < y or x == y and a < b

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lost
        return won

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, place in it) in merged order."""
        while self.k and self.at[self.winner] < len(self.runs[self.winner]):
            run = self.winner
            yield run, self.at[run]
            self.at[run] += 1
            node = (run + self.k) // 2
            while node:
                if self._beats(self.losers[node], run):
                    self.losers[node], run = run, self.losers[node]
                node //= 2
            self.winner = run


def write(
    df: DataFrame,
    folder: str,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    captured: Column | None = None,
    archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Write the rows as archives into ``folder``. Runs jobs: one over digests, one that writes."""
    body = F.coalesce(ref(payload), F.lit("")).cast("binary")
    when = F.lit(0).cast("long") if captured is None else F.coalesce(F.unix_micros(captured), F.lit(0))
    rows = df.select(
        ref(key).cast("long").alias("page_id"), ref(url).alias("url"), body.alias("payload"), F.sha2(body, 256).alias("digest"), when.alias("captured")
    )
    # Staged, so that the join below sees its size and AQE may split a payload with very many copies.
    firsts = staged(
        rows.where(F.octet_length("payload") >= MIN_REVISIT)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and first is not null")
        .select("digest", "first")
    )
    marked = rows.join(firsts, "digest", "left").withColumn(
        "refers_to", F.when(F.coalesce(F.col("page_id") > F.col("first"), F.lit(True)), F.col("first"))
    )
    names = ("page_id", "url", "payload", "digest", "captured", "refers_to")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for values in zip(*(batch.column(c) for c in names)):
                record = page_record(*(v.as_py() for v in values))
                held.append(record)
                size += len(record)
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join([warc_info(), *held])], pa.binary())], names=["archive"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join([warc_info(), *held])], pa.binary())], names=["archive"])

    archives = marked.select(*names).mapInArrow(pack, "archive binary").select(F.col("archive").cast("string"))
    archives.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The captures of all archives in ``folder``; those of an archive ascend by URL key and time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                name, found = path.as_py().rpartition("/")[2], []
                for offset, length, record in members(content.as_py()):
                    if (capture := parse_capture(record)) is not None:
                        found.append((*capture, name, offset, length))
                found.sort(key=lambda c: (c[0], c[1], c[2] is not None, c[2] or 0, c[9]))
                for at in range(0, len(found), 8192):
                    yield pa.RecordBatch.from_pylist([dict(zip(_FIELDS, c)) for c in found[at : at + 8192]], schema=_SCHEMA)

    return files.mapInArrow(run, CAPTURE)


_SCHEMA = pa.schema([(f, pa.string() if kind == "string" else pa.int64()) for f, kind in (c.split() for c in CAPTURE.split(", "))])


def _runs(rows: pa.Table) -> list[list[tuple]]:
    """Keys of the rows, as ascending runs, each ending with the row's place; a run is what one archive brought, in the order it came."""
    lists: dict[str, list[list[tuple]]] = {}
    for place, (u, c, p, a, o) in enumerate(zip(*(rows[f].to_pylist() for f in _ORDER))):
        key = (u, c, p is not None, p or 0, a, o, place)
        mine = lists.setdefault(a, [[]])
        if mine[-1] and key < mine[-1][-1]:
            mine.append([])
        mine[-1].append(key)
    return [run for mine in lists.values() for run in mine]


def history(captures: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures with their ``position`` (from 0) in the order of URL key, time, id (NULL first) and place. Runs jobs."""
    runs = staged(captures)
    n, spread = runs.count(), int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # At least as many ranges as keep the cluster busy; positions don't depend on them.
    ranges = max(1, -(-n // range_rows), min(spread, n // 1024))
    cut = runs.repartitionByRange(ranges, *_ORDER)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        pieces = _runs(rows)
        merged = rows.take(pa.array([pieces[run][at][-1] for run, at in LoserTree(pieces)], pa.int64()))
        merged = merged.append_column("part", pa.array([TaskContext.get().partitionId()] * len(rows), pa.int32()))
        yield from merged.append_column("place", pa.array(range(len(rows)), pa.int64())).to_batches(8192)

    merged = staged(cut.mapInArrow(merge, f"{CAPTURE}, part int, place long"))
    # One row per range in this window.
    before = F.sum("n").over(W.orderBy("part")) - F.col("n")
    starts = merged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", before.alias("start"))
    return merged.join(starts, "part").select(*_FIELDS, (F.col("start") + F.col("place")).alias("position"))


@query(
    """WITH d AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND coalesce(page_id > first, TRUE) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND coalesce(page_id > first, TRUE) THEN first END AS refers_to FROM f"""
)
def op13_warc_index(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written as archives, read back, and indexed in the order of their captures."""
    archives = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(table(spark, folder, "pages"), archives, captured=F.timestamp_seconds(F.lit(FIRST_CAPTURE) + F.col("page_id")))
    return history(read(spark, archives)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

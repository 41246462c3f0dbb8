"""Batch and incremental readers of landing files.

CSV files of one feed may have different headers. Spark drops columns that the
first header does not name, so files are grouped by header and each group is
read as text with its own column list. Listing and exactly-once bookkeeping is
Spark's: the incremental form streams *file names* and reads each file once.
"""

from __future__ import annotations

import csv
import re
from collections import defaultdict
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerloom.schemas import Feed
from ledgerloom.sources.rescue import RESCUED, infer_schema, json_fields, rescue_columns, rescue_map

MALFORMED = "_malformed"
FILE_COLUMNS = ("_source_file", "_ingest_timestamp")
BINARY = "path string, modificationTime timestamp, length long, content binary"


def _first_line(spark: SparkSession, path: str) -> str:
    """Header of one file: its first line that isn't blank, read through the Hadoop file system of its path."""
    jvm = spark._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    stream = location.getFileSystem(spark._jsc.hadoopConfiguration()).open(location)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
    try:
        line = reader.readLine()
        while line is not None and not line.strip(" \t\ufeff"):
            line = reader.readLine()
        return (line or "").lstrip("﻿")
    finally:
        reader.close()


def _literal(path: str) -> str:
    """The path with its glob characters escaped."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def _stamped(df: DataFrame) -> DataFrame:
    return df.withColumns({"_source_file": F.col("_metadata.file_path"), "_ingest_timestamp": F.current_timestamp()})


def _spelled(header: tuple[str, ...], schema: StructType) -> tuple[str, ...]:
    """Header names in the schema's spelling where they differ in letter case only; a name that is there before gets its position."""
    known = {n.lower(): n for n in schema.fieldNames()}
    names = [known[h.lower()] if h.lower() in known and known[h.lower()] not in header else h for h in header]
    out: list[str] = []
    for i, name in enumerate(names):
        # The schema's own spelling keeps the name, else the first one.
        twins = [j for j, n in enumerate(names) if n.lower() == name.lower()]
        keeper = next((j for j in twins if names[j] == known.get(name.lower())), twins[0])
        out.append(name if i == keeper else f"{name}_{i + 1}")
    return tuple(out)


def read_csv_files(spark: SparkSession, paths: Iterable[str], schema: StructType, multi_line: bool = False) -> DataFrame:
    """Rescued read of the named CSV files (one header look-up per file).

    ``multi_line`` allows line breaks inside quotes; such files are not split.
    """
    listed = list(paths)
    with ThreadPoolExecutor(16) as pool:
        headers = list(pool.map(lambda path: _first_line(spark, path), listed))
    groups: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for path, header in zip(listed, headers):
        groups[tuple(next(csv.reader([header]), []))].append(path)
    out = None
    for header, members in groups.items():
        if not header:  # a file of blank lines only
            continue
        header = _spelled(header, schema)
        # A line with more or fewer fields than the header is kept whole and so reaches the rescued data.
        text = StructType([StructField(name, StringType()) for name in (*header, MALFORMED)])
        reader = spark.read.schema(text).option("header", True).option("multiLine", multi_line)
        raw = _stamped(reader.option("columnNameOfCorruptRecord", MALFORMED).csv([_literal(p) for p in members]))
        typed = rescue_columns(raw, schema, keep=FILE_COLUMNS)
        out = typed if out is None else out.unionByName(typed)
    return out if out is not None else empty(spark, schema)


def empty(spark: SparkSession, schema: StructType) -> DataFrame:
    tail = StructType.fromDDL(f"{RESCUED} string, _source_file string, _ingest_timestamp timestamp")
    return spark.createDataFrame([], StructType(schema.fields + tail.fields))


def read_json_text(lines: DataFrame, schema: StructType, multi_line: bool = False) -> DataFrame:
    """Rescued rows from text lines (or whole documents holding one object or an array)."""
    stamped = lines if set(FILE_COLUMNS) <= set(lines.columns) else _stamped(lines)
    if multi_line:
        body = F.trim(F.col("value"))
        listed = F.when(body.startswith("["), body).otherwise(F.concat(F.lit("["), body, F.lit("]")))
        objects = F.from_json(listed, "array<map<string,string>>")
        whole = F.array(F.create_map(F.lit("_malformed"), F.col("value")))
        fields = stamped.select(F.explode(F.coalesce(objects, whole)).alias("_fields"), *FILE_COLUMNS)
    else:
        rows = stamped.where(F.length(F.trim(F.col("value"))) > 0)
        fields = rows.select(json_fields(F.col("value")).alias("_fields"), *FILE_COLUMNS)
    return rescue_map(fields, "_fields", schema, keep=FILE_COLUMNS)


def read_feed(spark: SparkSession, feed: Feed, paths: list[str]) -> DataFrame:
    """All rows of the named files."""
    if feed.fmt == "csv":
        return read_csv_files(spark, paths, feed.schema, feed.multi_line)
    lines = spark.read.text([_literal(p) for p in paths], wholetext=feed.multi_line)
    return read_json_text(lines, feed.schema, feed.multi_line)


def stream_json_lines(spark: SparkSession, feed: Feed, folder: str, max_files: int | None = None) -> DataFrame:
    """Streaming text of a JSON feed with its file columns, throttled by files per micro-batch."""
    reader = spark.readStream.option("maxFilesPerTrigger", max_files or feed.max_files)
    return _stamped(reader.text(folder, wholetext=feed.multi_line))


def stream_json(spark: SparkSession, feed: Feed, folder: str) -> DataFrame:
    """Streaming rows of a JSON feed, throttled by files per micro-batch."""
    return read_json_text(stream_json_lines(spark, feed, folder), feed.schema, feed.multi_line)


def stream_file_names(spark: SparkSession, folder: str, glob: str, max_files: int) -> DataFrame:
    """Streaming list of new files; contents are pruned from the scan."""
    return (
        spark.readStream.format("binaryFile")
        .schema(BINARY)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", max_files)
        .load(folder)
        .select("path")
    )


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """One-shot look at a CSV file; tests and exploration only (reads it twice)."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def read_csv_inferred_rescued(spark: SparkSession, paths: Iterable[str], tolerance: float = 0.01, multi_line: bool = False) -> DataFrame:
    """Rescued read of CSV files whose types follow from all their rows (see ``infer_schema``).

    Columns are those of all headers, in the order they are met first. Runs a job
    that reads the files once; the result reads them again.
    """
    listed = list(paths)
    names: dict[str, str] = {}
    for path in listed:
        for name in next(csv.reader([_first_line(spark, path)]), []):
            names.setdefault(name.lower(), name)
    text = StructType([StructField(n, StringType()) for n in names.values()])
    schema = infer_schema(read_csv_files(spark, listed, text, multi_line), text.fieldNames(), tolerance)
    return read_csv_files(spark, listed, schema, multi_line)


def read_documents(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, modificationTime, length, content of matching files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)


def rate(spark: SparkSession, rows_per_second: int = 2) -> DataFrame:
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


def expand_json(df: DataFrame, column: str, ddl: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Fields of a JSON text column as columns, beside the kept ones; batch or stream."""
    return df.select(F.from_json(column, ddl).alias("_event"), *keep).select("_event.*", *keep)


def example_schema(spark: SparkSession, example: str) -> str:
    """DDL of an example document, to be checked in as the feed's schema."""
    return spark.range(1).select(F.schema_of_json(F.lit(example))).first()[0]

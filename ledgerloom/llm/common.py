"""Shared pieces: the query registry, staged tables and word patterns."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Words are runs of anything but ASCII white space; ``bytes.split()`` finds the same ones.
WORD = r"[^\x20\x09-\x0D]+"


def query(sql: str | None = None):
    """Register ``build(spark, folder)`` under its own name, with its SQL twin if there is one."""

    def register(build):
        QUERIES[build.__name__] = build
        if sql:
            ORACLES[build.__name__] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def staged(df: DataFrame) -> DataFrame:
    """Run ``df`` once into the shared folder and read it back.

    Later steps then neither repeat its work nor depend on executors that may
    be lost. Runs a job.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unit_hash(*parts: Column | str, digits: int = 15) -> Column:
    """A bigint of ``digits`` hexadecimal digits (at most 15) that SQL engines agree on: md5 of the parts joined by ``|``; NULL parts count as empty."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("bigint")


def release() -> None:
    """Give freed memory back: Python workers stay alive between stages, several to an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


def released(batches: Iterator) -> Iterator:
    """The same items; memory is given back before the next one is made and at the end."""
    for batch in batches:
        yield batch
        del batch
        release()

"""Query registry and table access."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ledgerloom.functions.columns import ref

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """``t.orders`` reads ``<folder>/orders.parquet``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self._folder, self._open = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._open:
            self._open[name] = self.spark.read.parquet(f"{self._folder}/{name}.parquet")
        return self._open[name]


def query(sql: str | None = None, name: str | None = None):
    """Register ``build(t: Tables) -> DataFrame`` and, if given, its SQL twin."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or build.__name__
        QUERIES[key] = lambda spark, folder: build(Tables(spark, folder))
        if sql:
            ORACLES[key] = sql
        return build

    return register


def flags_as_int(df: DataFrame) -> DataFrame:
    """Booleans as 0/1, so that results compare across engines."""
    flags = [f.name for f in df.schema.fields if isinstance(f.dataType, BooleanType)]
    return df.withColumns({c: ref(c).cast("int") for c in flags}) if flags else df


def utc_ntz(moment: Column) -> Column:
    """An instant as UTC wall-clock time, whatever the session's time zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), moment.cast("timestamp_ntz"))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(ref(c), digits) for c in columns})


def sql_round(expression: str, digits: int, scale: int = 10) -> str:
    """Half-up rounding of the printed decimal value, as Spark rounds."""
    return f"CAST(round(CAST({expression} AS DECIMAL(38,{scale})), {digits}) AS DOUBLE)"


def sql_sum(expression: str) -> str:
    """Plain compensated sum of doubles."""
    return f"fsum(CAST({expression} AS DOUBLE))"


def sql_mean(expression: str) -> str:
    return f"({sql_sum(expression)} / CAST(count({expression}) AS DOUBLE))"

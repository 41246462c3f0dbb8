"""Export of small results as one CSV or JSON file in a folder of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StringType

from ledgerloom.functions.columns import ref
from ledgerloom.functions.scalars import neutralize_formula

MAX_ROWS = 1_000_000
FORMATS = ("csv", "json")


def _guard(df: DataFrame, max_rows: int) -> None:
    """Counts at most one row past the limit."""
    if df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"export: more than {max_rows:,} rows; write a table instead")


def single_file(df: DataFrame, path: str, fmt: str = "csv", append: bool = False, max_rows: int = MAX_ROWS) -> None:
    """Write the rows as one file below ``path``.

    Exports are capped, so one task may write them; larger results are refused,
    never cut. Appending needs the same column set and respects the cap for old
    and new rows together.
    """
    if fmt not in FORMATS:
        raise ValueError(f"export: format {fmt!r} is not one of {FORMATS}")
    _guard(df, max_rows)
    if append:
        reader = df.sparkSession.read
        try:
            old = (reader.option("header", True).csv(path) if fmt == "csv" else reader.json(path))
            old_columns = old.columns
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            old_columns = None
        if old_columns is not None:
            if sorted(old_columns) != sorted(df.columns):
                raise ValueError(f"export: columns {sorted(df.columns)} differ from the file's {sorted(old_columns)}")
            if old.count() + df.count() > max_rows:
                raise ValueError(f"export: appending would pass {max_rows:,} rows; write a table instead")
            df = df.select(*[ref(c) for c in old_columns])
    if fmt == "csv":
        text = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
        df = df.withColumns({c: neutralize_formula(ref(c)) for c in text}) if text else df
    writer = df.repartition(1).write.mode("append" if append else "overwrite")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.option("ignoreNullFields", False).json(path)



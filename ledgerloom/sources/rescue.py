"""Typed columns from raw text, with everything that does not fit kept as JSON.

A value that cannot be cast becomes NULL and its raw text goes to
``_rescued_data``; so does every column the schema does not know. No row is lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from ledgerloom.functions.columns import ref

RESCUED = "_rescued_data"
RAW = "map<string,string>"


def _blank_as_null(text: Column) -> Column:
    return F.when(F.length(F.trim(text)) > 0, text)


def _cast(text: Column, schema_type: DataType) -> tuple[Column, Column]:
    """(typed value, whether the text did not fit)."""
    if isinstance(schema_type, StringType):
        return text, F.lit(False)
    value = text.try_cast(schema_type.simpleString())
    return value, text.isNotNull() & value.isNull()


#: Types from narrow to wide; a value that fits one fits all that list it.
LATTICE = ("boolean", "int", "bigint", "double", "date", "timestamp")


def infer_schema(df: DataFrame, columns: Sequence[str], tolerance: float = 0.0) -> StructType:
    """Types of text columns from all their rows, by one aggregation.

    Every type counts the values that fit it; counts of parts add up, so files and
    tasks may be merged in any order. A column gets the narrowest type that all
    but a share of ``tolerance`` of its values fit, else text; blanks fit all. A column
    of numbers is a ``double`` only if some value needs it. Runs a job.
    """
    counts = []
    for i, name in enumerate(columns):
        text = _blank_as_null(ref(name))
        counts.append(F.count(text).alias(f"_{i}"))
        # A moment is no date, and 10d is no number, though both can be cast.
        plain = {"date": ~text.rlike("[ T]"), "double": ~text.rlike("[dDfF]$")}
        counts += [F.count(F.when(plain.get(kind, F.lit(True)), text.try_cast(kind))).alias(f"_{i}_{kind}") for kind in LATTICE]
    row = df.agg(*counts).first()
    fields = []
    for i, name in enumerate(columns):
        n = row[f"_{i}"]
        fits = [k for k in LATTICE if n and n - row[f"_{i}_{k}"] <= tolerance * n]
        # 0 and 1 are numbers, not flags; of types that miss few values the one that misses fewest.
        if "boolean" in fits and "int" in fits:
            fits.remove("boolean")
        best = max(fits, key=lambda k: (row[f"_{i}_{k}"], -LATTICE.index(k)), default="string")
        fields.append(StructField(name, DataType.fromDDL(best)))
    return StructType(fields)


def rescue_columns(df: DataFrame, schema: StructType, keep: tuple[str, ...] = ()) -> DataFrame:
    """For all-text frames (CSV). Columns in ``keep`` pass through untouched."""
    typed, doubtful = [], []
    for field in schema.fields:
        text = ref(field.name) if field.name in df.columns else F.lit(None).cast("string")
        if not isinstance(field.dataType, StringType):
            text = _blank_as_null(text)
        value, bad = _cast(text, field.dataType)
        typed.append(value.alias(field.name))
        if field.name in df.columns and not isinstance(field.dataType, StringType):
            doubtful.append(F.when(bad, text).alias(field.name))
    for name in df.columns:
        if name not in keep and name not in schema.fieldNames():
            doubtful.append(ref(name).alias(name))
    rescued = F.lit(None).cast("string")
    if doubtful:
        # NULL fields are left out of the JSON text.
        rescued = F.when(F.coalesce(*doubtful).isNotNull(), F.to_json(F.struct(*doubtful)))
    return df.select(*typed, rescued.alias(RESCUED), *[ref(k) for k in keep])


def rescue_map(df: DataFrame, entries: str, schema: StructType, keep: tuple[str, ...] = ()) -> DataFrame:
    """For frames with one map of raw fields (JSON objects read as text)."""
    raw = ref(entries)
    typed, failed = [], []
    for field in schema.fields:
        value, bad = _cast(F.try_element_at(raw, F.lit(field.name)), field.dataType)
        typed.append(value.alias(field.name))
        if not isinstance(field.dataType, StringType):
            failed.append(F.when(bad, F.lit(field.name)))
    known = F.array(*[F.lit(n) for n in schema.fieldNames()])
    broken = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")
    # Most rows have neither unknown nor broken fields and skip the map work.
    odd = (F.size(broken) > 0) | (F.size(F.array_except(F.map_keys(raw), known)) > 0)
    left = F.map_filter(
        raw, lambda k, v: v.isNotNull() & (F.array_contains(broken, k) | ~F.array_contains(known, k))
    )
    rescued = F.when(odd, F.when(F.size(left) > 0, F.to_json(left)))
    return df.select(*typed, rescued.alias(RESCUED), *[ref(k) for k in keep])


def json_fields(text: Column) -> Column:
    """One JSON object -> map of field name to raw text; malformed text -> one entry."""
    parsed = F.from_json(text, RAW)
    return F.when(parsed.isNotNull() & (F.size(parsed) > 0), parsed).otherwise(
        F.create_map(F.lit("_malformed"), text)
    )

"""Column references and fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """Back-quote a name so that dots in it are not read as field access."""
    return "`" + name.replace("`", "``") + "`"


def ref(name: str) -> Column:
    return F.col(quoted(name))


def col_or(df: DataFrame, name: str, default: Column | object = None) -> Column:
    """The column when ``df`` has it, else the default (a literal or a Column)."""
    value = ref(name) if name in df.columns else (default if isinstance(default, Column) else F.lit(default))
    return value.alias(name)


def flag(condition: Column) -> Column:
    """True only where the condition holds; NULL counts as false."""
    return F.coalesce(condition, F.lit(False))

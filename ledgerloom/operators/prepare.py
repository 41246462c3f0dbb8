"""Column cleaning as a list of actions, applied in order.

Each action is ``{"type": ..., ...}``; ``"enabled": False`` skips it.
``columns_for`` of an action type answers with (target column, expression).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerloom.functions.columns import ref

Params = Mapping[str, object]
Builder = Callable[[DataFrame, Params], tuple[str, Column]]


def _need(params: Params, key: str) -> object:
    value = params.get(key)
    if value in (None, ""):
        raise ValueError(f"prepare {params.get('type')}: {key!r} is required")
    return value


def _choice(params: Params, key: str, allowed: Mapping[str, object], default: str | None = None):
    value = params.get(key, default)
    if value not in allowed:
        raise ValueError(f"prepare {params.get('type')}: {key} {value!r} is not one of {sorted(allowed)}")
    return allowed[value]


def _input(df: DataFrame, params: Params) -> tuple[str, Column]:
    name = str(_need(params, "column"))
    if name not in df.columns:
        raise ValueError(f"prepare {params.get('type')}: no column {name!r} in {df.columns}")
    return name, ref(name)


def _typed(df: DataFrame, name: str, value: object) -> Column:
    return F.lit(value).cast(df.schema[name].dataType)


def _replacement(df: DataFrame, name: str, p: Params) -> Column:
    """The parameter ``with``; without it an empty text, which other types can only show as NULL."""
    missing = "" if isinstance(df.schema[name].dataType, StringType) else None
    return _typed(df, name, p.get("with", missing))


def formula(df: DataFrame, p: Params) -> tuple[str, Column]:
    return str(_need(p, "target")), F.expr(str(_need(p, "expression")))


def cast(df: DataFrame, p: Params) -> tuple[str, Column]:
    name, value = _input(df, p)
    to = str(_need(p, "to"))
    return name, value.try_cast(to) if p.get("on_error", "null") == "null" else value.cast(to)


_MATCHERS: dict[str, Callable[[Column, Column], Column]] = {
    "exact": lambda text, needle: text == needle,
    "contains": lambda text, needle: text.contains(needle),
    "prefix": lambda text, needle: text.startswith(needle),
    "suffix": lambda text, needle: text.endswith(needle),
    "regex": lambda text, needle: F.regexp_like(text, needle),
}


def replace_value(df: DataFrame, p: Params) -> tuple[str, Column]:
    name, value = _input(df, p)
    matcher = _choice(p, "match_mode", _MATCHERS, "exact")
    needle, text = str(p.get("match", "")), value.cast("string")
    if not p.get("case_sensitive", False):
        if p.get("match_mode") == "regex":
            needle = "(?i)" + needle
        else:
            needle, text = needle.lower(), F.lower(text)
    return name, F.when(matcher(text, F.lit(needle)), _replacement(df, name, p)).otherwise(value)


def fill_null(df: DataFrame, p: Params) -> tuple[str, Column]:
    name, value = _input(df, p)
    return name, F.coalesce(value, _replacement(df, name, p))


def text_case(df: DataFrame, p: Params) -> tuple[str, Column]:
    name, value = _input(df, p)
    return name, _choice(p, "case", {"lower": F.lower, "upper": F.upper, "title": F.initcap})(value)


def trim(df: DataFrame, p: Params) -> tuple[str, Column]:
    name, value = _input(df, p)
    return name, _choice(p, "side", {"both": F.trim, "left": F.ltrim, "right": F.rtrim}, "both")(value)


def regex_replace(df: DataFrame, p: Params) -> tuple[str, Column]:
    name, value = _input(df, p)
    return name, F.regexp_replace(value, str(p.get("pattern", "")), str(p.get("replacement", "")))


def extract(df: DataFrame, p: Params) -> tuple[str, Column]:
    name, value = _input(df, p)
    try:
        group = int(p.get("group", 0))  # type: ignore[arg-type]
    except (TypeError, ValueError):
        raise ValueError(f"prepare extract: group {p.get('group')!r} is not a whole number") from None
    return str(p.get("target") or name), F.regexp_extract(value, str(p.get("pattern", "")), group)


def parse_date(df: DataFrame, p: Params) -> tuple[str, Column]:
    name, value = _input(df, p)
    lenient = p.get("on_error", "null") == "null"
    kind = _choice(p, "kind", {"date": "date", "timestamp": "timestamp"}, "date")
    pattern = p.get("format")
    if pattern:
        by_kind = {
            ("date", True): lambda: F.try_to_date(value, str(pattern)),
            ("date", False): lambda: F.to_date(value, str(pattern)),
            ("timestamp", True): lambda: F.try_to_timestamp(value, F.lit(pattern)),
            ("timestamp", False): lambda: F.to_timestamp(value, str(pattern)),
        }
        return name, by_kind[kind, lenient]()
    return name, value.try_cast(kind) if lenient else value.cast(kind)


ACTION_TYPES: dict[str, Builder] = {
    f.__name__: f
    for f in (formula, cast, replace_value, fill_null, text_case, trim, regex_replace, extract, parse_date)
}


def prepare(df: DataFrame, actions: Sequence[Params]) -> DataFrame:
    for position, action in enumerate(actions):
        if not isinstance(action, Mapping):
            raise ValueError(f"prepare: action {position} must be a mapping")
        if action.get("enabled", True) is False:
            continue
        builder = ACTION_TYPES.get(str(action.get("type", "")))
        if builder is None:
            raise ValueError(f"prepare: action {position} has unknown type {action.get('type')!r}; use {sorted(ACTION_TYPES)}")
        target, value = builder(df, action)
        df = df.withColumn(target, value)
    return df


def project(df: DataFrame, expressions: Sequence[str], keep_all: bool = True) -> DataFrame:
    """SQL expressions in front of (or instead of) the existing columns."""
    if not expressions:
        return df
    return df.selectExpr(*expressions, *(["*"] if keep_all else []))



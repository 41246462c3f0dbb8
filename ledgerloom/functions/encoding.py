"""Categorical encoding and probability vectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordinal(value: Column, codes: Mapping[str, int], default: int = 0) -> Column:
    """Code of a category, letter case ignored; one map look-up per row."""
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in (pair[0].lower(), pair[1])])
    return F.coalesce(F.try_element_at(table, F.lower(value)), F.lit(default))


def label_of(index: Column, labels: Sequence[str]) -> Column:
    """Decode a class index; text that is already a label passes through, a number that is no index gives NULL."""
    names = F.array(*[F.lit(x) for x in labels])
    text = index.cast("string")
    number = text.try_cast("double")
    inside = (number >= 0) & (number < len(labels))  # also keeps NaN and infinity from the cast
    return F.when(number.isNull(), text).when(inside, F.get(names, F.when(inside, number).cast("int")))


def one_hot(index: Column, size: int) -> Column:
    """Probability vector for a bare class index; out of range falls to class 0."""
    valid = F.when((index >= 0) & (index < size), index.cast("int")).otherwise(F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == valid, 1.0).otherwise(0.0))


def uniform(size: int) -> Column:
    return F.array_repeat(F.lit(1.0 / size), size)


def ranked(probabilities: Column, labels: Sequence[str]) -> Column:
    """Array of ``(p, label)`` by falling probability; ties keep class order."""
    names = F.array(*[F.lit(x) for x in labels])
    pairs = F.zip_with(
        F.zip_with(probabilities, F.sequence(F.lit(0), F.lit(len(labels) - 1)), lambda p, i: F.struct(p.alias("p"), (-i).alias("o"))),
        names,
        lambda po, n: F.struct(po["p"].alias("p"), po["o"].alias("o"), n.alias("label")),
    )
    return F.sort_array(pairs, asc=False)


def top_two(probabilities: Column, labels: Sequence[str]) -> list[Column]:
    """recommendation_1, confidence_1, recommendation_2, confidence_2 (per cent, 1 decimal)."""
    order = ranked(probabilities, labels)
    out: list[Column] = []
    for rank in (1, 2):
        best = F.get(order, rank - 1)
        out.append(best["label"].alias(f"recommendation_{rank}"))
        out.append(F.round(best["p"] * F.lit(100), 1).alias(f"confidence_{rank}"))
    return out

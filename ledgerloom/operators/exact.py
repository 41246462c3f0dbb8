"""Exact sums of doubles, whatever their size and order.

A double is a whole number times a power of two. Values are binned by their
exponent (``BITS`` binary places to a bin) and cut into signed digits of
``BITS`` bits at fixed places, so a digit is the same whichever bin its value
lies in. Digits are added as longs, per bin in one partial/final aggregation over
the rows and per place afterwards; a place overflows only beyond 2**41 rows.
Carries are settled once per result, which is then rounded to the nearest
double: the exact sum, whatever the order of the rows, their partitioning or a
retried task. NaN and the infinities have bins of their own that count them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a digit, and exponents in a bin; digits a value of a bin can touch.
BITS, DIGITS = 22, 4
_BASE = 1 << BITS
#: Bins of values that have no digits; their first digit counts them.
INFINITY, MINUS_INFINITY, NOT_A_NUMBER = 1000, 2000, 3000
#: A value of bin b is a whole number of 2**(BITS * b - _BELOW), even if the logarithm is one off.
_BELOW = 54


def with_digits(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add, for each named double (names are plain words), its bin ``<name>b`` and digits ``<name>d0`` (the place of the bin) and up.

    The steps are columns of their own, so that none is worked out twice.
    """
    step = 1 << 2 * BITS
    special = f"WHEN isnan({{n}}) THEN {NOT_A_NUMBER} WHEN {{n}} = double('Infinity') THEN {INFINITY} WHEN {{n}} = double('-Infinity') THEN {MINUS_INFINITY}"
    digit = "CASE WHEN {n}b IS NULL THEN NULL WHEN {n}b >= %d THEN %dL ELSE IF({n} < 0, -1L, 1L) * (%s) END"
    parts = [f"{{n}}l & {_BASE - 1}L", f"shiftright({{n}}l, {BITS})", f"{{n}}h & {_BASE - 1}L", f"shiftright({{n}}h, {BITS})"]
    steps = [
        # Zero has no logarithm.
        {"b": f"CASE WHEN {{n}} IS NULL THEN NULL {special} ELSE coalesce(CAST(floor(log2(abs({{n}})) / {BITS}) AS INT), 0) END"},
        {"w": f"IF({{n}}b < {INFINITY}, {_power('abs({n})', f'{_BELOW} - {{n}}b * {BITS}')}, NULL)"},
        {"h": f"floor({{n}}w / {step}D)"},
        {"l": f"CAST({{n}}w - {{n}}h * {step}D AS BIGINT)"},
        {f"d{j}": digit % (INFINITY, not j, part) for j, part in enumerate(parts)},
    ]
    for columns in steps:
        df = df.withColumns({n + c: F.expr(text.replace("{n}", n)) for n in names for c, text in columns.items()})
    return df.drop(*[n + c for n in names for c in "whl"])


def _power(value: str, exponent: str) -> str:
    """SQL of value * 2**exponent, in two steps so that the power stays a double."""
    half = f"floor(({exponent}) / 2)"
    return f"({value}) * pow(2.0D, {half}) * pow(2.0D, ({exponent}) - {half})"


def _settled(line: str) -> str:
    """SQL of one pass of carries over digits, lowest first.

    ``high`` and ``low`` are the last four digits, two each, ``more`` tells of
    anything below, ``carry`` is what stands above.
    """
    mask = _BASE - 1
    start = "named_struct('carry', 0L, 'high', 0L, 'low', 0L, 'more', false)"
    step = (
        f"named_struct('carry', shiftright(a.carry + x, {BITS}), 'high', shiftright(a.high, {BITS}) + shiftleft((a.carry + x) & {mask}L, {BITS}), "
        f"'low', shiftright(a.low, {BITS}) + shiftleft(a.high & {mask}L, {BITS}), 'more', a.more OR (a.low & {mask}L) != 0L)"
    )
    return f"aggregate({line}, {start}, (a, x) -> {step})"


def _rounded(r: str, top: str) -> str:
    """SQL of the double nearest to a settled number whose last digit is at place ``top``.

    Both summands are exact, anything below them counts as half a unit: one addition rounds.
    """
    half = lambda rest: f"IF({r}.more OR {rest}, 0.5D, 0.0D)"
    two = lambda x, y, bits, rest: f"CAST({x} AS DOUBLE) * {float(1 << bits)!r}D + (CAST({y} AS DOUBLE) + {half(rest)})"
    none = two(f"{r}.high", f"{r}.low", 44, "false")
    wide = two(f"{r}.carry", f"{r}.high", 44, f"{r}.low != 0L")
    # A carry of few bits: 33 + 11 bits of the high pair and 40 of the low one.
    narrow = two(f"(shiftleft({r}.carry, 33) + shiftright({r}.high, 11))", f"(shiftleft({r}.high & 2047L, 40) + shiftright({r}.low, 4))", 51, f"({r}.low & 15L) != 0L")
    lowest = f"(({top} - 3) * {BITS} - {_BELOW})"
    return (
        f"CASE WHEN {r}.carry = 0L THEN {_power(none, lowest)} WHEN {r}.carry >= {1 << 19}L THEN {_power(wide, f'{lowest} + 44')} "
        f"ELSE {_power(narrow, f'{lowest} + 4')} END"
    )


def _once(value: str, name: str, use: str) -> str:
    """SQL that works ``value`` out once and uses it under a name."""
    return f"transform(array({value}), {name} -> {use})[0]"


def _number(line: str, lowest: str, tag: str) -> str:
    """SQL of the double nearest to digits, lowest first, whose sum isn't negative."""
    r, d, t, n = (f"{x}{tag}" for x in "rdtn")
    usual = _rounded(r, f"({lowest} + size({line}) - 1)")
    # The leading digits cancelled out: settle what is left without them.
    carried = f"named_struct('c', shiftright(a.c + x, {BITS}), 'out', concat(a.out, array((a.c + x) & {_BASE - 1}L)))"
    digits = f"aggregate({line}, named_struct('c', 0L, 'out', cast(array() AS array<bigint>)), (a, x) -> {carried}).out"
    used = f"array_max(transform({d}, (x, i) -> IF(x != 0L, i + 1, 0)))"
    again = _once(_settled(f"slice({d}, 1, {n})"), t, _rounded(t, f"({lowest} + {n} - 1)"))
    left = _once(digits, d, _once(used, n, f"IF({n} = 0, 0.0D, {again})"))
    return _once(_settled(line), r, f"IF({r}.carry != 0L OR {r}.high >= {_BASE}L, {usual}, {left})")


def nearest(places: str) -> Column:
    """The double nearest to the number in the named column: array of (place int, digit long), each place once; NULL if there are none."""
    has = lambda code: f"exists({places}, x -> x.place = {code} AND x.digit > 0L)"
    dense = "transform(s, x -> x.digit)"
    gaps = "transform(sequence(s[0].place, s[size(s) - 1].place), p -> coalesce(map_from_entries(s)[p], 0L))"
    line = f"IF(size(s) = s[size(s) - 1].place - s[0].place + 1, {dense}, {gaps})"
    # A negative number ends in a negative carry: its opposite is settled instead.
    opposite = _once("transform(l, x -> -x)", "m", _number("m", "s[0].place", "2"))
    signed = f"IF(aggregate(l, 0L, (a, x) -> shiftright(a + x, {BITS})) < 0L, -{opposite}, {_number('l', 's[0].place', '1')})"
    finite = f"array_sort(filter({places}, x -> x.place < {INFINITY}))"
    return F.expr(
        f"CASE WHEN {has(NOT_A_NUMBER)} OR ({has(INFINITY)} AND {has(MINUS_INFINITY)}) THEN double('NaN') "
        f"WHEN {has(INFINITY)} THEN double('Infinity') WHEN {has(MINUS_INFINITY)} THEN double('-Infinity') "
        f"WHEN size({places}) > 0 THEN {_once(finite, 's', _once(line, 'l', signed))} END"
    )

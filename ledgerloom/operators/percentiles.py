"""Exact percentiles without holding a group in one task.

Spark's ``percentile`` keeps every distinct value of a group in one aggregation
buffer. Here a group is an interval of values with exact row counts before and
in it. An interval with more than ``BOUND`` rows is cut at pivots: quantiles of
a KLL sketch of its rows, so they lie where the rows are, whatever the values.
Exact counts between the pivots tell where the wanted ranks fall, and only those
parts go on, each a point (a pivot itself, with all its ties) or an open interval
between two pivots. What is left is small or one value, and is ranked by value.
Small groups need no pivot at all.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.columns import ref
from ledgerloom.operators.sizes import settle

#: Rows of an interval that one task may rank; pivots of a larger one; size of its sketch.
BOUND, PIVOTS, SKETCH = 1_000_000, 64, 400

_RANKS = "array<struct<i:int,upper:boolean,rank:bigint,at:double>>"


def _inside(part: Column, value: Column) -> Column:
    """Open intervals leave out both ends, NULL ends are open without bound; a point has equal ends."""
    within = (part["lo"].isNull() | (value > part["lo"])) & (part["hi"].isNull() | (value < part["hi"]))
    return F.when(part["point"], value == part["lo"]).otherwise(within)


def _placed(rows: DataFrame, state: DataFrame, uncut: bool) -> DataFrame:
    """Rows that lie in a part of their group, with the number of the part as ``_k``."""
    if uncut:
        return rows.join(state.select("_g"), "_g").withColumn("_k", F.lit(0))
    numbered = F.transform("_parts", lambda p, i: F.when(_inside(p, F.col("_v")), i).otherwise(-1))
    return rows.join(state, "_g").select("_g", "_v", F.array_max(numbered).alias("_k")).where("_k >= 0")


def _with_part(df: DataFrame, state: DataFrame) -> DataFrame:
    """Aggregated rows with their part; narrow numbers, not parts, are what rows are grouped by."""
    return df.join(state, "_g").withColumn("_part", F.get("_parts", F.col("_k"))).drop("_parts")


def _part(lo: Column, hi: Column, point: Column, before: Column, n: Column, ranks: Column) -> Column:
    return F.struct(
        lo.cast("double").alias("lo"), hi.cast("double").alias("hi"), point.alias("point"), before.cast("long").alias("before"), n.alias("n"), ranks.alias("ranks")
    )


def _cut(rows: DataFrame, state: DataFrame, uncut: bool, bound: int, pivots: int) -> DataFrame:
    """State with every part of more than ``bound`` rows replaced by those between its pivots that hold a wanted rank."""
    large = lambda p: ~p["point"] & (p["n"] > bound)
    asked = state.select("_g", F.filter("_parts", large).alias("_parts")).where(F.size("_parts") > 0)
    inside = _placed(rows, asked, uncut)
    levels = ", ".join(f"{j / (pivots + 1)}D" for j in range(1, pivots + 1))
    marks = F.expr(f"kll_sketch_get_quantile_double(_sketch, array({levels}))")
    cuts = settle(
        inside.where(~F.isnan("_v"))
        .groupBy("_g", "_k")
        .agg(F.kll_sketch_agg_double("_v", F.lit(SKETCH)).alias("_sketch"))
        .select("_g", F.struct("_k", F.array_sort(F.array_distinct(marks)).alias("cuts")).alias("_c"))
        .groupBy("_g")
        .agg(F.collect_list("_c").alias("_cuts"))
    )
    # Slice 2 j lies before cut j, slice 2 j + 1 is cut j itself. A part of nothing but NaN has no cut.
    def own(df: DataFrame) -> DataFrame:
        mine = F.get(F.filter("_cuts", lambda c: c["_k"] == F.col("_k")), F.lit(0))["cuts"]
        return df.join(cuts, "_g", "left").withColumn("_own", F.coalesce(mine, F.array().cast("array<double>"))).drop("_cuts")

    below = F.size(F.filter("_own", lambda c: c < F.col("_v")))
    exact = F.exists("_own", lambda c: c == F.col("_v")).cast("int")
    upto = W.partitionBy("_g", "_k").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    counts = own(inside).withColumn("_slice", 2 * below + exact).groupBy("_g", "_k", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    counted = own(_with_part(counts, asked)).withColumn(
        "_before", F.col("_part.before") + F.coalesce(F.sum("_n").over(upto), F.lit(0))
    )
    j, point = F.floor(F.col("_slice") / 2).cast("int"), F.col("_slice") % 2 == 1
    lo = F.when(point, F.get("_own", j)).otherwise(F.coalesce(F.get("_own", j - 1), F.col("_part.lo")))
    hi = F.when(point, F.get("_own", j)).otherwise(F.coalesce(F.get("_own", j), F.col("_part.hi")))
    held = F.filter("_part.ranks", lambda r: (r["rank"] >= F.col("_before")) & (r["rank"] < F.col("_before") + F.col("_n")))
    found = (
        counted.select("_g", _part(lo, hi, point, F.col("_before"), F.col("_n"), held).alias("_p"))
        .where(F.size("_p.ranks") > 0)
        .groupBy("_g")
        .agg(F.collect_list("_p").alias("_new"))
    )
    small = F.filter("_parts", lambda p: ~large(p))
    return state.join(found, "_g", "left").select("_g", F.concat(small, F.coalesce("_new", F.slice("_parts", 1, 0))).alias("_parts"))


def exact_percentiles(
    df: DataFrame, by: Sequence[str], value: str, wanted: Mapping[str, float], bound: int = BOUND, pivots: int = PIVOTS
) -> DataFrame:
    """One row per group: each name of ``wanted`` -> linearly interpolated percentile.

    Matches ``percentile(value, p)``: rank p*(n-1), NULL values left out, NaN above
    infinity. Runs jobs: one that counts the groups, and two for each round of
    pivots, which leaves a part about 1 / ``pivots`` of its rows; the rows of the
    last parts are read lazily.
    """
    # Struct keys compare NULL fields as equal, so a NULL group joins to itself.
    group = F.struct(*[ref(k) for k in by]) if by else F.struct(F.lit(1).alias("_all"))
    rows = df.where(ref(value).isNotNull()).select(group.alias("_g"), ref(value).cast("double").alias("_v"))
    last = F.col("_n") - F.lit(1)
    # The two ranks around each percentile.
    ranks = []
    for i, p in enumerate(wanted.values()):
        at = last * F.lit(float(p))
        for upper, rank in ((False, F.floor(at)), (True, F.ceil(at))):
            ranks.append(F.struct(F.lit(i).alias("i"), F.lit(upper).alias("upper"), rank.alias("rank"), at.alias("at")))
    nothing = F.lit(None)
    whole = _part(nothing, nothing, F.lit(False), F.lit(0), F.col("_n"), F.array(*ranks).cast(_RANKS))
    state = settle(rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).select("_g", F.array(whole).alias("_parts")))
    largest = F.max(F.array_max(F.transform("_parts", lambda p: F.when(p["point"], F.lit(0)).otherwise(p["n"]))))
    uncut, size = True, state.agg(largest).first()[0] or 0
    while size > bound:
        state = settle(_cut(rows, state, uncut, bound, pivots))
        uncut, before = False, size
        size = state.agg(largest).first()[0] or 0
        if size == before:  # nothing but NaN
            break
    running = W.partitionBy("_g", "_k").orderBy("_v")
    counts = _placed(rows, state, uncut).groupBy("_g", "_k", "_v").agg(F.count(F.lit(1)).alias("_n"))
    spans = _with_part(counts.withColumn("_upto", F.sum("_n").over(running)), state).withColumn("_to", F.col("_part.before") + F.col("_upto"))
    covered = lambda r: (r["rank"] >= F.col("_to") - F.col("_n")) & (r["rank"] < F.col("_to"))
    found = spans.select("_g", "_v", F.explode(F.filter("_part.ranks", covered)).alias("_r"))
    columns = []
    for i, name in enumerate(wanted):
        mine = F.col("_r.i") == i
        low = F.max(F.when(mine & ~F.col("_r.upper"), F.col("_v")))
        high = F.max(F.when(mine & F.col("_r.upper"), F.col("_v")))
        at = F.max(F.when(mine, F.col("_r.at")))
        exact = (low == high) | (low == F.lit(float("-inf")))
        columns.append(F.when(exact, low).otherwise(low + (high - low) * (at - F.floor(at))).alias(name))
    out = found.groupBy("_g").agg(*columns)
    return out.select(*[F.col("_g")[k].alias(k) for k in by], *wanted)

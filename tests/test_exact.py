"""Exact sums against math.fsum: any size, any order, any partitioning."""

from __future__ import annotations

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import measures, profile


def drawn(draw: random.Random, kind: int) -> float:
    if kind == 0:
        value = struct.unpack("d", struct.pack("Q", draw.getrandbits(64)))[0]
        return value if abs(value) < 1e300 else 1e300
    if kind == 1:
        return round(draw.uniform(-1000, 1000), 2)
    if kind == 2:
        return draw.choice([1e16, -1e16, 1.0, 1e-300, 5e-324, -5e-324, 2.0**22, 2.0**44, -(2.0**66), 0.0, -0.0, 0.1, -0.1])
    return draw.uniform(-1, 1) * 10.0 ** draw.randint(-20, 20)


@pytest.fixture(scope="module")
def values():
    draw = random.Random(9)
    return {g: [drawn(draw, g % 4) for _ in range(draw.randint(1, 30))] + [None] for g in range(160)}


def test_sums_are_the_nearest_doubles_in_any_order(spark, values):
    rows = [(g, v) for g, vs in values.items() for v in vs]
    for seed, parts in ((1, 1), (2, 9)):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "g int, v double").repartition(parts)
        got = measures.rollup(df, ["g"], [measures.total("s", F.col("v")), measures.mean("m", F.col("v")), measures.count("n")]).collect()
        assert len(got) == len(values)
        for r in got:
            whole = [v for v in values[r["g"]] if v is not None]
            assert r["s"] == math.fsum(whole) and r["n"] == len(whole) + 1
            assert r["m"] == math.fsum(whole) / len(whole)


@pytest.mark.parametrize(
    "values, total, mean",
    [
        ([math.inf, 1.0], math.inf, math.inf),
        ([-math.inf, 1.0], -math.inf, -math.inf),
        ([math.inf, -math.inf], math.nan, math.nan),
        ([math.nan, 1.0, math.inf], math.nan, math.nan),
        ([3e-9, 4e-9], 7e-9, 3.5e-9),
        ([1e308, 1e308, -1e308], 1e308, 1e308 / 3),
        ([1e308, 1e308], math.inf, math.inf),
        ([1e16, 1.0, -1e16], 1.0, 1 / 3),
        ([5e-324, 5e-324], 1e-323, 5e-324),
        ([None, None], 0.0, None),
        ([], 0.0, None),
    ],
)
def test_odd_values(spark, values, total, mean):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = measures.rollup(df, [], [measures.total("s", F.col("v")), measures.mean("m", F.col("v"))]).first()
    assert got["s"] == total or math.isnan(total) and math.isnan(got["s"])
    assert got["m"] == mean or math.isnan(mean) and math.isnan(got["m"])


def test_decimals_and_whole_numbers_keep_their_scale(spark):
    df = spark.createDataFrame([("a", 2**62), ("a", 2**62), (None, 1)], "g string, n long").withColumn("d", F.lit("0.00000000001").cast("decimal(38,11)"))
    total = lambda c: measures.total(c, F.col(c))
    got = {r["g"]: (r["n"], r["d"]) for r in measures.rollup(df, ["g"], [total("n"), total("d")]).collect()}
    assert got == {"a": (2.0**63, 2e-11), None: (1.0, 1e-11)}


def test_conditions_parts_and_several_sums(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("n"), (F.col("id") * 0.1 * F.pow(F.lit(10.0), F.col("id") % 7 - 3)).alias("v"))
    some = F.col("n") % 2 == 0
    asked = [measures.total("even", F.col("v"), some), measures.count("n", some), measures.total("v", F.col("v")), measures.any_true("big", F.col("v") > 900), measures.latest("last", F.col("v"), [F.col("n")])]
    rows = [(r["g"], r["n"], r["v"]) for r in df.collect()]
    for r in measures.rollup(df, ["g"], asked).collect():
        mine = [x for x in rows if x[0] == r["g"]]
        assert r["even"] == math.fsum(v for _, n, v in mine if n % 2 == 0) and r["v"] == math.fsum(v for _, _, v in mine)
        assert r["n"] == sum(n % 2 == 0 for _, n, _ in mine) and r["big"] == any(v > 900 for _, _, v in mine)
        assert r["last"] == max((n, v) for _, n, v in mine)[1]


def test_sums_through_a_bridge(spark):
    fact = spark.range(3000).select((F.col("id") % 70).alias("order"), (F.col("id") * 1.1e-5).alias("v"))
    bridge = spark.range(70).select(F.col("id").alias("key"), (F.col("id") % 4).alias("owner"))
    got = measures.rollup_through(fact, "order", bridge, "key", "owner", [measures.total("s", F.col("v")), measures.mean("m", F.col("v"))])
    rows = [(r["order"] % 4, r["v"]) for r in fact.collect()]
    for r in got.collect():
        mine = [v for o, v in rows if o == r["owner"]]
        assert r["s"] == math.fsum(mine) and r["m"] == math.fsum(mine) / len(mine)


def test_segment_means_keep_small_values(spark):
    df = spark.createDataFrame([("a", 0.0042), ("a", 0.0039), ("a", 0.0021)], "s string, v double")
    assert profile.segment_means(df, "s", {"m": "v"}).first()["m"] == math.fsum([0.0042, 0.0039, 0.0021]) / 3

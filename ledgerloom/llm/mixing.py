"""Mixing sources to target weights by capped water-filling.

Every source asks for its weight's share of the budget, but never for more than
``epochs`` times its own size; what a clamped source cannot take is reshared by
weight among the others. With sources in order of cap / weight, the level that
the others reach after the first i are clamped rises while clamping is due and
falls afterwards, so the final level is the maximum over i: one window over one
row per source, no iteration.

A document is repeated floor(target / size of source) times, and once more if it
lies before the cut in the seeded order of its source. The cut is found from the
sums of 4,096 hash slices per source; only the slice it falls into is ordered
row by row, so a source with a third of all rows never meets in one task.

NULL text counts zero words, NULL sources form a source of their own (last),
NULL ids hash like an empty one, sources without words get target 0, repeated
rows are drawn one by one, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.columns import ref
from ledgerloom.llm.common import WORD, query, staged, table, unit_hash

#: Hash slices per source: three hexadecimal digits.
SLICES = 4096
_DIGITS = 12  # of the hash that follow the slice


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, share: float, epochs: float) -> DataFrame:
    """Add ``target`` to one row per source with ``_key``, ``source_size`` and ``weight``.

    ``share`` is the budget as a part of all sizes. Holds one row per source in
    one task, a few dozen bytes each.
    """
    cap, weight = F.col("source_size") * F.lit(float(epochs)), F.col("weight")
    order = W.orderBy(cap / weight, "_key")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    rest = F.sum(weight).over(everything) - F.coalesce(F.sum(weight).over(before), F.lit(0.0))
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (budget - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / rest
    return (
        sources.withColumn("_level", level)
        .withColumn("target", F.least(cap, weight * F.max("_level").over(everything)))
        .drop("_level")
    )


def _marked(df: DataFrame, key: str, text: str, source: str, seed: str) -> DataFrame:
    """``df`` with what placing a row needs, in columns named ``_ll_``."""
    spot = unit_hash(ref(key), seed)
    return df.withColumns(
        {
            "_ll_size": word_count(ref(text)),
            "_ll_spot": spot,
            "_ll_slice": F.floor(spot / F.lit(16**_DIGITS).cast("long")).cast("int"),
            # one key that also covers NULL, which sorts after every name
            "_ll_key": F.when(ref(source).isNull(), "1").otherwise(F.concat(F.lit("0"), ref(source))),
        }
    )


def _plan(base: DataFrame, weights: Sequence[float], share: float, epochs: float) -> DataFrame:
    """One row per source: size, target, whole repetitions, words still to draw, the slice where drawing ends and the words before it."""
    slices = staged(base.groupBy("_ll_key", "_ll_slice").agg(F.sum("_ll_size").alias("_words")))
    named = (
        slices.groupBy("_ll_key")
        .agg(F.sum("_words").alias("source_size"))
        .withColumn("_rank", F.row_number().over(W.orderBy("_ll_key")))
    )
    dealt = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = (
        water_fill(named.withColumn("weight", dealt).withColumnRenamed("_ll_key", "_key"), share, epochs)
        .withColumn("_whole", F.floor(ratio))
        .withColumn("_part", F.col("target") - F.col("_whole") * F.col("source_size"))
        .select(F.col("_key").alias("_ll_key"), "source_size", "target", "_whole", "_part")
    )
    along = W.partitionBy("_ll_key").orderBy("_ll_slice")
    cut = (
        slices.join(plan.select("_ll_key", "_part"), "_ll_key")
        .withColumn("_end", F.sum("_words").over(along))
        .where(F.col("_end") > F.col("_part"))
        .groupBy("_ll_key")
        .agg(F.min(F.struct(F.col("_ll_slice").alias("_cut"), (F.col("_end") - F.col("_words")).alias("_before"))).alias("_at"))
        .select("_ll_key", "_at.*")
    )
    # Staged: its size on disk is known when rows meet it, so a small one is broadcast and a large one is not.
    return staged(plan.join(cut, "_ll_key", "left").withColumn("_cut", F.coalesce("_cut", F.lit(SLICES))))


def _drawn(marked: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """Each row with its source's plan (struct ``_ll_plan``) and ``_ll_copies``."""
    plans = plan.select(F.col("_ll_key").alias("_ll_name"), F.struct(*[c for c in plan.columns if c != "_ll_key"]).alias("_ll_plan"))
    placed = marked.join(plans, F.col("_ll_key") == F.col("_ll_name")).drop("_ll_name")
    cut, size = F.col("_ll_plan._cut"), F.col("_ll_size")
    upto = W.partitionBy("_ll_key").orderBy("_ll_spot", ref(key), "_ll_size").rowsBetween(W.unboundedPreceding, 0)
    middle = 2 * (F.col("_ll_plan._before") + F.sum(size).over(upto)) - size
    split = placed.where(F.col("_ll_slice") == cut).withColumn("_ll_extra", (middle <= 2 * F.col("_ll_plan._part")).cast("long"))
    others = placed.where(F.col("_ll_slice") != cut).withColumn("_ll_extra", (F.col("_ll_slice") < cut).cast("long"))
    copies = F.when(F.col("_ll_plan.source_size") > 0, F.col("_ll_plan._whole") + F.col("_ll_extra")).otherwise(F.lit(0))
    return others.unionByName(split).withColumn("_ll_copies", copies.cast("long"))


def mix(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (1.0,),
    share: float = 1.0,
    epochs: float = 1.0,
    seed: str = "mix",
) -> DataFrame:
    """One row per row of ``df``: doc_id, source, size, source_size, target, copies, taken.

    ``weights`` are dealt to the sources in code-point order, repeating. Runs
    jobs: sizes are counted once into a staged table of narrow rows.
    """
    marked = _marked(df.select(ref(key).alias("doc_id"), ref(source).alias("source"), ref(text).alias("text")), "doc_id", "text", "source", seed)
    base = staged(marked.drop("text"))
    out = _drawn(base, _plan(base, weights, share, epochs), "doc_id")
    return out.select(
        "doc_id",
        "source",
        F.col("_ll_size").alias("size"),
        "_ll_plan.source_size",
        "_ll_plan.target",
        F.col("_ll_copies").alias("copies"),
        (F.col("_ll_copies") * F.col("_ll_size")).alias("taken"),
    )


def repeat(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (1.0,),
    share: float = 1.0,
    epochs: float = 1.0,
    seed: str = "mix",
) -> DataFrame:
    """The rows of ``df``, each as often as ``mix`` takes it. Runs jobs."""
    marked = _marked(df, key, text, source, seed)
    base = staged(marked.select("_ll_key", "_ll_slice", "_ll_size"))
    out = _drawn(marked, _plan(base, weights, share, epochs), key)
    times = F.explode(F.array_repeat(F.lit(0), F.col("_ll_copies").cast("int")))
    return out.where("_ll_copies > 0").select(*[ref(c) for c in df.columns], times.alias("_ll_time")).drop("_ll_time")


@query(
    f"""WITH b AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|mix'), 1, 15) AS BIGINT) AS spot FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM b GROUP BY source),
w AS (SELECT source, source_size, CAST([5, 2, 1][(k - 1) % 3 + 1] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap, k FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER u, 0) AS used, sum(weight) OVER () - coalesce(sum(weight) OVER u, 0) AS rest,
  1.5::DOUBLE * sum(source_size) OVER () AS budget FROM w
  WINDOW u AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max((budget - used) / rest) AS level FROM o),
t AS (SELECT source, source_size, least(cap, weight * level) AS target FROM w, l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
d AS (SELECT b.doc_id, b.size, r.source_size, r.target, r.whole, r.target - r.whole * r.source_size AS part,
  2 * sum(b.size) OVER (PARTITION BY b.source ORDER BY spot, doc_id, b.size ROWS UNBOUNDED PRECEDING) - b.size AS middle
  FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN middle <= 2 * part THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM d"""
)
def op9_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Weights 5, 2, 1 over 150 % of all words, at most two epochs of a source."""
    mixed = mix(table(spark, folder, "documents"), weights=(5, 2, 1), share=1.5, epochs=2)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")

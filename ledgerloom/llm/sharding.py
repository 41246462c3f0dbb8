"""Sharding by best-fit decreasing: indivisible groups into bins of one capacity.

Groups in order of falling size enter the bin with the tightest capacity left
that still holds them, found in a balanced search tree of remaining capacities;
a group that fits nowhere opens a bin.

What is packed one by one must not grow with the data. Groups above 1/``GRAIN``
of a region's share of all bytes are items of their own (at most ``GRAIN`` of them); all others
are pooled by hash into ``PACKETS`` packets of whole groups. A region therefore
has at most ``GRAIN + PACKETS`` items, whatever it holds. ``pack_even`` has one
region and a given number of bins; ``pack_capacity`` deals groups to as many
regions as the total needs, each packed in its own task.

NULL and empty texts are one group of size ``extra`` per row; repeated rows stay
together; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.columns import ref
from ledgerloom.llm.common import query, staged, table

#: A group of at least 1/GRAIN of a region is packed on its own.
GRAIN = 4096
#: Packets that the smaller groups of a region are pooled into.
PACKETS = 8192
#: Bins of the fixed capacity that one region should fill.
REGION_BINS = 64
#: Rows of a shard numbered in one task.
SLOT_ROWS = 100_000


class CapacityTree:
    """A treap of (remaining, bin) with the tightest fit in logarithmic time."""

    def __init__(self):
        self._root, self._seed = None, 1

    def _split(self, node, key):
        """Nodes below ``key`` and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            left, right = self._split(node[3], key)
            return (node[0], node[1], node[2], left), right
        left, right = self._split(node[2], key)
        return left, (node[0], node[1], right, node[3])

    def _merge(self, left, right):
        if left is None or right is None:
            return left or right
        if left[1] > right[1]:
            return left[0], left[1], left[2], self._merge(left[3], right)
        return right[0], right[1], self._merge(left, right[2]), right[3]

    def add(self, remaining: int, bin_: int) -> None:
        self._seed = self._seed * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
        left, right = self._split(self._root, (remaining, bin_))
        self._root = self._merge(self._merge(left, ((remaining, bin_), self._seed >> 11, None, None)), right)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the smallest remaining capacity that holds ``size``; ties to the lower bin."""
        left, right = self._split(self._root, (size, -1))
        if right is None:
            return None
        node = right
        while node[2] is not None:
            node = node[2]
        _, rest = self._split(right, (node[0][0], node[0][1] + 1))
        self._root = self._merge(left, rest)
        return node[0]


def best_fit(sizes: Iterable[int], capacity: int) -> list[int]:
    """Bins of items that come in falling order of size; a larger item than the capacity fills a bin of its own."""
    tree, bins, used = CapacityTree(), [], 0
    for size in sizes:
        found = tree.take(size)
        remaining, bin_ = found if found else (capacity, used)
        used += found is None
        bins.append(bin_)
        if remaining > size:
            tree.add(remaining - size, bin_)
    return bins


def even_bins(sizes: list[int], shards: int) -> list[int]:
    """Bins 0 to shards - 1 for falling sizes, at the smallest capacity that best fit needs no more bins for.

    Items above a fair share of what is left get bins of their own first, so
    that one giant doesn't set the capacity of all others.
    """
    left, alone = sum(sizes), 0
    while alone < min(len(sizes), shards - 1) and sizes[alone] * (shards - alone) >= left:
        left -= sizes[alone]
        alone += 1
    rest, free = sizes[alone:], shards - alone
    if not rest:
        return list(range(alone))
    low, high = max(-(-left // free), rest[0]), left
    while low < high:
        middle = (low + high) // 2
        if max(best_fit(rest, middle)) < free:
            high = middle
        else:
            low = middle + 1
    return [*range(alone), *(alone + b for b in best_fit(rest, high))]


def _rows(df: DataFrame, key: str, text: str, extra: int) -> DataFrame:
    """Narrow rows: key, size, checksum, group."""
    whole = F.coalesce(ref(text), F.lit(""))
    return staged(
        df.select(
            ref(key).alias("doc_id"),
            (F.octet_length(whole) + F.lit(extra)).cast("long").alias("size"),
            F.crc32(whole.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(whole.cast("binary"), 256)).alias("_group"),
        )
    )


def _total(rows: DataFrame) -> int:
    return rows.agg(F.sum("size")).first()[0] or 0


def _items(rows: DataFrame, total: int, regions: int = 1) -> DataFrame:
    """One row per group with its region and item: its own hash, or a packet number."""
    region = F.pmod(F.xxhash64("_group"), F.lit(regions))
    groups = rows.groupBy("_group").agg(F.sum("size").alias("_bytes")).withColumn("_region", region)
    packet = F.concat(F.lit("p"), F.pmod(F.xxhash64("_group", F.lit(1)), F.lit(PACKETS)).cast("string"))
    big = F.col("_bytes") * F.lit(GRAIN * regions) >= F.lit(total)
    return groups.select("_group", "_bytes", "_region", F.when(big, F.hex("_group")).otherwise(packet).alias("_item"))


def with_slots(rows: DataFrame, shard: str = "shard", order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add ``slot``: gapless numbers from 0 within each shard, in hash slices of bounded size."""
    # The number of slices follows from the rows alone: the same input gets the same slots on any cluster.
    slices = max(1, -(-rows.count() // SLOT_ROWS))
    rows = rows.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int"))
    counts = rows.groupBy(shard, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(shard).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select(shard, "_slice", F.coalesce(before, F.lit(0)).alias("_start"))
    number = F.row_number().over(W.partitionBy(shard, "_slice").orderBy(*order))
    return (
        rows.withColumn("_number", number)
        .join(starts, [shard, "_slice"])
        .withColumn("slot", (F.col("_start") + F.col("_number") - 1).cast("long"))
        .drop("_number", "_start", "_slice")
    )


def pack_even(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", extra: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: equal texts together, shard sizes near equal.

    Runs jobs: rows are staged once; at most GRAIN + PACKETS item sizes come to the driver.
    """
    rows = _rows(df, key, text, extra)
    items = staged(_items(rows, _total(rows)))
    sizes = items.groupBy("_item").agg(F.sum("_bytes").alias("_bytes")).orderBy(F.desc("_bytes"), "_item").toPandas()
    sizes["shard"] = even_bins([int(b) for b in sizes["_bytes"]], shards)
    # at most GRAIN + PACKETS rows, however large the input
    homes = F.broadcast(rows.sparkSession.createDataFrame(sizes[["_item", "shard"]], "_item string, shard int"))
    return with_slots(staged(rows.join(items.join(homes, "_item").select("_group", "shard"), "_group").drop("_group")))


def pack_capacity(df: DataFrame, capacity: int, key: str = "doc_id", text: str = "text", extra: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard (region.bin): as few bins of ``capacity`` as best fit finds in each region."""
    rows = _rows(df, key, text, extra)
    total = _total(rows)
    regions = max(1, -(-total // (capacity * REGION_BINS)))
    # A packet does not outgrow a bin: it holds about 1 / PACKETS of REGION_BINS capacities.
    items = staged(_items(rows, total, regions))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_bytes", "_item"], ascending=[False, True])
        return part.assign(shard=[f"{r}.{b}" for r, b in zip(part["_region"], best_fit(part["_bytes"], capacity))])[["_region", "_item", "shard"]]

    sizes = items.groupBy("_region", "_item").agg(F.sum("_bytes").alias("_bytes"))
    homes = sizes.groupBy("_region").applyInPandas(pack, "_region long, _item string, shard string")
    placed = items.join(homes, ["_region", "_item"]).select("_group", "shard")
    return rows.join(placed, "_group").drop("_group")


@query()
def op1_shard_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in shards 0 to 23 of near equal bytes."""
    return pack_even(table(spark, folder, "documents"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )

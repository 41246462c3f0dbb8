r"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is embedded as the bit counts of its 32 two-bit segments. The
Manhattan distance of two embeddings never exceeds the Hamming distance of the
fingerprints. The segments form six blocks; fingerprints within three bits
agree in the counts of at least three blocks, so the grid has one cell per
choice of three blocks and their counts, and every such pair shares a cell.
Inside a cell the total bit count orders the members, and only members whose
totals differ by at most three are compared; the comparison is exact.

Work is on distinct fingerprints. Cells above ``TILE`` members are dealt to pairs
of tiles, each a task's worth, and every task returns a spanning forest of the
links it found instead of the links, so neither a hot cell nor a large group of
near copies makes a task or a result grow with the square of its size. The
closure over all forests is that over all links.

NULL, empty and wordless texts have fingerprint zero and link like any other.
Repeated rows are one node. Rows with NULL ids get the smallest id of their
component, NULL if it has none. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ledgerloom.functions.columns import ref
from ledgerloom.llm.common import query, release, staged, table
from ledgerloom.llm.components import components

#: Words in a shingle, differing bits of a link, and the hash seed.
SHINGLE, DISTANCE, SEED = 3, 3, 42
#: Two-bit segments in each of the six blocks.
BLOCKS = (5, 5, 5, 5, 6, 6)
#: Members of a cell that are compared in one piece.
TILE = 4096
_PIECE = 1 << 16  # shingles whose bits are spread at once
_EDGES = 1 << 20  # links that a task holds before it reduces them to a forest


def fingerprint(text: str | None) -> int:
    """64 bits, each set in over half of the shingles' hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    width = min(SHINGLE, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
    stops = ends[width - 1 :].tolist()
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), dtype=np.uint64, count=len(starts))
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _PIECE):
        piece = hashes[i : i + _PIECE].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(piece, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


@F.pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    prints = pd.Series([fingerprint(t) for t in texts], dtype="int64")
    release()
    return prints


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but the roots with its root, for the components of the links a-b."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    child = label != np.arange(len(nodes))
    return nodes[child], nodes[label[child]]


def _linked(cell: np.ndarray, total: np.ndarray, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between members of equal cells; rows come in order of cell and total."""
    first, step = np.arange(len(cell)), 1
    while True:
        first = first[first + step < len(cell)]
        other = first + step
        near = (cell[first] == cell[other]) & (total[other] - total[first] <= DISTANCE)
        first, other = first[near], other[near]
        if not len(first):
            return
        close = np.bitwise_count(prints[first] ^ prints[other]) <= DISTANCE
        if close.any():
            yield prints[first[close]], prints[other[close]]
        step += 1


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forests of the links in the cells of one partition; a cell that ends a batch waits for the next one."""
    rest: list[np.ndarray] | None = None

    def forests(cell, total, prints):
        a, b = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for x, y in _linked(cell, total, prints):
            a, b = np.concatenate([a, x]), np.concatenate([b, y])
            if len(a) > _EDGES:
                a, b = _forest(a, b)
        if len(a):
            a, b = _forest(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        arrays = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        arrays = [arrays[0], arrays[1].astype(np.int64), arrays[2].view(np.uint64)]
        rest = arrays if rest is None else [np.concatenate(p) for p in zip(rest, arrays)]
        if not len(rest[0]):
            continue
        open_ = int(np.flatnonzero(rest[0] == rest[0][-1])[0])
        if open_:
            yield from forests(*[x[:open_] for x in rest])
            rest = [x[open_:] for x in rest]
    if rest is not None and len(rest[0]):
        yield from forests(*rest)


def _masks() -> list[int]:
    masks, shift = [], 0
    for segments in BLOCKS:
        masks.append((1 << 2 * segments) - 1 << shift)
        shift += 2 * segments
    return [sum(chosen) for chosen in combinations(masks, len(BLOCKS) - DISTANCE)]


def _signed(bits: int) -> Column:
    return F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("bigint")


def links(prints: DataFrame, tile: int = TILE) -> DataFrame:
    """Edges a, b whose components are those of all fingerprints at most three bits apart.

    ``prints`` has one row per distinct bigint ``print``.
    """
    low, high, even = F.col("print"), F.shiftrightunsigned("print", 1), _signed(0x5555555555555555)
    # the bit count of each segment, in its own two bits
    counts = F.shiftleft(low.bitwiseAND(high).bitwiseAND(even), 1).bitwiseOR(low.bitwiseXOR(high).bitwiseAND(even))
    cells = F.array(*[F.xxhash64(F.lit(i), F.col("_counts").bitwiseAND(_signed(m))) for i, m in enumerate(_masks())])
    keyed = prints.withColumn("_counts", counts).select("print", F.explode(cells).alias("cell"))
    # Cells by size: a table of the hot ones only, as many rows at most as tiles are full.
    hot = staged(keyed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile)).select(
        "cell", F.ceil(F.col("n") / tile).cast("int").alias("tiles")
    )
    own = F.pmod(F.xxhash64("print"), F.col("tiles")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.xxhash64(F.col("cell"), F.least(t, own), F.greatest(t, own))
    )
    pieces = keyed.join(hot, "cell", "left").select(
        F.explode(F.when(F.col("tiles").isNull(), F.array("cell")).otherwise(pairs)).alias("cell"),
        F.bit_count("print").alias("total"),
        "print",
    )
    return pieces.repartition("cell").sortWithinPartitions("cell", "total").mapInArrow(_verify, "a bigint, b bigint")


def label(rows: DataFrame, key: str, prints: str = "print") -> DataFrame:
    """One row per distinct fingerprint: print, component_id (smallest key reachable), links (of the forest).

    Runs jobs: nodes and edges are staged.
    """
    nodes = staged(rows.groupBy(F.col(prints).alias("print")).agg(F.min(ref(key)).alias("_rep")))
    roots = staged(components(links(nodes.select("print"))))
    owned = nodes.join(roots, nodes["print"] == roots["node"], "left").select(
        "print", "_rep", F.coalesce("root", "print").alias("root")
    )
    least = staged(owned.groupBy("root").agg(F.min("_rep").alias("component_id")))
    return owned.join(least, "root").select("print", "component_id")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id of every row. Runs jobs."""
    rows = staged(df.select(ref(key).alias("doc_id"), fingerprints(ref(text)).alias("print")))
    shown = F.lpad(F.lower(F.hex("print")), 16, "0")
    classes = staged(label(rows, "doc_id"))
    return rows.join(classes, "print").select("doc_id", shown.alias("fingerprint"), "component_id")


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` without near copies: of each component the row with the smallest key stays.

    Ties (repeated keys) go to the smaller hash of key and text; of wholly
    repeated rows one stays; NULL keys come last. Runs jobs.
    """
    mark = F.xxhash64(ref(key), ref(text))
    rows = staged(df.select(ref(key).alias("doc_id"), fingerprints(ref(text)).alias("print"), mark.alias("_mark")))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_mark")
    # One key per component: the smallest print in it, since ids may be missing or repeated.
    nodes = staged(rows.groupBy("print").agg(F.min(rank).alias("_first")))
    roots = staged(components(links(nodes.select("print"))))
    owned = nodes.join(roots, nodes["print"] == roots["node"], "left").select("_first", F.coalesce("root", "print").alias("root"))
    stays = staged(owned.groupBy("root").agg(F.min("_first").alias("_first")).select(F.col("_first._mark").alias("_ll_mark")).distinct())
    kept = df.withColumn("_ll_row", mark).join(stays, F.col("_ll_row") == F.col("_ll_mark"), "left_semi")
    one = F.row_number().over(W.partitionBy("_ll_row").orderBy(ref(key)))
    return kept.withColumn("_ll_n", one).where("_ll_n = 1").drop("_ll_n", "_ll_row")


@query()
def op4_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, folder, "documents"))

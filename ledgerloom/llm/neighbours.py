"""Approximate nearest neighbours by collision counting over single projections.

Each vector is projected on ``PROJECTIONS`` random lines, and every line keeps
its values sorted. A query opens a window around its own value on each line and
widens all of them together, level by level (virtual rehashing: no bucket is
rebuilt); only the newly covered ends are counted. A vector inside at least
``THRESHOLD`` of a query's windows is verified by its exact distance. A level
stands for a radius; a query is done when as many verified vectors as asked for
lie within it, or when everything has been verified. There is no cap on
candidates, so wide windows end in an exact search.

Vectors and queries are dealt to blocks of bounded size; each pair of blocks is
one task's work and returns at most ``k`` rows per query, which a ranked window
merges. Of equal vectors only the ``k`` + 1 smallest ids can be an answer (ties go
to the smaller id), so only those are indexed: a vector that a third of all rows
share is never gathered.

Vectors that are NULL, empty, zero or hold NULL or non-finite components, and
rows without id, take no part; only vectors of equal length are compared;
repeated rows count once, of different vectors under one id the smallest
(component by component) stands for it; with fewer than ``k`` candidates all are returned; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.columns import ref
from ledgerloom.llm.common import query, staged, table

PROJECTIONS = 64
#: Share of the windows that a vector must lie in to be verified.
THRESHOLD = 0.7
#: Half-width of a window in radii: vectors within the radius lie in 83 % of the windows.
HALF_WIDTH = 1.36
#: Growth of the radius from level to level.
GROWTH = 1.25
#: Vectors and queries in a block.
BLOCK, QUERY_BLOCK = 8192, 4096
SEED = 20


def usable(vector: Column) -> Column:
    """True for vectors that take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class SortedLines:
    """The projections of one block of vectors, sorted line by line."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.lines = np.random.default_rng(SEED).standard_normal((vectors.shape[1], PROJECTIONS))
        values = vectors @ self.lines
        self.order = np.argsort(values, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(values, self.order, axis=0)
        # Typical distance in the block: half of it is the first radius.
        self.scale = float(np.sqrt(2 * vectors.var(axis=0).sum())) or 1.0

    def search(self, query: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of the nearest ``k`` found; ``own`` marks rows that aren't candidates."""
        n, at = len(self.vectors), query @ self.lines
        need = int(np.ceil(THRESHOLD * PROJECTIONS))
        counts, distance = np.zeros(n, np.int64), np.full(n, np.nan)
        lows = highs = np.array([np.searchsorted(self.sorted[:, j], at[j]) for j in range(PROJECTIONS)])
        radius = self.scale / 2
        while True:
            half = HALF_WIDTH * radius
            new_lows = np.array([np.searchsorted(self.sorted[:, j], at[j] - half) for j in range(PROJECTIONS)])
            new_highs = np.array([np.searchsorted(self.sorted[:, j], at[j] + half, side="right") for j in range(PROJECTIONS)])
            ends = [
                self.order[a:b, j]
                for j in range(PROJECTIONS)
                for a, b in ((new_lows[j], min(lows[j], new_highs[j])), (max(highs[j], new_lows[j]), new_highs[j]))
                if b > a
            ]
            if ends:
                counts += np.bincount(np.concatenate(ends), minlength=n)
            lows, highs = np.minimum(lows, new_lows), np.maximum(highs, new_highs)
            fresh = np.flatnonzero((counts >= need) & np.isnan(distance))
            distance[fresh] = np.sqrt(((self.vectors[fresh] - query) ** 2).sum(axis=1))
            distance[fresh[own[fresh]]] = np.inf
            verified = ~np.isnan(distance)
            if verified.all() or np.count_nonzero(distance <= radius) >= k:
                found = np.flatnonzero(np.isfinite(distance))
                return found, distance[found]
            radius *= GROWTH


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    flat = vectors.combine_chunks().flatten().to_numpy().astype(np.float64)
    return flat.reshape(len(vectors), -1)


def _search_block(k: int):
    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(data) and len(queries):
            ids = data.column("id").to_numpy()
            lines = SortedLines(_matrix(data.column("vector")))
            for query_id, vector in zip(queries.column("id").to_numpy(), _matrix(queries.column("vector"))):
                rows, score = lines.search(vector, ids == query_id, k)
                best = np.lexsort((ids[rows], score))[:k]
                out["query_id"] += [query_id] * len(best)
                out["vec_id"] += ids[rows[best]].tolist()
                out["score"] += score[best].tolist()
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    return run


def nearest(df: DataFrame, queries: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row where ``queries`` holds, its ``k`` nearest rows found.

    ``queries`` is a condition on the column ``id``. Runs jobs: rows are staged.
    """
    rows = df.select(ref(key).cast("bigint").alias("id"), ref(vector).cast("array<double>").alias("vector"))
    rows = staged(rows.where(F.col("id").isNotNull() & usable(F.col("vector"))).groupBy("id").agg(F.min("vector").alias("vector")))
    copy = F.row_number().over(W.partitionBy("vector").orderBy("id"))
    index = rows.withColumn("copy", copy).where(F.col("copy") <= k + 1).drop("copy")
    asked = rows.where(queries)
    n, n_asked = rows.count(), asked.count()
    parts, query_parts = max(1, -(-n // BLOCK)), max(1, -(-n_asked // QUERY_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys = ("size", "part", "query_part")
    left = index.select("id", "vector", F.size("vector").alias("size"), block(parts).alias("part"), every(query_parts).alias("query_part"))
    right = asked.select("id", "vector", F.size("vector").alias("size"), block(query_parts).alias("query_part"), every(parts).alias("part"))
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search_block(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query()
def op8_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Ten nearest of every hundredth vector among all others."""
    return nearest(table(spark, folder, "embeddings"), F.col("id") % 100 == 0)

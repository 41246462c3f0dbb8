"""Audit of how quality filters interact, from sorted posting lists.

Every filter marks the documents it fails. Within a part (a source) documents
are sorted by id, dealt to tasks by ranges of ids, and each range keeps one
ascending posting list of failing places per filter. A filter applied after a
set S of others removes its list minus the union of theirs: unions are k-way
merges and differences walk both lists, both by galloping (doubling steps, then
bisection), so a run that meets no other list is taken in one step. Sizes of
the differences add up over ranges, and every order of the filters is a path
through the sets, so 120 orders of five filters need 80 differences.

A range holds at most ``RANGE`` failing places, whatever a part holds. A text
equal to that of a smaller id is found from digests of 128 bits: the smallest
id of every repeated digest is joined back to narrow rows. A range partition is
cut within ids too (by digest), so even one id with very many rows is dealt out.

NULL texts are empty (they fail by length), texts of any length are read whole,
NULL sources form the part '' together with empty ones. A NULL id is neither
smaller nor larger than any other: such a row never counts as a copy and makes
no copy. Repeated rows count one by one; of one id's equal texts none is
smaller, so they are no copies of each other. An id with several labels has a
label if any row says so; rows without a label count as neither. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.columns import ref
from ledgerloom.llm.common import WORD, query, staged, table

#: The filters, in bit order.
FILTERS = "ABCDE"
#: Fixed by the contract of the filters.
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT = 200, 50, 2
SYMBOLS, UPPER = b"#$%&*|", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Failing documents whose posting lists are in memory at once.
RANGE = 65_536

#: (set of filters applied before, filter): what is counted for every range.
STEPS = [(s, f) for s in range(1 << len(FILTERS)) for f in range(len(FILTERS)) if not s >> f & 1]


def text_filters(text: str | None) -> int:
    """Bits of the filters A to D that the text fails."""
    raw = (text or "").encode()
    words = raw.split()
    upper = len(raw) - len(raw.translate(None, UPPER))
    failed = (
        len(words) < MIN_WORDS,
        100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words),
        100 * upper > MAX_UPPER_PERCENT * len(text or ""),
        len(raw.translate(None, SYMBOLS)) < len(raw),
    )
    return sum(bit << k for k, bit in enumerate(failed))


def gallop(ids: Sequence[int], start: int, value: int) -> int:
    """First place at or after ``start`` whose id isn't below ``value``: doubling steps, then bisection between the last two."""
    low, step, n = start, 1, len(ids)
    while low + step <= n and ids[low + step - 1] < value:
        low += step
        step *= 2
    return bisect_left(ids, value, low, min(n, low + step))


def union(lists: Sequence[Sequence[int]]) -> list[int]:
    """Ascending union of ascending lists without repeats, run by run."""
    heap = [(ids[0], k, 0) for k, ids in enumerate(lists) if ids]
    heapq.heapify(heap)
    out: list[int] = []
    while heap:
        value, k, at = heap[0]
        ids = lists[k]
        if out and out[-1] == value:
            end = at + 1
        else:
            # The list runs freely up to the smallest head of the others.
            rest = min(heap[1:3], default=None)
            end = len(ids) if rest is None else max(at + 1, gallop(ids, at, rest[0]))
            out.extend(ids[at:end])
        if end < len(ids):
            heapq.heapreplace(heap, (ids[end], k, end))
        else:
            heapq.heappop(heap)
    return out


def difference(left: Sequence[int], right: Sequence[int]) -> list[int]:
    """What of ``left`` isn't in ``right``; both ascend without repeats."""
    out: list[int] = []
    a = b = 0
    while a < len(left) and b < len(right):
        end = gallop(left, a, right[b])
        out.extend(left[a:end])
        a = end
        if a < len(left):
            b = gallop(right, b, left[a])
            if b < len(right) and right[b] == left[a]:
                a, b = a + 1, b + 1
    out.extend(left[a:])
    return out


def range_counts(failing: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """For every entry of ``STEPS``: documents the filter removes after the set, and how many of them are good and toxic.

    ``failing`` has the bits of each document of the range, in the order of ids.
    """
    postings = [np.flatnonzero(failing >> f & 1).tolist() for f in range(len(FILTERS))]
    unions = {s: union([p for f, p in enumerate(postings) if s >> f & 1]) for s in {s for s, _ in STEPS}}
    out = np.zeros((len(STEPS), 3), dtype=np.int64)
    for i, (s, f) in enumerate(STEPS):
        removed = difference(postings[f], unions[s])
        out[i] = len(removed), int(good[removed].sum()), int(toxic[removed].sum())
    return out


def examined(df: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """part, doc_id, bits of the filters A to D, digest of the text; one row per row."""
    rows = df.select(
        F.coalesce(ref(part).cast("string"), F.lit("")).alias("part"), ref(key).alias("doc_id"), ref(text).alias("_text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column("_text")]
            bits = pa.array([text_filters(t) for t in texts], pa.int32())
            digest = pa.array([hashlib.blake2b((t or "").encode(), digest_size=16).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("doc_id"), bits, digest], names=["part", "doc_id", "failed", "digest"])

    return rows.mapInArrow(run, f"part string, doc_id {dict(rows.dtypes)['doc_id']}, failed int, digest binary")


def removals(
    df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", range_size: int = RANGE
) -> DataFrame:
    """part, before (set of filters as bits), filter (its bit), removed, good, toxic; every set and filter of every part.

    ``removed`` counts the documents that fail the filter and none of the set
    before it. ``labels`` has the key, ``quality`` and ``toxic``. Runs a job:
    narrow rows are staged in the shared folder.
    """
    rows = staged(examined(df, key, text, part))
    # Staged, so that both sides of the join are plain shuffles: AQE may then split a text with very many copies.
    firsts = staged(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last"))
    marks = (
        labels.where(ref(key).isNotNull())
        .groupBy(ref(key).alias("doc_id"))
        .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    )
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    failing = (
        rows.join(firsts.select("digest", "first"), "digest", "left")
        .withColumn("failed", F.col("failed") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0))
        .where("failed > 0")
        .select("part", "doc_id", "failed", "digest")
        .join(marks, "doc_id", "left")
        .select("part", "doc_id", "failed", "digest", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    )
    ordered = failing.repartitionByRange("part", "doc_id", "digest").sortWithinPartitions("part", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, sums = None, [], 0, None

        def add() -> None:
            nonlocal held, size, sums
            if held:
                sums = sums + range_counts(*(np.concatenate(c) for c in zip(*held)))
            held, size = [], 0

        def report() -> pa.RecordBatch:
            columns = [pa.array([now] * len(STEPS), pa.string()), *(pa.array(list(c), pa.int32()) for c in zip(*STEPS))]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array(c) for c in sums.T)], names=["part", "before", "filter", "removed", "good", "toxic"])

        for batch in batches:
            parts = batch.column("part")
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("failed", "good", "toxic")]
            at = 0
            while at < len(parts):
                if parts[at].as_py() != now:
                    add()
                    if now is not None:
                        yield report()
                    now, sums = parts[at].as_py(), np.zeros((len(STEPS), 3), dtype=np.int64)
                # The rows of one part stand together.
                end = at + bisect_left(range(at, len(parts)), True, key=lambda i: parts[i].as_py() != now)
                end = min(end, at + range_size - size)
                held.append([c[at:end] for c in columns])
                size += end - at
                at = end
                if size == range_size:
                    add()
        add()
        if now is not None:
            yield report()

    counted = ordered.drop("doc_id", "digest").mapInArrow(run, "part string, before int, filter int, removed long, good long, toxic long")
    sums = counted.groupBy("part", "before", "filter").agg(*[F.sum(c).alias(c) for c in ("removed", "good", "toxic")])
    # Parts in which nothing fails have zeros.
    cells = F.expr(f"array({', '.join(f'struct({s} AS before, {f} AS filter)' for s, f in STEPS)})")
    totals = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    return (
        totals.select("part", "n", F.inline(cells))
        .join(sums, ["part", "before", "filter"], "left")
        .select("part", "n", "before", "filter", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("removed", "good", "toxic")])
    )


def audit(
    df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", range_size: int = RANGE
) -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``shapley`` is the filter's ``removed`` summed over all orders. Runs a job.
    """
    n = len(FILTERS)
    passed: dict[tuple[int, int], list[tuple[str, int]]] = {cell: [] for cell in STEPS}
    for order in permutations(range(n)):
        before = 0
        for step, f in enumerate(order, 1):
            passed[before, f].append(("".join(FILTERS[g] for g in order), step))
            before |= 1 << f
    # Every set and filter knows the steps of the orders that pass through it.
    of = lambda cell: ", ".join(f"struct('{o}' AS filter_order, {k} AS step)" for o, k in passed[cell])
    steps = F.expr(f"map({', '.join(f'{s * n + f}, array({of((s, f))})' for s, f in STEPS)})[before * {n} + filter]")
    mine = W.partitionBy("part", "filter")
    alone = F.expr(f"before + shiftleft(1, filter) = {(1 << n) - 1}")
    along = W.partitionBy("part", "filter_order").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    cells = removals(df, labels, key, text, part, range_size).withColumn("_steps", steps)
    return (
        cells.withColumn("fails", F.max(F.when(F.col("before") == 0, F.col("removed"))).over(mine))
        .withColumn("unique_fails", F.max(F.when(alone, F.col("removed"))).over(mine))
        .withColumn("shapley", F.sum(F.col("removed") * F.size("_steps")).over(mine))
        .select("*", F.inline("_steps"))
        .select(
            "part",
            "filter_order",
            "step",
            (F.col("n") - F.sum("removed").over(along)).alias("kept"),
            "removed",
            (F.col("fails") - F.col("removed")).alias("redundant"),
            "unique_fails",
            F.col("good").alias("good_lost"),
            F.col("toxic").alias("toxic_lost"),
            "shapley",
        )
    )


@query(
    f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part,
  coalesce(regexp_extract_all(text, '{WORD}'), []) AS words FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
  [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
   100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'),
   coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), FALSE)] AS fails
  FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS way FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT filter_order, k AS step, way[k] AS f, way[:k - 1] AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
r AS (SELECT part, filter_order, step, f,
  sum(CASE WHEN fails[f] OR list_bool_or(list_transform(before, lambda b: fails[b])) THEN 0 ELSE n END) AS kept,
  sum(CASE WHEN fails[f] AND NOT coalesce(list_bool_or(list_transform(before, lambda b: fails[b])), FALSE) THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN fails[f] AND list_bool_or(list_transform(before, lambda b: fails[b])) THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails[f] AND len(list_filter(fails, lambda b: b)) = 1 THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN fails[f] AND NOT coalesce(list_bool_or(list_transform(before, lambda b: fails[b])), FALSE) THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN fails[f] AND NOT coalesce(list_bool_or(list_transform(before, lambda b: fails[b])), FALSE) THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r"""
)
def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of all documents under all 120 orders of five filters, by source."""
    return audit(table(spark, folder, "documents"), table(spark, folder, "labels"))

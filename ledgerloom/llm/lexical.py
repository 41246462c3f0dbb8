r"""Ranked lexical search through K2-treaps over grids of terms and documents.

Documents are dealt to blocks of bounded text. A block is a grid: rows are its
terms, columns its documents in the order of their ids, a cell holds the impact
of a term in a document. The grid is halved in both directions again and again;
a node of that quadtree is four bits (which quarters hold cells) and the largest
impact below it, level by level; children are found by counting bits.

An item is a set of rows. It goes down all its row paths together: an entry of
its frontier is a range of documents with one node per term, and the sum of the
nodes' maxima times the terms' weights bounds every score inside. The entry with
the largest bound is opened first; an entry that cannot beat the item's last
place (smaller bound, or equal bound and no smaller id) ends the descent. An
entry of one document is its exact score. The last place carries over from block
to block of a group, and a ranked window merges the groups.

Every row is indexed, with all its terms; nothing is sampled or capped. Items are
dealt to batches of bounded size, blocks to groups of ``GROUP``, and each group
meets each batch (a stated set of queries against all rows, in blocks). Of the
corpus only two numbers reach the driver (documents with terms, and terms);
document frequencies stay distributed.

NULL and empty texts have no terms: such documents are never found and such
items find nothing. Texts of any length are read whole; a longer one than a
block is a block of its own. A repeated document row is ranked as a document of
its own; NULL ids come last among equal scores. Rows of one item id with equal
texts are one item, with different texts each is ranked by itself. An empty
table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.columns import ref
from ledgerloom.llm.common import query, release, released, staged, table

#: Terms are the maximal matches; only A-Z lose their case.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of characters outside terms become blanks.
_TERM_BYTES = bytes(
    c if c >= 0x80 or chr(c).isalnum() and chr(c) == chr(c).lower() else c + 32 if chr(c).isupper() and c < 0x80 else 0x20 for c in range(256)
)
#: Characters of text in a block, blocks in a group, terms of items in a batch.
BLOCK_CHARS, GROUP, BATCH_TERMS = 4_000_000, 4, 65_536
#: Entries that an item opens at a time, so that many items share one numpy call.
AHEAD = 4
#: An entry of so many halvings above one document is scored whole.
LEAF = 4
#: Fixed by the contract of the score.
LENGTH_PERCENT, SATURATION, SCALE, UNIT = 25, 12, 1000, 1_000_000_000
_LAST = np.iinfo(np.int64).max

_BITS = np.array([i.bit_count() for i in range(16)], dtype=np.int64)


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERM_BYTES).split()


def spread(values: np.ndarray) -> np.ndarray:
    """A zero bit before every bit of values below 2**31."""
    out = values.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        out = (out | out << np.uint64(shift)) & np.uint64(mask)
    return out


class K2Treap:
    """A sparse grid as a quadtree of four-bit nodes with the largest value below each.

    Nodes are numbered level by level from the root, so the children of a node
    stand together and the first of them is one more than the bits before it.
    """

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray):
        self.depth = max(1, int(max(rows.max(), columns.max())).bit_length())
        codes = spread(rows) << np.uint64(1) | spread(columns)
        order = np.argsort(codes)
        codes, top = codes[order], values[order]
        maxima, quarters = [top], []
        for _ in range(self.depth):
            bit = np.left_shift(np.uint8(1), (codes & np.uint64(3)).astype(np.uint8))
            codes = codes >> np.uint64(2)
            starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            codes, top = codes[starts], np.maximum.reduceat(top, starts)
            quarters.append(np.bitwise_or.reduceat(bit, starts))
            maxima.append(top)
        self.top = np.concatenate(maxima[::-1])
        self.quarters = np.concatenate(quarters[::-1])
        ahead = np.cumsum(_BITS[self.quarters])
        self.first = 1 + np.concatenate([[0], ahead[:-1]])

    def child(self, nodes: np.ndarray, quarter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which nodes have that quarter, and the numbers of those children."""
        bits = self.quarters[nodes].astype(np.int64)
        has = np.flatnonzero(bits >> quarter & 1)
        return has, self.first[nodes[has]] + _BITS[bits[has] & ((1 << quarter[has]) - 1)]


class Ranking:
    """The best ``k`` of one item so far: a heap whose head is the last place."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def open(self, bound: int, smallest: int) -> bool:
        """Can a document with at most that score and at least that id still enter?"""
        return len(self.heap) < self.k or (bound, -smallest) > self.heap[0]

    def least(self) -> int:
        """Smallest score that may enter."""
        return self.heap[0][0] if len(self.heap) == self.k else 0

    def add(self, score: int, doc: int) -> None:
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, (score, -doc))
        elif (score, -doc) > self.heap[0]:
            heapq.heapreplace(self.heap, (score, -doc))


def _joined(entries: list[tuple]) -> tuple[np.ndarray, ...]:
    """Number of the entry, node, row and weight of every term of the entries."""
    sizes = np.array([len(e[3]) for e in entries])
    return np.repeat(np.arange(len(entries)), sizes), *(np.concatenate([e[k] for e in entries]) for k in (3, 4, 5))


def _exact(treap: K2Treap, entries: list[tuple], levels: int) -> np.ndarray:
    """Scores of the 2**levels documents of every entry, all levels below it at once."""
    entry, nodes, rows, weights = _joined(entries)
    column = entry << levels
    for level in range(levels - 1, -1, -1):
        lower = rows >> level & 1
        halves = [(right, *treap.child(nodes, 2 * lower + right)) for right in (0, 1)]
        nodes = np.concatenate([children for _, _, children in halves])
        column = np.concatenate([column[has] + (right << level) for right, has, _ in halves])
        rows, weights = (np.concatenate([x[has] for _, has, _ in halves]) for x in (rows, weights))
    scores = np.zeros(len(entries) << levels, np.int64)
    np.add.at(scores, column, weights * treap.top[nodes])
    return scores.reshape(len(entries), -1)


def descend(treap: K2Treap, ids: np.ndarray, asked: Sequence[tuple[np.ndarray, np.ndarray]], rankings: Sequence[Ranking]) -> int:
    """Best-first search of all items of ``asked`` (rows, weights) at once; returns the number of entries opened.

    ``ids`` ascend with the columns. Each item opens its best ``AHEAD`` entries
    at a time; entries of 2**``LEAF`` documents are scored whole.
    """
    depth, leaf, opened = treap.depth, min(LEAF, treap.depth), 0
    frontiers = [
        [(-int(weights.sum()) * int(treap.top[0]), 0, 0, np.zeros(len(rows), np.int64), rows, weights)] if len(rows) else []
        for rows, weights in asked
    ]
    active = [i for i, f in enumerate(frontiers) if f]
    while active:
        inner, ends, owners, last = [], [], [], []
        for i in active:
            frontier, ranking = frontiers[i], rankings[i]
            for _ in range(min(AHEAD, len(frontier))):
                if not ranking.open(-frontier[0][0], ids[frontier[0][1]]):
                    frontier.clear()
                    break
                entry = heapq.heappop(frontier)
                at_end = depth - entry[2] <= leaf
                (ends if at_end else inner).append(entry)
                (last if at_end else owners).append(i)
        opened += len(inner) + len(ends)
        if ends:
            scores = _exact(treap, ends, leaf)
            least = np.array([rankings[i].least() for i in last])
            for e, c in zip(*(x.tolist() for x in np.nonzero((scores >= least[:, None]) & (scores > 0)))):
                rankings[last[e]].add(int(scores[e, c]), int(ids[ends[e][1] + c]))
        if inner:
            entry, nodes, rows, weights = _joined(inner)
            lower = rows >> np.array([depth - 1 - e[2] for e in inner])[entry] & 1
            least = np.array([rankings[i].least() for i in owners])
            for right in (0, 1):
                has, children = treap.child(nodes, 2 * lower + right)
                if not len(has):
                    continue
                mine = entry[has]
                starts = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
                bounds = np.add.reduceat(weights[has] * treap.top[children], starts)
                stops = np.append(starts[1:], len(has))
                keep = np.flatnonzero(bounds >= np.maximum(least[mine[starts]], 1))
                for e, a, b, bound in zip(mine[starts[keep]].tolist(), starts[keep].tolist(), stops[keep].tolist(), bounds[keep].tolist()):
                    column = inner[e][1] + (right << (depth - 1 - inner[e][2]))
                    if rankings[owners[e]].open(bound, ids[column]):
                        part = has[a:b]
                        heapq.heappush(frontiers[owners[e]], (-bound, column, inner[e][2] + 1, children[a:b], rows[part], weights[part]))
        active = [i for i in active if frontiers[i]]
    return opened


def packed(values: np.ndarray) -> bytes:
    """Values from zero on as unsigned numbers of the least width that holds them all."""
    return values.astype(np.min_scalar_type(int(values.max()))).tobytes()


def unpacked(data: pa.Buffer, n: int) -> np.ndarray:
    """The ``n`` values of ``packed``; the width follows from their number."""
    return np.frombuffer(data, f"u{data.size // n}").astype(np.int64)


def _grid(spelled: bytes, found: pa.Buffer) -> tuple[pa.Array, np.ndarray]:
    """The terms of a block and how many of its documents hold each."""
    names = pa.array(spelled.split(b" "), pa.binary())
    return names, unpacked(found, len(names))


def index(df: DataFrame, key: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per block: ids (ascending, NULL last) and lengths of its documents, its terms, their document frequencies, columns and counts.

    Documents without a term have no column. What grows with the text is packed
    (terms joined by blanks, numbers in as few bytes as they need), since the JVM
    holds several blocks at once while they are staged, sorted and sent.
    """
    rows = df.select(ref(key).cast("long").alias("_id"), ref(text).alias("_text"))

    def pack(held: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
        held.sort(key=lambda d: (d[0] is None, d[0] or 0))
        lengths = np.array([len(words) for _, words in held], dtype=np.int64)
        spelled = pa.array([w for _, words in held for w in words], pa.binary()).dictionary_encode()
        codes = spelled.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        cells, counts = np.unique(codes * len(held) + np.repeat(np.arange(len(held)), lengths), return_counts=True)
        values = {
            "ids": pa.array([[i for i, _ in held]], pa.list_(pa.int64())),
            "lengths": pa.array([lengths], pa.list_(pa.int64())),
            "terms": pa.array([b" ".join(spelled.dictionary.to_pylist())], pa.binary()),
            "found": pa.array([packed(np.bincount(cells // len(held), minlength=len(spelled.dictionary)))], pa.binary()),
            "columns": pa.array([packed(cells % len(held))], pa.binary()),
            "counts": pa.array([packed(counts)], pa.binary()),
        }
        return pa.RecordBatch.from_pydict(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars = [], 0
        for batch in released(batches):
            for i, text in zip(batch.column("_id").to_pylist(), batch.column("_text")):
                text = text.as_py()
                if words := terms(text):
                    held.append((i, words))
                    chars += len(text)
                    if chars >= block_chars:
                        yield pack(held)
                        held, chars = [], 0
                        release()
        if held:
            yield pack(held)
        held = []
        release()

    return rows.mapInArrow(run, "ids array<long>, lengths array<long>, terms binary, found binary, columns binary, counts binary")


def _frequencies(blocks: DataFrame) -> DataFrame:
    """term, df: a row per block and term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for spelled, found in zip(batch.column("terms"), batch.column("found")):
                names, df = _grid(spelled.as_py(), found.as_buffer())
                yield pa.RecordBatch.from_arrays([names, pa.array(df)], names=["term", "df"])

    return blocks.select("terms", "found").mapInArrow(run, "term binary, df long")


def _weighted(blocks: DataFrame, items: DataFrame, n_docs: int, key: str, text: str) -> DataFrame:
    """item (digest), item_id, term, weight: repeats times the weight of the term; terms of weight 0 are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("_text").to_pylist()):
                spelled = pa.array(terms(text), pa.binary()).value_counts()
                n = len(spelled)
                columns = [batch.column(c).take(pa.array([i] * n, pa.int64())) for c in ("item", "item_id")]
                yield pa.RecordBatch.from_arrays([*columns, spelled.field("values"), spelled.field("counts")], names=["item", "item_id", "term", "times"])

    name = F.sha2(F.to_json(F.struct("item_id", "_text")), 256)
    distinct = items.select(ref(key).alias("item_id"), ref(text).alias("_text")).distinct().select(name.alias("item"), "item_id", "_text")
    asked = staged(distinct.mapInArrow(run, f"item string, item_id {dict(distinct.dtypes)['item_id']}, term binary, times long"))
    df = _frequencies(blocks).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    return (
        asked.join(df, "term")
        .select("item", "item_id", "term", (weight * F.col("times")).alias("weight"))
        .where("weight > 0")
    )


def search(
    df: DataFrame,
    items: DataFrame,
    k: int = 20,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item, equal scores by ascending id.

    Runs jobs: the index and the weighted terms of the items are staged in the shared folder.
    """
    blocks = staged(index(df, key, text, block_chars))
    total = lambda c: F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), c)), F.lit(0))
    n_blocks, n_docs, n_terms = blocks.agg(
        F.count(F.lit(1)), total(lambda a, x: a + F.lit(1)), total(lambda a, x: a + x)
    ).first()
    asked = staged(_weighted(blocks, items, n_docs, item, item_text))
    n_batches, n_groups = -(-asked.count() // BATCH_TERMS), -(-n_blocks // GROUP)
    deal = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    numbered = blocks.select("*", F.pmod(F.xxhash64("columns", "counts", "ids"), F.lit(max(n_groups, 1))).cast("int").alias("group"))
    sides = numbered.select("*", deal(n_batches).alias("batch"))
    batches = (
        asked.groupBy("item")
        .agg(F.first("item_id").alias("item_id"), F.collect_list("term").alias("asked"), F.collect_list("weight").alias("weights"))
        .withColumn("batch", F.pmod(F.xxhash64("item"), F.lit(max(n_batches, 1))).cast("int"))
        .select("*", deal(n_groups).alias("group"))
    )

    def impacts(counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        norm = 100 - LENGTH_PERCENT + (LENGTH_PERCENT * lengths * n_docs) // n_terms
        return (UNIT * counts) // (SCALE * counts + SATURATION * norm)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted = [np.array(w, np.int64) for w in right["weights"].to_pylist()]
        ends = np.cumsum([len(w) for w in wanted])[:-1]
        asked_terms = right["asked"].combine_chunks().flatten().cast(pa.binary())
        rankings = [Ranking(k) for _ in wanted]
        for i in range(left.num_rows if wanted else 0):
            ids = pc.fill_null(left["ids"][i].values, _LAST).to_numpy()
            lengths = left["lengths"][i].values.to_numpy()
            names, found = _grid(left["terms"][i].as_py(), left["found"][i].as_buffer())
            columns, counts = (unpacked(left[c][i].as_buffer(), found.sum()) for c in ("columns", "counts"))
            rows = np.repeat(np.arange(len(found)), found)
            treap = K2Treap(rows, columns, impacts(counts, lengths[columns]))
            at = pc.fill_null(pc.index_in(asked_terms, value_set=names), -1).to_numpy().astype(np.int64)
            here = [(a[a >= 0], w[a >= 0]) for a, w in zip(np.split(at, ends), wanted)]
            descend(treap, ids, here, rankings)
            del columns, counts, rows, treap, names
            release()
        best = [(j, -d, s) for j, r in enumerate(rankings) for s, d in r.heap]
        which = pa.array([b[0] for b in best], pa.int64())
        docs = pa.array([None if b[1] == _LAST else b[1] for b in best], pa.int64())
        names = ["item", "item_id", "doc_id", "score"]
        return pa.Table.from_arrays([right["item"].take(which), right["item_id"].take(which), docs, pa.array([b[2] for b in best], pa.int64())], names=names)

    kind = dict(asked.dtypes)["item_id"]
    found = sides.groupBy("group", "batch").cogroup(batches.groupBy("group", "batch")).applyInArrow(run, f"item string, item_id {kind}, doc_id long, score long")
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


@query(
    f"""WITH t AS (SELECT doc_id, row_number() OVER () AS r, unnest(regexp_extract_all(
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM documents),
p AS (SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM t GROUP BY r, term),
s AS (SELECT count(DISTINCT r) AS n_docs, CAST(sum(tf) AS BIGINT) AS n_terms FROM p),
m AS (SELECT r, 75 + (25 * CAST(sum(tf) AS BIGINT) * (SELECT n_docs FROM s)) // (SELECT n_terms FROM s) AS m FROM p GROUP BY r),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT n_docs FROM s) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM p WHERE term IN (SELECT term FROM q) GROUP BY term),
x AS (SELECT item_id, r, any_value(p.doc_id) AS doc_id,
  CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY item_id, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM x WHERE score > 0 QUALIFY rank <= 20"""
)
def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best of all documents for every benchmark item."""
    return search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))

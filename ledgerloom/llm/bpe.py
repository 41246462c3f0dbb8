r"""Byte-level BPE encoding and decoding through one global table of distinct words.

Encoding: each task cuts its texts into pre-tokens and numbers the distinct ones
of a block of documents, so a document becomes its pre-tokens' numbers in order
of position. The blocks' distinct words are shuffled by word to buckets, where
each distinct word is encoded once, whatever number of blocks asked for it; the
ids travel back to their block, and documents are reassembled by position.
Shuffled are the numbered documents, once, and per block its distinct words and
their ids: a word as frequent as it may be is one entry per block.

Decoding joins the token-byte table (one entry per id of the vocabulary, its
bound) by id inside each task and concatenates the bytes in order. Where encoded
documents are decoded or digested at once, the task that reassembles them does it:
a second Python operator in the stage would be a second worker to every core, and
ids shown as text would be a string object each.

NULL text counts as empty and gives no ids; a word may be as long as a text.
Repeated rows are encoded each, NULL keys are carried, an empty table gives an
empty result. Character classes are those of the installed ``regex`` package; it
may know a later Unicode version than the tokenizer's own library, for code
points assigned since then.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.columns import ref
from ledgerloom.llm.common import query, release, released, table

#: Characters after which a block of documents is closed.
BLOCK_CHARS = 4_000_000
#: Documents whose tokens are looked up at once.
DECODE_ROWS = 256
#: Ids of a document that are digested at once.
DIGEST_IDS = 1 << 20

_ID = pa.int32()


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def word_encoder(path: str) -> tiktoken.Encoding:
    """Merges by rank within one pre-token: its pattern takes any string whole."""
    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def token_bytes(path: str) -> pa.Array:
    """The token-byte table: position is the id."""
    known = {rank: token for token, rank in ranks(path).items()}
    return pa.array([known.get(i) for i in range(max(known, default=-1) + 1)], pa.binary())


@lru_cache(maxsize=2)
def decimals(path: str) -> pa.Array:
    """A comma and the decimal id of every token: position is the id."""
    return pa.array([b",%d" % i for i in range(len(token_bytes(path)))], pa.binary())


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each piece, one piece after the other."""
    before = np.cumsum(lengths) - lengths
    positions = np.repeat((starts - before).astype(np.int32), lengths)
    positions += np.arange(len(positions), dtype=np.int32)
    return positions


def _pack(values: np.ndarray) -> bytes:
    """Numbers below 2**31, compressed byte plane by byte plane."""
    return zlib.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def _pack_words(words: list[bytes]) -> dict[str, bytes]:
    return {"lengths": _pack(np.fromiter(map(len, words), np.int64, len(words))), "letters": zlib.compress(b"".join(words))}


def _unpack_words(lengths: bytes, letters: bytes) -> list[bytes]:
    ends, data = np.cumsum(_unpack(lengths)).tolist(), zlib.decompress(letters)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def _homes(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a block's words in order of bucket, and where each bucket begins and ends."""
    home = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
    order = np.argsort(home, kind="stable")
    return order, np.searchsorted(home[order], np.arange(buckets + 1))


class Block:
    """Documents of one block as numbers of distinct pre-tokens.

    A blank before a printing character always begins a pre-token, so texts are
    first cut at blanks, and each distinct piece is cut by the pattern once.
    Texts with a blank inside a longer run of white space are cut directly.
    """

    _run = regex.compile(r"\s (?:\s|\Z)")

    def __init__(self, pattern: str):
        self._find = regex.compile(pattern).findall
        self.words: dict[str, int] = {}
        self._pieces: tuple[dict[str, int], dict[str, int]] = ({}, {})
        self._codes: list[list[int]] = []
        self._docs: list[tuple[bool, list[int]]] = []
        self.chars = 0

    def _number(self, text: str) -> list[int]:
        words = self.words
        return [words.setdefault(w, len(words)) for w in self._find(text)]

    def _piece(self, piece: str, leading: int) -> int:
        known = self._pieces[leading]
        at = known.get(piece)
        if at is None:
            at = known[piece] = len(self._codes)
            self._codes.append(self._number(" " + piece if leading else piece))
        return at

    def add(self, text: str) -> None:
        self.chars += len(text)
        if self._run.search(text):
            self._docs.append((True, self._number(text)))
            return
        first, *others = text.split(" ")
        known, piece = self._pieces[1], self._piece
        found = [piece(first, 0)]
        found += [known[p] if p in known else piece(p, 1) for p in others]
        self._docs.append((False, found))

    def numbers(self) -> Iterator[np.ndarray]:
        """Word numbers of each document, in order of position."""
        lengths = np.fromiter(map(len, self._codes), dtype=np.int64, count=len(self._codes))
        flat = np.fromiter((c for codes in self._codes for c in codes), dtype=np.int32, count=int(lengths.sum()))
        starts = np.cumsum(lengths) - lengths
        for direct, found in self._docs:
            found = np.array(found, dtype=np.int64)
            yield found.astype(np.int32) if direct else flat[_gather(starts[found], lengths[found])]


_WORDS = "lengths binary, letters binary"


def _number_blocks(pattern: str, block_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), count()
        block, keys = Block(pattern), []
        release()

        def close() -> pa.RecordBatch:
            docs, key = list(block.numbers()), pa.concat_arrays(keys)
            codes = np.concatenate(docs)
            # numbered by falling frequency, so that most numbers are short
            order = np.argsort(-np.bincount(codes, minlength=len(block.words)), kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            words = list(block.words)
            row = {
                "block": f"{task}-{next(number)}",
                "sizes": _pack(np.fromiter(map(len, docs), np.int64, len(docs))),
                "codes": _pack(rank[codes]),
                **_pack_words([words[i].encode() for i in order]),
            }
            arrays = [pa.array([v]) for v in row.values()]
            return pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays([0, len(key)], key)], [*row, "keys"])

        for batch in batches:
            key, start = batch.column(0), 0
            for i, text in enumerate(batch.column(1)):
                block.add(text.as_py() or "")
                if block.chars >= block_chars:
                    keys.append(key[start : i + 1])
                    yield close()
                    block, keys, start = Block(pattern), [], i + 1
                    release()
            if start < len(key):
                keys.append(key[start:])
        if keys:
            yield close()
        block = keys = None
        release()

    return run


def _deal_words(buckets: int):
    """The distinct words of each block, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for block, lengths, letters in zip(*[batch.column(c).to_pylist() for c in ("block", "lengths", "letters")]):
                words = _unpack_words(lengths, letters)
                order, cuts = _homes(words, buckets)
                rows = [
                    {"bucket": int(b), "block": block, **_pack_words([words[i] for i in order[cuts[b] : cuts[b + 1]]])}
                    for b in np.flatnonzero(np.diff(cuts))
                ]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows)

    return run


def _encode_bucket(path: str):
    """Ids of all words of one bucket; each distinct word is encoded once."""

    def run(rows: pa.Table) -> pa.Table:
        encode = word_encoder(path).encode_ordinary
        known: dict[bytes, list[int]] = {}
        out = []
        for row in rows.to_pylist():
            ids = []
            for word in _unpack_words(row["lengths"], row["letters"]):
                if word not in known:
                    known[word] = encode(word.decode())
                ids.append(known[word])
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for one in ids for i in one), np.int64, int(counts.sum()))
            out.append({"block": row["block"], "bucket": row["bucket"], "counts": _pack(counts), "ids": _pack(flat)})
        known.clear()
        release()
        return pa.Table.from_pylist(out)

    return run


def _reassemble(buckets: int, finish: Callable[[pa.ListArray], dict[str, pa.Array]]):
    """Documents of one block as ids, from the ids of its words, and what ``finish`` makes of them."""

    def run(replies: pa.Table, block: pa.Table) -> pa.Table:
        (row,) = block.select(["sizes", "codes", "lengths", "letters"]).to_pylist()
        order, _ = _homes(_unpack_words(row["lengths"], row["letters"]), buckets)
        replies = replies.sort_by("bucket")
        nothing = [np.zeros(0, np.int32)]
        counts = np.concatenate(nothing + [_unpack(c) for c in replies.column("counts").to_pylist()])
        ids = np.concatenate(nothing + [_unpack(c) for c in replies.column("ids").to_pylist()])
        if len(counts) != len(order):
            raise ValueError("a block and its words do not belong together")
        lengths, starts = np.empty_like(counts), np.empty_like(counts)
        lengths[order] = counts
        starts[order] = np.cumsum(counts) - counts
        codes, sizes = _unpack(row["codes"]), _unpack(row["sizes"])
        flat = ids[_gather(starts[codes], lengths[codes])]
        words_before = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.concatenate([[0], np.cumsum(lengths[codes])])[words_before]
        keys = block.column("keys").combine_chunks().flatten()
        out = {"key": keys, **finish(pa.ListArray.from_arrays(pa.array(ends, _ID), pa.array(flat, _ID)))}
        release()
        return pa.table(out)

    return run


def _encoded(
    df: DataFrame,
    pattern: str,
    path: str,
    finish: Callable[[pa.ListArray], dict[str, pa.Array]],
    columns: dict[str, str],
    key: str,
    text: str,
    block_chars: int,
    buckets: int | None,
) -> DataFrame:
    """The key of every row and the ``columns`` that ``finish`` makes of the ids."""
    rows = df.select(ref(key).alias("key"), ref(text).alias("text"))
    kind = dict(rows.dtypes)["key"]
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Both uses of the numbered blocks are this one exchange, which Spark then runs once.
    blocks = rows.mapInArrow(
        _number_blocks(pattern, block_chars), f"block string, sizes binary, codes binary, {_WORDS}, keys array<{kind}>"
    ).repartition("block")
    dealt = blocks.mapInArrow(_deal_words(buckets), f"bucket long, block string, {_WORDS}")
    replies = dealt.groupBy("bucket").applyInArrow(_encode_bucket(path), "block string, bucket long, counts binary, ids binary")
    whole = replies.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(
        _reassemble(buckets, finish), ", ".join(f"{c} {t}" for c, t in {"key": kind, **columns}.items())
    )
    return whole.select(F.col("key").alias(key), *columns)


def encode(
    df: DataFrame,
    path: str,
    pattern: str,
    key: str = "doc_id",
    text: str = "text",
    block_chars: int = BLOCK_CHARS,
    buckets: int | None = None,
    spelled: bool = False,
) -> DataFrame:
    """key, ids (array<int>) of every row; ``spelled`` adds the bytes decoded from the ids, in the same Python worker.

    ``path`` is a rank file, ``buckets`` the word buckets (default: shuffle partitions).
    """

    def finish(ids: pa.ListArray) -> dict[str, pa.Array]:
        return {"ids": ids} | ({"bytes": _spell(ids, token_bytes(path))} if spelled else {})

    columns = {"ids": "array<int>"} | ({"bytes": "binary"} if spelled else {})
    return _encoded(df, pattern, path, finish, columns, key, text, block_chars, buckets)


def _spell(lists: pa.ListArray, tokens: pa.Array) -> pa.Array:
    """Bytes of each list of ids: the token-byte table joined by id, in order."""
    found = tokens.take(lists.flatten())
    if found.null_count:
        raise ValueError("an id is not in the vocabulary")
    at = np.frombuffer(found.buffers()[1], dtype=np.int32)[found.offset : found.offset + len(found) + 1] if len(found) else np.zeros(1, np.int32)
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
    joined = pa.Array.from_buffers(
        pa.binary(), len(lists), [None, pa.py_buffer(np.ascontiguousarray(at[ends], dtype=np.int32)), found.buffers()[2] or pa.py_buffer(b"")]
    )
    return pa.compute.if_else(lists.is_valid(), joined, pa.scalar(None, pa.binary())) if lists.null_count else joined


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, ids, bytes of every row; NULL ids give NULL bytes, an id outside the vocabulary fails the job."""
    rows = df.select(ref(key).alias("key"), ref(ids).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_bytes(path)
        for batch in (whole.slice(i, DECODE_ROWS) for whole in released(batches) for i in range(0, len(whole), DECODE_ROWS)):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _spell(batch.column(1), tokens)], ["key", "ids", "bytes"])

    kind = dict(rows.dtypes)["key"]
    return rows.mapInArrow(run, f"key {kind}, ids array<int>, bytes binary").select(F.col("key").alias(key), "ids", "bytes")


def _joined(ids: pa.Array, entries: pa.Array) -> memoryview:
    """The entries of all ids, one after the other."""
    found = entries.take(ids)
    if found.null_count:
        raise ValueError("an id is not in the vocabulary")
    if not len(found):
        return memoryview(b"")
    ends = np.frombuffer(found.buffers()[1], dtype=np.int32)
    return memoryview(found.buffers()[2])[ends[found.offset] : ends[found.offset + len(found)]]


def _digest(path: str):
    """n_tokens and the digests of each list of ids, a slice of a list at a time."""

    def run(lists: pa.ListArray) -> dict[str, pa.Array]:
        tokens, names, flat = token_bytes(path), decimals(path), lists.flatten()
        lengths = lists.value_lengths().to_numpy()
        digests: tuple[list[str], list[str]] = ([], [])
        for end, length in zip(np.cumsum(lengths).tolist(), lengths.tolist()):
            shown, decoded = hashlib.sha256(), hashlib.sha256()
            for at in range(end - length, end, DIGEST_IDS):
                piece = flat.slice(at, min(DIGEST_IDS, end - at))
                shown.update(_joined(piece, names)[at == end - length :])  # no comma before the first id
                decoded.update(_joined(piece, tokens))
            digests[0].append(shown.hexdigest())
            digests[1].append(decoded.hexdigest())
        return {"n_tokens": pa.array(lengths, pa.int64()), "ids_sha256": pa.array(digests[0], pa.string()), "decoded_sha256": pa.array(digests[1], pa.string())}

    return run


def digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS, buckets: int | None = None) -> DataFrame:
    """key, n_tokens, ids_sha256 (of the decimal ids, joined by commas), decoded_sha256 (of the bytes decoded from the ids)."""
    columns = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    return _encoded(df, pattern, path, _digest(path), columns, key, text, block_chars, buckets)


@query()
def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded by the multilingual ranks and decoded again."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)

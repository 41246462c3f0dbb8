r"""Quality rules: repetition coverage by rolling hashes.

Words are numbered per document, and a polynomial hash rolls over the numbers
for each n-gram length; a word is covered if a window it stands in occurs twice
or more in the document. Coverage is measured in characters. A document fails if
coverage of any length, or the characters of lines seen before, pass a limit.
The base rules count words, symbols, repeated lines and words in repeated
8-word windows.

NULL and empty texts have no words and fail by length. Each text is measured
whole, in memory that grows with that text alone. Repeated rows are measured one
by one, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.functions.columns import ref
from ledgerloom.llm.common import query, table

#: Fixed by the contract of the base rules.
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
SYMBOLS = b"#*$%&|<>"
#: n-gram length: largest percentage of word characters in repeated n-grams.
COVERAGE = {4: 50, 6: 45, 12: 40}
#: Largest percentage of word characters on lines equal to an earlier one.
MAX_LINE_PERCENT = 30

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Rolling:
    """Hashes modulo 2**64 of all windows of any length, from one prefix sum."""

    def __init__(self, codes: np.ndarray):
        powers = np.cumprod(np.full(len(codes), _BASE, dtype=np.uint64))
        self._prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * powers, dtype=np.uint64)])
        self._back = np.cumprod(np.full(len(codes), _INVERSE, dtype=np.uint64))

    def of(self, n: int) -> np.ndarray:
        return (self._prefix[n:] - self._prefix[:-n]) * self._back[: max(0, len(self._back) - n + 1)]


def repeated_starts(codes: np.ndarray, n: int, rolling: Rolling, among: np.ndarray | None = None) -> np.ndarray:
    """Starts of n-word windows that occur at least twice.

    ``among`` are starts that can be meant at all. Windows with equal hashes are
    compared word by word, so a collision cannot count.
    """
    hashes = rolling.of(n)
    if among is not None:
        among = among[among < len(hashes)]
        hashes = hashes[among]
    ranked = np.sort(hashes)
    if not (ranked[1:] == ranked[:-1]).any():
        return np.zeros(0, dtype=np.int64)
    order = np.argsort(hashes, kind="stable")
    same = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    left, right = order[same], order[same + 1]
    if among is not None:
        left, right = among[left], among[right]
    if all((codes[left + k] == codes[right + k]).all() for k in range(n)):
        return np.union1d(left, right)
    starts = np.arange(len(codes) - n + 1) if among is None else among
    windows = np.lib.stride_tricks.sliding_window_view(codes, n)[starts]
    _, which, count = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    return starts[count[which.ravel()] > 1]


def covered(codes: np.ndarray, lengths: Iterable[int]) -> dict[int, np.ndarray]:
    """For each length, True for the words inside a window that occurs at least twice.

    A repeated window begins with a repeated shorter one, so each length only looks at the starts of the one before.
    """
    rolling, starts, out = Rolling(codes), None, {}
    for n in sorted(lengths):
        if starts is None or len(starts):
            starts = repeated_starts(codes, n, rolling, starts)
        if not len(starts):
            out[n] = np.zeros(len(codes), dtype=bool)
            continue
        hit = np.zeros(len(codes) + 1, dtype=np.int32)
        hit[starts] += 1
        np.add.at(hit, starts + n, -1)
        out[n] = hit[:-1].cumsum() > 0
    return out


def measure_text(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, coverage in percent by length, and of lines."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    distinct = pa.array(words, pa.binary()).dictionary_encode()
    index = distinct.indices.to_numpy(zero_copy_only=False)
    codes = index.astype(np.uint64)
    chars = pc.utf8_length(distinct.dictionary.cast(pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)[index]
    total = int(chars.sum())
    lines: set[bytes] = set()
    n_dup_lines = line_chars = 0
    for line in raw.split(b"\n"):
        if line in lines:
            n_dup_lines += 1
            line_chars += sum(len(w.decode()) for w in line.split())
        elif line.strip(b" \t\n\r\x0b\x0c"):
            lines.add(line)
    cover = covered(codes, {WINDOW, *COVERAGE})
    repeated = int(cover[WINDOW].sum())
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
    shares = [100.0 * int(chars[cover[k]].sum()) / total if total else 0.0 for k in COVERAGE]
    line_share = 100.0 * line_chars / total if total else 0.0
    kept = not failed and line_share <= MAX_LINE_PERCENT and all(s <= m for s, m in zip(shares, COVERAGE.values()))
    symbols = sum(raw.count(bytes([c])) for c in SYMBOLS)
    return n, total, symbols, n_dup_lines, repeated, failed, kept, shares, line_share


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, coverage array<double>, line_coverage double"
)
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def measure(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and measures of every row."""
    rows = df.select(ref(key).alias("doc_id"), ref(text).alias("_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([measure_text(t) for t in batch["_text"]], columns=_NAMES)
            yield pd.concat([batch[["doc_id"]].reset_index(drop=True), out], axis=1)

    return rows.mapInPandas(run, f"doc_id {dict(rows.dtypes)['doc_id']}, {SCHEMA}")


@query()
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base measures and the verdict of repetition coverage for all documents."""
    return measure(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )

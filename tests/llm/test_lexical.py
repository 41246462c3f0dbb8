"""The K2-treap and the ranked search against plain scoring."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import lexical

SCHEMA = "doc_id long, text string, item_id long, rank int, score string, terms string"


@given(st.dictionaries(st.tuples(st.integers(0, 40), st.integers(0, 70)), st.integers(1, 99), min_size=1, max_size=120))
@settings(max_examples=150, deadline=None)
def test_treap_holds_cells_and_maxima(cells):
    rows, columns, values = (np.array(c) for c in zip(*[(r, c, v) for (r, c), v in cells.items()]))
    treap = lexical.K2Treap(rows, columns, values)
    found = {}

    def walk(node, depth, row, column):
        if depth == treap.depth:
            found[row, column] = int(treap.top[node])
            return int(treap.top[node])
        below = []
        for q in range(4):
            has, children = treap.child(np.array([node]), np.array([q]))
            if len(has):
                below.append(walk(int(children[0]), depth + 1, row * 2 + q // 2, column * 2 + q % 2))
        assert max(below) == treap.top[node]
        return max(below)

    walk(0, 0, 0, 0)
    assert found == cells


@given(
    st.dictionaries(st.tuples(st.integers(0, 9), st.integers(0, 80)), st.integers(1, 3), min_size=1, max_size=200),
    st.lists(st.dictionaries(st.integers(0, 9), st.integers(1, 4), max_size=6), min_size=1, max_size=4),
    st.integers(1, 8),
)
@settings(max_examples=200, deadline=None)
def test_descent_finds_the_best(cells, items, k):
    rows, columns, values = (np.array(c) for c in zip(*[(r, c, v) for (r, c), v in cells.items()]))
    ids = np.arange(100) // 2 * 3  # ascending, with repeats
    items = [{r: w for r, w in item.items() if r in set(rows.tolist())} for item in items]
    rankings = [lexical.Ranking(k) for _ in items]
    lexical.descend(lexical.K2Treap(rows, columns, values), ids, [(np.array(list(i), int), np.array(list(i.values()), int)) for i in items], rankings)
    for item, ranking in zip(items, rankings):
        scores = Counter()
        for (r, c), v in cells.items():
            if r in item:
                scores[c] += item[r] * v
        want = sorted(((-s, int(ids[c])) for c, s in scores.items()))[:k]
        assert sorted((-s, -d) for s, d in ranking.heap) == want


def plain(docs, items, k):
    spell = lambda t: re.findall(lexical.TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    bags = [(i, Counter(spell(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n, total = len(bags), sum(x[2] for x in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in set(items):
        scores = []
        for i, bag, length in bags:
            m = 75 + (25 * length * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m)) for t in spell(text) if t in bag)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if absent else i, -s) for r, (s, absent, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_chars", [1, 300, 10**9])
def test_search_equals_plain_scoring(spark, block_chars):
    draw = np.random.default_rng(4)
    words = ["the", "THE", "été", "Été", "a1", "x", "日本", "don't", "rare", "w-w", "B2", "ßß"]
    docs = [(i, " ".join(draw.choice(words, 1 + i % 17))) for i in range(90)]
    docs += [(i, "the rare copy") for i in range(200, 240)] + [(None, "the rare copy"), (3, "the rare copy"), (3, docs[3][1]), (3, docs[3][1])]
    docs += [(400, None), (401, ""), (402, " .,- \n"), (403, "long " * 20_000 + "rare"), (-5, "été rare")]
    items = [(0, "the rare"), (1, "THE the the x"), (1, "THE the the x"), (2, "nowhere"), (3, None), (4, ""), (5, "été Été 日本, rare!"), (None, "b2 a1"), (6, "copy"), (6, "ßß")]
    df = spark.createDataFrame([(i, t, 1, 1, "s", "t") for i, t in docs], SCHEMA)
    asked = spark.createDataFrame([(7, t, i, 1, "s", "t") for i, t in items], SCHEMA)
    got = [tuple(r) for r in lexical.search(df, asked, block_chars=block_chars).collect()]
    assert sorted(got, key=str) == plain(docs, items, 20)
    some = [tuple(r) for r in lexical.search(df, asked, k=3, block_chars=block_chars).collect()]
    assert sorted(some, key=str) == plain(docs, items, 3)


@given(st.lists(st.integers(0, 2**40) | st.integers(0, 300), min_size=1, max_size=50))
def test_packed_numbers_come_back(values):
    data = lexical.packed(np.array(values))
    assert lexical.unpacked(pa.py_buffer(data), len(values)).tolist() == values
    assert len(data) <= 8 * len(values) and (max(values) > 255 or len(data) == len(values))


def test_blocks_are_packed(spark):
    """Blocks cross the JVM; they take fewer bytes than their texts, and hold every term of every document."""
    draw = np.random.default_rng(5)
    docs = [(i, " ".join(f"w{w}" for w in draw.zipf(1.3, 300) % 5000)) for i in range(400)]
    df = spark.createDataFrame([(i, t, 1, 1, "s", "t") for i, t in docs], SCHEMA)
    seen, size = Counter(), 0
    for block in lexical.index(df, block_chars=100_000).collect():
        size += sum(len(block[c]) for c in ("terms", "found", "columns", "counts"))
        names, found = lexical._grid(bytes(block["terms"]), pa.py_buffer(block["found"]))
        columns, counts = (lexical.unpacked(pa.py_buffer(block[c]), found.sum()) for c in ("columns", "counts"))
        for term, column, count in zip(np.repeat(names.to_pylist(), found).tolist(), columns, counts):
            seen[block["ids"][column], term.decode()] += int(count)
    assert seen == Counter((i, w) for i, t in docs for w in t.split())
    assert size < sum(len(t) for _, t in docs)


def test_empty(spark):
    none, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a b", 2, 1, "s", "t")], SCHEMA)
    assert [lexical.search(a, b).count() for a, b in ((none, none), (none, one), (one, none))] == [0, 0, 0]

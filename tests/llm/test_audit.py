"""The filter audit against plain sets."""

from __future__ import annotations

import re
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import audit

SCHEMA = "doc_id long, text string, source string, part string, failed int, quality int, n string"
LABELS = "doc_id long, quality int, toxic int, good boolean, part string"
IDS = st.lists(st.integers(0, 60), unique=True, max_size=40).map(sorted)


@given(st.lists(IDS, max_size=6), IDS)
@settings(max_examples=300, deadline=None)
def test_lists(lists, other):
    assert audit.union(lists) == sorted(set().union(*lists))
    for ids in lists:
        assert audit.difference(ids, other) == sorted(set(ids) - set(other))
        for value in range(62):
            for start in range(len(ids) + 1):
                assert audit.gallop(ids, start, value) == max(start, sum(i < value for i in ids))


@given(st.lists(st.tuples(st.integers(0, 31), st.booleans(), st.booleans()), max_size=60))
@settings(max_examples=100, deadline=None)
def test_counts_of_a_range(docs):
    failing, good, toxic = (np.array(c, dtype=kind) for c, kind in zip(list(zip(*docs)) or [[], [], []], (int, bool, bool)))
    got = audit.range_counts(failing, good, toxic)
    for (before, f), counts in zip(audit.STEPS, got.tolist()):
        hit = [d for d in docs if d[0] >> f & 1 and not d[0] & before]
        assert counts == [len(hit), sum(d[1] for d in hit), sum(d[2] for d in hit)]


def plain(docs, labels):
    """Rows of the audit, one filter after the other over lists of documents."""
    firsts = {}
    for i, text, _ in docs:
        if i is not None:
            firsts[text or ""] = min(i, firsts.get(text or "", i))
    marks = {}
    for i, quality, toxic in labels:
        a, b = marks.get(i, (False, False))
        marks[i] = a or quality == 1, b or toxic == 1
    parts = {}
    for i, text, source in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and firsts[t] < i,
        }
        parts.setdefault(source or "", []).append((fails, *(marks.get(i, (False, False)) if i is not None else (False, False))))
    out, shapley = {}, {}
    for part, rows in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                unique = sum(r[0][f] and sum(r[0].values()) == 1 for r in rows)
                out[part, order, step] = [len(left), len(gone), sum(r[0][f] for r in rows) - len(gone), unique, sum(r[1] for r in gone), sum(r[2] for r in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("range_size", [1, 7, 65_536])
def test_every_order(spark, range_size):
    long = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", "  ", long, long + " #", "a b a a " * 80, "A B " * 100, long.upper(), "x", "x", "é" * 3000, long, "ab|c " * 90]
    docs = [(i, t, ("s", "t", None, "")[i % 4]) for i, t in enumerate(texts * 4)]
    docs += [(None, long, "s"), (None, "x", "t"), (5, long, "s"), (5, long, "s"), (5, texts[5], "t"), (99, "only here", "u")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 60, 2)] + [(4, 1, 1), (4, 0, 0), (7, None, None), (None, 1, 1)]
    df = spark.createDataFrame([(i, t, s, "p", 9, 9, "n") for i, t, s in docs], SCHEMA)
    marks = spark.createDataFrame([(i, q, None if t is None else int(t), True, "q") for i, q, t in labels], LABELS)
    got = audit.audit(df, marks, range_size=range_size).collect()
    assert len(got) == 600 * 4
    fields = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[f] for f in fields) for r in got} == plain(docs, labels)


def test_one_id_and_one_text_with_most_rows(spark):
    docs = [(7, "same", "s")] * 300 + [(i, "copy " * 300, "s") for i in range(300)] + [(i, f"text {i}", "t") for i in range(50)]
    df = spark.createDataFrame([(i, t, s, "p", 9, 9, "n") for i, t, s in docs], SCHEMA)
    got = audit.audit(df, spark.createDataFrame([], LABELS), range_size=64).collect()
    fields = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[f] for f in fields) for r in got} == plain(docs, [])


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert audit.audit(none, spark.createDataFrame([], LABELS)).count() == 0

"""The training-data operators against plain Python, on small fixtures."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, chat, language, licenses, mixing, neighbours, pii, quality, sharding, simhash
from ledgerloom.llm.components import components

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard int, print string, ids string"
TEXTS = [None, "", "  ", "Hello  world \n\n  x", "a" * 5000, "Été  ça　l'été\tdon't\r\n 123 4!", "the same", "the same", "#* $%", "   lead", "trail   "]


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def docs(spark, texts, sources=("a", "b", None)):
    """Documents whose extra columns clash with names the operators use."""
    rows = [(i, t, "en", sources[i % len(sources)], 0, 1, 1, "p", "i") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs in every column, repeated rows, ties, a long text."""
    rows = [(i, t, "en", "s", 0, 1, 1, "p", "i") for i, t in enumerate(TEXTS)]
    rows += [(None, "no id", None, None, None, None, None, None, None), (3, "again", "de", "s", 1, 1, 1, "p", "i"), (4, TEXTS[4], "en", "s", 0, 1, 1, "p", "i")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 1 sharding


@given(st.lists(st.integers(1, 60), max_size=60), st.integers(60, 90))
@settings(max_examples=60, deadline=None)
def test_best_fit_takes_the_tightest_bin(sizes, capacity):
    sizes = sorted(sizes, reverse=True)
    left, want = [], []
    for s in sizes:
        fits = [(r, b) for b, r in enumerate(left) if r >= s]
        if fits:
            b = min(fits)[1]
        else:
            b, left = len(left), [*left, capacity]
        left[b] -= s
        want.append(b)
    assert sharding.best_fit(sizes, capacity) == want


def test_even_bins_isolate_a_giant():
    bins = sharding.even_bins([1000, *[10] * 60], 4)
    loads = np.bincount(bins, weights=[1000, *[10] * 60])
    assert loads.tolist() == [1000, 200, 200, 200]


def test_shards(spark, odd):
    got = sharding.pack_even(odd, 3).collect()
    assert len(got) == odd.count()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    for r in got:
        if r["doc_id"] not in (3, None):
            raw = (texts[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert len({r["shard"] for r in got if r["size"] == 8}) == 1  # NULL and empty are one group


def test_shards_of_many_groups_are_even(spark):
    texts = [f"{i % 4000} " * (1 + i % 9) for i in range(12_000)]
    got = sharding.pack_even(docs(spark, texts), 24)
    loads = [r["b"] for r in got.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(loads) == 24 and max(loads) - min(loads) <= 0.002 * max(loads)
    assert got.groupBy("text_crc32", "size").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0


def test_slots_do_not_hang_on_the_cluster(spark):
    df = docs(spark, [f"{i % 300} " * (1 + i % 9) for i in range(2000)])
    took = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions in ("4", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        took.append(sorted((r["doc_id"], r["shard"], r["slot"]) for r in sharding.pack_even(df, 5).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert took[0] == took[1]


def test_fixed_capacity(spark, empty):
    got = sharding.pack_capacity(docs(spark, [f"{i}" * (1 + i % 50) for i in range(3000)]), 2000)
    loads = [r["b"] for r in got.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert max(loads) <= 2000 and len(loads) <= 1.1 * sum(loads) / 2000 + 2
    assert sharding.pack_even(empty, 3).count() == sharding.pack_capacity(empty, 10).count() == 0


# 2 byte-level BPE


@pytest.fixture(scope="module")
def reference_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("reference", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("block_chars", [1, 40, 10**9])
def test_bpe_equals_the_library(spark, odd, reference_encoding, block_chars):
    coded = bpe.encode(odd, RANKS, public_tokenizers.PATTERN, block_chars=block_chars, buckets=3)
    got = sorted((str(r["doc_id"]), r["ids"], bytes(r["bytes"])) for r in bpe.decode(coded, RANKS).collect())
    want = sorted((str(r["doc_id"]), reference_encoding.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()) for r in odd.collect())
    assert got == want
    at_once = bpe.encode(odd, RANKS, public_tokenizers.PATTERN, block_chars=block_chars, buckets=3, spelled=True)
    assert sorted((str(r["doc_id"]), r["ids"], bytes(r["bytes"])) for r in at_once.collect()) == want
    digests = bpe.digests(odd, RANKS, public_tokenizers.PATTERN, block_chars=block_chars, buckets=3).collect()
    sha = lambda data: hashlib.sha256(data).hexdigest()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in digests) == sorted(
        (key, len(ids), sha(",".join(map(str, ids)).encode()), sha(data)) for key, ids, data in want
    )


@pytest.mark.parametrize("step", [1, 2, 1 << 20])
def test_digests_in_slices(monkeypatch, reference_encoding, step):
    monkeypatch.setattr(bpe, "DIGEST_IDS", step)
    ids = [reference_encoding.encode_ordinary(t) for t in ("", "the cat sat on the mat", "é", "")]
    got = bpe._digest(RANKS)(bpe.pa.array(ids, bpe.pa.list_(bpe.pa.int32())))
    assert got["ids_sha256"].to_pylist() == [hashlib.sha256(",".join(map(str, one)).encode()).hexdigest() for one in ids]
    assert got["decoded_sha256"].to_pylist() == [hashlib.sha256(reference_encoding.decode_bytes(one)).hexdigest() for one in ids]


@given(st.text(alphabet=st.sampled_from(" \n\t　ab1é'!s"), max_size=40))
@settings(max_examples=300, deadline=None)
def test_blocks_cut_like_the_pattern(text):
    import regex

    block = bpe.Block(public_tokenizers.PATTERN)
    block.add(text)
    names = list(block.words)
    assert [names[i] for i in next(iter(block.numbers()))] == regex.findall(public_tokenizers.PATTERN, text)


def test_bpe_edges(spark, empty):
    assert bpe.digests(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), RANKS).orderBy("doc_id").collect() == [(1, None, None), (2, [], b"")]


# 3 quality rules


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = {n: [tuple(words[i : i + n]) for i in range(len(words) - n + 1)] for n in (4, 6, 8, 12)}
    cover = {}
    for n, g in grams.items():
        hit = {i + k for i, x in enumerate(g) if g.count(x) > 1 for k in range(n)}
        cover[n] = hit
    chars = sum(map(len, words))
    lines, seen, dup, dup_chars = (text or "").split("\n"), set(), 0, 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            if line in seen:
                dup += 1
                dup_chars += sum(map(len, re.findall(r"[^\x20\x09-\x0D]+", line)))
            seen.add(line)
    failed = len(words) < 20 or 100 * len(cover[8]) > 30 * len(words)
    bad = any(100 * sum(len(words[i]) for i in cover[n]) > m * chars for n, m in quality.COVERAGE.items())
    kept = not failed and not bad and 100 * dup_chars <= quality.MAX_LINE_PERCENT * chars
    return len(words), chars, sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(cover[8]), failed, kept


@given(st.lists(st.sampled_from(["a", "bé", "c#", "\n", "d", "　", "e f g h", "a bé c# d\n"]), max_size=80).map(" ".join))
@settings(max_examples=150, deadline=None)
def test_quality_equals_plain_counting(text):
    assert quality.measure_text(text)[:7] == plain_quality(text)


def test_quality_rows(spark, odd, empty):
    got = {r["doc_id"]: r for r in quality.measure(odd).collect()}
    assert got[0]["n_words"] == 0 and got[0]["base_failed"] and not got[0]["kept"]
    assert quality.measure(odd).count() == odd.count() and quality.measure(empty).count() == 0


def test_colliding_hashes_do_not_count(monkeypatch):
    codes = np.arange(50, dtype=np.uint64)
    rolling = quality.Rolling(codes)
    monkeypatch.setattr(quality.Rolling, "of", lambda self, n: np.zeros(len(codes) - n + 1, dtype=np.uint64))
    assert len(quality.repeated_starts(codes, 4, rolling)) == 0


# 4 SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(prints, ids):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(prints))]


@pytest.mark.parametrize("tile", [3, simhash.TILE])
def test_links_have_the_closure_of_all_links(spark, tile):
    rng = random.Random(5)
    prints = [0]
    for _ in range(6):  # chains and dense balls
        centre = rng.getrandbits(64)
        prints += [centre] + [centre ^ sum(1 << b for b in rng.sample(range(12), rng.randint(0, 4))) for _ in range(40)]
    prints = sorted(set(prints + [rng.getrandbits(64) for _ in range(100)]))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    roots = components(simhash.links(spark.createDataFrame([(p,) for p in signed], "print long"), tile))
    root = {r["node"]: r["root"] for r in roots.collect()}
    groups = plain_groups(prints, list(range(len(prints))))
    got = {}
    for p, g in zip(signed, groups):
        got.setdefault(root.get(p, p), set()).add(g)
    assert all(len(g) == 1 for g in got.values()) and len(got) == len(set(groups))


def test_simhash_rows(spark, odd, empty):
    rows = odd.collect()
    prints = [plain_fingerprint(r["text"]) for r in rows]
    want = sorted((str(r["doc_id"]), f"{p:016x}", str(g)) for r, p, g in zip(rows, prints, plain_groups(prints, [r["doc_id"] for r in rows])))
    got = sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in simhash.near_duplicates(odd).collect())
    assert got == want
    assert simhash.near_duplicates(empty).count() == simhash.keep_first(empty).count() == 0


def test_one_row_of_each_group_stays(spark, odd):
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    rows = odd.collect()
    prints = [plain_fingerprint(r["text"]) for r in rows]
    groups = plain_groups(prints, list(range(len(rows))))
    assert kept.count() == len(set(groups))
    assert {r["doc_id"] for r in kept.collect()} == {min((rows[i]["doc_id"] is None, rows[i]["doc_id"] or 0) for i, x in enumerate(groups) if x == g)[1] if any(rows[i]["doc_id"] is not None for i, x in enumerate(groups) if x == g) else None for g in set(groups)}


@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), max_size=25))
@settings(max_examples=4, deadline=None)
def test_components(spark, edges):
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


# 5 language


def test_languages_held_out(spark):
    rng, words = random.Random(1), {"en": "the of and to that is", "de": "der und die nicht ein zu", "fr": "le les des que une pas", "es": "el los de que una por"}
    rows = [(i, " ".join(rng.choices(words[c].split(), k=30)), c) for i, c in ((i, list(words)[i % 4]) for i in range(400))]
    rows += [(500, None, "en"), (501, "12 !?", "de"), (502, "", None), (None, "the of and", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, language.fold() != 2)
    got = {r["doc_id"]: r for r in language.identify(df, model).collect()}
    held = [r for r in rows[:400] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(held) > 50 and sum(got[i]["lang_pred"] == c for i, _, c in held) >= 0.97 * len(held)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (500, 501, 502))
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[None]["lang_pred"] == "en"


def test_an_unlabelled_corpus_keeps_its_documents(spark):
    df = docs(spark, ["the cat", "123", None, "", "été"]).withColumn("lang", F.lit(None).cast("string"))
    learned = language.sampled(df, F.lit(True))
    keep = language.keeper(language.train(learned), language.usual(learned, language.sampled(df, F.lit(True))))
    assert sorted(r["text"] for r in df.where(keep(F.col("text"))).collect()) == ["the cat", "été"]


def test_languages_without_labels_or_with_one(spark, empty):
    assert language.identify(empty, language.fit(empty, language.fold() != 2)).count() == 0
    df = spark.createDataFrame([(0, "abc", "tlh"), (1, "abd", "tlh"), (2, "xyz", None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.identify(df, language.fit(df, F.lit(True))).collect()} == {"tlh"}
    assert {r["lang_pred"] for r in language.identify(df, language.fit(df, F.lit(False))).collect()} == {"und"}


# 6 chat


HARD = ["", "plain", "[INST]", "[/INST] x </s>", r"[\INST] and [INST]", r"back\slash </s> \\", "<s>[OUT:1]", r"<\/s>", "a]b[ROLE:0:41]"]


def test_chat_round_trip(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool]", "", None]), rng.choice([*HARD, None])) for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(7, 0, "user", "tie"), (7, 0, "user", "tie"), (None, None, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    want = {}
    for c, t, r, x in rows:
        want.setdefault(c, []).append((t, r or "", x or ""))
    for r in chat.format_conversations(df).collect():
        assert r["identical"]
        turns = sorted(want[r["conv_id"]], key=lambda t: (t[0] is not None, t))
        assert [tuple(t) for t in r["turns"]] == [t[1:] for t in turns]


def test_chat_escapes_only_conflicts(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "</s>"), (2, 0, "user", r"<\/s></s>")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["formatted"] for r in chat.format_conversations(df).collect()}
    assert got == {1: r"<s>[INST]hi[/INST][OUT:1]<\/s></s>", 2: r"<s>[INST:2]<\\/s><\/s>[/INST]"}
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_native_operators_run_no_python(spark, odd):
    for df in (
        chat.format_conversations(spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")),
        mixing.mix(odd, weights=(5, 2, 1)),
        licenses.scan_licenses(odd.withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string")))),
    ):
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", df._jdf.queryExecution().executedPlan().toString())


# 7 licences


def test_licenses_and_inheritance(spark):
    rows = [
        ("LICENSE", "Released under the MIT License."),
        ("a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("a/b/c/x.py", "code"),
        ("a/b/c/own.py", "# Licensed under the Apache License, Version 2.0.\ncode"),
        ("a/z.py", None),
        ("a/z.py", None),
        ("y", ""),
        (None, "Released under the MIT License."),
        ("a/odd", "copyright of nothing known whatsoever"),
    ]
    df = spark.createDataFrame(rows, "path string, text string").withColumn("license", F.lit("clash"))
    got = sorted((str(r["path"]), r["license"], r["via"]) for r in licenses.scan_licenses(df).collect())
    assert got == sorted(
        [
            ("LICENSE", "MIT", "own"),
            ("a/b/COPYING", "GPL-3.0", "own"),
            ("a/b/c/x.py", "GPL-3.0", "inherited"),
            ("a/b/c/own.py", "Apache-2.0", "own"),
            ("a/z.py", "MIT", "inherited"),
            ("a/z.py", "MIT", "inherited"),
            ("y", "MIT", "inherited"),
            ("None", None, "none"),
            ("a/odd", "MIT", "inherited"),
        ]
    )
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_license_query_carries_null_ids(spark, tmp_path):
    rows = [(None, "Released under the MIT License.", "s"), (None, None, None), (5, "Released under the MIT License.", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in licenses.op7_license_scan(spark, str(tmp_path)).select("doc_id", "license", "via").collect()]
    assert sorted(got, key=str) == [(5, "MIT", "own"), (None, None, "none"), (None, None, "none")]


# 8 neighbours


def plain_nearest(rows, k):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    out = {}
    for q in good:
        if q % 100 == 0:
            found = sorted((float(np.sqrt(((v - good[q]) ** 2).sum())), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            out[q] = found[:k]
    return out


def test_recall_and_ties(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(12).tolist()) for i in range(1500)]
    same = rng.standard_normal(12).tolist()
    rows += [(5000 + i, same) for i in range(300)]
    rows += [(9000, None), (9100, [0.0] * 12), (9200, [float("nan")] * 12), (9300, [None] * 12), (9400, []), (None, same), (9500, [1.0, 2.0]), (9501, [1.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").union(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>"))
    got = {}
    for r in neighbours.nearest(df, F.col("id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    want = plain_nearest(rows, 10)
    assert set(got) == set(want)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    assert [i for _, i in got[5000]] == [i for _, i in want[5000]] and len(got[9500]) == 1


def test_no_vectors(spark):
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 100 == 0).count() == 0


# 9 mixing


def plain_targets(sizes, weights, share, epochs):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[n] for n in open_)
        over = {n for n in open_ if left * weight[n] / total > epochs * sizes[n]}
        if not over:
            target |= {n: left * weight[n] / total for n in open_}
            break
        target |= {n: epochs * sizes[n] for n in over}
        left -= sum(target[n] for n in over)
        open_ -= over
    return target


def test_targets_and_draws(spark):
    rng = random.Random(4)
    texts = [" ".join("w" * rng.randint(0, 40)) for _ in range(3000)]
    df = docs(spark, texts, ("a", "a", "a", "b", "c", "d", None, "é"))
    got = mixing.mix(df, weights=(5, 2, 1), share=1.5, epochs=2).collect()
    assert sorted(r["taken"] for r in got) == sorted(r["taken"] for r in mixing.mix(df, weights=(5, 2, 1), share=1.5, epochs=2).collect())
    sizes, taken = {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    want = plain_targets(sizes, (5, 2, 1), 1.5, 2)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    assert all(abs(taken[s] - want[s]) <= 40 for s in want)
    out = mixing.repeat(df, weights=(5, 2, 1), share=1.5, epochs=2)
    assert out.columns == df.columns and out.count() == sum(r["copies"] for r in got)


def test_mix_edges(spark, odd, empty):
    assert mixing.mix(odd, weights=(1,)).count() == odd.count()
    assert mixing.mix(empty).count() == mixing.repeat(empty).count() == 0
    assert {r["taken"] for r in mixing.mix(docs(spark, [None, "", " "])).collect()} == {0}


# 10 personal data


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


@given(st.lists(st.sampled_from(["a@b.c", "@", ".", "1.2.3.4", "4111111111111111", " ", "+1 (222) 333-4444", "-", "é", "999", "x", "+", "1", "0"]), max_size=25).map("".join))
@settings(max_examples=400, deadline=None)
def test_base_spans_equal_the_plain_patterns(text):
    want = sorted((m.start(), pii.KINDS.index(k), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if pii.passes(k, m[0]))
    assert [(a, pii.KINDS.index(k), b) for a, b, k in pii.base_spans(text)] == want


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1 " * 60_000, "a@a" * 60_000):
        pii.find(text, {})


@given(
    st.lists(st.tuples(st.integers(0, 40), st.integers(1, 9), st.sampled_from(pii.KINDS)).map(lambda s: (s[0], s[0] + s[1], s[2])), max_size=15),
    st.lists(st.tuples(st.integers(0, 40), st.integers(1, 12)).map(lambda s: (s[0], s[0] + s[1])), max_size=8),
    st.lists(st.tuples(st.integers(0, 40), st.integers(1, 9), st.sampled_from(pii.KINDS)).map(lambda s: (s[0], s[0] + s[1], s[2])), max_size=15),
)
@settings(max_examples=300, deadline=None)
def test_labels_of_candidates_equal_the_plain_rule(spans, swallowed, base):
    want = []
    for start, end, kind in spans:
        if not any(a <= start and end <= b and b - a > end - start for a, b in swallowed):
            hit = any(k == kind and a <= start <= a + 4 and end <= b and end - start >= 0.7 * (b - a) for a, b, k in base)
            want.append(((start, end, kind), float(hit)))
    assert list(pii._labelled(spans, base, swallowed)) == want
    reach = pii.Reach(base)
    for start, end, _ in spans:
        assert (reach.before(end) > start) == any(start < b and a < end for a, b, _ in base)


def test_two_million_characters_of_numbers(spark):
    """Finding and learning both stay within seconds."""
    models = pii.learn(docs(spark, pii_docs(1500)))
    for unit in ("10.1.2.3 ", "+1 (222) 555-1234 ", "2020 2021 2022 "):
        text = unit * (2_000_000 // len(unit))
        started = time.monotonic()
        base, spans = pii.find(text, models)
        assert time.monotonic() - started < 30 and len(spans) >= len(base)
    text = "10.1.2.3 4000000000000002 " * 75_000
    started = time.monotonic()
    assert len(list(pii._labelled(pii.candidates(text), pii.base_spans(text), pii._swallowed(text)))) > 0
    assert time.monotonic() - started < 30
    redacted = docs(spark, [text]).select(pii.redactor(models)("text")).first()[0]
    assert redacted.count("[IP]") == 75_000


def test_the_sample_never_becomes_empty(spark):
    spots = spark.range(200_000).select(F.xxhash64("id").alias("spot"))
    for total in (50_000, 400_000, 4_000_000):
        share = spots.where(pii.sampled(F.col("spot"), total)).count() / 200_000
        assert abs(share - min(1, pii.SAMPLE_DOCS / total)) < 0.02
    limit = pii.SAMPLE_DOCS * 2**40 / 10**11
    assert 495 <= spark.range(1000).where(pii.sampled(F.col("id") * F.lit(int(limit / 500)), 10**11)).count() <= 505


def pii_docs(n):
    rng = random.Random(6)
    digit = lambda k: "".join(rng.choices("0123456789", k=k))

    def card():
        body = "4" + digit(14)
        return next(body + str(c) for c in range(10) if pii.luhn(body + str(c)))

    out = []
    for _ in range(n):
        phone = f"+1 ({digit(3)}) 555-{digit(4)}"
        out.append(rng.choice([f"call {phone} now", f"pay {card()} today", f"mail ab.{digit(2)}@mail{digit(1)}.example.com ok", f"id {digit(16)} ref {digit(14)}", f"on {digit(3)} {digit(3)} {digit(4)} we", f"{phone} {card()}"]))
    return out


def test_trees_find_what_the_rules_swallow(spark):
    texts = pii_docs(1500)
    df = docs(spark, texts)
    models = pii.learn(df)
    assert "card" in models
    missed = 0
    for r in pii.scan(df, models).collect():
        text = texts[r["doc_id"]]
        base = [f"{k}:{a}:{b}" for a, b, k in pii.base_spans(text)]
        assert set(base) <= set(r["spans"].split(",")) | {""} and r["base"] == ",".join(base)
        if m := re.fullmatch(r"(\+1.*\d{4}) (\d{16})", text):
            missed += f"card:{m.start(2)}:{m.end(2)}" not in r["spans"]
    assert missed <= 5


def test_pii_rows(spark, odd, empty):
    models = pii.learn(odd)
    assert pii.scan(odd, models).count() == odd.count() and pii.scan(empty, pii.learn(empty)).count() == 0
    df = spark.createDataFrame([(1, "mail a@b.cd or 1.2.3.4!"), (2, None)], "doc_id long, text string")
    got = [r[0] for r in df.select(pii.redactor({})("text")).collect()]
    assert got == ["mail [EMAIL] or [IP]!", None]


def test_without_a_model_nothing_is_added():
    text = "in 2020 2021 2022, e.g. 3.14 @ U.S.A, id 4000000000000002x +1 (222) 555-1234"
    base, spans = pii.find(text, {})
    assert spans == base != []
    good = ["a.b@c.de", "a.b @ c.de", "ab (at) mail [dot] example.com", "ab at mail dot com"]
    assert all(pii.passes("email", t) for t in good) and not any(pii.passes("email", t) for t in ("e.g", "U.S", "3.14", "a@b", "mail.example.com"))


def test_a_full_document_and_a_rare_kind_do_not_decide(spark):
    lows = spark.range(3000).orderBy(F.xxhash64("id", F.lit(11))).limit(1).collect()[0][0]
    rng = random.Random(3)
    digit = lambda k: "".join(rng.choices("0123456789", k=k))
    texts = [f"call +1 ({digit(3)}) 555-{digit(4)} now" if i % 25 == 0 else f"ref {digit(7)} and {digit(8)}" for i in range(3000)]
    texts[lows] = " x ".join(digit(8) for _ in range(6000))
    models = pii.learn(docs(spark, texts))
    assert "phone" in models
    # negatives stand for more candidates than positives, so the probability of a plain run stays low
    assert [s for t in texts[1:200:2] for s in pii.find(t, models)[1] if s[2] == "phone"] == [s for t in texts[1:200:2] for s in pii.base_spans(t) if s[2] == "phone"]


def test_one_id_with_different_vectors(spark):
    rows = [(i, [float(i), 1.0]) for i in range(40)] + [(0, [39.0, 1.0]), (8, [8.0, 1.0]), (8, [-50.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("id") == 0, k=5).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 1, 1.0), (2, 2, 2.0), (3, 3, 3.0), (4, 4, 4.0), (5, 5, 5.0)]
    far = neighbours.nearest(df, F.col("id") == 0, k=60).collect()
    assert len(far) == 39 and {r["score"] for r in far if r["vec_id"] == 8} == {50.0}

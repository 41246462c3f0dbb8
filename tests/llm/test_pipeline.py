"""The corpus pipeline against plain steps over its own stages, and its odd inputs."""

from __future__ import annotations

import hashlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SMALL = "/root/testdata/sf0.001"


def test_each_stage_acts_on_all_it_gets(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SMALL).cache()
        seen[name] = (before, docs)
        if name != "bpe":
            assert docs.columns == columns
    before, after = seen["language"]
    assert before.exceptAll(after).where("text rlike '[a-z]{3}'").count() == 0
    before, after = seen["near_copies"]
    assert after.count() == after.select("text").distinct().count() == before.select("text").distinct().count()
    before, after = seen["personal_data"]
    assert after.count() == before.count() and after.where("text rlike '[a-z]@[a-z0-9]+[.]'").count() == 0
    before, after = seen["mixing"]
    assert after.exceptAll(before.unionAll(before)).count() == 0
    before, after = seen["bpe"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    assert after.count() == before.count()
    for r in after.collect():
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_nulls_and_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "the cat sat", "en", None, 11), (2, "the cat sat", "en", None, 11)]
    for name, data in (("odd", rows), ("empty", [])):
        folder = tmp_path / name
        spark.createDataFrame(data, schema).write.parquet(str(folder / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(folder))
        assert set(out.columns) >= {"doc_id", "n_tokens"}
        assert {r["doc_id"] for r in out.collect()} <= {2}


def test_gibberish_and_unknown_languages_go(spark):
    import random

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    draw = random.Random(5)
    junk = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz     ", k=n)) for n in (60, 200, 1000) for _ in range(10)]
    junk += ["Magyarország közép-európai ország a Kárpát-medencében, fővárosa Budapest.", "Русский язык является одним из восточнославянских языков"]
    bad = spark.createDataFrame([(-1 - i, t, None, "junk", len(t)) for i, t in enumerate(junk)], "doc_id long, text string, lang string, source string, n_chars long")
    clean = docs.where("text rlike '[a-z]{3}'")
    kept = dict(corpus_pipeline.STAGES)["language"](spark, docs.unionByName(bad.select(*docs.columns)), SMALL).cache()
    assert kept.where("doc_id < 0").count() == 0
    assert clean.exceptAll(kept).count() == 0

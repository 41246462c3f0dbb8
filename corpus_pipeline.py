"""The training corpus in five stages, each written as Parquet and read again.

``run`` applies them to ``documents``. All but the last return the columns of
documents. Stages: languages (rejected documents go), near copies (the first of
each group stays), personal data (replaced in the text), source mixing (documents
are repeated or left out), byte-level BPE (ids and digests).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, language, mixing, pii, simhash
from ledgerloom.session import shared_dir


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or unlike what is usual in the language predicted for them, go.

    What is usual follows from labelled documents that the model didn't learn from.
    """
    learned = language.sampled(docs, language.fold() != 2)
    usual = language.usual(learned, language.sampled(docs, language.fold() == 2))
    return docs.where(language.keeper(language.train(learned), usual)(F.col("text")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return simhash.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data becomes its kind in brackets; ``n_chars`` follows."""
    clean = docs.withColumn("text", pii.redactor(pii.learn(docs))(F.col("text")))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion 5, 2, 1 of 150 % of all words, at most two epochs of each."""
    return mixing.repeat(docs, weights=(5, 2, 1), share=1.5, epochs=2)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes decoded from them."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language", languages),
    ("near_copies", near_copies),
    ("personal_data", personal_data),
    ("mixing", mixed_sources),
    ("bpe", tokens),
]

#: The trained stages have no SQL form; tests compare ``run`` with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs

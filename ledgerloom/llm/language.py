"""Language identification: family first, then one-versus-one linear SVMs.

A text is the hashed counts of its character bigrams and trigrams, lower-cased,
square-rooted and scaled to length one, over the whole text. One linear support
vector machine per pair of families decides the family; within it one per pair
of languages decides the language. Each pair is trained in its own Spark task on
a bounded sample: at most ``PER_LANGUAGE`` labelled rows of a language, chosen by
a hash of the key. Everything else covers all rows.

A pair's margin becomes a number from 0 to 1 by a logistic curve; a class's share
is the mean over its pairs, and the score is the share of the family times that
of the language. Texts that are NULL or hold no letter are ``und`` with score 0,
and so is everything if there is no labelled row. Shares compare the classes with each
other: the best one is a half at least, whatever the text is. Whether a text is in
its language at all is told by its fit (see ``Usual``). Rows without label or key are
not learned from. Repeated rows are predicted each, an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from ledgerloom.functions.columns import ref
from ledgerloom.llm.common import query, release, staged, table

#: Labelled rows of a language that are learned from, at most.
PER_LANGUAGE = 400
#: Hashed features.
FEATURES = 4096
#: A text's fit counts grams that a language never showed as if they had this share.
UNSEEN = 1e-5
#: Labelled rows that a language needs before its own fits say what is usual.
MIN_HELD = 20
#: Passes over the sample, and the weight of its errors.
EPOCHS, COST = 20, 10.0

#: Languages by family (ISO 639-1). A language not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
UNKNOWN = "und"
_NUMBER = re.compile(r"[\d@]")


def family(language: str) -> str:
    return _FAMILY.get(language, f"={language}")


def features(text: str) -> np.ndarray:
    """The text as a vector of length one."""
    chars = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
    pairs = chars[:-1] * np.uint32(0x9E3779B1) ^ chars[1:] * np.uint32(0x85EBCA77)
    triples = pairs[:-1] * np.uint32(0xC2B2AE3D) ^ chars[2:] * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - (FEATURES.bit_length() - 1))
    counts = np.zeros(FEATURES)
    for grams in (pairs, triples):
        counts += np.bincount((grams * np.uint32(0x165667B1)) >> shift, minlength=FEATURES)
    counts = np.sqrt(counts, out=counts)
    norm = np.sqrt(counts @ counts)
    return (counts / norm if norm else counts).astype(np.float32)


def words(text: str) -> np.ndarray:
    """The vector of the words that hold neither a digit nor an @, which say nothing of a language; of the text if there is no other."""
    return features(" ".join(w for w in text.split() if w.isalpha() or not _NUMBER.search(w)) or text)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def train_svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias of a linear SVM (squared hinge loss) by dual coordinate descent; y is 1 or -1."""
    x = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    weights, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    diagonal = (x * x).sum(axis=1) + 1 / (2 * COST)
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(x)):
            slope = y[i] * (weights @ x[i]) - 1 + alpha[i] / (2 * COST)
            new = max(0.0, alpha[i] - slope / diagonal[i])
            if new != alpha[i]:
                weights += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return weights


@dataclass(frozen=True)
class Model:
    """Pairs of classes with their weights; classes are families or, within one, languages."""

    families: dict[str, list[str]]
    pairs: dict[tuple[str, str], np.ndarray]

    def _shares(self, classes: list[str], x: np.ndarray) -> np.ndarray:
        shares = np.zeros((len(x), len(classes)))
        for i, j in combinations(range(len(classes)), 2):
            weights = self.pairs[classes[i], classes[j]]
            p = 1 / (1 + np.exp(-4 * (x @ weights[:-1] + weights[-1])))
            shares[:, i] += p
            shares[:, j] += 1 - p
        return shares / (len(classes) - 1) if len(classes) > 1 else shares + 1

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of texts that hold a letter."""
        names = sorted(self.families)
        if not names or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        return self.predict_vectors(np.stack([features(t) for t in texts]))

    def predict_vectors(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        names = sorted(self.families)
        shares = self._shares([f"family {n}" for n in names], x)
        first, score = shares.argmax(axis=1), shares.max(axis=1)
        out = np.empty(len(x), dtype=object)
        for f, name in enumerate(names):
            rows, languages = np.flatnonzero(first == f), self.families[name]
            if len(rows):
                within = self._shares(languages, x[rows])
                out[rows] = np.array(languages, dtype=object)[within.argmax(axis=1)]
                score[rows] *= within.max(axis=1)
        return out.tolist(), score


def sampled(df: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """label, x, words: vectors of at most ``PER_LANGUAGE`` texts of each language, of rows where ``learn`` holds and label and key aren't NULL. Runs jobs."""
    labelled = df.where(learn & ref(label).isNotNull() & ref(key).isNotNull() & ref(text).isNotNull()).select(
        ref(label).cast("string").alias("label"), F.xxhash64(ref(key), F.lit(7)).alias("spot"), ref(text).alias("text")
    )
    # Staged: a row per language, whose size Spark then knows, so that the texts need not move to meet it.
    counts = staged(labelled.groupBy("label").count())
    # Twice the sample by hash, so that ranking sees few rows of a language however many there are.
    likely = F.pmod("spot", F.lit(1 << 20)) * F.col("count") < F.lit(2 * PER_LANGUAGE << 20)
    few = labelled.join(counts, "label").where(likely | (F.col("count") <= 2 * PER_LANGUAGE))
    rank = F.row_number().over(W.partitionBy("label").orderBy("spot", "text"))
    sample = few.withColumn("rank", rank).where(F.col("rank") <= PER_LANGUAGE).select("label", "text")

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["text"].map(has_letter).astype(bool)]
            yield pd.DataFrame({"label": batch["label"], **{k: [f(t).tobytes() for t in batch["text"]] for k, f in (("x", features), ("words", words))}})

    return staged(sample.mapInPandas(vectors, "label string, x binary, words binary"))


def fit(df: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "lang") -> Model:
    """Learn from the rows where ``learn`` holds and label and key aren't NULL. Runs jobs; weights of the pairs come to the driver."""
    return train(sampled(df, learn, key, text, label))


def train(sample: DataFrame) -> Model:
    """A model of the vectors of ``sampled``. Runs jobs."""
    languages = sorted(r["label"] for r in sample.select("label").distinct().collect())
    families: dict[str, list[str]] = {}
    for code in languages:
        families.setdefault(family(code), []).append(code)
    groups = {f"family {n}": codes for n, codes in families.items()}
    problems = [(a, b, groups[a], groups[b]) for a, b in combinations(sorted(groups), 2)]
    problems += [(a, b, [a], [b]) for codes in families.values() for a, b in combinations(codes, 2)]
    # one row per pair and language: a table whose size depends on the languages alone
    roles = [(f"{a}\n{b}", code, side) for a, b, left, right in problems for codes, side in ((left, 1), (right, -1)) for code in codes]

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.frombuffer(v, dtype=np.float32) for v in part["x"]])
        return pd.DataFrame({"pair": part["pair"].iloc[:1], "weights": [train_svm(x, part["side"].to_numpy(dtype=np.float64)).tobytes()]})

    pairs = {}
    if roles:
        dealt = sample.sparkSession.createDataFrame(roles, "pair string, label string, side int")
        for r in sample.drop("words").join(F.broadcast(dealt), "label").groupBy("pair").applyInPandas(solve, "pair string, weights binary").collect():
            pairs[tuple(r["pair"].split("\n"))] = np.frombuffer(r["weights"])
    return Model(families, pairs)


@dataclass(frozen=True)
class Usual:
    """How well texts fit the language they are in.

    The fit of a text is the mean, over the grams of its ``words``, of the binary logarithm of the
    gram's share in the language against an even spread: below zero for letters
    at random. ``least`` is the smallest fit that still counts as the language.
    """

    gains: dict[str, np.ndarray]
    least: dict[str, float]

    def fits(self, languages: list[str], x: np.ndarray) -> np.ndarray:
        return np.array([np.square(v.astype(np.float64)) @ self.gains[code] for v, code in zip(x, languages)])

    def within(self, languages: list[str], x: np.ndarray) -> np.ndarray:
        return self.fits(languages, x) >= [self.least.get(code, -np.inf) for code in languages]


def usual(learned: DataFrame, held: DataFrame) -> Usual:
    """Shares of grams from the vectors ``learned``, least fits from those ``held`` out. Runs jobs; a row per language comes to the driver.

    The least fit is the lowest hundredth of the language's held-out fits, less half of
    it or half a bit. A language with fewer than ``MIN_HELD`` held-out rows takes the
    lowest of the others; if there is none, nothing is too low.
    """

    def shares(part: pd.DataFrame) -> pd.DataFrame:
        mean = np.mean([np.square(np.frombuffer(v, dtype=np.float32).astype(np.float64)) for v in part["words"]], axis=0)
        return pd.DataFrame({"label": part["label"].iloc[:1], "gains": [np.log2((mean + UNSEEN) * FEATURES).tobytes()]})

    rows = learned.drop("x").groupBy("label").applyInPandas(shares, "label string, gains binary").collect()
    gains = {r["label"]: np.frombuffer(r["gains"]) for r in rows}

    def lowest(part: pd.DataFrame) -> pd.DataFrame:
        known = part[part["label"].isin(gains)]
        if len(known) < MIN_HELD:
            return pd.DataFrame({"label": [], "low": []}).astype({"label": object, "low": float})
        fits = Usual(gains, {}).fits(known["label"].tolist(), [np.frombuffer(v, dtype=np.float32) for v in known["words"]])
        return pd.DataFrame({"label": known["label"].iloc[:1], "low": [float(np.quantile(fits, 0.01))]})

    lows = {r["label"]: r["low"] for r in held.drop("x").groupBy("label").applyInPandas(lowest, "label string, low double").collect()}
    least = {code: low - max(abs(low) / 2, 0.5) for code, low in lows.items()}
    return Usual(gains, {code: least.get(code, min(least.values())) for code in gains} if least else {})


def keeper(model: Model, usual: Usual):
    """A column function: whether a text has a letter and fits the language predicted for it.

    If nothing was learned (no row has a label), every text with a letter is kept.
    """

    @F.pandas_udf(BooleanType())
    def keep(texts: pd.Series) -> pd.Series:
        kept = np.zeros(len(texts), dtype=bool)
        rows = [i for i, t in enumerate(texts) if has_letter(t)]
        if not model.families:
            kept[rows], rows = True, []
        for at in range(0, len(rows), 256):
            some = rows[at : at + 256]
            x = np.stack([features(texts.iloc[i]) for i in some])
            kept[some] = usual.within(model.predict_vectors(x)[0], np.stack([words(texts.iloc[i]) for i in some]))
        release()
        return pd.Series(kept)

    return keep


PREDICTION = StructType([StructField("lang", StringType()), StructField("score", DoubleType())])


def predictor(model: Model):
    """A column function: text to struct of lang and score."""

    @F.pandas_udf(PREDICTION)
    def predict(texts: pd.Series) -> pd.DataFrame:
        lang, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
        rows = [i for i, t in enumerate(texts) if has_letter(t)]
        for at in range(0, len(rows), 256):
            some = rows[at : at + 256]
            lang[some], score[some] = model.predict([texts.iloc[i] for i in some])
        release()
        return pd.DataFrame({"lang": lang, "score": score})

    return predict


def fold(key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo 4."""
    return F.crc32(ref(key).cast("string").cast("binary")) % 4


def identify(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, lang_pred and score of every row."""
    found = predictor(model)(ref(text))
    return df.select(ref(key).alias(key), found.alias("_found")).select(key, F.col("_found.lang").alias("lang_pred"), "_found.score")


@query()
def op5_language_svm(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from three folds of four."""
    docs = table(spark, folder, "documents")
    model = fit(docs, fold() != 2)
    return identify(docs, model).select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")

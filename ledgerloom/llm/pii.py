r"""Personal data: fixed base rules, and boosted trees over overlapping candidates.

Base rules find emails, IPs, cards and phones by pattern and check, leftmost and
non-overlapping per kind. They miss what greedy patterns swallow (a phone next to
a card is one long run of digits) and other spellings. So generators of high
recall propose further, overlapping spans; gradient-boosted trees per kind score
them by format and context; what reaches the kind's calibrated threshold and
overlaps nothing better is added. Base spans always stay.

The trees learn by distant supervision: candidates inside a base span of their
kind, of nearly its length, are positive, parts of a run that a base rule took and dropped
are left out, all others are negative; signs that make a
base rule fire (``+``, ``@``) are not features, so spans that look alike without
them can be found. Candidates of ``SAMPLE_DOCS`` documents at most, chosen by a
hash of the key, are learned from, of each kind at most half of ``PER_KIND`` positive
and as many negative ones, chosen by a hash of document and place, every kind in its
own task; a third of the documents is held out, examples weigh as many candidates as they stand for, a logistic curve turns margins into
probabilities there, and the threshold is the lowest with ``PRECISION`` on them. A
kind with fewer than ``MIN_POSITIVE`` positive examples, or without negative ones,
has no model, and nothing is added to its base spans. Added emails must have the form of one.

NULL and empty texts have no spans; spans count code points of the whole text;
time grows in proportion to its length. Repeated rows are scanned each, NULL keys
are carried (and not learned from), an empty table gives an empty result.
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ledgerloom.functions.columns import ref
from ledgerloom.llm.common import query, table

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS, PER_KIND, MIN_POSITIVE, PRECISION = 40_000, 4000, 20, 0.95
TREES, DEPTH, RATE = 30, 3, 0.3
#: Places that candidates are hashed to.
PLACES = 1 << 40

# The base rules' patterns. Equal to the plain ones, written so that no run of characters is tried
# from each of its places: a match can only start where a run of digits starts, and an address is
# found from its @.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
#: A local part, a sign for at, and a domain of at least two labels.
_ADDRESS = re.compile(
    r"[A-Za-z0-9._%+-]+(?: ?@ ?| ?[(\[]at[)\]] ?| at )[A-Za-z0-9-]+(?:(?: ?\. ?| ?[(\[]dot[)\]] ?| dot )[A-Za-z0-9-]+)+"
)

Span = tuple[int, int, str]  # start, end, kind


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def passes(kind: str, text: str) -> bool:
    """The check of a kind on a span that has its form."""
    digits = digits_of(text)
    if kind == "ip":
        parts = [p.lstrip("0") or "0" for p in text.split(".")]
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "email":
        return _ADDRESS.fullmatch(text) is not None
    return 9 <= len(digits) <= 15


def base_spans(text: str) -> list[Span]:
    """Spans of the base rules by start, then kind as listed."""
    found: list[Span] = []
    if "@" in text:
        last = 0
        for m in _AT.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                found.append((start, m.end(), "email"))
                last = m.end()
    if _DIGIT.search(text):
        for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
            if kind != "phone" or "+" in text:
                found += [(*m.span(), kind) for m in pattern.finditer(text) if passes(kind, m[0])]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


#: Any run of digits and the marks between them: a candidate of every numeric kind, so each kind also sees the others'.
_NUMERIC = re.compile(r"(?<![0-9])\(?[0-9][0-9 ().-]{5,24}(?<=[0-9])(?![0-9])")

#: Generators of candidates: kind, what the text must hold, form.
GENERATORS = [
    *[(kind, ("",), _NUMERIC) for kind in ("ip", "card", "phone")],
    ("email", ("@",), re.compile(r"(?<![A-Za-z0-9.-])[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+)+")),
    ("email", ("@",), re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?@ ?[A-Za-z0-9-]{1,63}+(?: ?\. ?[A-Za-z0-9-]{1,63}+)+")),
    ("email", ("(at)", "[at]", " dot "), re.compile(
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:[(\[]at[)\]]|(?<= )at(?= )) ?[A-Za-z0-9-]{1,63}+"
        r"(?: ?(?:[(\[]dot[)\]]|\.|(?<= )dot(?= )) ?[A-Za-z0-9-]{1,63}+)+")),
    ("ip", (".",), re.compile(r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])")),
    ("card", ("",), re.compile(r"(?<![0-9])[0-9]{12,19}(?![0-9])")),
    ("card", (" ", "-", "."), re.compile(r"(?<![0-9])(?=((?:[0-9]{4}[ .-]){3}[0-9]{1,7}|[0-9]{4}[ .-][0-9]{6}[ .-][0-9]{5})(?![0-9]))")),
    ("phone", ("+",), re.compile(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])")),
    ("phone", (" ", ".", "-"), re.compile(r"(?<![0-9])(?=(\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9]))")),
    ("phone", ("00",), re.compile(r"(?<![0-9])00[1-9][0-9]{0,2}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])")),
]

#: Words before a span that speak for a kind.
CUES = {
    "email": re.compile(r"(?i)mail|contact|write"),
    "ip": re.compile(r"(?i)\bip\b|host|server|addr"),
    "card": re.compile(r"(?i)card|visa|credit|carte|karte|tarjeta"),
    "phone": re.compile(r"(?i)phone|tel|call|fax|mobile"),
}


def candidates(text: str) -> list[Span]:
    found = set()
    numeric = _DIGIT.search(text) is not None
    for kind, marks, form in GENERATORS:
        if (numeric or kind == "email") and any(m in text for m in marks):
            group = form.groups
            found |= {(*m.span(group), kind) for m in form.finditer(text)}
    return sorted(found)


def _class(char: str) -> int:
    return 0 if not char else 1 if char.isspace() else 2 if char.isdigit() else 3 if char.isalpha() else 4


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate, without the signs that base rules ask for."""
    start, end, kind = span
    body = text[start:end].lstrip("+")
    digits = digits_of(body)
    groups = [len(g) for g in re.split(r"[^0-9A-Za-z]+", body) if g] or [0]
    before = text[max(0, start - 30) : start]
    ahead = text[max(0, start - 1) : start]
    return [
        len(body), len(digits), sum(c.isalpha() for c in body), len(groups), max(groups), groups[0], groups[-1],
        sum(c in " .-" for c in body), body.count("("), len(set(digits)), float(kind == "card" and luhn(digits)),
        float(kind == "ip" and passes("ip", body)), float(digits[:1] or 0), _class("" if ahead == "+" else ahead),
        _class(text[end : end + 1]), float(bool(CUES[kind].search(before))),
    ]


class Boosted:
    """Gradient-boosted trees for one kind, with a logistic calibration and a threshold."""

    def __init__(self, trees: list, bias: float, slope: float = 1.0, shift: float = 0.0, threshold: float = 0.5):
        self.trees, self.bias, self.slope, self.shift, self.threshold = trees, bias, slope, shift, threshold

    def margin(self, row) -> float:
        total = self.bias
        for node in self.trees:
            while isinstance(node, tuple):
                node = node[2] if row[node[0]] <= node[1] else node[3]
            total += node
        return total

    def probability(self, row) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * self.margin(row) + self.shift))))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], depth: int):
    """A regression tree of Newton steps: (feature, cut, left, right) or a leaf's value."""
    leaf = lambda g, h: float(-RATE * g.sum() / (h.sum() + 1))
    gain = lambda g, h: g.sum() ** 2 / (h.sum() + 1)
    best = (1e-6, None, None)
    if depth and len(x) >= 4:
        for f, places in enumerate(cuts):
            for cut in places:
                left = x[:, f] <= cut
                if 0 < left.sum() < len(x):
                    better = gain(g[left], h[left]) + gain(g[~left], h[~left]) - gain(g, h)
                    if better > best[0]:
                        best = (better, f, cut)
    if best[1] is None:
        return leaf(g, h)
    _, f, cut = best
    left = x[:, f] <= cut
    return f, float(cut), *(_grow(x[s], g[s], h[s], cuts, depth - 1) for s in (left, ~left))


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    bias = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 12))) for f in range(x.shape[1])]
    margin, trees = np.full(len(y), bias), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(x, p - y, p * (1 - p), cuts, DEPTH)
        trees.append(tree)
        step = Boosted([tree], 0.0)
        margin += np.array([step.margin(r) for r in x])
    return Boosted(trees, bias)


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray, weight: np.ndarray, odds: float) -> Boosted:
    """Fit the logistic curve by Newton steps and set the lowest threshold of the wanted precision.

    An example stands for ``weight`` candidates; ``odds`` is the weight of a positive one over that of a negative one.
    """
    share, start = weight / weight.mean(), np.array([1.0, math.log(odds)])
    m = np.array([model.margin(r) for r in x])
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    design, coef = np.stack([m, np.ones(len(m))], axis=1), start
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(design @ coef, -30, 30)))
        hess = design.T @ (design * (share * p * (1 - p))[:, None]) + 0.05 * np.eye(2)
        coef = coef - np.linalg.solve(hess, design.T @ (share * (p - target)) + 0.05 * (coef - start))
    # a slope below zero: the held-out examples say nothing about the order, so margins only get the odds
    model.slope, model.shift = map(float, coef if coef[0] > 0 else start)
    scores = np.array([model.probability(r) for r in x])
    good = [t for t in np.unique(scores) if np.average(y[scores >= t], weights=weight[scores >= t]) >= PRECISION]
    model.threshold = max(0.5, float(min(good))) if good else 1.1
    return model


def _swallowed(text: str) -> list[tuple[int, int]]:
    """Runs that a base pattern took and its check dropped."""
    runs = (("ip", _IP), ("card", _CARD), ("phone", _PHONE))
    return [m.span() for kind, pattern in runs for m in pattern.finditer(text) if not passes(kind, m[0])]


class Reach:
    """Spans in the order of their starts, and how far those reach that start so far; each question is one bisection."""

    def __init__(self, spans: Iterable[tuple]):
        ordered = sorted((s[0], s[1]) for s in spans)
        self.starts, self.ends = [a for a, _ in ordered], [b for _, b in ordered]
        self.furthest = list(accumulate(self.ends, max))

    def before(self, place: int) -> int:
        """Furthest end of the spans that start before that place."""
        i = bisect_left(self.starts, place)
        return self.furthest[i - 1] if i else -1

    def near(self, place: int, back: int) -> Iterator[tuple[int, int]]:
        """Spans that start at that place or up to ``back`` before it."""
        for i in range(bisect_left(self.starts, place - back), bisect_left(self.starts, place + 1)):
            yield self.starts[i], self.ends[i]


def _labelled(spans: list[Span], base: list[Span], swallowed: list[tuple[int, int]]) -> Iterator[tuple[Span, float]]:
    """Candidates with 1 or 0; a part of a swallowed run is left out, since the base rules say nothing of it."""
    runs, known = Reach(swallowed), {k: Reach(s for s in base if s[2] == k) for k in KINDS}
    for span in spans:
        start, end, kind = span
        # inside a longer run: one that starts earlier and reaches the end, or one from here that goes on
        if runs.before(start) >= end or runs.before(start + 1) > end:
            continue
        yield span, float(any(end <= b and end - start >= 0.7 * (b - a) for a, b in known[kind].near(start, 4)))


def _stands_for(places: np.ndarray) -> float:
    """How many candidates one of the sample stands for: the last of k smallest places tells how densely places are taken."""
    k = len(places)
    return 1.0 if k < PER_KIND // 2 else max(1.0, (k - 1) / ((places.max() + 1) / PLACES) / k)


def sampled(spot: Column, total: int) -> Column:
    """True for about ``SAMPLE_DOCS`` of ``total`` hashes, up to 4e16 of them."""
    return F.pmod(spot, F.lit(1 << 40)) < F.lit(max(1, (SAMPLE_DOCS << 40) // total))


def learn(df: DataFrame, key: str = "doc_id", text: str = "text") -> dict[str, Boosted]:
    """A model per kind that has examples enough. Runs jobs; the models come to the driver."""
    rows = df.where(ref(key).isNotNull() & ref(text).isNotNull()).select(F.xxhash64(ref(key), F.lit(11)).alias("spot"), ref(text).alias("text"))
    total = max(1, df.count())
    if total > SAMPLE_DOCS:
        rows = rows.where(sampled(F.col("spot"), total))

    def propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for spot, text in zip(batch["spot"], batch["text"]):
                spans = candidates(text)
                base, runs = (base_spans(text), _swallowed(text)) if spans else ([], [])
                out += [(s[2], spot, s[0], s[1], y, features(text, s)) for s, y in _labelled(spans, base, runs)]
            if out:
                yield pd.DataFrame(out, columns=["kind", "spot", "start", "stop", "y", "x"]).astype({"kind": object})

    def train(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["spot", "start", "stop"])
        x, y = np.array(part["x"].tolist(), dtype=float), part["y"].to_numpy(dtype=float)
        if y.sum() < MIN_POSITIVE or (y == 0).sum() < MIN_POSITIVE:
            return pd.DataFrame({"kind": [], "model": []}, dtype=object)
        each = {v: _stands_for(part.loc[part["y"] == v, "place"].to_numpy()) for v in (0.0, 1.0)}
        weight = np.where(y > 0, each[1.0], each[0.0])
        out = part["spot"].to_numpy() % 3 == 0
        if min(y[out].sum(), (1 - y[out]).sum(), y[~out].sum(), (1 - y[~out]).sum()) < 3:
            out = np.zeros(len(y), dtype=bool)
        model = boost(x[~out], y[~out])
        seen = out if out.any() else ~out
        return pd.DataFrame({"kind": [part["kind"].iloc[0]], "model": [pickle.dumps(calibrate(model, x[seen], y[seen], weight[seen], each[1.0] / each[0.0]).__dict__)]})

    # positive and negative ones apart, each candidate at a place of its own: neither one document nor a rare kind decides
    place = F.pmod(F.xxhash64("spot", "start", "stop", F.lit(13)), F.lit(PLACES)).alias("place")
    rank = F.row_number().over(W.partitionBy("kind", "y").orderBy("place", "spot", "start", "stop"))
    seen = rows.mapInPandas(propose, "kind string, spot long, start int, stop int, y double, x array<double>").select("*", place)
    few = seen.withColumn("rank", rank).where(F.col("rank") <= PER_KIND // 2)
    fitted = few.groupBy("kind").applyInPandas(train, "kind string, model binary").collect()
    return {r["kind"]: Boosted(**pickle.loads(r["model"])) for r in fitted}


def find(text: str | None, models: dict[str, Boosted]) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: base ones and added candidates."""
    text = text or ""
    base = base_spans(text)
    scored, taken = [], Reach(base)
    for span in candidates(text):
        model = models.get(span[2])
        if taken.before(span[1]) > span[0]:
            continue
        if model is None or (span[2] == "email" and not passes("email", text[span[0] : span[1]])):
            continue
        if (p := model.probability(features(text, span))) >= model.threshold:
            scored.append((p, span))
    spans = list(base)
    added: list[Span] = []  # by start; they don't overlap
    for _, span in sorted(scored, key=lambda s: (-s[0], s[1][0] - s[1][1], s[1])):
        i = bisect_left(added, (span[1],))
        if not i or added[i - 1][1] <= span[0]:
            added.insert(i, span)
    return base, sorted(spans + added, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


FOUND = StructType([StructField(f"n_{k}", LongType()) for k in KINDS] + [StructField("base", StringType()), StructField("spans", StringType())])


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scanner(models: dict[str, Boosted]):
    """A column function: text to struct of base counts, base spans and all spans."""

    @F.pandas_udf(FOUND)
    def scan(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            base, spans = find(text, models)
            out.append([*[sum(s[2] == k for s in base) for k in KINDS], _joined(base), _joined(spans)])
        return pd.DataFrame(out, columns=FOUND.fieldNames())

    return scan


def redactor(models: dict[str, Boosted]):
    """A column function: text with each span replaced by its kind in brackets; overlapping spans become one."""

    @F.pandas_udf(StringType())
    def redact(texts: pd.Series) -> pd.Series:
        def clean(text):
            if text is None:
                return None
            out, last = [], 0
            for a, b, kind in find(text, models)[1]:
                if a >= last:
                    out += [text[last:a], f"[{kind.upper()}]"]
                last = max(last, b)
            return "".join(out) + text[last:] if out else text

        return texts.map(clean)

    return redact


def scan(df: DataFrame, models: dict[str, Boosted], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, counts of the base rules, base spans and all spans of every row."""
    found: Column = scanner(models)(ref(text))
    return df.select(ref(key).alias(key), found.alias("_found")).select(key, "_found.*")


@query()
def op10_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document; the trees learn from a sample of the same table."""
    docs = table(spark, folder, "documents")
    return scan(docs, learn(docs)).select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans"
    )

"""Product brochures and generated text: parse, classify, extract, screen.

Rules are column expressions over whole texts; there is no model call. The trained
classifier learns from labelled rows and scores inside the JVM.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, IndexToString, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.columns import ref
from ledgerloom.operators.sizes import settle
from ledgerloom.session import shared_dir

# Categories in class order, with the words that speak for each.
CATEGORY_WORDS: dict[str, tuple[str, ...]] = {
    "CREDIT_CARD": ("credit card", "cashback", "credit limit", "airport lounge", "reward points"),
    "PERSONAL_LOAN": ("personal financing", "personal loan", "unsecured", "early settlement"),
    "HOME_LOAN": ("home loan", "property value", "lock-in", "first home", "mortgage"),
    "INVESTMENT": ("unit trust", "fund", "funds", "distribution", "capital guaranteed"),
    "INSURANCE": ("takaful", "insurance", "sum covered", "no-claim", "coverage period"),
}

#: Hashed words of the trained classifier; passes of its solver.
HASHED_WORDS, PASSES = 1 << 16, 30

#: Field -> (line labels, value pattern). A field is the first matching value of
#: a line ``label: value``; patterns have exactly one group.
_ANY = r"(\S[^\r\n]*?)"
_MONEY = r"[^\r\n0-9]*?RM\s*([0-9][0-9,.]*)"
_MONEY_UPPER = r"[^\r\n]*?RM\s*[0-9][0-9,.]*\s*[-–]\s*RM\s*([0-9][0-9,.]*)"
_PCT = r"[^\r\n0-9]*([0-9]+(?:\.[0-9]+)?)\s*%"
_MONTHS = r"([0-9]+)\s*(?:months?|years?)"
_YES = r"(Yes|No)\b"
BROCHURE_FIELDS: dict[str, tuple[tuple[str, ...], str]] = {
    "product_name": (("Product Name", "Name"), _ANY),
    "min_amount_myr": (("Credit Limit", "Min Financing Amount", "Min Initial Investment", "Min Property Value"), _MONEY),
    "max_amount_myr": (("Max Financing Amount", "Maximum Amount"), _MONEY),
    "min_rate_pct": (("Profit Rate", "Interest Rate", "Base Rate", "Annual Management Fee"), _PCT),
    "max_rate_pct": (("Effective Rate", "Maximum Rate"), _PCT),
    "min_tenure_months": (("Min Tenure", "Lock-In Period", "Investment Horizon"), r"[^\r\n0-9]*" + _MONTHS),
    "max_tenure_months": (("Max Tenure", "Coverage Period"), r"[^\r\n0-9]*" + _MONTHS),
    "min_income_annual_myr": (("Minimum Income", "Minimum Annual Income"), _MONEY),
    "shariah_compliant": (("Shariah Compliant",), _YES),
    "annual_fee_myr": (("Annual Fee (Principal)", "Annual Fee"), _MONEY),
    "annual_fee_waiver": (("Annual Fee (Principal)", "Annual Fee"), r"[^\r\n(]*\(([^)\r\n]*waived[^)\r\n]*)\)"),
    "processing_fee": (("Processing Fee",), _ANY),
    "early_termination_fee": (("Early Settlement Fee", "Lock-In Penalty", "Repurchase Charge"), _ANY),
    "key_benefit_1": (("Benefit 1",), _ANY),
    "key_benefit_2": (("Benefit 2",), _ANY),
    "key_benefit_3": (("Benefit 3",), _ANY),
    "fees_summary": (("Fees", "Sales Charge"), _ANY),
    "eligibility_age_min": (("Eligible Age",), r"([0-9]+)"),
    "eligibility_age_max": (("Eligible Age",), r"[0-9]+\s*[-–]\s*([0-9]+)"),
    "eligibility_nationality": (("Eligibility", "Eligible Nationality"), r"([^,\r\n]+)"),
    "eligibility_employment": (("Eligible Employment",), _ANY),
    "documents_required": (("Documents Required", "Documents"), _ANY),
    "cashback_rate_pct": (("Cashback Rate",), _PCT),
    "reward_points_per_rm": (("Reward Points",), r"([0-9]+(?:\.[0-9]+)?)x"),
    "lounge_access_included": (("Airport Lounge Access",), _YES),
    "profit_rate_type": (("Profit Rate", "Rate Type"), r"[^\r\n]*\((fixed|variable|floating)\)"),
    "collateral_required": (("Collateral Required",), _YES),
    "max_dsr_pct": (("Max DSR",), _PCT),
    "fund_risk_rating": (("Risk Rating",), r"(Low|Medium|High)"),
    "capital_guaranteed": (("Capital Guaranteed",), _YES),
    "distribution_frequency": (("Distribution Frequency",), _ANY),
    "sum_covered_max_myr": (("Max Sum Covered",), _MONEY),
    "effective_date": (("Effective Date",), _ANY),
    "product_code_extracted": (("Product Code", "Code"), _ANY),
}

# What a reply to a customer must not contain.
NATIONAL_ID = r"[0-9]{6}-[0-9]{2}-[0-9]{4}"
ACCOUNT_NUMBER = r"[0-9]{10,}"
BANNED_PHRASES = ("you should invest", "guaranteed return", "I recommend you buy")

_LITERAL = str.maketrans({c: "\\" + c for c in r"\.^$|?*+()[]{}-/"})


def line_pattern(labels: Sequence[str], value: str) -> str:
    """Pattern of a ``label: value`` line (any letter case)."""
    names = "|".join(label.translate(_LITERAL) for label in labels)
    return rf"(?im)^[ \t]*(?:{names})[ \t]*[:|\t][ \t]*{value}[ \t]*" + (r"\r?$" if value == _ANY else "")


def parse_files(files: DataFrame) -> DataFrame:
    """Text of binary document rows, with product code, size and time.

    Files must hold plain text or HTML; decoding of other formats is up to the
    caller.
    """
    return files.select(
        F.col("path").alias("file_path"),
        F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("product_code"),
        F.decode("content", "UTF-8").alias("parsed_text"),
        F.length("content").cast("long").alias("file_size_bytes"),
        F.current_timestamp().alias("parsed_at"),
    )


def html_text(html: Column) -> Column:
    """Visible text: comments, scripts, styles and tags become blanks, blanks are folded."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1))


def classify(
    df: DataFrame, text: str, name: str = "product_category", words: Mapping[str, Sequence[str]] = CATEGORY_WORDS
) -> DataFrame:
    """Add the category with most keyword hits, letter case ignored.

    Keywords count where they stand as whole words: "fund" is not in "refund".
    Ties go to the earlier category; no hit gives NULL. Keywords are counted one
    by one, and only in texts that hold them at all, which a plain search tells.
    The folded text is a column of its own, so that it is computed once.
    """
    folded = df.withColumn("_folded", F.lower(ref(text)))
    letter = r"[\p{L}\p{N}_]"

    def count(word: str) -> Column:
        plain = word.lower()
        whole = rf"(?<!{letter}){plain.translate(_LITERAL)}(?!{letter})"
        return F.when(F.contains("_folded", F.lit(plain)), F.regexp_count("_folded", F.lit(whole))).otherwise(0)

    hits = {f"_hits_{i}": sum((count(w) for w in ws), F.lit(0)) for i, ws in enumerate(words.values())}
    best = F.greatest(*[F.col(h) for h in hits])
    pick = F.when(best == 0, None)
    for h, category in zip(hits, words):
        pick = pick.when(F.col(h) == best, F.lit(category))
    return folded.withColumns(hits).withColumn(name, pick).drop("_folded", *hits)


def _lower_words(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("_words", F.filter(F.split(F.lower(F.coalesce(ref(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def train_classifier(df: DataFrame, text: str, label: str) -> PipelineModel:
    """Category of a text learned from labelled rows: hashed word counts, idf, logistic regression. Runs jobs.

    Rows without a label are left out; classes weigh alike, however rare. The rows
    are read once: their word counts are staged in the shared folder, and every pass
    reads those, spread as they were written, whatever the number of classes.
    """
    rows = df.where(ref(label).isNotNull()).select(ref(text), ref(label).cast("string").alias("_label"))
    hashing = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=HASHED_WORDS)
    hashed = hashing.transform(_lower_words(rows, text)).select("_label", "_counts")
    path = f"{shared_dir(df.sparkSession)}/classifier-{uuid.uuid4().hex}"
    hashed.write.parquet(path)
    hashed = df.sparkSession.read.schema(hashed.schema).parquet(path)
    counts = hashed.groupBy(F.col("_label").alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    weights = settle(counts.select("_l", (F.lit(1.0) / F.col("_n")).alias("_weight")))
    weighed = hashed.join(weights, F.col("_label") == F.col("_l")).drop("_l")
    names = StringIndexer(inputCol="_label", outputCol="_index", stringOrderType="alphabetAsc").fit(hashed)
    steps = Pipeline(
        stages=[
            IDF(inputCol="_counts", outputCol="_tfidf", minDocFreq=2),
            LogisticRegression(
                featuresCol="_tfidf", labelCol="_index", weightCol="_weight", maxIter=PASSES, regParam=0.05,
                rawPredictionCol="_raw", probabilityCol="_shares", predictionCol="_best",
            ),
            IndexToString(inputCol="_best", outputCol="_category", labels=names.labels),
        ]
    )
    return PipelineModel([hashing, *steps.fit(names.transform(weighed)).stages])


def classify_trained(df: DataFrame, model: PipelineModel, text: str, name: str = "product_category") -> DataFrame:
    """Add the learned category and its probability (``<name>_share``); NULL and empty texts have neither."""
    scored = model.transform(_lower_words(df, text))
    some = F.size("_words") > 0
    return scored.select(
        *[ref(c) for c in df.columns],
        F.when(some, F.col("_category")).alias(name),
        F.when(some, F.array_max(vector_to_array("_shares"))).alias(f"{name}_share"),
    )


def extract_fields(text: Column, patterns: Mapping[str, str]) -> Column:
    """Struct of the first group of each pattern; no match and a blank one give NULL."""
    return F.struct(*[F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")).alias(name) for name, p in patterns.items()])


def brochure_patterns() -> dict[str, str]:
    return {name: line_pattern(labels, value) for name, (labels, value) in BROCHURE_FIELDS.items()}


def product_catalog(parsed: DataFrame) -> DataFrame:
    """Category and extracted fields per brochure."""
    return classify(parsed, "parsed_text").select(
        "file_path",
        "product_code",
        "product_category",
        "parsed_at",
        extract_fields(F.col("parsed_text"), brochure_patterns()).alias("extracted_fields"),
        F.current_timestamp().alias("extracted_at"),
    )


def flat_catalog(catalog: DataFrame, struct: str = "extracted_fields") -> DataFrame:
    """Struct fields as columns of their own."""
    return catalog.select(*[ref(c) for c in catalog.columns if c != struct], F.col(f"{struct}.*"))


def screen(df: DataFrame, text: str) -> DataFrame:
    """Flags for ids, account numbers and advice phrases, and the redacted text.

    Texts are rewritten only where a flag says so.
    """
    value = ref(text)
    folded = F.lower(value)
    banned = F.lit(False)
    for phrase in BANNED_PHRASES:
        banned = banned | folded.contains(phrase.lower())
    flagged = df.withColumns(
        {
            "has_national_id": value.rlike(NATIONAL_ID),
            "has_account_number": value.rlike(ACCOUNT_NUMBER),
            "has_banned_phrase": banned,
        }
    )
    no_ids = F.when(F.col("has_national_id"), F.regexp_replace(value, NATIONAL_ID, "[ID]")).otherwise(value)
    hidden = F.when(
        F.col("has_national_id") | F.col("has_account_number"), F.regexp_replace(no_ids, ACCOUNT_NUMBER, "[ACCOUNT]")
    ).otherwise(value)
    return flagged.withColumn("redacted", hidden)


def customer_context(df: DataFrame) -> DataFrame:
    """One line of facts per customer, ready to be put into a prompt or letter."""
    label = F.initcap(F.regexp_replace("lifestyle_segment", "_", " "))
    line = F.format_string(
        "Customer: %s | Segment: %s | Tenure: %d years | Income: MYR %,.0f | Product: %s (%.0f%%)",
        F.coalesce("legal_name", F.lit("Valued Customer")),
        F.coalesce(label, F.lit("Retail")),
        F.coalesce(F.col("relationship_tenure_years"), F.lit(0)),
        F.coalesce("annual_income_amount", F.lit(0.0)),
        F.coalesce("recommendation_1", F.lit("PENDING")),
        F.coalesce("confidence_1", F.lit(0.0)),
    )
    return df.select("party_id", line.alias("context"))

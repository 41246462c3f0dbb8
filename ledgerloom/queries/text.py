"""Documents, web pages and model replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.replies import reply_text
from ledgerloom.plans import documents as d
from ledgerloom.queries.base import Tables, query

_BARE = r"regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', ' ', 'g')"
_TEXT = rf"trim(regexp_replace(regexp_replace({_BARE}, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


@query(
    f"SELECT page_id, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title, {_TEXT} AS text, CAST(octet_length(encode(html)) AS BIGINT) AS size_bytes FROM pages"
)
def q_doc_parse(t: Tables) -> DataFrame:
    return t.pages.select(
        "page_id",
        d.html_title(F.col("html")).alias("title"),
        d.html_text(F.col("html")).alias("text"),
        F.octet_length("html").cast("bigint").alias("size_bytes"),
    )


#: Frequent words of each language stand in for product words.
WORDS = {
    "EN": ("the", "and", "with"),
    "FR": ("les", "des", "que"),
    "DE": ("der", "und", "nicht"),
    "ES": ("los", "del", "para"),
}


def _hits(words) -> str:
    """Whole words, from the list of all words of the text."""
    return f"len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w IN {tuple(words)}))"


@query(
    f"""WITH s AS (SELECT doc_id, {', '.join(f'{_hits(w)} AS h{i}' for i, w in enumerate(WORDS.values()))} FROM documents)
SELECT doc_id, CASE WHEN greatest(h0, h1, h2, h3) = 0 THEN NULL
  {' '.join(f"WHEN h{i} = greatest(h0, h1, h2, h3) THEN '{c}'" for i, c in enumerate(WORDS))} END AS category FROM s"""
)
def q_doc_classify(t: Tables) -> DataFrame:
    return d.classify(t.documents.select("doc_id", "text"), "text", "category", WORDS).drop("text")


@query()
def q_doc_trained(t: Tables) -> DataFrame:
    """Quality of every document, learned from the labelled ones of four folds of five."""
    folded = t.documents.select("doc_id", "text").withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    labels = t.labels.select("doc_id", "quality")
    model = d.train_classifier(folded.where("not held_out").join(labels, "doc_id"), "text", "quality")
    scored = d.classify_trained(folded, model, "text", "predicted").select("doc_id", "held_out", "predicted")  # texts stay where they are read
    return scored.join(labels, "doc_id", "left").select("doc_id", "quality", "held_out", "predicted")


#: Field -> pattern over "url <newline> html".
PAGE_FIELDS = {
    "host": r"^https?://([^/]+)/",
    "url_lang": r"^https?://[^/]+/([a-z]{2})/",
    "page_no": r"^https?://[^/]+/[a-z]{2}/([0-9]+)",
    "ref": r"^[^\n]*[?&]ref=([^&#\n]+)",
    "html_lang": r'<html lang="([a-z]+)"',
    "title": r"(?is)<title>(.*?)</title>",
    "first_heading": r"(?is)<h1>(.*?)</h1>",
}
_FOUND = {n: f"nullif(trim(regexp_extract(url || chr(10) || html, '{p}', 1)), '')" for n, p in PAGE_FIELDS.items()}


def _extracted(t: Tables) -> DataFrame:
    text = F.concat_ws("\n", "url", "html")
    return t.pages.select("page_id", F.length("html").cast("bigint").alias("html_chars"), d.extract_fields(text, PAGE_FIELDS).alias("fields"))


@query(
    "SELECT page_id, " + " || '|' || ".join(f"coalesce({e}, '-')" for e in _FOUND.values()) + " AS fields FROM pages"
)
def q_doc_extract(t: Tables) -> DataFrame:
    """The struct shown as one line."""
    shown = F.concat_ws("|", *[F.coalesce(F.col("fields")[n], F.lit("-")) for n in PAGE_FIELDS])
    return _extracted(t).select("page_id", shown.alias("fields"))


@query("SELECT page_id, CAST(length(html) AS BIGINT) AS html_chars, " + ", ".join(f"{e} AS {n}" for n, e in _FOUND.items()) + " FROM pages")
def q_doc_catalog(t: Tables) -> DataFrame:
    return d.flat_catalog(_extracted(t), "fields")


def _screened(source: str, key: str) -> str:
    hidden = f"regexp_replace(regexp_replace(text, '{d.NATIONAL_ID}', '[ID]', 'g'), '{d.ACCOUNT_NUMBER}', '[ACCOUNT]', 'g')"
    return (
        f"SELECT '{source}' AS source, {key} AS id, CAST(regexp_matches(text, '{d.NATIONAL_ID}') AS INTEGER) AS has_national_id, "
        f"CAST(regexp_matches(text, '{d.ACCOUNT_NUMBER}') AS INTEGER) AS has_account_number, "
        f"CAST(({' OR '.join(f'contains(lower(text), {chr(39)}{p.lower()}{chr(39)})' for p in d.BANNED_PHRASES)}) AS INTEGER) AS has_banned_phrase, "
        f"CAST(length({hidden}) AS BIGINT) AS redacted_chars FROM {source}"
    )


@query(_screened("documents", "doc_id") + " UNION ALL " + _screened("conversations", "conv_id * 1000 + turn"))
def q_guardrail(t: Tables) -> DataFrame:
    docs = t.documents.select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), "text")
    talks = t.conversations.select(
        F.lit("conversations").alias("source"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"
    )
    return d.screen(docs.unionByName(talks), "text").select(
        "source",
        "id",
        *[F.col(c).cast("int").alias(c) for c in ("has_national_id", "has_account_number", "has_banned_phrase")],
        F.length("redacted").cast("bigint").alias("redacted_chars"),
    )


_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 0)"


@query(
    f"""WITH l AS (SELECT conv_id, turn, role, text, {_LINES} AS lines FROM conversations),
g AS (SELECT *, list_position(list_transform(lines, lambda x: regexp_matches(x, 'Dear |Subject:|Hi |Greetings')), true) AS first FROM l),
b AS (SELECT *, CASE WHEN first > 0 THEN lines[first:] END AS body FROM g),
e AS (SELECT *, list_position(list_transform(body, lambda x: regexp_matches(x, 'Regards|Sincerely|Warm regards|Best')), true) AS last FROM b)
SELECT conv_id, turn, CASE role WHEN 'assistant' THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') WHEN 'system' THEN text
  ELSE array_to_string(CASE WHEN first > 0 THEN (CASE WHEN last > 0 THEN body[:last] ELSE body END) ELSE lines[greatest(len(lines) - 14, 1):] END, chr(10)) END AS reply FROM e"""
)
def q_reply_text(t: Tables) -> DataFrame:
    """Assistant turns as message content, user turns as reasoning, system turns as predictions."""
    choice = lambda message: F.to_json(F.struct(F.array(F.struct(message.alias("message"))).alias("choices")))
    body = (
        F.when(F.col("role") == "assistant", choice(F.struct(F.col("text").alias("content"))))
        .when(F.col("role") == "system", F.to_json(F.struct(F.array("text").alias("predictions"))))
        .otherwise(choice(F.struct(F.lit(" ").alias("content"), F.col("text").alias("reasoning_content"))))
    )
    return reply_text(t.conversations.select("conv_id", "turn", body.alias("body")), "body", "reply").drop("body")

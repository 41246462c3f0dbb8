"""Text of a chat-style model reply kept as a JSON string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.columns import ref

# How a letter starts and ends.
GREETING = r"Dear |Subject:|Hi |Greetings"
CLOSING = r"Regards|Sincerely|Warm regards|Best"


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _non_blank(text: Column) -> Column:
    trimmed = stripped(text)
    return F.when(F.length(trimmed) > 0, trimmed)


def _first_match(lines: Column, pattern: str) -> Column:
    """Position (from 1) of the first line with the pattern; 0 when there is none."""
    return F.array_position(F.transform(lines, lambda x: x.rlike(pattern)), True).cast("int")


def reply_text(df: DataFrame, reply: str, name: str = "reply_text", keep_last: int = 15) -> DataFrame:
    """Add the answer text of a reply.

    It is the message content; else the letter inside the reasoning (from the
    first line with a greeting to the first later line with a closing formula);
    else the last lines of the reasoning; else the first prediction; else an
    empty string, also for text that is not JSON. Steps are columns of their
    own, so that nothing is parsed twice.
    """
    message = "$.choices[0].message."
    trimmed = F.transform(F.split("_thought", "\n"), lambda x: stripped(x))
    steps = [
        ("_content", _non_blank(F.get_json_object(ref(reply), message + "content"))),
        ("_thought", F.when(F.col("_content").isNull(), _non_blank(F.get_json_object(ref(reply), message + "reasoning_content")))),
        ("_lines", F.filter(trimmed, lambda x: F.length(x) > 0)),
        ("_from", _first_match(F.col("_lines"), GREETING)),
        ("_letter", F.when(F.col("_from") > 0, F.slice("_lines", F.col("_from"), F.size("_lines")))),
        ("_to", _first_match(F.col("_letter"), CLOSING)),
    ]
    out = df
    for column, value in steps:
        out = out.withColumn(column, value)
    skip = F.greatest(F.size("_lines") - F.lit(keep_last), F.lit(0))
    shown = (
        F.when(F.col("_to") > 0, F.slice("_letter", F.lit(1), F.col("_to")))
        .when(F.col("_from") > 0, F.col("_letter"))
        .otherwise(F.slice("_lines", skip + F.lit(1), F.lit(keep_last)))
    )
    answer = F.coalesce(
        "_content",
        F.when(F.col("_thought").isNotNull(), F.array_join(shown, "\n")),
        F.get_json_object(ref(reply), "$.predictions[0]"),
        F.lit(""),
    )
    return out.withColumn(name, answer).drop(*[c for c, _ in steps])

"""Date, money, score and text helpers used by the gold tables and the app queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_years(day: Column, as_of: Column) -> Column:
    """Days / 365 cut to whole years (leap days are ignored on purpose)."""
    return (F.datediff(as_of, day) / F.lit(365)).cast("int")


def within_days(day: Column, as_of: Column, days: int) -> Column:
    """``day`` lies at most ``days`` before ``as_of``; the bare column stays on
    the left so that the test can prune partitions and reach the scan."""
    return day >= F.date_sub(as_of, days)


def epoch_millis(value: Column) -> Column:
    return F.timestamp_millis(value.cast("long"))


def digital_score(sessions: Column, maturity: Column) -> Column:
    """Weighted engagement score; fixed weights 0.4 and 0.6, neutral maturity 5.0."""
    return F.round(F.coalesce(sessions, F.lit(0)) * F.lit(0.4) + F.coalesce(maturity, F.lit(5.0)) * F.lit(0.6), 1)


def megabytes_to_gigabytes(mb: Column) -> Column:
    return F.round(F.coalesce(mb, F.lit(0.0)) / F.lit(1024), 2)


def debt_ratio(monthly_commitment: Column, annual_income: Column) -> Column:
    """Commitment as a share of income; NULL when income is zero."""
    return F.try_divide(monthly_commitment, annual_income) * F.lit(12)


def score_gauge(score: Column) -> Column:
    """Position of a 300..850 bureau score on a 0..100 gauge."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), (F.coalesce(score, F.lit(0)) - F.lit(300)) / F.lit(5.5)))


def score_band(score: Column) -> Column:
    """Fixed cut points: 700 and 600."""
    return (
        F.when(score.isNull(), "none")
        .when(score >= 700, "good")
        .when(score >= 600, "fair")
        .otherwise("poor")
    )


def humanize_money(amount: Column, currency: str = "MYR") -> Column:
    """``MYR 1.2B`` / ``MYR 3.4M`` / ``MYR 56K`` / ``MYR 789``."""
    prefix = F.lit(currency + " ")
    return (
        F.when(amount.isNull(), "-")
        .when(amount >= 1e9, F.concat(prefix, F.format_string("%.1fB", amount / 1e9)))
        .when(amount >= 1e6, F.concat(prefix, F.format_string("%.1fM", amount / 1e6)))
        .when(amount >= 1e3, F.concat(prefix, F.format_string("%.0fK", amount / 1e3)))
        .otherwise(F.concat(prefix, F.format_string("%,.0f", amount)))
    )


def initials(name: Column) -> Column:
    """First letters of the first two words, upper case."""
    words = F.filter(F.split(name, " "), lambda w: F.length(w) > 0)
    letters = F.transform(F.slice(words, 1, 2), lambda w: F.upper(F.substring(w, 1, 1)))
    return F.when(F.length(F.trim(name)) > 0, F.array_join(letters, "")).otherwise("??")


def pretty_label(code: Column) -> Column:
    """``HOME_LOAN`` -> ``Home Loan``."""
    return F.initcap(F.regexp_replace(code, "_", " "))


def neutralize_formula(text: Column) -> Column:
    """Put a quote before text that a spreadsheet would run as a formula."""
    return F.when(text.rlike(r"\A[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def contains_ignore_case(column: Column, needle: str) -> Column:
    """Substring test in which ``%`` and ``_`` of the needle are plain characters."""
    escaped = needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return column.ilike(f"%{escaped}%")

"""The operators applied to the star-schema test tables, each with a SQL twin."""

from ledgerloom.queries import banking, cleaning, history, profiles, rules, scoring, serving, text  # noqa: F401
from ledgerloom.queries.base import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]

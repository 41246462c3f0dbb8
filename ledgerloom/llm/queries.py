"""The operators' queries and SQL twins; importing the modules registers them."""

from ledgerloom.llm import audit, bpe, chat, language, lexical, licenses, mixing, neighbours, pii, quality, sharding, simhash, warc  # noqa: F401
from ledgerloom.llm.common import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]

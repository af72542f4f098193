"""quotemill: equity market data, fundamentals, account ledgers and data quality on Spark."""

from quotemill.schemas import KEYS, SCHEMAS, WATERMARK
from quotemill.session import build_session

__all__ = ["KEYS", "SCHEMAS", "WATERMARK", "build_session"]

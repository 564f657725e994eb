"""All queries but those of the training-data operators, and their oracles."""

from __future__ import annotations

from .plans import archives, corpus, epochs, examples, files, more, scores, search, shape, signals, streams, texts  # noqa: F401  registers their queries
from .plans.base import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

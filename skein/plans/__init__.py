"""Registered queries over the shared test tables and their SQL counterparts."""

from skein.plans import governance, ingest, searching, sequences, summaries, texts, toolwork  # noqa: F401
from skein.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

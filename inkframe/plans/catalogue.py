"""Every query of the library's own operators, by name, and the SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkframe.plans import glyph_queries, photo_queries, review_queries, signal_queries, table_queries, text_queries

_MODULES = (text_queries, table_queries, signal_queries, photo_queries, review_queries, glyph_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLES.items()}

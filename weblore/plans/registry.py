"""All queries of the core: name -> function of (session, folder of tables), and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weblore.plans import nested_queries, stage_queries, text_kb_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**nested_queries.QUERIES, **text_kb_queries.QUERIES, **stage_queries.QUERIES}
ORACLES: dict[str, str] = {**nested_queries.ORACLES, **text_kb_queries.ORACLES, **stage_queries.ORACLES}

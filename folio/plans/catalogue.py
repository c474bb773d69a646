"""The registered queries over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.plans import service_queries, structure_queries, study_queries, text_queries, unit_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**text_queries.QUERIES, **structure_queries.QUERIES, **study_queries.QUERIES, **service_queries.QUERIES, **unit_queries.QUERIES}
ORACLES: dict[str, str] = {**text_queries.ORACLES, **structure_queries.ORACLES, **study_queries.ORACLES, **service_queries.ORACLES, **unit_queries.ORACLES}

"""All queries of the core, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyforge.plans import arm_queries, detail_queries, floor_queries, inference_queries, quality_queries, records, report_queries, resample_queries, scored_queries, sheet_queries
from tallyforge.session import prepare

MODULES = (records, sheet_queries, scored_queries, resample_queries, quality_queries, floor_queries, inference_queries, arm_queries, detail_queries, report_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: (lambda s, d, f=f: f(prepare(s), d)) for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in getattr(m, "SQL", {}).items()}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return sheet_queries.order_floor(prepare(spark), d)

"""Every query over the engine's own operators, bound to the test tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarryline.plans import answer_queries, contact_queries, listing_queries, people_queries, posting_queries, state_queries, text_queries

_MODULES = (posting_queries, text_queries, state_queries, contact_queries, listing_queries, answer_queries, people_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, (f, _) in m.QUERIES.all.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.all.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["q_search_jobs_fit"](spark, sf_dir)

"""The library's named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import address_queries, crawl_queries, discovery_queries, extract_queries, judge_queries, key_queries, layout_queries, merge_queries, misc_queries, page_queries, record_queries, store_queries, stream_queries, survey_queries

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (key_queries, address_queries, judge_queries, extract_queries, crawl_queries, merge_queries, misc_queries, record_queries, survey_queries, page_queries, discovery_queries, layout_queries, store_queries, stream_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_queries.pipeline_topk(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: f for module in _MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}

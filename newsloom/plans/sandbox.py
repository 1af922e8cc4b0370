"""Grouping by hand: titles are fetched once and kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsloom.operators.grouping import title_groups
from newsloom.sources.archive import state

TITLES = "pos bigint, title string"


def cached_titles(spark: SparkSession, path: str, load: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """(pos, title) kept at path; where there are none yet, or with refresh, those of load(), which are kept."""
    kept = state(spark, path, TITLES)
    if refresh or kept.isEmpty():
        load().select("pos", "title").write.mode("overwrite").parquet(path)
        kept = state(spark, path, TITLES)
    return kept


def grouped(spark: SparkSession, path: str, load: Callable[[], DataFrame], threshold: float, refresh: bool = False) -> DataFrame:
    """(leader, pos, title) of the kept titles' groups."""
    t = cached_titles(spark, path, load, refresh)
    return title_groups(t, threshold).join(t, "pos").select("leader", "pos", "title")

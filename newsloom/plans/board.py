"""Readers' queries over stories and momentum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def board_rows(stories: DataFrame, momentum: DataFrame) -> DataFrame:
    m = momentum.select("id", "peak_date", "trend", F.col("series").alias("series"))
    return stories.join(m, "id", "left")


def board(stories: DataFrame, kind: str = "story") -> DataFrame:
    return stories.where(F.col("kind") == kind)


def search(stories: DataFrame, q: str) -> DataFrame:
    """Case-insensitive substring of headline, titles, outlets or keywords."""
    q = q.lower()
    has = lambda c: F.contains(F.lower(c), F.lit(q))
    return stories.where(has(F.col("headline")) | F.exists("articles", lambda a: has(a["title"])) | F.exists("outlets", lambda o: has(o["outlet"])) | F.exists("keywords", has))


def by_section(stories: DataFrame, section: str) -> DataFrame:
    return stories.where(F.col("section") == section)


def by_keyword(stories: DataFrame, keyword: str) -> DataFrame:
    return stories.where(F.array_contains("keywords", keyword))


def ordered(stories: DataFrame, how: str) -> DataFrame:
    keys = {"rank": ["outlet_count", "article_count", "latest_published"], "covered": ["outlet_count"], "newest": ["latest_published"]}[how]
    return stories.orderBy(*[F.col(k).desc() for k in keys], "id")


def facet_counts(filtered: DataFrame) -> DataFrame:
    """Stories per section of the current result, and all of them (section null)."""
    return filtered.rollup("section").agg(F.count("*").alias("n"))


def outlet_share(stories: DataFrame) -> DataFrame:
    o = stories.select("id", F.explode("outlets").alias("o")).select("id", "o.outlet", "o.articles")
    return o.withColumn("share", F.col("articles") / F.sum("articles").over(Window.partitionBy("id")))

"""The batch run and the ordered replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import momentum as M
from newsloom.operators.grouping import groups_fact
from newsloom.operators.ingest import prepared
from newsloom.operators.naming import named
from newsloom.operators.stories import stories
from newsloom.operators.tables import written


def story_fact(fact: DataFrame) -> DataFrame:
    """groups_fact() rows to stories()' input: groups numbered by their cluster."""
    return fact.select(F.col("cluster").alias("group"), F.col("top_id").alias("label"), "pos", "title", "link", "timestamp", "source")


def run(entries: DataFrame, sources: DataFrame, state: DataFrame, names: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """entries (pos, title, link, published, day, title_detail_base) to the run's tables."""
    fact = written(groups_fact(prepared(entries, F.lit(as_of).cast("date"))), "fact")
    s = written(stories(story_fact(fact), sources), "stories")
    s, new_state = M.advanced(s, state, as_of)
    s, new_names = named(s, names, as_of)
    return {"groups": fact, "stories": s, "momentum": M.momentum(new_state, s), "state": new_state, "names": new_names}


def replay(spark: SparkSession, days: list[tuple[str, DataFrame]], sources: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """days: (date, groups fact) in date order. The state after the last."""
    state = spark.createDataFrame([], M.STATE) if state is None else state
    for day, fact in days:
        _, state = M.advanced(written(stories(fact, sources), "stories"), state, day)
    return state

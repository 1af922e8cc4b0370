"""Story identity across days, and each story's rolling series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.leader import matching_profiles
from newsloom.operators.similarity import jaccard_profiles
from newsloom.operators.tables import written

WINDOW_DAYS, MATCH = 14, 0.4
STATE = "id string, keywords array<string>, entities array<string>, first_seen string, last_seen string, series array<struct<date:string,outlets:bigint,articles:bigint>>"


def signature(k: Column, e: Column) -> Column:
    return F.array_union(k, F.transform(e, lambda x: F.lower(x)))


def carried(stories: DataFrame, state: DataFrame, today: str, threshold: float = MATCH) -> DataFrame:
    """(story, prev): matches of today's stories with entries seen yesterday or later, one to one, best first."""
    cur = stories.select(F.col("story").alias("id"), F.explode(signature(F.col("keywords"), F.col("entities"))).alias("item"))
    live = state.where(F.col("last_seen") >= F.date_format(F.date_sub(F.lit(today).cast("date"), 1), "yyyy-MM-dd"))
    prev = live.select("id", F.explode(signature(F.col("keywords"), F.col("entities"))).alias("item"))
    return matching_profiles(*jaccard_profiles(cur, prev, threshold)).select(F.col("i").alias("story"), F.col("j").alias("prev"))


def folded(series: Column, today: str, outlets: Column, articles: Column, days: int = WINDOW_DAYS) -> Column:
    """The series with today's point (element-wise maximum with an earlier one of today), cut to the window."""
    point = F.struct(F.lit(today).alias("date"), outlets.alias("outlets"), articles.alias("articles"))
    same = F.filter(series, lambda p: p["date"] == today)
    top = F.aggregate(same, point, lambda a, p: F.struct(F.lit(today).alias("date"), F.greatest(a["outlets"], p["outlets"]).alias("outlets"), F.greatest(a["articles"], p["articles"]).alias("articles")))
    rest = F.filter(series, lambda p: p["date"] != today)
    start = F.date_format(F.date_sub(F.lit(today).cast("date"), days - 1), "yyyy-MM-dd")
    return F.filter(F.array_sort(F.concat(rest, F.array(top))), lambda p: p["date"] >= start)


def peak_date(series: Column) -> Column:
    """The earliest day of most outlets."""
    most = F.array_max(F.transform(series, lambda p: p["outlets"]))
    return F.element_at(F.filter(series, lambda p: p["outlets"] == most), 1)["date"]


def trend(series: Column) -> Column:
    """new, climbing, peaked, cooling or steady, by the last two stored points, in that order of tests."""
    n = F.size(series)
    last, prev = F.element_at(series, -1), F.try_element_at(series, F.lit(-2))
    mean = F.aggregate(series, F.lit(0).cast("long"), lambda a, p: a + p["outlets"]) / n
    falls = last["outlets"] < prev["outlets"]
    return (
        F.when(n == 1, "new")
        .when((last["outlets"] > prev["outlets"]) & (last["outlets"] >= mean), "climbing")
        .when((peak_date(series) == prev["date"]) & falls, "peaked")
        .when(falls & (last["outlets"] < mean), "cooling")
        .otherwise("steady")
    )


def advanced(stories: DataFrame, state: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """One day's step: (stories with carried ids, first_seen and days_running; the new state)."""
    match = written(carried(stories, state, today), "carried")
    prev = state.select(F.col("id").alias("prev"), F.col("first_seen").alias("_first"), F.col("series").alias("_series"))
    s = stories.join(match, "story", "left").join(prev, "prev", "left")
    none = F.array().cast("array<struct<date:string,outlets:bigint,articles:bigint>>")
    s = s.withColumn("series", folded(F.coalesce("_series", none), today, F.col("outlet_count").cast("long"), F.col("article_count").cast("long")))
    s = s.withColumn("id", F.coalesce("prev", "id")).withColumn("first_seen", F.coalesce("_first", F.lit(today))).withColumn("days_running", F.size("series").cast("long"))
    s = written(s.drop("prev", "_first", "_series"), "carried")
    rank = Window.partitionBy("id").orderBy(F.col("outlet_count").desc(), F.col("article_count").desc(), F.col("latest_published").desc(), "story")
    now = s.withColumn("n", F.row_number().over(rank)).withColumn("most", F.max("n").over(Window.partitionBy("id"))).where("n = most")  # of equal ids the last in rank stays
    now = now.select("id", "keywords", "entities", "first_seen", F.lit(today).alias("last_seen"), "series")
    start = F.date_format(F.date_sub(F.lit(today).cast("date"), WINDOW_DAYS - 1), "yyyy-MM-dd")
    old = state.join(now.select("id"), "id", "left_anti").where(F.col("last_seen") >= start)
    old = old.withColumn("series", F.filter("series", lambda p: p["date"] >= start)).where(F.size("series") > 0)
    return s, written(now.unionByName(old.select(*now.columns)), "state")


def momentum(state: DataFrame, current: DataFrame) -> DataFrame:
    """The public table: current ids only."""
    s = state.join(current.select("id").distinct(), "id", "left_semi")
    return s.select("id", "first_seen", F.size("series").alias("days_running"), "series", peak_date(F.col("series")).alias("peak_date"), trend(F.col("series")).alias("trend"))


def daily_trend(points: DataFrame) -> DataFrame:
    """points (id, date, outlets, articles), one per day: each day's rolling values and trend, in the long form.

    Columns: window_mean and peak_date over the last WINDOW_DAYS days, trend at that day.
    """
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy("id").orderBy(day)
    frame = w.rangeBetween(-(WINDOW_DAYS - 1), 0)
    p = points.withColumn("prev", F.lag("outlets").over(w)).withColumn("prev_date", F.lag("date").over(w))
    p = p.withColumn("n", F.count("*").over(frame)).withColumn("window_mean", F.avg("outlets").over(frame))
    p = p.withColumn("peak", F.max(F.struct("outlets", (-day).alias("d"))).over(frame)).withColumn("peak_date", F.date_sub(F.lit("1970-01-01").cast("date"), F.col("peak.d")))
    falls = F.col("outlets") < F.col("prev")
    t = (
        F.when(F.col("n") == 1, "new")
        .when((F.col("outlets") > F.col("prev")) & (F.col("outlets") >= F.col("window_mean")), "climbing")
        .when((F.col("peak_date") == F.col("prev_date")) & falls, "peaked")
        .when(falls & (F.col("outlets") < F.col("window_mean")), "cooling")
        .otherwise("steady")
    )
    return p.select("id", "date", "outlets", "articles", "window_mean", "peak_date", t.alias("trend"))

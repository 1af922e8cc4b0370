"""Publication gate, feed health and document validation."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR, DEVIATION = 50, 0.6


def gate(articles: Column, stories: Column, previous_articles: Column, previous_stories: Column, floor: int | None = None, deviation: float | None = None) -> Column:
    """struct(ok, reason): `floor` distinct articles at least, and a number of stories that is within `deviation` of the previous run's.

    Without a previous run (no stories in it, or none known) only the floor counts. Numbers that are null count as 0.
    """
    floor = int(os.environ.get("PUBLISH_FLOOR", FLOOR)) if floor is None else floor
    deviation = float(os.environ.get("PUBLISH_DEVIATION", DEVIATION)) if deviation is None else deviation
    new, old = F.coalesce(articles, F.lit(0)), F.coalesce(previous_articles, F.lit(0))
    now, before = F.coalesce(stories, F.lit(0)), F.coalesce(previous_stories, F.lit(0))
    share = F.abs(now - before) / before
    reason = (
        F.when(new < floor, F.concat(F.lit("only "), new.cast("string"), F.lit(" articles (before: "), old.cast("string"), F.lit(")")))
        .when((before > 0) & (share > deviation), F.concat(F.lit("story count "), now.cast("string"), F.lit(" deviates from "), before.cast("string")))
        .otherwise("")
    )
    return F.struct((reason == "").alias("ok"), reason.alias("reason"))


def feed_ok(status: Column, entries: Column) -> Column:
    return F.coalesce(status < 400, F.lit(True)) & (entries > 0)


def newest_age(days: Column, as_of: Column) -> Column:
    """Aggregate: smallest age in days; dates that can't be read are null and skipped."""
    return F.min(F.datediff(as_of, days))


def feed_health(feeds: DataFrame, entries: DataFrame, as_of: Column) -> DataFrame:
    """feeds (url, http_status, latency_ms, bozo, error), entries (url, day): a record for each feed."""
    e = entries.groupBy("url").agg(F.count("*").alias("entry_count"), newest_age(F.col("day"), as_of).alias("newest_entry_age_days"))
    h = feeds.join(e, "url", "left").withColumn("entry_count", F.coalesce("entry_count", F.lit(0)))
    return h.withColumn("ok", feed_ok(F.col("http_status"), F.col("entry_count")))


def health_counts(health: DataFrame) -> DataFrame:
    return health.agg(F.count("*").alias("feeds"), F.count_if(F.col("ok")).alias("ok"), F.count_if(~F.col("ok")).alias("failing"), F.sum("entry_count").alias("entries"))


def failing(health: DataFrame) -> DataFrame:
    """url and why, by url."""
    why = F.coalesce(F.col("error"), F.when(F.col("http_status") >= 400, F.concat(F.lit("HTTP "), F.col("http_status").cast("string"))), F.lit("no entries"))
    return health.where(~F.col("ok")).select("url", why.alias("reason")).orderBy("url")


def with_late_errors(health: DataFrame, late: DataFrame) -> DataFrame:
    """A second record, with its error, for each feed of late (url, error): what was read and failed behind the reader has both."""
    second = late.select("url", "error", F.lit(0).cast("long").alias("entry_count"), F.lit(False).alias("ok"))
    return health.unionByName(second, allowMissingColumns=True)


def emit_health(health: DataFrame, stamp: str, path: str | None = None, remote: bool | None = None) -> bool:
    """Prints the summary and, if remote (default: FEED_HEALTH_REMOTE is true), writes the records as JSON under path.

    Whatever fails is printed and False returned: a run never ends for its feeds' health.
    """
    try:
        n = health_counts(health).first()
        print(f"feeds: {n.feeds}, ok: {n.ok}, failing: {n.failing}, entries: {n.entries or 0}")
        for r in failing(health).toLocalIterator():
            print(f"failing: {r.url}: {r.reason}")
        if os.environ.get("FEED_HEALTH_REMOTE", "").lower() == "true" if remote is None else remote:
            health.coalesce(1).write.mode("overwrite").json(f"{path}/feed_health_{stamp.replace(':', '-')}.json")
    except Exception as e:
        print(f"feed health wasn't written: {e}")
        return False
    return True


def status(stamp: Column, now: Column) -> Column:
    """fresh up to seven hours, then stale; unknown without a stamp."""
    return F.when(stamp.isNull(), "unknown").when(F.unix_timestamp(now) - F.unix_timestamp(stamp) > 7 * 3600, "stale").otherwise("fresh")


def _broken(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, violation): each rule that holds for a row; a rule that is null holds."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]))
    return df.select(key, F.explode(found).alias("violation"))


def _no(c: str, pattern: str) -> Column:
    return ~F.col(c).rlike(pattern)


def violations(stories: DataFrame) -> DataFrame:
    """What a stories document may not hold."""
    return _broken(stories, "id", {
        "id": _no("id", "^st_[0-9a-f]{6}$"), "headline": F.col("headline") == "", "headline_source": F.col("headline_source").isNull(),
        "kind": ~F.col("kind").isin("story", "roundup", "deal"), "outlet_count": F.col("outlet_count") < 1, "article_count": F.col("article_count") != F.size("articles"),
        "days_running": F.col("days_running") < 1, "outlets": F.size("outlets") != F.col("outlet_count"), "keywords": F.size("keywords") > 8,
    })


def momentum_violations(momentum: DataFrame) -> DataFrame:
    return _broken(momentum, "id", {
        "id": _no("id", "^st_[0-9a-f]{6}$"), "series": (F.size("series") < 1) | (F.size("series") > 14), "days_running": F.col("days_running") != F.size("series"),
        "first_seen": _no("first_seen", r"^\d{4}-\d{2}-\d{2}$"), "peak_date": F.col("peak_date").isNull(), "trend": ~F.col("trend").isin("new", "climbing", "peaked", "cooling", "steady"),
    })


def news_violations(fact: DataFrame) -> DataFrame:
    """fact (top_id, title, link, timestamp, source): rows of the visualization document."""
    return _broken(fact, "top_id", {c: F.col(c).isNull() | (F.col(c) == "") for c in ("title", "link", "source")} | {"timestamp": F.col("timestamp").isNull()})


def metadata_violations(metadata: DataFrame) -> DataFrame:
    return _broken(metadata, "datetime", {"datetime": _no("datetime", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}"), "version": _no("version", r"^\d+\.\d+\.\d+$")})


def health_violations(health: DataFrame) -> DataFrame:
    return _broken(health, "url", {"entry_count": F.col("entry_count") < 0, "ok": F.col("ok") != feed_ok(F.col("http_status"), F.col("entry_count"))})

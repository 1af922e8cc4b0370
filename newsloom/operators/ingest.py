"""Feed entries: required fields, recency, sources, one row per title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW_DAYS = 14


def has_required(*cols: str) -> Column:
    """Every column is neither null nor ''."""
    out = F.lit(True)
    for c in cols:
        out = out & F.coalesce(F.col(c) != "", F.lit(False))
    return out


def is_recent(day: Column, as_of: Column, days: int = WINDOW_DAYS) -> Column:
    """Less than `days` before as_of; future and unknown days stay."""
    return F.coalesce(F.datediff(as_of, day) < days, F.lit(True))


def source_of(base: Column, link: Column) -> Column:
    return F.coalesce(F.nullif(base, F.lit("")), F.nullif(link, F.lit("")), F.lit("unknown"))


def feed_title(title: Column, subtitle: Column, description: Column, link: Column, url: Column) -> Column:
    """The title if the feed has one (an empty one too); else, told as such, the first of subtitle, description and link that isn't empty, or the URL's host."""
    told = [F.when(c != "", F.concat(F.lit(f"Feed ({name}: "), c, F.lit(")"))) for name, c in (("subtitle", subtitle), ("description", description), ("link", link))]
    host = F.coalesce(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")), F.nullif(url, F.lit("")))
    return F.coalesce(title, *told, F.concat(F.lit("Feed ("), host, F.lit(")")), F.concat(F.lit("Unknown Feed ("), F.coalesce(url, F.lit("")), F.lit(")")))


def one_per_title(entries: DataFrame) -> DataFrame:
    """entries with title and pos: of equal titles the last entry's values at the first entry's position."""
    rest = [c for c in entries.columns if c not in ("title", "pos")]
    last = F.max_by(F.struct(*rest), F.col("pos")).alias("last")
    out = entries.groupBy("title").agg(F.min("pos").alias("pos"), last)
    return out.select("title", "pos", *[F.col(f"last.{c}").alias(c) for c in rest])


def prepared(entries: DataFrame, as_of: Column) -> DataFrame:
    """entries (pos, title, link, published, day, title_detail_base): filtered, with source, one row per title."""
    kept = entries.where(has_required("title", "link", "published") & is_recent(F.col("day"), as_of))
    return one_per_title(kept.withColumn("source", source_of(F.col("title_detail_base"), F.col("link"))))


def unknown_only(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Incremental load: rows whose key isn't known."""
    return found.join(known.select(key), key, "left_anti")


def unmapped(feeds: DataFrame, sources: DataFrame) -> DataFrame:
    """feeds (url): those that sources (url, …) doesn't have, by url."""
    known = sources.select(F.trim("url").alias("_url")).distinct()
    return feeds.select(F.trim("url").alias("url")).distinct().join(known, F.col("url") == F.col("_url"), "left_anti").orderBy("url")


def resolved(feeds: DataFrame, sources: DataFrame, domain: Column, outlet: Column) -> DataFrame:
    """feeds (feed) with outlet, domain, section from sources (url, outlet, domain, section), else derived and General."""
    s = sources.select(F.trim("url").alias("_url"), F.col("outlet").alias("_o"), F.col("domain").alias("_d"), F.col("section").alias("_s"))
    out = feeds.join(s, F.trim("feed") == F.col("_url"), "left")
    return out.select(*feeds.columns, F.coalesce("_o", outlet).alias("outlet"), F.coalesce("_d", domain).alias("domain"), F.coalesce("_s", F.lit("General")).alias("section"))

"""Feed dates as Column expressions. Results are UTC whatever the session's zone is, if that is UTC (which sessions of this engine set)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (fixed values) zone names that feeds still write, as offsets.
ZONES = {"EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700", "GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000"}


def parsed(raw: Column) -> Column:
    """Timestamp of an ISO 8601 or RFC 2822 date; a missing or unknown zone is UTC; null if it can't be read."""
    iso = F.regexp_replace(raw, r"Z$", "+00:00")
    iso = F.regexp_replace(iso, r"^(\d{4}-\d{2}-\d{2}) ", "$1T")
    iso = F.when(iso.rlike(r"[+-]\d{2}:?\d{2}$") | ~raw.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"), iso).otherwise(F.concat(iso, F.lit("+00:00")))
    mail = F.regexp_replace(F.trim(raw), r"^[A-Za-z]{3,9},?\s*", "")
    mail = F.regexp_replace(mail, r"(\d{1,2}:\d{2})(\s|$)", "$1:00$2")
    mail = F.regexp_replace(mail, r"(:\d{2}):(\d{2}):00", "$1:$2")
    body = F.regexp_extract(mail, r"^(\d{1,2}\s+[A-Za-z]{3}\s+\d{4}\s+\d{1,2}:\d{2}:\d{2})", 1)
    zone = F.upper(F.trim(F.regexp_extract(mail, r"^\d{1,2}\s+[A-Za-z]{3}\s+\d{4}\s+\d{1,2}:\d{2}:\d{2}(.*)$", 1)))
    offset = F.when(zone.rlike(r"^[+-]\d{4}$"), zone)
    for name, value in ZONES.items():
        offset = F.when(zone == name, value).otherwise(offset)
    offset = F.coalesce(offset, F.lit("+0000"))
    as_mail = F.try_to_timestamp(F.concat(F.regexp_replace(body, r"\s+", " "), F.lit(" "), offset), F.lit("d MMM yyyy H:mm:ss Z"))
    is_iso = raw.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}")
    return F.when(is_iso, F.try_to_timestamp(iso)).when(body != "", as_mail)


def to_iso8601(raw: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SSZ, or the raw text if it can't be read."""
    return F.coalesce(F.date_format(parsed(raw), "yyyy-MM-dd'T'HH:mm:ss'Z'"), raw)


def iso_date(raw: Column) -> Column:
    return F.coalesce(F.date_format(parsed(raw), "yyyy-MM-dd"), F.lit(""))


def run_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def relative_time(then: Column, now: Column) -> Column:
    """'just now', minutes, hours or days ago."""
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    some = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(f" {unit}"), F.when(F.floor(n) == 1, "").otherwise("s"), F.lit(" ago"))
    return F.when(then.isNull(), "Unknown").when(s < 60, "Just now").when(s < 3600, some(s / 60, "minute")).when(s < 86400, some(s / 3600, "hour")).otherwise(some(s / 86400, "day"))


def _stamp(name: Column, minutes: bool = False) -> Column:
    """A run's stamp in a file's name, its time written with : or, where a file system bars that, with -; '' if none."""
    found = F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2}T\d{2}[:-]\d{2}" + ("" if minutes else r"(?:[:-]\d{2})?") + ")", 1)
    return F.concat(F.substring(found, 1, 10), F.replace(F.substring(found, 11, 20), F.lit("-"), F.lit(":")))


def file_stamp(name: Column) -> Column:
    """The run's stamp inside an archive file's name, or null."""
    return F.nullif(_stamp(name), F.lit(""))


def minute_of(name: Column) -> Column:
    """The minute of a file's run stamp, or null."""
    return F.nullif(_stamp(name, minutes=True), F.lit(""))


def archive_name(name: Column) -> Column:
    """struct(version, stamp, ts) of an archive file's name latest_news_<version>_<stamp>.json, or null."""
    pattern = r"^latest_news_([0-9][^_]*)_\d{4}-\d{2}-\d{2}T\d{2}[:-]\d{2}(?:[:-]\d{2})?(?:\.\d+)?\.json$"
    stamp = _stamp(name)
    ts = F.coalesce(F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd'T'HH:mm")))
    return F.when(name.rlike(pattern), F.struct(F.regexp_extract(name, pattern, 1).alias("version"), stamp.alias("stamp"), ts.alias("ts")))

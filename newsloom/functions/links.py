"""Links, domains and outlets as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (fixed values) public suffixes of two labels.
TWO_LABELS = ("co.uk", "com.au", "co.jp")


def authority(url: Column) -> Column:
    """What stands between // and the path, query or fragment; '' if there is none."""
    return F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def _no_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def normalize_link(url: Column) -> Column:
    """An article's identity: host in lower case without www., path as it is without its last slashes."""
    return F.concat(_no_www(F.lower(authority(url))), F.regexp_replace(path(url), r"/+$", ""))


def registered_domain(host: Column) -> Column:
    parts = F.split(F.regexp_replace(F.lower(host), r"^\.+", ""), r"\.")
    n = F.size(parts)
    last = lambda k: F.array_join(F.slice(parts, n - k + 1, k), ".")
    return F.when((n >= 3) & last(2).isin(*TWO_LABELS), last(3)).when(n >= 2, last(2)).otherwise(host)


def feed_domain(feed: Column) -> Column:
    feed = F.trim(feed)
    host = F.coalesce(F.nullif(authority(feed), F.lit("")), feed)
    return registered_domain(_no_www(F.substring_index(host, ":", 1)))


def outlet_of_domain(domain: Column) -> Column:
    """First label, capitalised."""
    label = F.substring_index(domain, ".", 1)
    return F.concat(F.upper(F.substring(label, 1, 1)), F.lower(F.substring(label, 2, 1_000_000)))

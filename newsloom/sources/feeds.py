"""Feed lists and feed documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.retry import retried
from newsloom.operators.ingest import feed_title

ENTRY = "feed_url string, feed_title string, feed_subtitle string, feed_description string, feed_link string, pos bigint, title string, link string, published string, title_detail_base string, bozo boolean, error string"


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


def feed_list(spark: SparkSession, path: str) -> DataFrame:
    """One URL a line; blank lines are skipped; there is no comment syntax."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> ''")


def retired_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines 'url  # retired date: reason'."""
    line = F.col("value")
    return spark.read.text(path).where("trim(value) <> ''").select(
        F.trim(F.regexp_extract(line, r"^([^#]+)", 1)).alias("url"),
        F.nullif(F.regexp_extract(line, r"#\s*retired\s+(\S+?):", 1), F.lit("")).alias("retired"),
        F.trim(F.regexp_extract(line, r"#[^:]*:\s*(.*)$", 1)).alias("reason"),
    )


def sources_dimension(spark: SparkSession, path: str | None) -> DataFrame:
    """A JSON object url -> {outlet, domain, section}; a missing file is an empty table."""
    schema = "url string, outlet string, domain string, section string"
    if path is None:
        return spark.createDataFrame([], schema)
    try:
        raw = spark.read.text(path, wholetext=True)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise
    m = F.from_json("value", "map<string,struct<outlet:string,domain:string,section:string>>")
    return raw.select(F.explode(m).alias("url", "s")).select(F.trim("url").alias("url"), "s.outlet", "s.domain", "s.section")


def parse_feed(url: str, body: str | bytes) -> list[dict]:
    """RSS 2.0 and Atom documents to entries; a document that isn't XML gives one row with an error."""
    import xml.etree.ElementTree as ET

    def tag(e) -> str:
        return e.tag.rpartition("}")[2].lower()

    def text(e, *names: str) -> str | None:
        for name in names:
            for c in e:
                if tag(c) == name:
                    value = (c.text or "").strip() or (c.get("href") or "").strip()
                    if value:
                        return value
        return None

    try:
        root = ET.fromstring(body)
    except ET.ParseError as e:
        return [{"feed_url": url, "bozo": True, "error": str(e)}]
    channel = next((c for c in root if tag(c) == "channel"), root)
    title = next(((c.text or "").strip() for c in channel if tag(c) == "title"), None)
    told = {"feed_title": title, "feed_subtitle": text(channel, "subtitle"), "feed_description": text(channel, "description"), "feed_link": text(channel, "link")}
    base = root.get("{http://www.w3.org/XML/1998/namespace}base") or url
    out = []
    items = [e for e in root.iter() if tag(e) in ("item", "entry")]
    for i, e in enumerate(items):
        out.append({"feed_url": url, **told, "pos": i, "title": text(e, "title"), "link": text(e, "link", "guid", "id"), "published": text(e, "pubdate", "published", "updated", "date"), "title_detail_base": base, "bozo": False})
    return out


def entries_of(feeds: DataFrame, body: str = "body") -> DataFrame:
    """feeds (url, body): entries. One Arrow pass over the documents; a feed that can't be read is one row with its error."""
    schema = arrow_schema(ENTRY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for u, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist(parse_feed(u, x or ""), schema)

    e = feeds.select("url", body).mapInArrow(run, ENTRY)
    told = ("feed_subtitle", "feed_description", "feed_link")
    return e.withColumn("feed_title", feed_title(F.col("feed_title"), *map(F.col, told), F.col("feed_url"))).drop(*told)


def fetched(feeds: DataFrame, fetch: Callable[[str], tuple[int | None, str, int]], attempts: int = 1) -> DataFrame:
    """feeds (url) through fetch(url) -> (status, body, milliseconds): url, http_status, body, latency_ms, error. A feed that fails in all attempts is a row too."""
    fetch = retried(fetch, attempts)
    ddl = "url string, http_status int, body string, latency_ms int, error string"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for u in b.column(0).to_pylist():
                row = {"url": u}
                try:
                    row["http_status"], row["body"], row["latency_ms"] = fetch(u)
                except Exception as e:  # one feed's failure is its own
                    row["error"] = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_pylist([row], schema)

    return feeds.select("url").mapInArrow(run, ddl)


def http_fetch(url: str, timeout: float = 20.0) -> tuple[int | None, str, int]:
    """The default fetch for runs with a network."""
    import time
    import urllib.request

    began = time.time()
    with urllib.request.urlopen(url, timeout=timeout) as r:
        return r.status, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace"), int(1000 * (time.time() - began))


def chosen_list(environment: str, lists: dict[str, str], default: str = "prod") -> str:
    """The feed list's path for an environment; an unknown one has the default's."""
    return lists.get(environment.lower(), lists[default])


def feeds_or(spark: SparkSession, path: str, fallback: list[str]) -> DataFrame:
    """The feeds of a list, or the fallback's where the list is missing or empty."""
    try:
        f = feed_list(spark, path)
        if not f.isEmpty():
            return f
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    return spark.createDataFrame([(u,) for u in fallback], "url string")

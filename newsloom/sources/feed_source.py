"""Feeds as a data source: spark.read.format("newsloom_feeds") reads all of them, spark.readStream those that have changed.

Option `feeds`: a path of a feed list (one URL a line), or `urls`: the URLs as a JSON list. A partition is a feed, so tasks fetch side by side and one
feed's failure is a row of its own (bozo, with the error). The stream's offset is each feed's validator: its ETag, else the date of its last
change, as a HEAD request tells them (by the driver, PROBES at a time, a line a feed); a batch reads the feeds whose validator differs from the
one of the batch before. So a restart from a checkpoint reads no feed twice, and a feed without validators is read at every trigger. A feed whose probe fails keeps
its validator; right after a restart that is unknown, and such a feed may be read once more.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from newsloom.functions.retry import retried
from newsloom.sources.feeds import ENTRY, arrow_schema, http_fetch, parse_feed

PROBES = 16


def http_probe(url: str, timeout: float = 20.0) -> str | None:
    """A feed's validator by a HEAD request; None if it has none."""
    import urllib.request

    with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=timeout) as r:
        return r.headers.get("ETag") or r.headers.get("Last-Modified")


@dataclass
class Feed(InputPartition):
    url: str


class FeedSource(DataSource):
    """A subclass with other fetch (url to status, body, milliseconds) and probe (url to validator) is a source with another transport."""

    fetch = staticmethod(http_fetch)
    probe = staticmethod(http_probe)

    @classmethod
    def name(cls) -> str:
        return "newsloom_feeds"

    def schema(self) -> str:
        return ENTRY

    def _urls(self) -> list[str]:
        if "urls" in self.options:
            return json.loads(self.options["urls"])
        from newsloom.sources.objects import get

        body = get(self.options["feeds"])
        if body is None:
            raise ValueError(f"there is no feed list at {self.options['feeds']}")
        return [u for line in body.decode().splitlines() if (u := line.strip())]

    def reader(self, schema) -> BatchReader:
        return BatchReader(self._urls(), self.fetch, int(self.options.get("attempts", 3)))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self._urls(), self.fetch, self.probe, int(self.options.get("attempts", 3)))


def _entries(url: str, fetch, attempts: int) -> Iterator[pa.RecordBatch]:
    try:
        status, body, _ = retried(fetch, attempts)(url)
        rows = parse_feed(url, body or "") if status is None or status < 400 else [{"feed_url": url, "bozo": True, "error": f"HTTP {status}"}]
    except Exception as e:  # one feed's failure is its own
        rows = [{"feed_url": url, "bozo": True, "error": f"{type(e).__name__}: {e}"}]
    yield pa.RecordBatch.from_pylist(rows, arrow_schema(ENTRY))


class BatchReader(DataSourceReader):
    def __init__(self, urls: list[str], fetch, attempts: int) -> None:
        self.urls, self.fetch, self.attempts = urls, fetch, attempts

    def partitions(self) -> list[Feed]:
        return [Feed(u) for u in self.urls]

    def read(self, partition: Feed) -> Iterator[pa.RecordBatch]:
        return _entries(partition.url, self.fetch, self.attempts)


class StreamReader(DataSourceStreamReader):
    def __init__(self, urls: list[str], fetch, probe, attempts: int) -> None:
        self.urls, self.fetch, self.probe, self.attempts, self.known = urls, fetch, probe, attempts, {}

    def initialOffset(self) -> dict:
        return {"feeds": {}}

    def _validator(self, url: str) -> str | None:
        try:
            return self.probe(url) or f"at {time.time()}"
        except Exception:  # told when the feed is read
            return self.known.get(url)

    def latestOffset(self) -> dict:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(PROBES) as pool:
            found = dict(zip(self.urls, pool.map(self._validator, self.urls), strict=True))
        self.known = {u: v for u, v in found.items() if v is not None}
        return {"feeds": self.known}

    def partitions(self, start: dict, end: dict) -> list[Feed]:
        return [Feed(u) for u, v in end["feeds"].items() if start["feeds"].get(u) != v]

    def read(self, partition: Feed) -> Iterator[pa.RecordBatch]:
        return _entries(partition.url, self.fetch, self.attempts)

    def commit(self, end: dict) -> None:
        pass

import json
import os

from pyspark.sql import functions as F

from newsloom.sources.feed_source import FeedSource, StreamReader

RSS = "<rss><channel><title>T {0}</title><item><title>one {0} {1}</title><link>https://{0}.com/1</link></item><item><title>two {0} {1}</title><link>https://{0}.com/2</link></item></channel></rss>"


def _made(folder):
    """A source over files: a feed's file has its validator and state; what is fetched is written down."""

    class Made(FeedSource):
        @staticmethod
        def fetch(url):
            with open(f"{folder}/asked", "a") as f:
                f.write(url + "\n")
            kind, n = open(f"{folder}/{url}").read().split()
            if kind == "dead":
                raise OSError("no route")
            return (500, "", 1) if kind == "broken" else (200, RSS.format(url, n), 1)

        @staticmethod
        def probe(url):
            kind, n = open(f"{folder}/{url}").read().split()
            if kind == "dead":
                raise OSError("no route")
            return None if kind == "plain" else f'"{n}"'

    return Made


def _asked(folder):
    at = f"{folder}/asked"
    got = sorted(open(at).read().split()) if os.path.exists(at) else []
    open(at, "w").close()
    return got


def test_batch_reads_each_feed_once(spark, tmp_path):
    for name, state in (("a", "ok 1"), ("b", "broken 1"), ("c", "dead 1")):
        (tmp_path / name).write_text(state)
    spark.dataSource.register(_made(str(tmp_path)))
    (tmp_path / "list.txt").write_text("a\n\n b \nc\n")
    df = spark.read.format("newsloom_feeds").option("feeds", str(tmp_path / "list.txt")).option("attempts", 1).load()
    rows = df.collect()
    assert sorted((x.feed_url, x.title) for x in rows if not x.bozo) == [("a", "one a 1"), ("a", "two a 1")]
    assert {x.feed_url: x.error for x in rows if x.bozo} == {"b": "HTTP 500", "c": "OSError: no route"}
    assert _asked(tmp_path) == ["a", "b", "c"] and df.rdd.getNumPartitions() == 3


def test_stream_reads_what_changed_and_nothing_twice(spark, tmp_path):
    urls = ["a", "b", "c", "d"]
    for name, state in zip(urls, ("ok 1", "ok 1", "dead 1", "plain 1"), strict=True):
        (tmp_path / name).write_text(state)
    spark.dataSource.register(_made(str(tmp_path)))
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        s = spark.readStream.format("newsloom_feeds").option("urls", json.dumps(urls)).option("attempts", 1).load()
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(once=True).start().awaitTermination()
        return _asked(tmp_path)

    assert run() == ["a", "b", "d"]
    assert run() == ["d"], "after a restart only the feed without a validator is read again"
    (tmp_path / "b").write_text("ok 2")
    (tmp_path / "c").write_text("ok 1")
    assert run() == ["b", "c", "d"]
    got = spark.read.parquet(out).where("feed_url <> 'd'").groupBy("title").agg(F.count("*").alias("n")).collect()
    assert {x.title: x.n for x in got} == {f"{w} {f}": 1 for w in ("one", "two") for f in ("a 1", "b 1", "b 2", "c 1")}


def test_a_failed_probe_keeps_the_validator(tmp_path):
    (tmp_path / "a").write_text("ok 1")
    made = _made(str(tmp_path))
    r = StreamReader(["a"], made.fetch, made.probe, 1)
    first = r.latestOffset()
    (tmp_path / "a").write_text("dead 1")
    assert first == {"feeds": {"a": '"1"'}} == r.latestOffset() and [p.url for p in r.partitions(r.initialOffset(), first)] == ["a"] and r.partitions(first, first) == []

import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from newsloom.operators import momentum, naming
from newsloom.plans import engine
from newsloom.sources import archive, feeds, versions
from newsloom.streaming import archive_stream

RSS = """<rss><channel><title>Planet</title><item><title>{0} bridge closes after storm damage</title><link>https://{1}.com/a</link><pubDate>Mon, 02 Mar 2026 10:00:00 GMT</pubDate></item>
<item><title>Unrelated music festival lineup</title><link>https://{1}.com/b</link><pubDate>Mon, 02 Mar 2026 11:00:00 GMT</pubDate></item><item><title>No link</title></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><subtitle>Sub</subtitle><entry><title>Storm damage closes harbor bridge</title><link href="https://c.com/x"/><updated>2026-03-02T09:00:00Z</updated></entry></feed>"""


def entries(spark):
    bodies = {"https://a.com/rss": RSS.format("Harbor", "a"), "https://b.com/rss": RSS.format("Big harbor", "b"), "https://c.com/atom": ATOM, "https://d.com/bad": "<oops"}

    def fetch(url):
        if "e.com" in url:
            raise OSError("no route")
        return 200, bodies[url], 5

    urls = spark.createDataFrame([(u,) for u in [*bodies, "https://e.com/x"]], "url string")
    got = feeds.fetched(urls, fetch)
    assert [x.error for x in got.where("url like '%e.com%'").collect()] == ["OSError: no route"]
    return feeds.entries_of(got.where("body is not null"))


def test_feeds_to_stories(spark, tmp_path):
    from newsloom.functions.dates import parsed

    e = entries(spark).cache()
    assert {x.feed_title for x in e.where("not bozo").collect()} == {"Planet", "Feed (subtitle: Sub)"} and e.where("bozo").count() == 1
    e = e.withColumn("day", F.to_date(parsed(F.col("published")))).withColumn("pos", F.row_number().over(Window.orderBy("feed_url", "pos")))
    none = spark.createDataFrame([], "url string, outlet string, domain string, section string")
    out = engine.run(e, none, spark.createDataFrame([], momentum.STATE), spark.createDataFrame([], naming.CACHE), "2026-03-03")
    s = out["stories"].collect()
    assert len(s) == 1 and s[0].article_count == 3 and s[0].outlet_count == 3 and s[0].kind == "story"
    assert out["momentum"].first().trend == "new"

    at = str(tmp_path)
    archive.emit(out["groups"], "2026-03-03T00:00", "0.2.1", "local", local=at)
    doc = json.loads(spark.read.text(f"{at}/latest_news.json").first().value)
    assert sum(len(e) for sub in doc.values() for e in sub.values()) == 3
    back = archive.fact_of(archive.documents(spark, f"{at}/archive"))
    assert back.count() == 3
    with pytest.raises(ValueError, match="writer"):
        archive.emit(out["groups"], "x", "0", "nowhere")
    ok, why = archive.emit_stories(out["stories"], out["momentum"], out["state"], at, f"{at}/state", floor=50)
    assert not ok and "3" in why
    ok, _ = archive.emit_stories(out["stories"], out["momentum"], out["state"], at, f"{at}/state", floor=1)
    assert ok and archive.state(spark, f"{at}/state", momentum.STATE).count() == 1
    ok, why = archive.emit_stories(out["stories"].limit(0), out["momentum"], out["state"], at, f"{at}/state", floor=0)
    assert not ok and "deviates" in why


def test_replay_in_order(spark):
    schema = "group long, label string, pos long, title string, link string, timestamp string, source string"
    day = lambda k: spark.createDataFrame([(0, "[bridge] [storm]", 0, f"t{k}", f"https://a.com/{k}", "", "https://a.com/f"), (0, "[bridge] [storm]", 1, "u", f"https://b.com/{k}", "", "https://b.com/f")], schema)
    none = spark.createDataFrame([], "url string, outlet string, domain string, section string")
    state = engine.replay(spark, [("2026-03-01", day(1)), ("2026-03-02", day(2))], none).collect()
    assert len(state) == 1 and [p.outlets for p in state[0].series] == [2, 2] and state[0].first_seen == "2026-03-01"


def test_lists(spark, tmp_path):
    (tmp_path / "f.txt").write_text("https://a.com/rss\n\n  https://b.com/rss \n")
    assert sorted(x.url for x in feeds.feed_list(spark, str(tmp_path / "f.txt")).collect()) == ["https://a.com/rss", "https://b.com/rss"]
    (tmp_path / "r.txt").write_text("https://c.com  # retired 2026-01-02: gone\n")
    assert tuple(feeds.retired_list(spark, str(tmp_path / "r.txt")).first()) == ("https://c.com", "2026-01-02", "gone")
    (tmp_path / "s.json").write_text('{"https://a.com/rss ": {"outlet": "A", "domain": "a.com", "section": "World"}}')
    assert tuple(feeds.sources_dimension(spark, str(tmp_path / "s.json")).first()) == ("https://a.com/rss", "A", "a.com", "World")
    assert feeds.sources_dimension(spark, str(tmp_path / "none.json")).count() == 0


def test_stream_upserts_each_stamp_once(spark, tmp_path):
    at = str(tmp_path / "t")
    schema = "date string, ts string, articles long"
    handle = archive_stream.metrics_upsert(at, schema)
    b = spark.createDataFrame([("d", "1", 5), ("d", "2", 6)], schema)
    handle(b, 0)
    handle(b, 0)
    handle(spark.createDataFrame([("d", "2", 99), ("e", "3", 7)], schema), 1)
    assert sorted((x.ts, x.articles) for x in archive.state(spark, at, schema).collect()) == [("1", 5), ("2", 6), ("3", 7)]


def test_stream_counts(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "event_id long, ts timestamp, event_type string, value double"
    rows = [(1, "2026-01-01 10:00:00", "a", 1.0), (1, "2026-01-01 10:00:00", "a", 1.0), (2, "2026-01-01 12:00:00", "a", 2.0), (3, "2026-03-01 00:00:00", "b", 1.0)]
    df = spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(src)
    archive_stream.run_available(archive_stream.daily_counts(archive_stream.event_stream(spark, src, schema)), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [(str(x.day), x.event_type, x.n, x.value) for x in spark.read.parquet(str(tmp_path / "out")).collect()] == [("2026-01-01", "a", 2, 3.0)]


def test_catalog_is_complete():
    from newsloom.plans.reports import ORACLE, QUERIES

    assert set(ORACLE) <= set(QUERIES) and len(QUERIES) >= 60


def test_archive_names_and_mirror(spark):
    from newsloom.functions import dates

    f = spark.createDataFrame([("latest_news_0.2.1_2026-03-01T10:20:30.json", 5), ("latest_news_0.2.1_2026-03-01T10-20-31.json", 6), ("momentum_state.json", 7)], "name string, size long")
    got = f.select("name", dates.archive_name(F.col("name")).alias("a")).collect()
    assert (got[0].a.version, got[0].a.stamp, str(got[0].a.ts)) == ("0.2.1", "2026-03-01T10:20:30", "2026-03-01 10:20:30") and got[2].a is None
    here = spark.createDataFrame([("momentum_state.json", 7), ("latest_news_0.2.1_2026-03-01T10:20:30.json", 4)], "name string, size long")
    assert archive.to_mirror(f, here).count() == 2
    assert [x.minute for x in archive.with_minutes(f).select("minute").distinct().collect()] == ["2026-03-01T10:20"]


def test_fallback_feeds(spark, tmp_path):
    assert [x.url for x in feeds.feeds_or(spark, str(tmp_path / "none"), ["u"]).collect()] == ["u"]
    assert feeds.chosen_list("QA", {"prod": "p", "qa": "q"}) == "q" and feeds.chosen_list("x", {"prod": "p"}) == "p"


def test_command_line(spark, tmp_path, monkeypatch):
    from newsloom import cli

    monkeypatch.setattr(cli, "session", lambda: spark)
    a, m = tmp_path / "archive", str(tmp_path / "metrics")
    a.mkdir()
    doc = {"[Bridge]": {"[Bridge]": {t: {"title": t, "link": f"https://{t}.com/x", "timestamp": "2026-03-01T00:00:00Z", "source": f"https://{t}.com/f"} for t in ("a", "b")}}}
    for k in (1, 2):
        (a / f"latest_news_0.2.1_2026-03-0{k}T10-00.json").write_text(json.dumps(doc))
    (a / "momentum_state.json").write_text("{}")
    for _ in range(2):
        assert cli.main(["update", "--archive", str(a), "--metrics", m]) == 0
    assert sorted((x.date, x.articles, x.sources) for x in versions.read(spark, m).collect()) == [("2026-03-01", 2, 2), ("2026-03-02", 2, 2)]
    assert cli.main(["stats", "--metrics", m]) == 0 and cli.main(["analyze", "--metrics", m]) == 0
    assert cli.main(["dashboard", "--metrics", m, "--now", "2026-03-02 12:00:00"]) == 0
    assert cli.main(["replay", "--archive", str(a), "--state", str(tmp_path / "state")]) == 0
    s = archive.state(spark, str(tmp_path / "state"), momentum.STATE).collect()
    assert len(s) == 1 and len(s[0].series) == 2
    assert cli.main(["clear-cache", "--metrics", m]) == 0 and archive.state(spark, m, "date string").count() == 0

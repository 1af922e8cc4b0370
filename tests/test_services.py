import json

import pytest
from pyspark.sql import functions as F

from newsloom import config
from newsloom.functions import terms
from newsloom.functions.retry import or_none, retried
from newsloom.operators import checks, metrics, naming
from newsloom.plans import sandbox
from newsloom.sources import archive, feeds


def test_settings(tmp_path):
    ini = tmp_path / "s.ini"
    ini.write_text("[storage]\nlocal = /a\n[params]\ndebug = True\n[extra]\nx = 100%\n")
    s = config.settings(str(ini), {"NEWSLOOM_STORAGE_REMOTE": "/b", "NEWSLOOM_PARAMS_VERSION": "9"})
    assert (s["storage"]["local"], s["storage"]["remote"], s["params"]["version"], s["extra"]["x"]) == ("/a", "/b", "9", "100%") and config.debug(s)
    assert config.settings(str(tmp_path / "none"), {}) == config.DEFAULTS and not config.debug(config.DEFAULTS)


def test_retries():
    calls = []

    def shaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError("later")
        return x

    assert retried(shaky)(7) == 7 and calls == [7, 7, 7]
    calls.clear()
    with pytest.raises(OSError, match="later"):
        retried(shaky, 2)(7)
    calls.clear()
    assert or_none(retried(shaky, 1))(7) is None


def test_fetch_is_retried(spark, tmp_path):
    def fetch(url):
        mark = tmp_path / "mark"
        if not mark.exists():
            mark.write_text("")
            raise OSError("once")
        return 200, "body", 1

    urls = spark.createDataFrame([("https://a.com",)], "url string").coalesce(1)
    assert feeds.fetched(urls, fetch, attempts=3).first().body == "body"


def test_old_and_new_names_of_fields(spark, tmp_path):
    new = {"title": "t", "link": "l", "timestamp": "2026", "source": "s"}
    old = {"title": "t", "link": "l", "published": "2021", "title_detail_base": "b"}
    both = {**new, **old, "source": ""}
    (tmp_path / "latest_news_0.2.1_2026-03-01T10-20.json").write_text(json.dumps({"[A]": {"[a]": {"1": new, "2": old, "3": both}}}))
    (tmp_path / "latest_news_0.2.1_2026-03-01T10-21.json").write_text("{oops")
    docs = archive.documents(spark, str(tmp_path))
    assert dict(docs.dtypes)["doc"] == archive.DOC
    assert [(x.timestamp, x.source) for x in archive.fact_of(docs).orderBy("pos").collect()] == [("2026", "s"), ("2021", "b"), ("2026", "b")]
    assert docs.where("doc is null").count() == 1


def test_mirror_copies_what_lacks(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir()
    names = [f"latest_news_0.2.1_{y}-03-01T10-20-30.json" for y in (2020, 2024, 2025)]
    for k, n in enumerate(names):
        (a / n).write_text("x" * (k + 1))
    (a / "state.json").write_text("no run")
    assert archive.mirrored(spark, str(a), str(b)) == 2 and archive.mirrored(spark, str(a), str(b)) == 0
    (b / "2025" / names[2]).write_text("cut short")
    assert archive.mirrored(spark, str(a), str(b), since="2025") == 1
    assert (b / "2025" / names[2]).read_text() == "xxx" and (b / "2024" / names[1]).read_text() == "xx" and not (b / "2020").exists()


def test_earlier_names_of_emit(spark, tmp_path):
    row = (0, "[A]", 0, "[a]", 0, "t", "https://a.com/x", "2026-03-01T00:00:00Z", "https://a.com/f")
    fact = spark.createDataFrame([row], "cluster long, top_id string, leader long, sub_id string, pos long, title string, link string, timestamp string, source string")
    l, r = str(tmp_path / "l"), str(tmp_path / "r")
    archive.log_visualization(fact, "2026-03-01T10:00", "0.2.1", l, r)
    assert not (tmp_path / "r").exists()
    archive.log_visualization(fact, "2026-03-01T10:00", "0.2.1", l, r, s3=True)
    archive.log_s3(fact, "2026-03-01T11:00", "0.2.1", r)
    assert [archive.documents(spark, f"{x}/archive").count() for x in (l, r)] == [1, 2]


def test_health_never_ends_a_run(spark, tmp_path, capsys):
    got = spark.createDataFrame([("a", 200, None), ("b", 500, None)], "url string, http_status int, error string")
    health = checks.feed_health(got, spark.createDataFrame([("a", None)], "url string, day date"), F.lit("2026-03-02").cast("date"))
    health = checks.with_late_errors(health, spark.createDataFrame([("a", "bad entry")], "url string, error string"))
    assert sorted((x.url, x.ok) for x in health.collect()) == [("a", False), ("a", True), ("b", False)]
    assert checks.emit_health(health, "2026-03-02T10:00", str(tmp_path), remote=True)
    said = capsys.readouterr().out
    assert "feeds: 3, ok: 1, failing: 2, entries: 1" in said and "failing: a: bad entry" in said and "failing: b: HTTP 500" in said
    assert spark.read.json(str(tmp_path / "feed_health_2026-03-02T10-00.json")).count() == 3
    assert not checks.emit_health(health, "x", "nowhere://at/all", remote=True) and "wasn't written" in capsys.readouterr().out
    assert checks.emit_health(health.limit(0), "x", "nowhere://at/all", remote=False)


def test_terms(spark):
    rows = [("Harbor bridge closed by storm",), ("The storms",), ("",), (None,), ("Court, judges; said nothing",)]
    t = spark.createDataFrame(rows, "t string")
    assert [x.a for x in t.select(terms.noun_chunks(F.col("t")).alias("a")).collect()] == [["Harbor bridge", "storm"], ["storms"], [], None, ["Court", "judges", "nothing"]]
    assert [x.a for x in t.select(terms.terms(F.col("t")).alias("a")).collect()] == [["closed", "Harbor bridge", "storm"], ["storm"], [], [], ["said", "Court", "judge", "nothing"]]
    words = {"cities": "city", "classes": "class", "bus": "bus", "class": "class", "storms": "storm", "is": "is"}
    w = spark.createDataFrame([(x,) for x in words], "w string")
    assert [x.a for x in w.select(terms.lemma(F.col("w")).alias("a")).collect()] == list(words.values())
    top = metrics.top_terms(metrics.sentence_terms(t.select(F.col("t").alias("text"))), 2).collect()
    assert [(x.term, x.freq) for x in top] == [("[storm]", 2), ("[harbor bridge]", 1)]


def test_local_name_adds_noun_phrases(spark):
    t = spark.createDataFrame([(["the court in Oslo fined a shipping firm", "heavy rain near Oslo", "rain again"],), (["nobody here"],), (None,)], "t array<string>")
    assert [x.a for x in t.select(naming.local_name(F.col("t")).alias("a")).collect()] == ["Oslo, court, firm", None, None]


def _stories(spark):
    art = lambda *t: [(x,) for x in t]
    rows = [(k, f"st_{k}", "story", f"fb{k}", 9 - k, 5, art(f"title {k}")) for k in range(4)]
    s = spark.createDataFrame(rows, "story long, id string, kind string, headline string, outlet_count long, article_count long, articles array<struct<title:string>>")
    return s.withColumn("headline_source", F.lit("fallback")).withColumn("latest_published", F.lit(""))


def test_remote_names_within_budget(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "asked")

    def post(url, headers, body, timeout):
        text = json.loads(body)["messages"][0]["content"]
        with open(log, "a") as f:
            f.write(text.splitlines()[-1] + "\n")
        if "title 1" in text:
            raise OSError("no route")
        reply = f"\"Named {text.splitlines()[-1]}.\""
        return json.dumps({"content": [{"text": reply}]} if "x-api-key" in headers else {"choices": [{"message": {"content": reply}}]}).encode()

    monkeypatch.setattr(naming, "NAMERS", dict(naming.NAMERS))
    for kind in ("messages", "chat"):
        open(log, "w").close()
        naming.register(kind, naming.http_ask(kind, "https://x.org", "m", "k", post=post))
        got, new = naming.named(_stories(spark), spark.createDataFrame([], naming.CACHE), "2026-03-10", provider=kind, budget=3)
        assert {x.id: (x.headline, x.headline_source, x.outcome) for x in got.collect()} == {
            "st_0": ("Named 1. title 0", kind, "named"), "st_1": ("fb1", "fallback", "failed"), "st_2": ("Named 1. title 2", kind, "named"), "st_3": ("fb3", "fallback", "over_budget")}
        assert sorted(open(log).read().split("\n")) == ["", *sorted(["1. title 0", "1. title 1", "1. title 1", "1. title 2"])], "budget and attempts"
        assert new.count() == 2
    assert naming.sdk_ask(lambda b: json.dumps({"content": [{"text": json.loads(b)["messages"][0]["content"][::-1]}]}))("abc") == "cba"
    with pytest.raises(ValueError, match="kind"):
        naming.http_ask("other", "", "", "")


def test_sandbox_keeps_titles(spark, tmp_path):
    asked = []

    def load():
        asked.append(1)
        return spark.createDataFrame([(0, "harbor bridge closes"), (1, "harbor bridge closes again"), (2, "music festival")], "pos long, title string")

    at = str(tmp_path / "titles")
    for _ in range(2):
        assert {(x.leader, x.pos) for x in sandbox.grouped(spark, at, load, 0.25).collect()} == {(0, 0), (0, 1)}
    assert len(asked) == 1
    sandbox.cached_titles(spark, at, load, refresh=True)
    assert len(asked) == 2

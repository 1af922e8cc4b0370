import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from newsloom.operators import checks, grouping, ingest, labels, leader, metrics, momentum, naming, similarity, stories
from newsloom.operators.graph import components
from newsloom.plans import board


def test_one_per_title(spark):
    e = spark.createDataFrame([("a", 0, "l0"), ("b", 1, "l1"), ("a", 2, "l2")], "title string, pos long, link string")
    assert sorted(map(tuple, ingest.one_per_title(e).collect())) == [("a", 0, "l2"), ("b", 1, "l1")]


def test_prepared(spark):
    rows = [(0, "a", "l", "p", "2026-01-01", ""), (1, "b", "l", "p", "2025-12-18", "base"), (2, "c", "l", "p", None, None), (3, "d", "", "p", None, None), (4, "e", "l", "p", "2027-01-01", ""), (5, "f", "l", "p", "2025-12-19", "")]
    e = spark.createDataFrame(rows, "pos long, title string, link string, published string, day string, title_detail_base string").withColumn("day", F.to_date("day"))
    got = ingest.prepared(e, F.lit("2026-01-01").cast("date"))
    assert {r.title: r.source for r in got.collect()} == {"a": "l", "c": "l", "e": "l", "f": "l"}


@pytest.mark.parametrize("threshold", [0.25, 0.6])
def test_cosine_pairs(spark, threshold):
    r = random.Random(1)
    docs = [(i, " ".join(r.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) for _ in range(r.randint(0, 8)))) for i in range(60)]
    w = similarity.tfidf(spark.createDataFrame(docs, "id long, text string")).cache()
    vec = defaultdict(dict)
    for x in w.collect():
        vec[x.id][x.term] = x.w
    assert all(abs(sum(v * v for v in d.values()) - 1) < 1e-9 for d in vec.values())
    want = {(i, j) for i in vec for j in vec if i < j and round(sum(v * vec[j].get(t, 0) for t, v in vec[i].items()), 12) >= threshold}
    assert {(x.i, x.j) for x in similarity.cosine_pairs(w, threshold).collect()} == want


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_containment_and_jaccard(spark, threshold):
    r = random.Random(2)
    sets = {i: {"hot"} | {f"x{r.randrange(25)}" for _ in range(r.randint(1, 7))} for i in range(50)}
    m = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "id long, item string")
    got = {(x.i, x.j, x.common) for x in similarity.containment_pairs(m, threshold).collect()}
    assert got == {(i, j, len(sets[i] & sets[j])) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= threshold * min(len(sets[i]), len(sets[j]))}
    a, b = m.where("id < 25"), m.where("id >= 25")
    got = {(x.i, x.j) for x in similarity.jaccard_pairs(a, b, threshold).collect()}
    assert got == {(i, j) for i in range(25) for j in range(25, 50) if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])}


@pytest.mark.parametrize("seed", [1, 2])
def test_leaders(spark, seed):
    r = random.Random(seed)
    n = 40
    edges = {(i, j) for i in range(n) for j in range(i + 1, n) if r.random() < 0.06} | {(i, i + 1) for i in range(5)}
    used, want = set(), {}
    for i in range(n):
        if i in used:
            continue
        group = [i] + [j for j in range(i + 1, n) if j not in used and (i, j) in edges]
        used.update(group)
        want[i] = group
    e = spark.createDataFrame(sorted(edges), "i long, j long")
    nodes = spark.range(n)
    for keep in (True, False):
        got = defaultdict(list)
        for x in leader.leaders(nodes, e, keep).collect():
            got[x.leader].append(x.id)
        assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if keep or len(v) > 1}


def test_matching(spark):
    r = random.Random(4)
    edges = [(i, j, r.choice([0.4, 0.5, 0.5, 0.9])) for i in range(15) for j in range(15) if r.random() < 0.3]
    a, b, want = set(), set(), set()
    for s, i, j in sorted(((s, i, j) for i, j, s in edges), reverse=True):
        if i not in a and j not in b:
            a.add(i)
            b.add(j)
            want.add((i, j, s))
    assert {tuple(x) for x in leader.matching(spark.createDataFrame(edges, "i long, j long, score double")).collect()} == want


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(100)] + [(5000, 5000 + i) for i in range(200)]
    p = {x: x for e in edges for x in e}

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for x, y in edges:
        p[max(find(x), find(y))] = min(find(x), find(y))
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {x for x, y in edges if x == y} - {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in p if x not in alone}


def test_labels(spark):
    rows = [
        (1, 0, "Harbor bridge closes after storm damage"), (1, 1, "Storm damage: Harbor bridge closes"), (1, 2, "Mayor says Harbor bridge stays shut"),
        (2, 3, "Alone"), (3, 4, "What is it about"), (3, 5, "It is what it is"), (4, 6, "Gold rallies"), (4, 7, "gold falls, gold waits"),
    ]
    got = {x.group: x.label for x in labels.labels(spark.createDataFrame(rows, "group long, pos long, title string")).collect()}
    assert got[1] == "[Harbor bridge closes] [storm damage]"
    assert got[2] == "" and got[3] == "" and got[4] == "[Gold]"


def test_label_order(spark):
    rows = [(1, "[a b]", 1, 1, 0), (2, "[a] [b]", 1, 9, 1), (3, "[a]", 1, 1, 2), (4, "", 1, 1, 3)]
    fact = spark.createDataFrame(rows, "cluster long, top_id string, leader long, sub_id string, pos long")
    assert [x.cluster for x in grouping.ranked_groups(fact).collect()] == [2, 4, 1, 3]


FACT = "group long, label string, pos long, title string, link string, timestamp string, source string"


def fact(spark):
    rows = [
        (0, "[Bridge] [Storm]", 0, "Bridge shut by storm", "https://www.one.com/a?x=1", "Mon, 02 Mar 2026 10:00:00 GMT", "https://one.com/rss"),
        (0, "[Bridge] [Storm]", 1, "Storm shuts the big bridge", "https://two.org/b/", "2026-03-01T08:00:00Z", "https://two.org/feed"),
        (0, "[Bridge] [Storm]", 2, "same again", "http://ONE.com/a", "zzz", "https://one.com/rss"),
        (1, "[Bridge]", 3, "Storm shuts the big bridge", "https://two.org/b", "2026-03-01T08:00:00Z", "https://two.org/feed"),
        (1, "[Bridge]", 4, "Bridge opens", "https://one.com/c", "later Z", "https://one.com/rss"),
        (2, "[Sale]", 5, "Lamp is 20% off", "https://one.com/d", "", "https://one.com/rss"),
    ]
    return spark.createDataFrame(rows, FACT)


def test_stories(spark):
    sources = spark.createDataFrame([("https://two.org/feed", "The Two", "two.org", "World")], "url string, outlet string, domain string, section string")
    got = [x.asDict(True) for x in stories.story_rank(stories.stories(fact(spark), sources)).collect()]
    a, b = got
    assert (a["kind"], a["article_count"], a["outlet_count"], a["merged_from_groups"]) == ("story", 3, 2, 2)
    assert a["keywords"] == ["bridge", "storm"] and a["headline"] == "Bridge shut by storm" and a["section"] == "General"
    assert [x["published"] for x in a["articles"]] == ["later Z", "2026-03-02T10:00:00Z", "2026-03-01T08:00:00Z"]
    assert (a["latest_published"], a["first_seen"], a["days_running"]) == ("later Z", "2026-03-01", 2)
    assert a["outlets"] == [{"outlet": "One", "domain": "one.com", "articles": 2}, {"outlet": "The Two", "domain": "two.org", "articles": 1}]
    assert (b["kind"], b["days_running"], b["first_seen"]) == ("deal", 1, "")
    assert a["id"].startswith("st_") and len(a["id"]) == 9
    h = stories.document_header(stories.stories(fact(spark), sources)).first()
    assert (h.feeds, h.article_count, h.story_count, h.story, h.deal) == (2, 4, 2, 1, 1)
    assert checks.violations(stories.stories(fact(spark), sources)).count() == 0


def test_template_runs(spark):
    rows = [
        *[(1, i, f"{x} third quarter results at a glance") for i, x in enumerate(("Acme", "Bolt", "Crux"))],
        *[(2, i, t) for i, t in enumerate(("Judge tells Wren to leave town", "Panel tells Wren to leave town"))],
        *[(3, i, t) for i, t in enumerate(("Silver prices today, Monday", "Silver prices today, Tuesday"))],
        (4, 0, "only one title of many words"),
    ]
    got = {x.story: x.run for x in stories.template_runs(spark.createDataFrame(rows, "story long, ord long, title string")).collect()}
    assert got == {1: 6, 2: 0, 3: 3, 4: 0}


def day(spark, rows):
    s = spark.createDataFrame(rows, "story long, id string, keywords array<string>, entities array<string>, outlet_count long, article_count long")
    return s.withColumn("latest_published", F.lit("")).withColumn("first_seen", F.lit("")).withColumn("days_running", F.lit(1).cast("long"))


def test_momentum(spark):
    state = spark.createDataFrame([], momentum.STATE)
    s, state = momentum.advanced(day(spark, [(0, "st_a", ["x", "y"], ["Z"], 2, 5), (1, "st_b", ["q"], [], 1, 1)]), state, "2026-03-01")
    _, state = momentum.advanced(day(spark, [(0, "st_a", ["x", "y"], ["Z"], 1, 9)]), state, "2026-03-01")  # rerun: maxima
    got = {x.id: x for x in state.collect()}
    assert [tuple(p) for p in got["st_a"].series] == [("2026-03-01", 2, 9)] and "st_b" in got
    s, state = momentum.advanced(day(spark, [(0, "st_c", ["x", "y", "w"], [], 4, 9)]), state, "2026-03-02")
    assert [(x.id, x.first_seen, x.days_running) for x in s.collect()] == [("st_a", "2026-03-01", 2)]
    m = momentum.momentum(state, s).first()
    assert (m.trend, str(m.peak_date)) == ("climbing", "2026-03-02")
    for d in range(3, 19):
        s, state = momentum.advanced(day(spark, [(0, "st_d", ["x", "y", "w"], [], 3, 1)]), state, f"2026-03-{d:02d}")
    x = state.collect()
    assert len(x) == 1 and len(x[0].series) == 14 and x[0].first_seen == "2026-03-01" and x[0].series[0].date == "2026-03-05"
    s, state = momentum.advanced(day(spark, [(0, "st_a", ["x", "y", "w"], [], 3, 1)]), state, "2026-03-25")  # two days and more later: a new start
    assert [(y.first_seen, len(y.series)) for y in state.collect()] == [("2026-03-25", 1)]


@pytest.mark.parametrize(("series", "want"), [([3], "new"), ([1, 3], "climbing"), ([1, 5, 3], "peaked"), ([5, 4, 1], "cooling"), ([3, 3], "steady"), ([9, 1, 2], "steady")])
def test_trend(spark, series, want):
    df = spark.createDataFrame([([(f"2026-01-{i + 1:02d}", n, n) for i, n in enumerate(series)],)], "series array<struct<date:string,outlets:long,articles:long>>")
    assert df.select(momentum.trend(F.col("series")).alias("t")).first().t == want
    p = spark.createDataFrame([("a", f"2026-01-{i + 1:02d}", n, n) for i, n in enumerate(series)], "id string, date string, outlets long, articles long").withColumn("date", F.to_date("date"))
    assert momentum.daily_trend(p).orderBy("date").collect()[-1].trend == want


def test_naming(spark):
    art = lambda *t: [(x,) for x in t]
    rows = [(0, "st_1", "story", "fb1", 3, 5, art("the court heard Ms Wren", "Ms Wren wins")), (1, "st_2", "deal", "fb2", 9, 9, art("x y")), (2, "st_3", "story", "fb3", 1, 4, art("in Oslo today")), (3, "st_4", "story", "fb4", 1, 30, art("a in Rome"))]
    s = spark.createDataFrame(rows, "story long, id string, kind string, headline string, outlet_count long, article_count long, articles array<struct<title:string>>")
    s = s.withColumn("headline_source", F.lit("fallback")).withColumn("latest_published", F.lit(""))
    cache = spark.createDataFrame([("st_3", "Old name", "local", 4, "2026-03-01"), ("st_4", "Small then", "local", 10, "2026-03-01"), ("st_9", "Gone", "local", 1, "2026-01-01")], naming.CACHE)
    got, new = naming.named(s, cache, "2026-03-10", budget=1)
    assert {x.id: (x.headline, x.outcome) for x in got.collect()} == {"st_1": ("Ms Wren", "named"), "st_2": ("fb2", "over_budget"), "st_3": ("Old name", "cached"), "st_4": ("fb4", "over_budget")}
    assert {x.id: x.headline for x in new.collect()} == {"st_1": "Ms Wren", "st_3": "Old name", "st_4": "Small then"}
    clean = lambda t: spark.createDataFrame([(t,)], "x string").select(naming.cleaned(F.col("x")).alias("y")).first().y
    assert [clean(t) for t in ('"A name."\nmore', "", "As an AI I would", "x" * 141)] == ["A name", None, None, None]


@pytest.mark.parametrize(
    ("articles", "stories", "old", "ok"),
    [(50, 9, None, True), (49, 9, None, False), (100, 100, 250, True), (100, 99, 250, False), (100, 160, 100, True), (100, 161, 100, False), (60, 5, 0, True), (9000, 10, 10, True), (None, None, 5, False)],
)
def test_gate(spark, articles, stories, old, ok):
    """The floor is on distinct articles, the deviation on the number of stories, whatever the previous run's articles were."""
    for before in (None, 1, 100_000):
        df = spark.createDataFrame([(articles, stories, before, old)], "a long, s long, pa long, ps long")
        assert df.select(checks.gate(*(F.col(c) for c in df.columns), 50, 0.6)["ok"].alias("x")).first().x is ok


def test_intermediate_folder_is_shared(spark, monkeypatch):
    from newsloom.operators import tables

    class Far:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        tables.shared_dir(Far)
    assert tables.shared_dir(spark).startswith("file:")


def test_health(spark):
    feeds = spark.createDataFrame([("a", 200, None), ("b", 404, None), ("c", None, "timeout"), ("d", None, None)], "url string, http_status int, error string")
    e = spark.createDataFrame([("a", "2026-01-01"), ("a", None), ("b", "2026-01-02"), ("d", None)], "url string, day string").withColumn("day", F.to_date("day"))
    h = checks.feed_health(feeds, e, F.lit("2026-01-05").cast("date"))
    assert {x.url: (x.entry_count, x.newest_entry_age_days, x.ok) for x in h.collect()} == {"a": (2, 4, True), "b": (1, 3, False), "c": (0, None, False), "d": (1, None, True)}
    assert [tuple(x) for x in checks.failing(h).collect()] == [("b", "HTTP 404"), ("c", "timeout")]
    c = checks.health_counts(h).first()
    assert (c.feeds, c.ok, c.failing, c.entries) == (4, 2, 2, 4)


def test_metrics(spark):
    doc = {"T": {"s1": {"t1": ("t1", "S1")}, "s2": {"t2": ("t2", "S1")}}}
    df = spark.createDataFrame([("f", "2026-01-01", doc), ("e", "2026-01-01", {})], "file string, ts string, doc map<string,map<string,map<string,struct<title:string,source:string>>>>")
    m = {x.file: x for x in metrics.file_metrics(df).collect()}
    assert (m["f"].total_articles, m["f"].top_level_groups, m["f"].sub_groups, m["f"].subgroups_per_top_group, m["f"].unique_sources, m["f"].articles_per_group_max) == (2, 1, 2, 2.0, 1, 2.0)
    assert (m["e"].total_articles, m["e"].top_level_groups, m["e"].unique_sources) == (0, 0, 0)


def test_metric_days(spark):
    rows = [("2026-01-01", "a", 10), ("2026-01-01", "a", 10), ("2026-01-01", "b", 20), ("2026-01-02", "c", 30)]
    r = spark.createDataFrame(rows, "date string, ts string, articles long")
    for c in metrics.METRICS[1:]:
        r = r.withColumn(c, F.lit(0).cast("long"))
    d = metrics.daily(r)
    assert {x.date: (x.update_count, x.articles_total, x.articles_mean, x.articles_stdev) for x in d.collect()}["2026-01-02"] == (1, 30, 30.0, 0.0)
    o = metrics.overall(d).first()
    assert (o.days, o.updates, o.articles_mean, o.sources_mean) == (2, 3, 22.5, 0.0)
    t = {x.metric: x for x in metrics.trends(d, 7).collect()}
    assert (t["articles"].direction, t["groups"].direction, t["articles"].change_percent) == ("up", "stable", 100.0)
    u = metrics.upserted(r.limit(0).unionByName(r.where("ts = 'a'").limit(1)), r)
    assert sorted(x.ts for x in u.collect()) == ["a", "b", "c"]
    assert metrics.overall(d.limit(0)).first().articles_mean == 0.0


def test_terms(spark):
    t = spark.createDataFrame([("oil", 3), ("oil prices", 2), ("gold", 1), ("crude oil", 1)], "term string, freq long")
    assert {x.term: x.freq for x in metrics.absorbed_terms(t).collect()} == {"oil prices": 3, "crude oil": 2, "gold": 1}
    w = spark.createDataFrame([(0, ["b", "a"]), (1, ["a", "b", "c"])], "pos long, words array<string>")
    assert [tuple(x) for x in metrics.top_words(w, 2).collect()] == [("b", 2), ("a", 2)]


def test_archive_window(spark):
    r = spark.createDataFrame([("f2", "m1", "d1"), ("f1", "m1", "d1"), ("f3", "m2", "d2"), ("f4", "m3", "d3")], "file string, minute string, date string")
    assert sorted(x.file for x in metrics.archive_window(r, 2).collect()) == ["f3", "f4"]


def test_board(spark):
    sources = spark.createDataFrame([], "url string, outlet string, domain string, section string")
    s = stories.stories(fact(spark), sources)
    assert board.search(s, "LAMP").count() == 1 and board.search(s, "two").count() == 1 and board.search(s, "storm").count() == 1 and board.search(s, "nothing").count() == 0
    assert board.board(s).count() == 1 and board.by_keyword(s, "sale").count() == 1
    assert {(x.section, x.n) for x in board.facet_counts(s).collect()} == {("General", 2), (None, 2)}
    assert [x.kind for x in board.ordered(s, "covered").collect()] == ["story", "deal"]
    assert sorted(round(x.share, 3) for x in board.outlet_share(board.board(s)).collect()) == [0.333, 0.667]


def test_terms_and_group_keywords(spark):
    t = spark.createDataFrame([("oil", 3), ("oil prices", 2), ("gold", 3), ("a b", 3)], "term string, freq long")
    assert [tuple(x) for x in metrics.top_terms(t, 3).collect()] == [("[a b]", 3), ("[oil prices]", 3), ("[gold]", 3)]
    w = spark.createDataFrame([(1, 0, ["b", "a"]), (1, 1, ["a", ""]), (2, 2, ["c"])], "group long, pos long, words array<string>")
    assert {x.group: (x.keywords, x.name) for x in metrics.group_keywords(w).collect()} == {1: (["a", "b"], "A B"), 2: (["c"], "C")}


def test_violations(spark):
    m = spark.createDataFrame([("st_00000a", "2026-01-01", 1, [("2026-01-01", 1, 1)], "2026-01-01", "new"), ("x", "y", 2, [], None, "odd")], "id string, first_seen string, days_running int, series array<struct<date:string,outlets:long,articles:long>>, peak_date string, trend string")
    assert sorted(x.violation for x in checks.momentum_violations(m).collect()) == ["days_running", "first_seen", "id", "peak_date", "series", "trend"]
    f = spark.createDataFrame([("t", "a", "l", "", "s"), ("t", "", None, None, "s")], "top_id string, title string, link string, timestamp string, source string")
    assert sorted(x.violation for x in checks.news_violations(f).collect()) == ["link", "timestamp", "title"]
    d = spark.createDataFrame([("2026-01-01T00:00:00", "0.2.1"), ("now", "2")], "datetime string, version string")
    assert sorted(x.violation for x in checks.metadata_violations(d).collect()) == ["datetime", "version"]

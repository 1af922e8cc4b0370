"""What grows with the number of pairs, or with one group, is neither gathered nor left to one task."""

import random

from newsloom.operators import leader, metrics, momentum, similarity, stories
from newsloom.operators.tables import written


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def test_cosine_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "SMALL_BLOCK", 7)
    monkeypatch.setattr(similarity, "CELLS", 20)
    rng = random.Random(5)
    docs = [(k, " ".join(rng.choices(["aa", "bb", "cc", "dd", "ee", "ff", "gg"], k=rng.randint(0, 5)))) for k in range(50)]
    w = similarity.tfidf(spark.createDataFrame(docs, "id long, text string")).cache()
    by = {}
    for r in w.collect():
        by.setdefault(r.id, {})[r.term] = r.w
    want = {(i, j) for i in by for j in by if i < j and round(sum(x * by[j].get(t, 0) for t, x in by[i].items()), 12) >= 0.5}
    out = similarity.cosine_pairs(w, 0.5)
    got = [(x.i, x.j) for x in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "Aggregate" not in _plan(out) and "Join" not in _plan(out)  # pairs are neither gathered nor joined again
    assert similarity.cosine_pairs(w.limit(0), 0.5).count() == 0


def _sets(n, seed):
    rng = random.Random(seed)
    return {k: {f"own {k}"} | set(rng.sample(["a", "b", "c", "d", "e", "f"], rng.randint(1, 5))) - ({f"own {k}"} if k % 2 else set()) for k in range(n)}


def test_set_joins_measure_where_they_meet(spark, monkeypatch):
    monkeypatch.setattr(similarity, "HOT", 3)
    sets = _sets(40, 1)
    rows = [(k, x) for k, s in sets.items() for x in s]
    m = spark.createDataFrame(rows, "id long, item string")
    want = {(i, j, len(sets[i] & sets[j])) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.5 * min(len(sets[i]), len(sets[j]))}
    out = similarity.containment_pairs(m, 0.5)
    got = [(x.i, x.j, x.common) for x in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "Aggregate" not in _plan(out)
    out = similarity.jaccard_pairs(m.where("id < 20"), m.where("id >= 20"), 0.4)
    got = [(x.i, x.j, x.common) for x in out.collect()]
    want = {(i, j, len(sets[i] & sets[j])) for i in range(20) for j in range(20, 40) if len(sets[i] & sets[j]) >= 0.4 * len(sets[i] | sets[j])}
    assert len(got) == len(set(got)) and set(got) == want
    assert "Aggregate" not in _plan(out)


def test_copies_are_one_profile(spark, monkeypatch):
    monkeypatch.setattr(similarity, "HOT", 7)
    # of each id an item is its own, so no two sets are equal; the last of today's has too many of them
    rows = [(k, x) for k in range(60) for x in ("a", "b", f"own {k}")] + [(60, x) for x in ("a", *"uvwxyz")] + [(None, "a")]
    m = spark.createDataFrame(rows, "id long, item string")
    today, before = m.where("id < 20 or id = 60 or id is null"), m.where("id between 20 and 59")
    pairs, left, right = similarity.jaccard_profiles(today, before, 0.4)
    assert [(r.common, r.score) for r in pairs.collect()] == [(2, 0.5)]
    assert {r.i for r in left.join(pairs, "p").collect()} == set(range(20)) and {r.j for r in right.join(pairs, "q").collect()} == set(range(20, 60))
    got = [tuple(r) for r in similarity.jaccard_pairs(today, before, 0.4).collect()]
    assert len(got) == 800 and set(got) == {(i, j, 2, 0.5) for i in range(20) for j in range(20, 60)}


def test_identity_is_carried_without_pairs_of_ids(spark, monkeypatch):
    made = []
    monkeypatch.setattr(similarity, "written", lambda df, name: made.append(written(df, name)) or made[-1])
    monkeypatch.setattr(leader, "written", lambda df, name: made.append(written(df, name)) or made[-1])
    stories = spark.range(70).selectExpr("concat('s', id) AS story", "array('a', 'b', concat('own ', id)) AS keywords", "array('C') AS entities")
    state = spark.range(90).selectExpr("concat('t', id) AS id", "array('a', 'b', concat('old ', id)) AS keywords", "array('c') AS entities", "'2026-01-01' AS last_seen")
    got = {(r.story, r.prev) for r in momentum.carried(stories, state, "2026-01-02").collect()}
    order = lambda c, n: sorted((f"{c}{k}" for k in range(n)), reverse=True)
    assert got == set(zip(order("s", 70), order("t", 90)))
    assert max(df.count() for df in made) <= 4 * (70 + 90)


def test_items_are_numbers_and_single_ones_are_counted(spark):
    coded, sizes = similarity.coded(spark.createDataFrame([(1, "x"), (1, "y"), (1, "y"), (2, "y"), (3, "z"), (4, None)], "id long, item string"))
    assert dict(coded.dtypes)["item"] == "bigint"
    assert sorted((r.id, r.n) for r in coded.collect()) == [(1, 2), (2, 1)]
    assert sorted((r.id, r.n) for r in sizes.collect()) == [(1, 2), (2, 1), (3, 1)]


def test_keywords_are_dealt_once(spark):
    t = spark.createDataFrame([(1, 0, ["b", "a", "a"]), (1, 1, ["b", "c", "b"]), (2, 0, ["", "z"])], "group long, pos long, words array<string>")
    out = metrics.group_keywords(t, 2)
    assert {r.group: r.keywords for r in out.collect()} == {1: ["b", "a"], 2: ["z"]}
    assert _plan(out).count("Exchange hashpartitioning") == 1


def test_template_runs_gather_no_story(spark):
    rows = [(1, k, f"best new deals of the week {k}") for k in range(30)] + [(2, k, f"see how Paris won again {'x' * k}") for k in range(5)] + [(3, 0, None)]
    out = stories.template_runs(spark.createDataFrame(rows, "story long, ord long, title string"))
    # of story 2 every run but "see how" and what lies behind the proper noun has it, and its longest run has it too
    assert {r.story: r.run for r in out.collect()} == {1: 6, 2: 0, 3: 0}
    assert "collect_" not in _plan(out)


def test_titles_are_dealt_before_their_phrases(spark):
    from newsloom.operators.labels import labels

    titles = spark.createDataFrame([(i % 3, i, f"markets rally in city {i % 3}") for i in range(60)], "group long, pos long, title string").coalesce(1)
    told = labels(titles)
    lines = told._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = [i for i, x in enumerate(lines) if "ArrowEvalPython" in x]
    assert at and all(any("RepartitionByExpression" in x for x in lines[i + 1 : i + 4]) for i in at)
    assert told.count() == 3


def test_labels_gather_no_group(spark):
    from newsloom.functions.titles import bracket_label
    from newsloom.operators import labels as L
    from pyspark.sql import functions as F

    rng = random.Random(8)
    words = ["Harbor", "bridge", "closes", "rain", "Storm", "city", "mayor", "vote", "school", "storm"]
    rows = [(g, i, " ".join(rng.choices(words, k=rng.randint(1, 7)))) for g in range(6) for i in range(1 if g == 5 else 12)]
    titles = spark.createDataFrame(rows, "group long, pos long, title string")
    out = L.labels(titles)
    assert "collect_" not in _plan(out)
    clean = {(r.group, r.pos): r.t for r in titles.select("group", "pos", L.normal_title(F.col("title")).alias("t")).collect()}
    want = {}
    for g in range(6):
        mine = [(i, p) for (x, i), t in clean.items() if x == g for p in L.pieces(t)]
        until = {}
        for i, (low, _, first) in mine:
            if first:
                until[low] = max(i, until.get(low, -1))
        texts = sorted({text for i, (low, text, _) in mine if text and i < until.get(low, -1)})
        scores = {r.t: round(r.s, 4) for r in spark.createDataFrame([(x,) for x in texts], "t string").select("t", L.sentence_score(F.col("t")).alias("s")).collect()} if texts else {}
        kept = []
        for x in sorted(texts, key=lambda x: (-len(x.split()), -scores[x], -len(x), x)):
            w = set(x.lower().split())
            if not any(len(w & set(k.lower().split())) / len(w) >= L.OVERLAP for k in kept):
                kept.append(x)
        want[g] = kept[: L.TOP]
    shown = spark.createDataFrame(list(want.items()), "group long, c array<string>").select("group", bracket_label(F.col("c")).alias("label"))
    assert {r.group: r.label for r in out.collect()} == {r.group: r.label or "" for r in shown.collect()}
    assert any(len(k) == L.TOP for k in want.values())


def test_texts_in_several_rows(spark):
    one = spark.createDataFrame([(1, "aa bb aa"), (2, "bb cc"), (3, "")], "id long, text string")
    many = spark.createDataFrame([(1, "aa bb"), (1, "aa"), (1, ""), (2, "bb"), (2, "cc"), (3, "")], "id long, text string")
    told = lambda d: {(r.id, r.term): round(r.w, 9) for r in similarity.tfidf(d).collect()}
    assert told(one) == told(many)

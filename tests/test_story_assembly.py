"""stories() and document_header() against a loop over groups, on made groups; leaf values (links, dates, shapes of titles) are the functions' own, which have SQL."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from newsloom.functions import dates, links, titles
from newsloom.operators import stories

FACT = "group long, label string, pos long, title string, link string, timestamp string, source string"


def _fact(seed):
    r = random.Random(seed)
    subject = ["Harbor bridge", "Oslo court", "gold", "rain", "Ms Wren", "big deal", "Monday"]
    links_ = [f"https://{r.choice('abcdef')}.com/{k}" for k in range(150)]
    feeds = ["https://a.com/rss", "https://news.b.co.uk/f", "https://c.org/x", "https://d.com/", ""]
    rows = []
    for g in range(45):
        start, template = r.randrange(140), r.random() < 0.3
        for pos in range(r.randint(1, 6)):
            title = f"daily briefing about the markets number {r.randrange(5)}" if template else f"{r.choice(subject)} {r.choice(['closes', 'opens', 'saves 20% off', 'wins'])} {r.choice(subject)} {r.choice(['today', 'again', 'Now'])}"
            stamp = r.choice([f"2026-03-{r.randint(1, 9):02}T0{r.randint(0, 9)}:00:00Z", f"Mon, 0{r.randint(1, 9)} Mar 2026 10:00:00 GMT", f"2026-03-0{r.randint(1, 9)}", "", "soon", None])
            link = links_[(start + r.randrange(6)) % 150] if r.random() < 0.95 else r.choice(["", None])
            rows.append((g, f"[{r.choice(subject)}] [{r.choice(subject)}]", pos, title, link, stamp, feeds[0] if template else r.choice(feeds)))
    return rows


def _leaves(spark, fact):
    """Each row with its leaf values."""
    c = F.col
    domain = links.feed_domain(c("source"))
    words = titles.words(c("title"))
    published = dates.to_iso8601(F.coalesce("timestamp", F.lit("")))
    df = fact.withColumns({
        "key": links.normalize_link(c("link")), "domain": domain, "outlet": links.outlet_of_domain(domain), "published": published, "deal": titles.is_deal(c("title")), "words": words,
        "proper": titles.proper_nouns(words), "entities": titles.capital_runs(c("title")), "keywords": titles.keywords(c("label")),
    }).withColumn("day", dates.iso_date(c("published")))
    return [x.asDict() for x in df.orderBy("group", "pos").collect()]


def _run(articles):
    """The longest run of words in 60 % of the titles that isn't in a longer one and names nobody."""
    rows = [[w.lower() for w in a["words"]] for a in articles]
    proper = {p for a in articles for p in a["proper"]}
    need = max(2, math.ceil(len(rows) * 6 / 10))
    runs = Counter(r for row in rows for r in {tuple(row[i:j]) for i in range(len(row)) for j in range(i + stories.MIN_RUN, len(row) + 1)})
    shared = {r for r, n in runs.items() if n >= need}
    inner = {x for r in shared for x in (r[:-1], r[1:])}
    bare = lambda w: w.lower().strip(".'’")
    return max((len(r) for r in shared - inner if not any(bare(w) in proper for w in r)), default=0)


def _modal(values):
    """Values by count, ties to the first met."""
    n = Counter(values)
    return sorted(n, key=lambda v: (-n[v], values.index(v))), n


def _stories(rows, known):
    groups = {}
    for x in rows:
        if x["key"]:
            groups.setdefault(x["group"], {}).setdefault(x["key"], x)
    root = {g: g for g in groups}

    def find(g):
        while root[g] != g:
            g = root[g]
        return g

    for a in groups:
        for b in groups:
            if a < b and len(groups[a].keys() & groups[b].keys()) >= stories.MERGE * min(len(groups[a]), len(groups[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    out = {}
    for s in {find(g) for g in groups}:
        own = [g for g in sorted(groups) if find(g) == s]
        first = {}
        for g in own:
            for key, x in groups[g].items():
                first.setdefault(key, x)
        art = sorted(first.values(), key=lambda x: (x["group"], x["pos"]))
        art.sort(key=lambda x: x["published"], reverse=True)
        for x in art:
            feed = known.get((x["source"] or "").strip())
            x["own"] = feed or (x["outlet"], x["domain"], "General")
        outlets, n = _modal([x["own"][0] for x in art])
        sections, _ = _modal([x["own"][2] for x in art])
        top = [x for x in art if x["own"][0] == outlets[0]]
        ents, _ = _modal([e for x in art for e in x["entities"]])
        days = {x["day"] for x in art} - {""}
        deal = sum(x["deal"] for x in art) / len(art) > 0.5
        kind = "deal" if deal else "roundup" if len(outlets) == 1 and _run(art) >= stories.MIN_RUN else "story"
        # a group's label is one for all its rows that stay, or several: each (group, label) has its keywords once
        words = [k for g in own for ks in sorted({tuple(x["keywords"]) for x in groups[g].values()}) for k in ks]
        keys = sorted(first)
        out[s] = {
            "id": "st_" + hashlib.sha256(",".join(keys[:20]).encode()).hexdigest()[:6], "headline": max(top, key=lambda x: len(x["title"]))["title"], "section": sections[0], "kind": kind,
            "keywords": list(dict.fromkeys(words))[: stories.MAX_KEYWORDS], "entities": ents[: stories.MAX_ENTITIES], "outlet_count": len(outlets), "article_count": len(art), "merged_from_groups": len(own),
            "latest_published": max((x["published"] for x in art if x["published"].endswith("Z")), default=""), "first_seen": min(days, default=""), "days_running": max(len(days), 1),
            "outlets": [(o, n[o]) for o in outlets], "titles": [x["title"] for x in art],
        }
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_stories_against_a_loop(spark, seed):
    rows = _fact(seed)
    # one label a group, as groups have
    label = {}
    rows = [(g, label.setdefault(g, lab), *rest) for g, lab, *rest in rows]
    known = {"https://a.com/rss": ("The A", "a.com", "World"), "https://c.org/x": ("C Daily", "c.org", "Science")}
    sources = spark.createDataFrame([(u, *x) for u, x in known.items()], "url string, outlet string, domain string, section string")
    fact = spark.createDataFrame(rows, FACT).repartition(4)
    want = _stories(_leaves(spark, fact), known)
    table = stories.stories(fact, sources).cache()
    got = {x.story: x for x in table.collect()}
    assert set(got) == set(want) and len(want) > 5 and {w["kind"] for w in want.values()} > {"story"}
    for s, w in want.items():
        g = got[s]
        for k in w:
            have = [(o.outlet, o.articles) for o in g.outlets] if k == "outlets" else [a.title for a in g.articles] if k == "titles" else g[k]
            assert have == w[k], (s, k)
    head = stories.document_header(table).first()
    assert (head.story_count, head.article_count) == (len(want), sum(w["article_count"] for w in want.values()) - _shared(want, got))
    assert (head.story, head.roundup, head.deal) == tuple(sum(w["kind"] == k for w in want.values()) for k in ("story", "roundup", "deal"))
    assert [x.story for x in stories.story_rank(table).collect()] == sorted(want, key=lambda s: (-want[s]["outlet_count"], -want[s]["article_count"], _late_first(want[s]["latest_published"]), s))


def _shared(want, got):
    """Links that several stories have, beyond once."""
    keys = Counter(a.link for s in want for a in got[s].articles)
    return sum(n - 1 for n in keys.values())


def _late_first(stamp):
    return tuple(-ord(c) for c in stamp) + (1,)

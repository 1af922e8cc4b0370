import math

import pytest
from pyspark.sql import functions as F

from newsloom.functions import dates, links, text, titles


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("A - b", "ab"), ("<i>Deep</i> blue", "deepi blue"), ("It's 5 o'clock", "its oclock"), ("Mayor's plan", "mayor's plan"), ("U.S. vote", "u s vote"),
        ("  Café – naïve_1 ", "café naïve"), ("well-known fact", "well-known fact"), ("", ""), (None, ""), ("don’t", "dont"),
    ],
)
def test_clean_text(spark, raw, want):
    assert one(spark, raw, text.clean_text) == want


def test_tokens(spark):
    assert one(spark, "", lambda c: text.tokens(text.clean_text(c))) == [""]
    assert one(spark, "The Mayor of Oslo and the vote", text.content_tokens) == ["mayor", "oslo", "vote"]
    assert one(spark, "UK vote uk", lambda c: text.content_tokens(c, {"uk": "britain"})) == ["britain", "vote", "britain"]


def plain_info(word):
    w = word.lower().strip(text.STRIPPED)
    if len(w) < 2:
        return 0.0
    rarity = min(sum(text.RARITY.get(c, 1) for c in w) / len(w) / 6, 1)
    v = sum(c in "aeiou" for c in w)
    k = sum(c.isalpha() for c in w) - v
    return 0.4 * rarity + 0.4 / (1 + v / (k or 0.5)) + 0.2 * min(math.log(len(w), 12), 1)


@pytest.mark.parametrize("word", ["quiz", "a", "ZZ", "'tis", "rhythm", "aeiou", "42nd", "Ångström", "(internationalization)"])
def test_info_value(spark, word):
    assert one(spark, word, text.info_value) == pytest.approx(plain_info(word))
    weight = lambda w: 2.5 if w.strip(text.STRIPPED).isupper() else 2.0 if w.strip(text.STRIPPED)[0].isupper() else 1.0
    want = round(plain_info(word), 4) * weight(word) if len(word.strip(text.STRIPPED)) > 1 else 0
    assert one(spark, word, text.weighted_score) == pytest.approx(want, abs=2e-4)


def test_sentence_score(spark):
    s = "Quick brown foxes jump over a dog"
    each = sorted((round(plain_info(w), 4) for w in s.lower().split()), reverse=True)
    want = sum(each[:3]) * (1 - 0.2 * sum(x < 0.45 for x in each) / len(each))
    assert one(spark, s, text.sentence_score) == pytest.approx(want, abs=1e-3)
    assert one(spark, "   ", text.sentence_score) == 0


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://www.Example.co.uk/News/One?x=1#top", "example.co.uk/News/One"), ("http://a.com/path//", "a.com/path"), ("https://a.com:80/", "a.com:80"), (" //a.com/x ", "a.com/x"),
        ("no url", "no url"), ("https://a.com?q=1", "a.com"),
    ],
)
def test_normalize_link(spark, url, want):
    assert one(spark, url, links.normalize_link) == want


@pytest.mark.parametrize(("host", "want"), [("news.site.co.uk", "site.co.uk"), ("a.b.c.com", "c.com"), ("localhost", "localhost"), (".x.com.au", "x.com.au"), ("co.uk", "co.uk")])
def test_domain(spark, host, want):
    assert one(spark, host, links.registered_domain) == want


def test_outlet(spark):
    assert one(spark, "https://www.planet-daily.org/rss", lambda c: links.outlet_of_domain(links.feed_domain(c))) == "Planet-daily"


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Tue, 03 Mar 2026 09:30:00 +0100", "2026-03-03T08:30:00Z"), ("3 Mar 2026 09:30:00 EST", "2026-03-03T14:30:00Z"), ("Fri, 14 Aug 2026 10:00:00 EST", "2026-08-14T15:00:00Z"),
        ("2026-03-03T09:30:00", "2026-03-03T09:30:00Z"), ("2026-03-03 09:30:00+02:00", "2026-03-03T07:30:00Z"), ("2026-03-03T09:30:00Z", "2026-03-03T09:30:00Z"),
        ("Tue, 03 Mar 2026 09:30 GMT", "2026-03-03T09:30:00Z"), ("2026-03-03", "2026-03-03"), ("soon", "soon"), ("", ""),
    ],
)
def test_dates(spark, raw, want):
    assert one(spark, raw, dates.to_iso8601) == want
    assert one(spark, raw, dates.iso_date) == (want[:10] if want.endswith("Z") else "")


def test_relative_time(spark):
    now = F.lit("2026-01-02 00:00:00").cast("timestamp")
    got = [one(spark, t, lambda c: dates.relative_time(c.cast("timestamp"), now)) for t in ("2026-01-01 23:59:30", "2026-01-01 23:58:00", "2026-01-01 22:30:00", "2025-12-31 00:00:00", None)]
    assert got == ["Just now", "2 minutes ago", "1 hour ago", "2 days ago", "Unknown"]


def test_titles(spark):
    assert [one(spark, t, titles.is_deal) for t in ("Phone is $1,200.50 off", "25 % OFF today", "Pre-order now", "Great deals", "An ideal day", None)] == [True, True, True, True, False, False]
    assert one(spark, "Café naïve x", titles.words) == ["Caf", "na", "ve", "x"]
    assert one(spark, "The Quick Brown Foxes Jump", lambda c: titles.is_title_case(titles.words(c))) is True
    assert one(spark, "The court tells a certain Ms. Wren to pay money on Monday", lambda c: titles.proper_nouns(titles.words(c))) == ["ms", "wren"]
    assert one(spark, "the court in New York heard Ms Wren today", titles.capital_runs) == ["New York", "Ms Wren"]


def test_label_parts(spark):
    assert one(spark, "[Oil Prices] [oil prices] [ ] [War]", titles.keywords) == ["oil prices", "war"]
    assert [one(spark, x, titles.phrase_count) for x in ("", "[a]", "[a b] [c]")] == [0, 1, 2]
    assert [one(spark, x, titles.word_count) for x in ("", "[a]", "[a b c]", "[a b] [c]")] == [999, 1, 3, 999]

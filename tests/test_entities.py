import random

import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from newsloom.functions import entities, titles
from newsloom.operators import grouping


def _longest(words, phrases, low):
    """Leftmost longest matches by looking every phrase up at every word."""
    out, at = [], 0
    while at < len(words):
        n = max((len(p) for p in phrases if [low(w) for w in words[at : at + len(p)]] == p), default=0)
        if n and " ".join(words[at : at + n]) not in out:
            out.append(" ".join(words[at : at + n]))
        at += n or 1
    return out


@pytest.mark.parametrize("fold", [False, True])
def test_matches_against_brute_force(spark, fold):
    r = random.Random(8)
    vocab = ["New", "York", "new", "york", "Times", "of", "the", "Été", "été", "O'Neil", "AT&T", "x-y", "日本"]
    phrases = [" ".join(r.choice(vocab) for _ in range(r.randint(1, 4))) for _ in range(40)] + ["", " - ", "New York", "New York Times", "York"]
    rows = [(i, " ".join(r.choice([*vocab, ",", "!", "zz"]) for _ in range(r.randrange(15)))) for i in range(300)] + [(900, None), (901, ""), (902, "New York Times, new york")]
    found = entities.dictionary_entities(spark, phrases, fold)
    got = {x.i: x.e for x in spark.createDataFrame(rows, "i int, t string").repartition(3).select("i", found(F.col("t")).alias("e")).collect()}
    low = (lambda s: s.lower()) if fold else (lambda s: s)
    known = [p for p in (regex.findall(entities.WORD, low(p)) for p in phrases) if p]
    for i, t in rows:
        words = regex.findall(entities.WORD, t or "")
        assert got[i] == _longest(words, known, low), t


def test_empty_dictionary_and_bound(spark, monkeypatch):
    assert entities.Dictionary([]).found(pa.array([["a"], None, []], pa.list_(pa.string()))).to_pylist() == [[], [], []]
    monkeypatch.setattr(entities, "MOST_WORDS", 3)
    with pytest.raises(ValueError, match="at most"):
        entities.Dictionary(["a b", "c d"])


def test_in_place_of_runs_of_capitals(spark):
    """Groups of similar titles whose entities, by the dictionary, are others' stay apart."""
    rows = [(0, "storm closes harbor bridge in oslo today"), (1, "storm closes harbor bridge in oslo again"), (2, "storm closes harbor bridge in rome today now"), (3, "storm closes harbor bridge in rome today still")]
    t = spark.createDataFrame(rows, "pos long, title string")
    g = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (3, 2)], "pos long, leader long")
    found = entities.dictionary_entities(spark, ["oslo", "rome"])
    by = lambda e: {(x.leader, x.cluster) for x in grouping.group_clusters(t, g, entities=lambda c: titles.entity_tokens(c, e)).collect()}
    assert by(titles.capital_runs) == {(0, 0), (2, 0)} and by(found) == {(0, 0), (2, 2)}

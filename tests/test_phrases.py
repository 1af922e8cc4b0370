import random

import regex
from pyspark.sql import functions as F

from newsloom.operators import labels


def _by_positions(t):
    """All pairs of positions, by the definition of a word's edge."""
    word = lambda c: bool(regex.match(r"[\p{L}\p{N}_]", c))
    edge = [p in (0, len(t)) or not word(t[p - 1]) or not word(t[p]) for p in range(len(t) + 1)]
    out = []
    for a in range(len(t)):
        for b in range(a + labels.MIN_CHARS, len(t) + 1):
            text = t[a:b].strip(" ")
            if edge[a] and edge[b] and len(text.split(" ")) <= labels.MAX_WORDS and (t[a:b].lower(), text) not in [x[:2] for x in out]:
                low = t[a:b].lower()
                at = t.lower().find(low)
                out.append((low, text, edge[at] and at + len(low) < len(edge) and edge[at + len(low)]))
    return out


def test_pieces_by_positions():
    r = random.Random(4)
    for _ in range(400):
        t = "".join(r.choice(["ab", "A", "é", "x1", "_", " ", " ", "-", "&", "ab ab", "日本"]) for _ in range(r.randrange(12)))
        t = " ".join(t.split())
        assert sorted(labels.pieces(t)) == sorted(_by_positions(t)), t


def test_phrases_column(spark):
    rows = [("Harbor bridge closes",), ("",), (None,)]
    got = [[tuple(p) for p in x.p] for x in spark.createDataFrame(rows, "t string").select(labels.phrases(F.col("t")).alias("p")).collect()]
    assert got == [labels.pieces("Harbor bridge closes"), [], []]

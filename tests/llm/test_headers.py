"""Near passages behind words that the documents share."""

import random

import pytest

from newsloom.llm import substring_dedup


def _pairs(gap_a, gap_b, every, n, header=24, length=60):
    """n pairs of documents: a header that all share, a gap of own words, and a passage of which one copy has a changed word every `every` words."""
    r = random.Random(gap_a * 100 + gap_b + every)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(9))
    head, rows = [word() for _ in range(header)], []
    for k in range(n):
        passage = [word() for _ in range(length)]
        other = [word() if i % every == every // 2 else w for i, w in enumerate(passage)]
        for side, (gap, p) in enumerate(((gap_a, passage), (gap_b, other))):
            rows.append((2 * k + side, " ".join([*head, *[word() for _ in range(gap)], *p, *[word() for _ in range(15)]])))
    return rows


@pytest.mark.parametrize(("gap_a", "gap_b", "every", "length"), [(30, 30, 60, 60), (30, 41, 60, 60), (12, 12, 60, 60)])
def test_passages_behind_a_shared_header(spark, gap_a, gap_b, every, length):
    """The gap is of equal length in both documents: the passage's own seeds must be compared although the seeds before them are equal and equally far."""
    rows = _pairs(gap_a, gap_b, every, 12, length=length)
    got = {x.doc_id: x.spans for x in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 24
    for doc, gap in ((d, gap_a if d % 2 == 0 else gap_b) for d in got):
        first = 24 + gap
        assert any(s["first"] <= first + 6 and s["end"] >= first + length - 6 for s in got[doc]), (doc, got[doc])


def test_a_change_in_every_thirty_words(spark):
    """Stretches of 59 words hold one change: similarity 0.833. All of the passage is covered by such stretches, though no longer one is similar enough."""
    rows = _pairs(30, 30, 30, 10, length=150)
    got = {x.doc_id: x.spans for x in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc, spans in got.items():
        inside = sum(min(s["end"], 54 + 150) - max(s["first"], 54) for s in spans if s["end"] > 54)
        assert inside >= 50, (doc, spans)

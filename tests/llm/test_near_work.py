"""op4's verification: what is looked at in a task, against brute force, and how often it is screened."""

import numpy as np
import pytest

from newsloom.llm import substring_dedup as S


@pytest.mark.parametrize("m", [2, 40, S.FEW + 70])
def test_common_shingles(m):
    rng = np.random.default_rng(m)
    sets = [set(rng.integers(0, 60, 25).tolist()) | set(rng.integers(1000, 1000 + 4 * m, 6).tolist()) for _ in range(m)]
    held = {}
    for r, s in enumerate(sets):
        for v in s:
            held.setdefault(v, []).append(r)
    pairs = [(v, r) for v in sorted(held) if len(held[v]) > 1 for r in held[v]]
    value, line = (np.array(c) for c in zip(*pairs, strict=True))
    rows = np.arange(0, m, 3)
    got = S.common_shingles(value, line, m, rows)
    for i, r in enumerate(rows.tolist()):
        assert [int(n) for j, n in enumerate(got[i]) if j != r] == [len(sets[r] & sets[j]) for j in range(m) if j != r]


def test_contexts():
    rng = np.random.default_rng(5)
    grams = [rng.integers(0, 80, n).astype(np.uint64) for n in (400, 0, 3, 150)]
    text = S._Contexts(grams)
    who, at = np.array([0, 0, 0, 2, 3, 3]), np.array([0, 200, 390, 1, 20, 149])
    ids, first, inside = text.around(who, at)
    names = {int(k): int(g) for d in (0, 2, 3) for k, g in zip(text.of(d), grams[d], strict=True)}
    assert len(set(names.values())) == len(names)
    for r, (d, p) in enumerate(zip(who, at, strict=True)):
        seen = set()
        for c in range(S.WIDTH):
            q = p - S.SIGHT + c
            assert inside[r, c] == (0 <= q < len(grams[d]))
            if inside[r, c]:
                g = int(grams[d][q])
                assert names[int(ids[r, c])] == g and first[r, c] == (g not in seen)
                seen.add(g)
            else:
                assert ids[r, c] == text.none
    own = [set(g.tolist()) for g in grams]
    assert all(text.shared[k] == (sum(g in s for s in own) > 1) for k, g in names.items()) and not text.shared[text.none]


def test_occurrences_of_a_seed_are_screened_at_once(monkeypatch):
    # a seed, and around it runs of six equal words between four that differ: shingles enough in common, but no passage
    rng = np.random.default_rng(9)
    x = rng.integers(-(1 << 31), 1 << 31, 213).astype(np.int32)
    y = x.copy()
    for k in [*range(0, 100, 10), *range(113, 213, 10)]:
        y[k : k + 4] = rng.integers(-(1 << 31), 1 << 31, 4)
    calls, screen = [], S.can_be_similar
    monkeypatch.setattr(S, "can_be_similar", lambda *a: calls.append(len(a[0])) or screen(*a))
    seen = (np.array([7, 7]), np.array([0, 1]), np.array([100, 100]), np.array([True, True]))
    assert S.passages([x, y], seen, np.array([0, 0])) == []
    assert calls == [2]
    # with a few changes it is one, as it was
    y = x.copy()
    y[[60, 150]] += 1
    assert {r[:3] for r in S.passages([x, y], seen, np.array([0, 0]))} == {(0, 0, 213), (1, 0, 213)}


def test_first_partners_are_screened_alone(monkeypatch):
    rng = np.random.default_rng(9)
    text = rng.integers(0, 2**31 - 1, 120).astype(np.int32)
    docs = [text.copy() for _ in range(60)]
    for k, d in enumerate(docs):
        d[90] = k  # no exact copies
    n = len(docs)
    wide, screen = [], S.can_be_similar
    monkeypatch.setattr(S, "can_be_similar", lambda *a: wide.append(len(a[0])) or screen(*a))
    key, place = np.zeros(n, np.int64), np.full(n, 20)
    found = S.passages(docs, (key, np.arange(n), place, np.ones(n, bool)), np.zeros(n, np.int64))
    assert {d for d, *_ in found} == set(range(n))
    # one row for each occurrence, and of each one's partners the first few
    assert sum(wide) <= n + 2 * 4 * n


def test_meet_is_the_nearest():
    rng = np.random.default_rng(2)
    for n in (1, 5, 12, 13, 40, 65):
        for kinds in (3, 60, 3000):
            x, y = rng.integers(0, kinds, n), rng.integers(0, kinds, rng.integers(1, 66))
            pairs = [(p + q, p, q) for p in range(len(x)) for q in range(len(y)) if x[p] == y[q]]
            assert S._meet(x, y) == (min(pairs)[1:] if pairs else None)

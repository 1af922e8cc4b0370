"""The operators over documents against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from newsloom.llm import chat_format, decontam, exact_dedup, license_scan, mixing, near_dedup, quality_crf, substring_dedup, textops, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, score double, key_id string, own_sha string"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", low(t))


def alnum(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))


def texts():
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdeéßŁ日") for _ in range(r.randint(1, 7))) for _ in range(300)]
    base = [" ".join(r.choice(vocab) for _ in range(n)) for n in (120, 200, 90, 61, 33)]
    out = [None, "", " \t\n", "x", "X", "one two three", base[0], base[0], base[0] + " ", base[1].upper()]
    for b in base:
        for _ in range(4):
            w = b.split(" ")
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(vocab)
            out.append(" ".join(w))
    passage = " ".join(r.choice(vocab) for _ in range(70))
    out += [f"{base[3]} {passage} {base[4]}", f"{passage}\n{base[2]}", "long " * 30_000, "né\x85\xa0" + "a" * 70_000]
    out += ["don't we'll 'tis it's''s \n\n x  y   \t z 12a3 <|endoftext|> end<|endoftext|>", "Released under the MIT License. under the mit license", "CC BY-NC 4.0; Apache License, Version 2.0 apache license version 2"]
    return out


def frame(spark, rows=None):
    t = texts()
    rows = rows if rows is not None else [(i, x, "en", ["a", None, "b", "", "c"][i % 5], 1, i, 0.5, "k", "s") for i, x in enumerate(t)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    t = texts()
    rows = [(i, x, "en", ["a", None, "b", "", "c"][i % 5], 1, i, 0.5, "k", "s") for i, x in enumerate(t)]
    rows += [rows[6], rows[6], (None, t[6], None, None, None, None, None, None, None), (6, "other text of that id", "de", "a", 1, 1, 0.1, "", "")]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_exact(docs):
    df, rows = docs
    for block in (exact_dedup.BLOCK, 7):
        got = exact_dedup.exact_groups(df, block).collect()
        groups = defaultdict(list)
        for r in rows:
            groups[r[1] or ""].append(r[0])
        assert len(got) == len(rows)
        kept = defaultdict(int)
        by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
        for g in got:
            ids = by_sha[g.text_sha256]
            assert g.group_size == len(ids) and g.keep_id == max((i for i in ids if i is not None), default=None)
            kept[g.text_sha256] += g.kept
        assert set(kept.values()) == {1}
    out = exact_dedup.stage(df.sparkSession, df, "")
    assert out.columns == df.columns and out.count() == len(groups)


def test_exact_digest_collisions(docs, monkeypatch):
    df, rows = docs
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "_digest", lambda c: (F.length(c).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2")))
    got = exact_dedup.exact_groups(df, 50).select("text_sha256", "group_size").distinct().collect()
    assert len(got) == len({r[1] or "" for r in rows})


def test_near(docs):
    df, rows = docs
    got = near_dedup.near_groups(df).collect()
    sets = []
    for r in rows:
        w = words(r[1])
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    low_id = defaultdict(list)
    for i, r in enumerate(rows):
        low_id[find(i)].append(r[0])
    want = sorted((repr(r[0]), len(sets[i]), repr(min((x for x in low_id[find(i)] if x is not None), default=None)) if sets[i] else repr(r[0])) for i, r in enumerate(rows))
    assert sorted((repr(g.doc_id), g.n_shingles, repr(g.component_id)) for g in got) == want


def test_linked_blocks_find_all_links():
    r = np.random.default_rng(5)
    base = [np.unique(r.integers(0, 10**9, 60)) for _ in range(6)]
    sets = []
    for _ in range(60):
        b = base[r.integers(6)].copy()
        k = r.integers(0, 6)
        b[r.choice(len(b), k, replace=False)] = r.integers(0, 10**9, k)
        sets.append(np.unique(b).astype(np.uint64))
    sim = Fraction(85, 100)
    links = {(i, j) for i in range(60) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) * 100 >= 85 * len(np.union1d(sets[i], sets[j]))}

    def parts(edges):
        p = list(range(60))

        def f(x):
            while p[x] != x:
                x = p[x]
            return x

        for a, b in edges:
            p[f(a)] = f(b)
        return {frozenset(i for i in range(60) if f(i) == f(j)) for j in range(60)}

    assert parts(near_dedup.linked(sets, np.zeros(60, int), sim)) == parts(links)
    blocks = np.arange(60) % 3
    found = near_dedup.linked(sets, blocks, sim)
    for b in range(3):
        own = np.flatnonzero(blocks == b)
        found += [(own[i], own[j]) for i, j in near_dedup.linked([sets[x] for x in own], np.zeros(len(own), int), sim)]
    assert parts(found) == parts(links)


def test_super_minhash_estimates_jaccard():
    r = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        common, extra = int(r.integers(1, 80)), int(r.integers(0, 60))
        x = r.integers(0, 2**63, common + 2 * extra).astype(np.uint64)
        a, b = np.sort(x[: common + extra]), np.sort(np.concatenate([x[:common], x[common + extra :]]))
        s = near_dedup.super_minhash(np.concatenate([a, b]), np.array([len(a), len(b)]), 120)
        errors.append((s[0] == s[1]).mean() - common / (common + 2 * extra))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


def test_decontamination(spark, docs):
    df, rows = docs
    w = alnum(rows[10][1])
    items = [(1, " ".join(w[5:30])), (2, "one TWO three"), (3, None), (4, "..."), (12, " ".join(w[20:40])), (12, " ".join(w[20:40])), (5, "x")]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.decontaminated(df, b).collect()
    want = []
    for r in rows:
        ws, hit, ids = alnum(r[1]), set(), set()
        for i, t in items:
            iw = alnum(t)
            k = min(10, len(iw))
            for j in range(len(iw) - k + 1) if k else ():
                for p in range(len(ws) - k + 1):
                    if ws[p : p + k] == iw[j : j + k]:
                        hit.update(range(p, p + k))
                        ids.add(str(i))
        want.append((repr(r[0]), len(ws), len(hit), sorted(ids)))
    assert sorted((repr(g.doc_id), g.n_words, g.n_hit, g.item_ids) for g in got) == sorted(want)
    before = decontam.BROADCAST_WINDOWS
    try:
        decontam.BROADCAST_WINDOWS = 0
        assert sorted((repr(g.doc_id), g.n_words, g.n_hit, g.item_ids) for g in decontam.decontaminated(df, b).collect()) == sorted(want)
    finally:
        decontam.BROADCAST_WINDOWS = before
    assert decontam.decontaminated(df, b.limit(0)).where("contaminated").count() == 0


def test_mixing(docs):
    df, rows = docs
    got = mixing.mixed(df).collect()
    assert len(got) == len(rows)
    assert sorted(g["size"] for g in got) == sorted(len(words(r[1])) for r in rows)
    total, taken, target = sum(g["size"] for g in got), defaultdict(int), {}
    for g in got:
        assert g.taken <= 3 * g["size"]
        taken[g.source] += g.taken
        target[g.source] = g.target
    assert abs(sum(target.values()) - total) < 1e-6 * total
    again = mixing.mixed(df).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.mixed(df.limit(0)).count() == 0
    out = mixing.stage(df.sparkSession, df, "")
    assert out.columns == [*df.columns, "copies", "taken"]


def test_mixing_comes_near(spark):
    r = random.Random(2)
    rows = [(i, "w " * r.randint(1, 50), None, "s%d" % (i % 7 if i % 3 else 0), 0, 0, 0.0, "", "") for i in range(3000)]
    got = mixing.mixed(frame(spark, rows)).collect()
    taken, target = defaultdict(int), {}
    for g in got:
        taken[g.source] += g.taken
        target[g.source] = g.target
    assert all(abs(taken[s] - target[s]) <= 50 for s in target)


def test_tokens(docs):
    tokenizers = pytest.importorskip("tokenizers")
    df, rows = docs
    t = tokenizers.Tokenizer.from_file(token_counts.vocabulary())
    r = random.Random(9)
    alphabet = list("ab 'stremdvl  \n\t1é日  🙂.,-_") + ["<|endoftext|>", "'re", "'ll", " the"]
    more = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 90))) for _ in range(1500)]
    rows = [(i, x, "", "", 0, 0, 0.0, "", "") for i, x in enumerate(more)] + rows
    got = token_counts.token_counts(frame(df.sparkSession, rows)).collect()
    want = [(repr(x[0]), len((x[1] or "").encode()), len(t.encode(x[1] or "", add_special_tokens=False).ids)) for x in rows]
    assert sorted((repr(g.doc_id), g.n_bytes, g.n_tokens) for g in got) == sorted(want)


def test_licences(docs):
    df, rows = docs
    r, spans = license_scan.license_spans(df)
    base = spans.where("is_base").groupBy("rid").count()
    got = r.join(base, "rid", "left").fillna(0, ["count"]).collect()
    want = []
    for x in rows:
        w = alnum(x[1])
        n = sum(w[i : i + len(p.split())] == p.split() for p in license_scan.BASE for i in range(len(w)))
        want.append((repr(x[0]), len(w), n))
    assert sorted((repr(g.doc_id), g.n_words, g["count"]) for g in got) == sorted(want)


def test_licence_spans_allow_changes(spark):
    t = "Permission is hereby kindly granted free of charge, to any person obtaining a copy of this software and the associated documentation files"
    df = spark.createDataFrame([(1, t), (2, "gnu general public license version 3"), (3, "permission is hereby granted")], "doc_id long, text string")
    r, spans = license_scan.license_spans(df)
    assert {(x.doc_id, x.label) for x in r.join(spans, "rid").collect()} == {(1, "mit"), (2, "gpl-3")}


def test_compact_windows():
    r = np.random.default_rng(1)
    for _ in range(100):
        counts = r.integers(0, 40, 5)
        v = r.integers(0, 2**63, counts.sum()).astype(np.uint64)
        least = int(r.integers(1, 8))
        got = set(zip(*map(list, substring_dedup.compact_windows(v, counts, least)), strict=True))
        want, at = set(), 0
        for n in counts:
            for c in range(at, at + n):
                a, b = c, c
                while a > at and v[a - 1] > v[c]:
                    a -= 1
                while b < at + n - 1 and v[b + 1] > v[c]:
                    b += 1
                if b - a + 1 >= least:
                    want.add((a, c, b))
            at += n
        assert got == want


def test_compact_windows_of_repeats():
    r = np.random.default_rng(2)
    for deep in (0, 1, 30):
        for _ in range(60):
            counts = r.integers(0, 60, 4)
            v = r.integers(0, 5, counts.sum()).astype(np.uint64) << np.uint64(40)
            before, substring_dedup.DEEP = substring_dedup.DEEP, deep
            try:
                left, c, right = substring_dedup.compact_windows(v, counts, 3)
            finally:
                substring_dedup.DEEP = before
            # every passage of three or more has a window of its minimum's value over it, and windows are what they say
            assert all(v[a : b + 1].min() == v[x] for a, x, b in zip(left, c, right, strict=True))
            at = 0
            for n in counts:
                for i in range(at, at + n):
                    for j in range(i + 2, at + n):
                        m = v[i : j + 1].min()
                        assert any(a <= i and b >= j and v[x] == m for a, x, b in zip(left, c, right, strict=True))
                at += n
    import time

    began = time.time()
    substring_dedup.compact_windows(np.zeros(2_000_000, np.uint64), np.array([2_000_000]), 46)
    assert time.time() - began < 10


@pytest.mark.parametrize("unique", [True, False])
def test_passages(docs, unique):
    df, rows = docs
    if unique:
        rows = [r for i, r in enumerate(rows) if i < len(texts())]
        df = frame(df.sparkSession, rows)
    got = substring_dedup.repeated_passages(df).collect()
    assert len(got) == len(rows)
    named = {(r[0], r[1]) for r in rows}
    first, hit = {}, defaultdict(set)
    for d in named:
        w = words(d[1])
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            o = first.setdefault(k, (d, i))
            if o[0] != d:
                hit[d].update(range(i, i + 50))
                hit[o[0]].update(range(o[1], o[1] + 50))
    for d in named:
        mine = [g for g in got if g.doc_id == d[0] and g.n_words == len(words(d[1]))]
        assert mine
        spans = [set(range(s.first, s.end)) for s in mine[0].spans]
        assert len(hit[d] - set().union(*spans)) <= substring_dedup.SLACK * max(1, len(spans))


def near_passages():
    """Pairs of documents that share a passage of n words with one word changed, put in or left out at every place."""
    rows, want = [], {}
    r = random.Random(5)
    for n in (50, 60, 70, 110):
        for at in range(n):
            for kind in ("change", "insert", "delete", "delete two"):
                p = [f"p{r.random()}" for _ in range(n)]
                q = p[:at] + ([f"n{r.random()}"] if kind in ("change", "insert") else []) + p[at + ("insert", "delete two").index(kind) * 2 if kind in ("insert", "delete two") else at + 1 :]
                docs = [[f"a{r.random()}" for _ in range(12)] + x + [f"z{r.random()}" for _ in range(15)] for x in (p, q)]
                s = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (p, q)]
                clear = 5 <= at < n - 6  # else the change is at an end and the passage may be what stands beside it
                if clear and len(p) >= 50 and 5 * len(s[0] & s[1]) >= 4 * len(s[0] | s[1]):
                    want[len(rows)] = (12, 12 + n, len(rows) + 1)
                rows += [(len(rows) + k, " ".join(d)) for k, d in enumerate(docs)]
    return rows, want


def test_near_passages_with_a_change_at_every_place(spark):
    rows, want = near_passages()
    got = {g.doc_id: g for g in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) > 500
    for d, (first, end, partner) in want.items():
        assert [tuple(s) for s in got[d].spans] == [(first, end)] and got[d].partner_id == partner


def test_a_passage_has_one_partner(spark):
    r = random.Random(6)
    new = lambda n: [f"w{r.random()}" for _ in range(n)]
    e, f, left, right = new(30), new(30), new(24), new(35)
    docs = [new(20) + e + f + new(20), new(40) + e + new(40), new(40) + f + new(40)]
    # the smallest document of the run has it alone; the two others are similar beyond it
    docs += [new(50) + right + new(50), new(9) + left + new(1) + right + new(9), new(9) + left + new(1) + right + new(9)]
    got = substring_dedup.repeated_passages(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")).collect()
    spans = {g.doc_id: [tuple(s) for s in g.spans] for g in got}
    assert spans == {0: [], 1: [], 2: [], 3: [], 4: [(9, 69)], 5: [(9, 69)]}


def test_stage_links_at_four_fifths(spark):
    r = random.Random(8)
    a = [f"w{r.random()}" for _ in range(100)]
    b = ["x" if i in (30, 60) else w for i, w in enumerate(a)]  # 86 / 106
    c = ["x" if i in (20, 50, 80) else w for i, w in enumerate(a)]  # 81 / 111
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate((a, b, c))], "doc_id long, text string")
    assert sorted(x.doc_id for x in near_dedup.pipeline_stage(spark, df, "").collect()) == [0, 2]
    assert near_dedup.near_groups(df).where("kept").count() == 3  # op7 keeps 0.85


def test_quality_features_and_field():
    bad = "AAA!! BBB!! CCC!!\nXX | YY | ZZ | QQ"
    good = "This is a plain sentence with some words.\nAnd another one, of the same kind, follows here."
    r = random.Random(1)
    t = [(good if i % 2 else bad).replace("s", r.choice("sst")) for i in range(200)]
    data = np.frombuffer("".join(t).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(x.encode()) for x in t])])
    f, lens, per = quality_crf.line_features(data, off)
    assert per.tolist() == [2] * 200 and lens.sum() == off[-1]
    x = quality_crf.encoded(f, per)
    label = np.arange(200) % 2
    m = quality_crf.fit(x, lens, per, label)
    assert ((quality_crf.scores(m, x, lens, per) >= 0.5) == label).all()


def test_quality_edges(spark, docs):
    df, _ = docs
    labels = spark.createDataFrame([(3, 1), (4, None), (None, 0)], "doc_id long, label int")
    assert quality_crf.train(df, labels) is None
    assert {r.score for r in quality_crf.scored(df.select("doc_id", "text"), None).collect()} == {1.0}
    labels = spark.createDataFrame([(3, 1), (6, 0), (6, 1), (7, 0), (12, 1)], "doc_id long, label int")
    m = quality_crf.train(df, labels)
    got = quality_crf.scored(df, m, "s2").collect()
    assert len(got) == df.count() and all(0 <= r.s2 <= 1 for r in got)


def test_empty_tables(spark, docs):
    e = docs[0].limit(0)
    assert exact_dedup.exact_groups(e).count() == 0
    assert near_dedup.near_groups(e).count() == 0
    assert token_counts.token_counts(e).count() == 0
    assert substring_dedup.repeated_passages(e).count() == 0
    assert license_scan.license_spans(e)[0].count() == 0
    assert decontam.decontaminated(e, spark.createDataFrame([(1, "x y")], "item_id long, text string")).count() == 0


def test_words_do_not_span_texts():
    import pyarrow as pa

    sep = textops.separators("space")
    for _, data, off in textops.passes(pa.array(["ab", "cd", "", None, " e", "f"])):
        s, e, c = textops.words(data, off, sep)
        assert c.tolist() == [1, 1, 0, 0, 1, 1]
        h = textops.span_hashes(data, s, e)
        assert len(set(h.tolist())) == 4


def test_chat(spark):
    call = '{"content":"let me see","tool_calls":[{"id":"c1","name":"search","arguments":{"limit":"x","query":"q \\"1\\"","z":2}},{"id":"c2","name":"other","arguments":{"b":1,"a":[1,2]}}]}'
    rows = [
        (1, 0, "user", "hi\n\"there\""), (1, 1, "tool", '{"tool_call_id":"c1","content":"early"}'), (1, 2, "assistant", call), (1, 3, "tool", '{"tool_call_id":"c2","content":"r2"}'),
        (1, 4, "tool", '{"tool_call_id":"nope","content":"?"}'), (2, 0, "tool", '{"tool_call_id":"c1","content":"elsewhere"}'), (2, 1, None, None), (None, 0, "user", "{not json"), (1, 0, "user", "hi\n\"there\""),
    ]
    got = {(r.conv_id, r.turn, r.message): r for r in chat_format.messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    by = {(k[0], k[1]): r for k, r in got.items()}
    assert by[1, 2].n_calls == 2 and by[1, 2].problems == ["type:limit", "unknown:z"]
    assert '"arguments":{"limit":"x","query":"q \\"1\\"","z":2}' in by[1, 2].message and '"arguments":{"a":[1,2],"b":1}' in by[1, 2].message
    assert (by[1, 1].at, by[1, 1].step, by[1, 1].call_turn) == (2, 1, 2)  # it came before its call
    assert by[1, 3].call_turn == 2 and not by[1, 3].orphan
    assert by[1, 4].orphan and by[2, 0].orphan
    assert by[2, 1].message == '{"content":"","role":"user"}' and by[None, 0].message == '{"content":"{not json","role":"user"}'


def test_chat_argument_types_duplicates_and_unanswered(spark):
    import json

    def call(*calls):
        return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]}, ensure_ascii=False)

    odd = {"query": "2024", "z": {"b": [{"d": 1, "c": "0123"}], "a": None}, "y": "[a] or [b]", "x": "true", "w": 1.5, "v": False, "u": "{}", "t": 'é "q"', "s": None}
    rows = [
        (1, 0, "assistant", call(("a", "search", odd), ("b", "search", {"query": 5, "limit": "5"}))), (1, 1, "assistant", call(("a", "weather", {"city": "x", "days": 2, "metric": True}))),
        (1, 2, "tool", '{"tool_call_id":"a","content":"r"}'), (2, 0, "assistant", call(("c", "weather", {"city": None, "days": 1.5, "metric": "true"}), ("c", "other", {}))), (2, 1, "user", "x"),
    ]
    got = {(r.conv_id, r.turn): r for r in chat_format.messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == 5
    first = json.loads(got[1, 0].message)["tool_calls"][0]["arguments"]
    assert first == odd
    assert json.dumps(odd, sort_keys=True, separators=(",", ":"), ensure_ascii=False) in got[1, 0].message
    assert got[1, 0].problems == sorted(f"unknown:{k}" for k in "stuvwxyz") + ["type:limit", "type:query"]
    assert got[2, 0].problems == ["type:city", "type:days", "type:metric"] and got[1, 1].problems == []
    assert [(got[k].duplicate, got[k].unanswered) for k in sorted(got)] == [([], ["b"]), (["a"], ["a"]), ([], []), (["c"], ["c", "c"]), ([], [])]


def test_chat_arguments_in_a_string_and_canonical_form(spark):
    import json

    r = random.Random(12)

    def value(depth):
        kind = r.randrange(9 if depth < 3 else 6)
        if kind > 6:
            return {r.choice(["b", "a", "é", "z\"", "0", "A"]): value(depth + 1) for _ in range(r.randrange(4))}
        if kind == 6:
            return [value(depth + 1) for _ in range(r.randrange(4))]
        return r.choice([None, True, False, 0, -7, 2**60, 1.25, "", "12", "true", "null", "{x}", "[1]", 'q"\\', "a\nb\t", "日🙂"])

    made = [{k: value(0) for k in r.sample(["q", "limit", "b", "a", "x y"], r.randrange(5))} for _ in range(120)]
    rows = [(1, i, "assistant", json.dumps({"tool_calls": [{"id": "a", "name": "n", "arguments": json.dumps(a) if i % 2 else a}]})) for i, a in enumerate(made)]
    rows += [(2, 0, "assistant", '{"tool_calls":[{"id":"a","name":"search","arguments":"not json"},{"id":"b","name":"search","arguments":[2,{"b":1,"a":2}]},{"id":"c","name":"n"}]}')]
    got = {(x.conv_id, x.turn): x for x in chat_format.messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for i, a in enumerate(made):
        m = got[1, i].message
        assert json.loads(m)["tool_calls"][0]["arguments"] == a
        assert m == json.dumps(json.loads(m), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert [c["arguments"] for c in json.loads(got[2, 0].message)["tool_calls"]] == ["not json", [2, {"a": 2, "b": 1}], {}]
    assert got[2, 0].problems == ["arguments"] * 3
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string, calls string, p string, at long, id string")
    assert chat_format.messages(none).count() == 0
    odd = spark.createDataFrame([(1, 0, "user", "x", "c", "p", 5, "i"), (1, 0, "user", "x", "c", "p", 5, "i")], none.schema)
    assert [x.message for x in chat_format.messages(odd).collect()] == ['{"content":"x","role":"user"}'] * 2


def test_licence_labels_against_brute_force(spark):
    r = random.Random(4)
    vocab = "gnu general public license version 3 2 the under mit apache cc by nc lesser 4 0 creative commons attribution international this is".split()
    parts = [*license_scan.TEMPLATES, *license_scan.BASE, "general public license"]
    rows = []
    for i in range(300):
        w = []
        for _ in range(r.randint(0, 6)):
            w += r.choice(parts).split() if r.random() < 0.5 else [r.choice(vocab) for _ in range(r.randint(1, 12))]
        rows.append((i, " ".join(w)))
    rows += [(300, "general public license " * 5 + "gnu general public license version 3"), (301, "Public-License " * 40), (302, None), (303, "")]
    got = spark.createDataFrame(rows, "doc_id long, text string")
    d, spans = license_scan.license_spans(got)
    found = defaultdict(set)
    for x in d.join(spans, "rid").collect():
        found[x.doc_id].add(x.label)
        w = alnum(rows[x.doc_id][1])
        assert 0 <= x.first < x.last <= len(w) and 0 < x.coverage <= 1
    for i, t in rows:
        w = alnum(t)
        for text, label in {**license_scan.TEMPLATES, **license_scan.BASE}.items():
            p = text.split()
            if any(w[k : k + len(p)] == p for k in range(len(w))):
                assert label in found[i], (i, label)
        # a label needs enough of its template's grams in a text
        grams = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
        possible = set()
        for text, label in {**license_scan.TEMPLATES, **license_scan.BASE}.items():
            p = text.split()
            g = [tuple(p[k : k + 3]) for k in range(len(p) - 2)]
            if sum(x in grams for x in g) >= (len(g) if len(g) < license_scan.LONG else license_scan.COVERAGE * len(g)):
                possible.add(label)
        assert found[i] <= possible
    assert "gpl-3" in found[300] and not found[301]


def test_licence_stretches():
    # 30 hits of one place on diagonals three words apart, then a whole template
    at = np.array([*range(0, 90, 3), *range(95, 99)])
    place = np.array([1] * 30 + [0, 1, 2, 3])
    assert license_scan.stretches(at, place, 4) == [(95, 101, 1.0)]
    assert license_scan.stretches(at[:30], place[:30], 4) == []


def test_quality_training_rows(spark):
    """Labelled documents whose rows repeat, and texts of very many lines, train with all that they have."""
    bad = "\n".join(["This is a plain sentence with some words, as the others have it."] * 400 + ["XX || YY!! ZZ ## 99"] * 50)
    good = "This is a plain sentence with some words, as the others have it."
    rows = [(i, good if i % 2 else bad) for i in range(10) for _ in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, label int")
    got = quality_crf.sampled(df, labels, 10).collect()
    assert sorted((x.id, x.label) for x in got) == [(i, i % 2) for i in range(10)]
    assert {len(x.lens) for x in got} == {1, 450}
    assert len(quality_crf.sampled(df, labels, 4).collect()) == 4
    # whole texts within the bound on lines, in the order of the hash
    few = quality_crf.sampled(df, labels, 10, 460).collect()
    assert few and all(len(x.lens) in (1, 450) for x in few) and sum(len(x.lens) for x in few) <= 460
    m = quality_crf.train(df, labels, 10)
    assert m is not None
    got = {x.doc_id: x.score for x in quality_crf.scored(df, m).collect()}
    assert all((got[i] >= 0.5) == (i % 2 == 1) for i in range(10))


def test_quality_query(spark, tmp_path):
    """op8 learns from rows that aren't held out alone, and nothing but the text is an input of a score."""
    import zlib

    r = random.Random(3)
    vocab = ["".join(r.choice("abcdefg") for _ in range(r.randint(2, 7))) for _ in range(300)]
    good = lambda: " ".join(r.choice(vocab) for _ in range(20)).capitalize() + "."
    bad = lambda: " | ".join(r.choice(vocab).upper() + "!!" for _ in range(12))
    rows = [(i, good() if i % 3 else bad(), "en", f"s{i % 4}", i, 0.5, True) for i in range(150)]
    rows += [(1000 + i, rows[i][1], "de", "other", 0, 0.1, False) for i in range(20)] + [(2000, None, None, None, None, None, None), (2001, "", "", "", 0, 0.0, False), (None, rows[0][1], "", "", 0, 0.0, True)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out boolean"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    labels = [(i, int(i % 3 > 0), 0) for i in range(150)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/a/labels.parquet")
    turned = [(i, 1 - q if held(i) else q, 0) for i, q, _ in labels]
    spark.createDataFrame(turned, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/b/labels.parquet")
    got = quality_crf.op8_quality_crf(spark, f"{tmp_path}/a").collect()
    assert len(got) == len(rows)
    assert all(x.held_out == held(x.doc_id) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got)
    by = {x.doc_id: x.score for x in got}
    assert all(by[1000 + i] == by[i] for i in range(20))
    assert sum((by[i] >= 0.5) == (i % 3 > 0) for i in range(150)) >= 145
    assert {x.doc_id: x.score for x in quality_crf.op8_quality_crf(spark, f"{tmp_path}/b").collect()} == by
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality_crf.train(empty, spark.createDataFrame(labels, "doc_id long, label int, toxic int")) is None
    assert quality_crf.scored(empty, None).count() == 0


def test_field_in_segments():
    from newsloom.llm import crf

    r = np.random.default_rng(0)
    per = r.integers(1, 60, 30)
    u, trans = r.normal(size=int(per.sum())), r.normal(size=(2, 2))
    whole, before = crf.marginals(u, per, trans), crf.STEP
    for step in (1, 3, 7):
        try:
            crf.STEP = step
            parts = crf.marginals(u, per, trans)
        finally:
            crf.STEP = before
        assert np.allclose(whole[0], parts[0]) and np.allclose(whole[1], parts[1]) and np.isclose(whole[2], parts[2])


def test_stages_keep_columns_and_take_effect(spark, docs, tmp_path):
    df, rows = docs
    cols = df.columns
    near = near_dedup.stage(spark, df, "")
    assert near.columns == cols
    groups = near_dedup.near_groups(df.select("doc_id", "text")).where("n_shingles > 0").select("root").distinct().count()
    empty = [r for r in rows if not words(r[1])]
    assert near.count() == groups + len({(r[0], r[1] or "") for r in empty})
    unique = frame(spark)
    assert near_dedup.stage(spark, unique, "").count() == near_dedup.near_groups(unique).where("kept").count()
    w = alnum(rows[10][1])
    spark.createDataFrame([(1, " ".join(w[5:30]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = decontam.stage(spark, df, str(tmp_path))
    bad = decontam.decontaminated(df, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).where("contaminated").count()
    assert bad > 0 and clean.columns == cols and clean.count() == len(rows) - bad


def test_pipeline_against_its_operators(spark, tmp_path):
    """run() on a small folder: what each stage drops is what its operator says of that stage's input."""
    import corpus_pipeline

    r = random.Random(6)
    vocab = ["".join(r.choice("abcdefg") for _ in range(r.randint(2, 7))) for _ in range(400)]
    good = lambda: "\n".join(" ".join(r.choice(vocab) for _ in range(12)).capitalize() + "." for _ in range(6))
    bad = lambda: "\n".join(" | ".join(r.choice(vocab).upper() + "!!" for _ in range(8)) for _ in range(6))
    rows = [(i, bad() if i % 5 == 0 else good(), "en", f"s{i % 3}", 0) for i in range(200)]
    rows += [(200 + i, rows[i * 5 + 1][1], "en", "s0", 0) for i in range(10)]
    rows += [(300 + i, rows[i * 5 + 2][1] + " end", "en", "s1", 0) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, rows[3][1]), (2, rows[4][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = {x.doc_id for x in out.collect()}
    assert not any(i % 5 == 0 for i in ids if i < 200)  # rejected by quality
    assert not ids & {i * 5 + 1 for i in range(10)}  # of equal texts the largest doc_id stays
    assert not ids & {300 + i for i in range(10)}  # of near copies the smallest stays
    assert not ids & {3, 4}
    mix = mixing.mixed(docs.where(docs.doc_id.isin(*[i for i, *_ in rows])))
    assert out.columns == [*docs.columns, "copies", "taken"] and mix.count() == len(rows)

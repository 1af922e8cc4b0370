"""op11, op12 and op13 against brute force."""

import hashlib
import json
import os
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest

from newsloom.llm import centroids, filter_audit, token_files

DOCS = "doc_id long, source string, text string, part string, good long, n long, mask int"


# ---- op11


def _documents():
    r = random.Random(5)
    word = lambda: r.choice(["alpha", "beta", "Gamma", "d", "eps", "ZETA", "é"]) + str(r.randrange(300))
    texts = [None, "", " \t\n", "X", "a#b", "one two", "word " * 500, "\x85 \xa0 x", "A" * 70_000 + " b" * 300, "|" * 30]
    texts += [" ".join(word() for _ in range(r.choice([5, 150, 199, 200, 201, 260]))) + r.choice(["", "$", " & "]) for _ in range(60)]
    rows = [(i, r.choice(["a", "b", None, ""]), r.choice(texts) if i > 70 else texts[i % len(texts)]) for i in range(160)]
    rows += [(None, "a", texts[12]), (None, None, texts[12]), rows[12], rows[12], (3, "b", texts[12]), (500, "c", None)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 160, 2)] + [(12, 0, 0), (12, 1, 1), (None, 1, 1), (9999, 1, 1), (5, 2, 7)]
    return rows, labels


def _audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    first = {}
    for d, _, t in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    docs = []
    for d, s, t in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {f for f, bad in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), d is not None and d > first.get(t, d)), strict=True) if bad}
        docs.append((s or "", fails, d in good, d in toxic))
    out = {}
    for part in {x[0] for x in docs}:
        own = [x for x in docs if x[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                total[f] += len(gone)
                before = [x for x in own if f in x[1] and set(order[:k]) & x[1]]
                left = [x for x in left if f not in x[1]]
                out[part, "".join(order), k + 1] = [len(left), len(gone), len(before), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(total[order[k - 1]])
    return out


def test_filter_audit(spark):
    rows, labels = _documents()
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], DOCS)
    marks = spark.createDataFrame([(*x, 1, 9) for x in labels], "doc_id long, quality int, toxic int, of long, n long")
    got = {(x.part, x.filter_order, x.step): [x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley] for x in filter_audit.audit(docs, marks).collect()}
    assert got == _audit(rows, labels)
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    assert filter_audit.audit(docs, marks.limit(0)).agg({"good_lost": "max", "toxic_lost": "max"}).first()[0] == 0


# ---- op12


def _texts():
    r = random.Random(9)
    marks = list("abzAZ'’09 \t\n.,-_<|>?!éÀ×÷ſƀβ日ﬁ́ ​Åİß") + ["<|endoftext|>", "<|startoftext|>", "'ll", "'S", "<|ENDOFTEXT|>", "\x85", "\x00", "😀"]
    out = [None, "", " \n", "Hello, World! it's", "don't 12a3", "x" * 40_000, "long words here. " * 20_000, "<|startoftext|>a,b<|endoftext|>.", "café, NAÏVE! Öl…", "a.b" * 5000]
    return out + ["".join(r.choice(marks) for _ in range(r.randrange(60))) for _ in range(400)]


def _wanted(rows):
    library = token_files._library(token_files.vocabulary())
    told, start = [], 0
    for d, ids in ((d, [*library.encode(t or "", add_special_tokens=False).ids, token_files.END]) for d, t in rows):
        told.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return told


@pytest.mark.parametrize("shards", [1, 7])
def test_token_files(spark, tmp_path, shards):
    from pyspark.sql import functions as F

    rows = [(i - 50, t) for i, t in enumerate(_texts())]
    df = spark.createDataFrame([(*x, "n", 1) for x in random.Random(1).sample(rows, len(rows))], "doc_id long, text string, ids string, h long").repartition(5)
    at = f"file://{tmp_path}/tokens"
    token_files.write_tokens(df, at, shards=shards)
    got = [tuple(x) for x in token_files.read_tokens(spark, at).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()]
    assert got == _wanted(rows), "in order, as they were written"
    files = [f for f in os.listdir(tmp_path / "tokens") if f.startswith("shard")]
    assert sorted(files) == sorted(f for f, _, _ in json.loads((tmp_path / "tokens" / "manifest.json").read_text())["files"]) and len(files) <= shards
    by_rank = np.fromfile(tmp_path / "tokens" / "ranks", "<u4")
    counts = np.bincount(np.concatenate([np.frombuffer(x.ids, "<u4") for x in token_files.read_tokens(spark, at).select("ids").collect()]))
    assert (np.diff(counts[by_rank].astype(np.int64)) <= 0).all() and len(by_rank) == (counts > 0).sum()


def test_token_files_of_repeated_and_null_ids(spark, tmp_path):
    rows = [(5, "b"), (None, "x y"), (5, "a a"), (5, "b"), (None, None), (2, "<|endoftext|>")]
    at = f"file://{tmp_path}/tokens"
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), at, shards=3)
    got = [(x.doc_id, x.start, np.frombuffer(x.ids, "<u4").tolist()) for x in token_files.read_tokens(spark, at).collect()]
    library = token_files._library(token_files.vocabulary())
    want = sorted(((d is not None, d or 0, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in rows), key=str)
    assert sorted(((d is not None, d or 0, ids) for d, _, ids in got), key=str) == want
    assert [d for d, _, _ in got] == [None, None, 2, 5, 5, 5] and [s for _, s, _ in got] == np.cumsum([0] + [len(i) for _, _, i in got[:-1]]).tolist()
    token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), f"{at}-none")
    assert token_files.read_tokens(spark, f"{at}-none").count() == 0


def test_other_tokenizers_take_whole_texts(spark, tmp_path):
    from pyspark.sql import functions as F

    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_files.cuts_words(token_files.vocabulary()) and not token_files.cuts_words(path)
    rows = [(i, t) for i, t in enumerate(["a b", None, "it's  x\n", "é日"])]
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/t", path)
    library = token_files._library(path)
    got = [np.frombuffer(x.ids, "<u4").tolist() for x in token_files.read_tokens(spark, f"file://{tmp_path}/t").collect()]
    assert got == [[*library.encode(t or "", add_special_tokens=False).ids, 2] for _, t in rows]


def test_numbers_of_all_lengths():
    r = np.random.default_rng(2)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (r.integers(0, 1 << 32, n, dtype=np.uint64) >> r.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
        control, data = token_files.packed(x)
        assert len(control) == -(-n // 4) and (token_files.unpacked(control, data, n) == x).all()
        want = b"".join(int(v).to_bytes(4, "little")[: max(1, (int(v).bit_length() + 7) // 8)] for v in [*x, *[0] * (-n % 4)])
        assert data.tobytes() == want


def test_a_lost_writer_leaves_no_shard(spark, tmp_path):
    """A task that fails leaves a file that no manifest names; the folder has no manifest until a write ends."""
    from pyspark.sql import functions as F

    token_files.ship(spark)
    spark.dataSource.register(token_files.TokenFiles)
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.expr("cast(repeat('ab', 10) as binary)").alias("ids")).repartition(4)
    bad = rows.withColumn("ids", F.when(F.col("doc_id") == 39, F.raise_error(F.lit("lost"))).otherwise(F.col("ids")).cast("binary"))
    at = f"file://{tmp_path}/t"
    with pytest.raises(Exception, match="lost"):
        bad.write.format("newsloom_tokens").option("width", 2).mode("append").save(at)
    assert not (tmp_path / "t" / "manifest.json").exists()
    rows.write.format("newsloom_tokens").option("width", 2).mode("append").save(at)
    assert token_files.read_tokens(spark, at).agg(F.count("*"), F.sum("n_tokens"), F.max("start")).first() == (40, 400, 390)


# ---- op13


def _clusters(rows, k, rounds):
    kept = []
    for v, x in rows:
        if x is not None and len(x) == 64 and all(c is not None and np.isfinite(c) for c in x):
            kept.append((v, np.array([int(np.floor(256 * float(np.float32(c)))) for c in x], object)))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), list(r[1])))
    c = [x for _, x in order[:k]]

    def nearest(x):
        d = [int(((x - y) ** 2).sum()) for y in c]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        at = [nearest(x)[0] for _, x in kept]
        for i in range(len(c)):
            own = [x for (_, x), a in zip(kept, at, strict=True) if a == i]
            if own:
                c[i] = sum(own) // len(own)
    told = [(v, *nearest(x)) for v, x in kept]
    inertia = {i: sum(d for _, a, d in told if a == i) for i in range(len(c))}
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((v, a, d, inertia[a], sum(inertia.values()), sha[a]) for v, a, d in told), key=str)


@pytest.mark.parametrize("kind", ["clusters", "noise", "ties"])
def test_centroids(spark, kind):
    r = np.random.default_rng(4)
    if kind == "clusters":
        x = r.normal(size=(8, 64))[r.integers(0, 8, 150)] + 0.05 * r.normal(size=(150, 64))
    else:
        x = r.normal(size=(90, 64)) if kind == "noise" else r.integers(-1, 2, (90, 64)) / 256
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [1.0] * 64
    rows += [(900, None), (901, []), (902, odd[:63]), (903, [*odd, 1.0]), (904, [None, *odd[1:]]), (905, [float("nan"), *odd[1:]]), (906, [float("inf"), *odd[1:]]), (None, odd), rows[3], rows[3]]
    df = spark.createDataFrame([(*v, 1, 2) for v in rows], "vec_id long, embedding array<float>, cluster int, of int").repartition(5)
    for k in (5, 200):
        got = sorted((tuple(y) for y in centroids.clustered(df, k=k, rounds=3).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)
        assert got == _clusters(rows, k, 3)
    assert centroids.clustered(df.limit(0)).count() == 0


def test_too_large_numbers_end_the_run(spark):
    df = spark.createDataFrame([(1, [600_000.0] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="beyond"):
        centroids.clustered(df).collect()


def test_bounds_screen_and_never_lie():
    r = np.random.default_rng(6)
    c = r.integers(-300, 300, (30, 64))
    x = c[r.integers(0, 30, 500)] + r.integers(-9, 9, (500, 64))
    x[:50] = np.repeat(c[:25], 2, 0)
    x[50:60] *= 400_000
    form = centroids.compressed(x)
    exact = ((x[:, None, :] - c) ** 2).sum(2)
    assert (centroids.bounds(form, centroids.compressed(c)) <= exact).all()
    best, dist, measured = centroids.nearest(x, form, c)
    assert (best == exact.argmin(1)).all() and (dist == exact.min(1)).all() and measured < 2 * len(x)

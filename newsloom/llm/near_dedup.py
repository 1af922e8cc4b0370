"""MinHash near-dedup by SuperMinHash (Ertl 2017): signatures, banding, verification on full sets, union-find.

1. Each text's distinct word shingles get a SuperMinHash signature: every element walks a random permutation of the
   slots, its j-th value lies in [j, j + 1), and a text stops at the first step at which no slot can still improve. The
   walk runs for all elements of many texts at once.
2. Texts with equal shingle sets are one node from here on (copies are never expanded).
3. Signatures are cut into bands; nodes that share a band key go to one candidate cluster (connected components).
   At a similarity of 0.85 a pair shares none of the 24 bands of 5 rows with probability 8e-7.
4. Clusters are verified in blocks of bounded total size: a cluster of g blocks is g(g+1)/2 tasks, each of which
   holds two blocks and finds the linked pairs through an inverted index on the rarest shingles first, skipping pairs that
   are already connected. Only a spanning forest leaves the task. No pair is dropped, capped or sampled.
5. Components of the verified links are the result.

Defined results: text null or without words has the empty set, is linked with nothing and is its own component; rows with
equal doc_id are apart but share what links them; doc_id null counts as no smallest; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import textops
from newsloom.llm._shared import components, drop_written, fresh, keep_rows, sha_of, ship, written

SHINGLE = 5
BANDS, ROWS = 24, 5
#: The pipeline's stage; a pair at its similarity shares none of its bands with probability 3e-6.
STAGE_SIMILARITY, STAGE_BANDS = Fraction(80, 100), 32
#: A cluster of n shingles has min(n / SMALL_BLOCK, SPREAD + n / BLOCK_SHINGLES) blocks: a block holds BLOCK_SHINGLES at most, about (a task holds
#: two of them, some 200 MB), and clusters of middling size are spread over more tasks. Each set goes to as many tasks as its cluster has blocks.
SMALL_BLOCK, SPREAD, BLOCK_SHINGLES = 50_000, 8, 1_000_000
U = np.uint64


def super_minhash(values: np.ndarray, counts: np.ndarray, m: int) -> np.ndarray:
    """values: distinct 64-bit elements, text after text; counts: how many each text has. Signatures, texts x m, as longs.

    A slot's value is kept as the integer (step << 32 | 32 random bits), so texts compare by whole numbers.
    """
    n = len(counts)
    out = np.full(n * m, np.iinfo(np.int64).max, np.int64)
    row = np.repeat(np.arange(n), counts)
    elem = values
    perm = None
    for j in range(m):
        if not len(elem):
            break
        bits = textops.mix(elem + U((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = j + ((bits & U(0xFFFFFFFF)) * U(m - j) >> U(32)).astype(np.int64)
        value = (np.int64(j) << 32) | (bits >> U(32)).astype(np.int64)
        if j == 0:
            slot = k
        else:
            here = np.arange(len(elem))
            slot = perm[here, k].astype(np.int64)
            perm[here, k] = perm[here, j]
            perm[here, j] = slot
        np.minimum.at(out, row * m + slot, value)
        # a text goes on while a slot's value could still fall below the next step's
        goes = out.reshape(n, m).max(1) >= (np.int64(j + 1) << 32)
        keep = goes[row]
        if j == 0:
            elem, row, first = elem[keep], row[keep], k[keep]
            perm = np.tile(np.arange(m, dtype=np.int8 if m < 128 else np.int16), (len(elem), 1))
            here = np.arange(len(elem))
            perm[here, first] = perm[here, 0]
            perm[here, 0] = first
        elif not keep.all():
            elem, row, perm = elem[keep], row[keep], perm[keep]
    return out.reshape(n, m)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each text and band."""
    s = signature.astype(U).reshape(-1, bands, rows)
    key = np.zeros(s.shape[:2], U)
    for i in range(rows):
        key = key * U(0xD6E8FEB86659FD93) + textops.mix(s[:, :, i])
    return textops.mix(key + np.arange(1, bands + 1, dtype=U) * U(0xA0761D6478BD642F))


def set_digests(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each text's set."""
    begin = np.cumsum(counts) - counts
    has = counts > 0
    out = []
    for salt in (0x8CB92BA72F3D8DD7, 0x2D358DCCAA6C78A5):
        d = np.zeros(len(counts), U)
        if has.any():
            d[has] = np.add.reduceat(textops.mix(values + U(salt)), begin[has])
        out.append(textops.mix(d + counts.astype(U)))
    return out[0], out[1]


def _sign(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sep = textops.separators("space")
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at, data, off in textops.passes(texts):
                g, per, _ = textops.gram_sets(data, off, sep, k)
                d1, d2 = set_digests(g, per)
                keys = np.zeros((len(per), bands), U)
                has = np.flatnonzero(per > 0)
                # texts of about 200,000 shingles at once: the permutations of 120 slots take 24 MB
                for part in np.array_split(has, max(1, int(per[has].sum()) // 200_000)) if len(has) else []:
                    mask = np.zeros(len(per), bool)
                    mask[part] = True
                    keys[part] = band_keys(super_minhash(g[np.repeat(mask, per)], per[part], bands * rows), bands, rows)
                counts = np.where(per > 0, bands, 0)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(per)), textops.longs(per), textops.longs(d1), textops.longs(d2), textops.long_lists(keys[per > 0].ravel(), counts)],
                    names=["doc_id", "n_shingles", "d1", "d2", "bands"],
                )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sep = textops.separators("space")
        for batch in batches:
            for _, data, off in textops.passes(batch.column(0)):
                g, per, _ = textops.gram_sets(data, off, sep, k)
                d1, d2 = set_digests(g, per)
                yield pa.RecordBatch.from_arrays([textops.longs(d1), textops.longs(d2), textops.long_lists(g, per)], names=["d1", "d2", "shingles"])

    return run


def linked(sets: list[np.ndarray], blocks: np.ndarray, similarity: Fraction) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets with |a & b| >= similarity * |a | b|, as positions.

    Of two different blocks only pairs across them are looked at. A linked pair has at least
    ceil(similarity * size) common elements, so both have one of their size - ceil(...) + 1 rarest
    elements in common; counting over the inverted index gives the exact intersections.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    _, ids, freq = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(freq), np.int64)
    rank[np.argsort(freq, kind="stable")] = np.arange(len(freq))
    ids = rank[ids]
    order = np.lexsort((ids, owner))
    ids = ids[order]
    begin = np.cumsum(sizes) - sizes
    num, den = similarity.numerator, similarity.denominator
    prefix = sizes - (-(-sizes * num // den)) + 1
    place = np.arange(len(ids)) - np.repeat(begin, sizes)
    in_prefix = place < np.repeat(prefix, sizes)

    def index(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by = np.argsort(ids[mask], kind="stable")
        return owner[mask][by], np.searchsorted(ids[mask][by], np.arange(len(freq) + 1))

    p_docs, p_at = index(in_prefix)
    f_docs, f_at = index(np.ones(len(ids), bool))
    parent = np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    comp = np.arange(n)  # each one's root, kept flat for whole-array tests
    both = len(np.unique(blocks)) > 1
    out = []
    for x in range(n):
        mine = ids[begin[x] : begin[x] + sizes[x]]
        near = np.concatenate([p_docs[p_at[t] : p_at[t + 1]] for t in mine[: prefix[x]]])
        near = near[(comp[near] != comp[x]) & (near > x)]
        if both:
            near = near[blocks[near] != blocks[x]]
        if not len(near):
            continue
        near = np.unique(near)
        near = near[(sizes[near] * den >= sizes[x] * num) & (sizes[x] * den >= sizes[near] * num)]
        if not len(near):
            continue
        if len(near) > 4:
            common = np.bincount(np.concatenate([f_docs[f_at[t] : f_at[t + 1]] for t in mine]), minlength=n)[near]
        else:
            own = sets[x]
            common = np.array([np.count_nonzero(np.isin(sets[y], own, assume_unique=True)) for y in near])
        for y in near[common * den >= num * (sizes[x] + sizes[near] - common)]:
            a, b = root(x), root(int(y))
            if a != b:
                lo, hi = min(a, b), max(a, b)
                parent[hi] = lo
                comp[comp == hi] = lo
                out.append((x, int(y)))
    return out


def _verify(similarity: Fraction):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        lists = group.column("shingles").combine_chunks()
        at = lists.offsets.to_numpy()
        flat = lists.values.to_numpy(zero_copy_only=False)
        sets = [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        nodes = group.column("node").to_numpy()
        pairs = linked(sets, group.column("block").to_numpy(), similarity)
        return pa.table({"a": pa.array([nodes[i] for i, _ in pairs], pa.int64()), "b": pa.array([nodes[j] for _, j in pairs], pa.int64())})

    return run


def near_groups(docs: DataFrame, k: int = SHINGLE, similarity: Fraction = Fraction(85, 100), bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_shingles, component_id, kept, root (a component's number), d1, d2 (its set's digest)."""
    spark = docs.sparkSession
    ship(spark)
    t = docs.select("doc_id", "text")
    id_type = t.schema["doc_id"].dataType.simpleString()
    signed = written(t.mapInArrow(_sign(k, bands, rows), f"doc_id {id_type}, n_shingles long, d1 long, d2 long, bands array<long>"), "signatures")
    some = signed.where("n_shingles > 0")
    nodes = some.groupBy("d1", "d2").agg(F.min("doc_id").alias("low"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    member = nodes.select("node", F.explode("bands").alias("key"))
    lead = member.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("top")).where("top > b").select("key", "b")
    near = member.join(lead, "key").where("node <> b").select(F.col("node").alias("a"), "b")
    cluster = written(components(near, "clusters"), "cluster")

    sized = nodes.select("node", "d1", "d2", "low", "n").join(cluster, "node")
    g = sized.groupBy("root").agg(F.ceil(F.least(F.sum("n") / SMALL_BLOCK, SPREAD + F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("g"))
    sized = written(sized.join(g, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("g")).cast("int")), "blocks")
    # the whole sets of clustered nodes, read again from the texts
    want = sized.select(F.col("low").alias("_low"), F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), "node", "root", "block", "g")
    texts = t.join(want.select("_low").distinct(), F.col("doc_id").eqNullSafe(F.col("_low")), "left_semi").select("text")
    sets = texts.mapInArrow(_sets(k), "d1 long, d2 long, shingles array<long>").where("size(shingles) > 0")
    sets = sets.join(want, (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2"))).dropDuplicates(["node"])
    other = F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("o")
    pairs = sets.select("root", "node", "block", "shingles", other)
    pairs = pairs.select("root", F.least("block", "o").alias("p"), F.greatest("block", "o").alias("q"), "node", "block", "shingles")
    links = pairs.groupBy("root", "p", "q").applyInArrow(_verify(similarity), "a long, b long")
    final = components(links, "links")

    node = nodes.select("node", "d1", "d2", "low").join(final, "node", "left").withColumn("root", F.coalesce("root", "node"))
    low = node.groupBy("root").agg(F.min("low").alias("component_id"))
    node = written(node.join(low, "root").select("d1", "d2", "root", "component_id"), "components")
    out = signed.drop("bands").join(node, ["d1", "d2"], "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    for x in (cluster, sized):
        drop_written(x)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "root", "d1", "d2")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_groups(docs).select("doc_id", "n_shingles", "component_id", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, similarity: Fraction = Fraction(85, 100), bands: int = BANDS) -> DataFrame:
    """Of each group of near duplicates (on five-word shingles) the smallest doc_id stays."""
    if not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():  # doc_id alone doesn't name a row
        named = docs.select(F.struct("doc_id", sha_of(F.col("text")).alias("sha")).alias("doc_id"), "text")
        return keep_rows(docs, near_groups(named, similarity=similarity, bands=bands).where("kept").select("doc_id.doc_id", "doc_id.sha"), single=True)
    (i,) = fresh(docs.columns, "key_id")
    kept = near_groups(docs, similarity=similarity, bands=bands).where("kept").select(F.col("doc_id").alias(i))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(i)), "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def pipeline_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: stage() at a similarity of 0.8."""
    return stage(spark, docs, sf_dir, STAGE_SIMILARITY, STAGE_BANDS)

"""Similarity self-joins: TF-IDF cosine by blocks of rows, containment and Jaccard by inverted indexes with prefix filters.

Items are numbers, and those that one id alone has are only counted. A pair above the threshold shares an item among those that come first in the
order of rarity, so only these are looked up; frequent items (a link of very many rows) come last and are rarely anybody's prefix.
Each row of the index holds its whole set, so a pair is measured where it meets, at its first common item and nowhere else: candidates are
neither gathered nor dealt. Jaccard compares profiles instead of ids, as many ids may have the same. Results are those of comparing every pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.tables import written

#: Ids of an item that one task looks up; an item of more is dealt over several.
HOT = 2_000
#: Rows (and 32 terms each) of a block: so few that small tables are dealt too, with SPREAD blocks at least so many.
SMALL_BLOCK, SPREAD, BLOCK = 2_000, 6, 16_000
#: Products, and cells of sums, that a task holds at once.
CELLS = 4_000_000


def tfidf(docs: DataFrame) -> DataFrame:
    """docs (id, text): rows (id, term, w) of raw tf, idf = ln((1 + n) / (1 + df)) + 1, L2-normalised. Terms: two word characters or more. A text may come in several rows of its id."""
    n = docs.select("id").distinct().count()
    terms = docs.select("id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))).alias("term"))
    tf = terms.groupBy("id", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    raw = tf.join(df, "term").withColumn("raw", F.col("tf") * (F.ln(F.lit(1.0 + n) / (1 + F.col("df"))) + 1))
    norm = Window.partitionBy("id")
    return raw.select("id", "term", "df", (F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(norm))).alias("w"))


def _sums(left: tuple, right: tuple, same: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of left, row of right, sum of products of equal codes) of at least `least`, of (row, code, weight) sorted by row; same: right is left, and of each pair of rows one order is taken."""
    row, code, w = left
    order = np.argsort(right[1], kind="stable")
    codes, rows, ws = right[1][order], right[0][order], right[2][order]
    if not len(row) or not len(rows):
        return
    hi = np.searchsorted(codes, code, "right")
    if same:
        lo = np.empty(len(order), np.int64)
        lo[order] = np.arange(1, len(order) + 1)  # rows of a code stand in order
    else:
        lo = np.searchsorted(codes, code, "left")
    n, width = hi - lo, int(right[0][-1]) + 1
    cut = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1], [True]]))
    upto = np.concatenate([[0], np.cumsum(n)])[cut]
    at, most = 0, max(1, CELLS // width)
    while at < len(cut) - 1:
        end = min(max(at + 1, int(np.searchsorted(upto, upto[at] + CELLS, "right")) - 1), at + most, len(cut) - 1)
        a, b = cut[at], cut[end]
        of = np.repeat(np.arange(a, b), n[a:b])
        to = np.arange(len(of)) + np.repeat(lo[a:b] - np.cumsum(n[a:b]) + n[a:b], n[a:b])
        first = row[a]
        total = np.bincount((row[of] - first) * width + rows[to], w[of] * ws[to], minlength=1)
        hit = np.flatnonzero(total >= least)
        yield hit // width + first, hit % width, total[hit]
        at = end


def _vectors(t: pa.Table) -> tuple[pa.Array, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    v = t["v"].combine_chunks()
    flat = v.flatten()
    code, w = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(2))
    return t["id"].combine_chunks(), (np.repeat(np.arange(len(v)), np.diff(v.offsets.to_numpy())), code, w)


def cosine_pairs(weights: DataFrame, threshold: float) -> DataFrame:
    """weights as tfidf() gives them: (i, j, sim) with i < j and sim >= threshold > 0.

    Rows are dealt into blocks; a task takes two of them and sums products term by term, so what it holds is bounded by the blocks, whatever number of pairs there is.
    """
    spark = weights.sparkSession
    met = weights.where("df > 1")  # what one row alone has adds to no pair
    codes = written(met.select("term").distinct().withColumn("code", F.monotonically_increasing_id()), "terms")
    rows = written(met.join(codes, "term").groupBy("id").agg(F.collect_list(F.struct("code", "w")).alias("v")), "vectors")
    size = rows.agg(F.greatest(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0)) / 32)).first()[0]
    g = max(1, int(np.ceil(min(size / SMALL_BLOCK, SPREAD + size / BLOCK))))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(g)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(g - 1))))
    dealt = dealt.select(F.least("block", "o").alias("bp"), F.greatest("block", "o").alias("bq"), "id", "block", "v")
    # in full number: the tasks have few bytes and much work, and Spark would put them together
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bp", "bq")
    kind = rows.schema["id"].dataType.simpleString()

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        bp, bq, block = (t[c].to_numpy() for c in ("bp", "bq", "block"))
        same = bp[0] == bq[0]
        one, left = _vectors(t.filter(pa.array(block == bp[0])))
        other, right = (one, left) if same else _vectors(t.filter(pa.array(block == bq[0])))
        for i, j, s in _sums(left, right, same, threshold - 1e-9):
            yield pa.RecordBatch.from_arrays([one.take(pa.array(i)), other.take(pa.array(j)), pa.array(s)], names=["i", "j", "sim"])

    out = dealt.groupBy("bp", "bq").applyInArrow(measured, f"i {kind}, j {kind}, sim double")
    out = out.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.round("sim", 12).alias("sim"))
    return out.where(F.col("sim") >= threshold)


def coded(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members (id, item): rows (id, item, n) of the items that two ids or more have, as numbers, n the id's size with its other items; and (id, n) of every id."""
    m = written(members.where("item is not null").select("id", "item").distinct(), "members")
    n = written(m.groupBy("id").agg(F.count("*").alias("n")), "sizes")
    shared = m.groupBy("item").agg(F.count("*").alias("k")).where("k > 1").select("item", F.monotonically_increasing_id().alias("code"))
    rows = m.join(written(shared, "items"), "item").select("id", F.col("code").alias("item"))
    return written(rows.join(n, "id"), "coded"), n


def ranked_items(rows: DataFrame) -> DataFrame:
    """rows (id, item, n) as coded() gives them, or a part of the ids: with the item's frequency, at least 2, and its place among all of the id's items (rarest first)."""
    m = rows.join(rows.groupBy("item").agg(F.count("*").alias("freq")), "item").where("freq > 1")
    own = Window.partitionBy("id")
    rare = F.col("n") - F.count("*").over(own)  # what nobody else has comes before
    return m.withColumn("place", rare + F.row_number().over(own.orderBy("freq", "item")))


def prefix_places(size: str, threshold: float) -> Column:
    """Rarest items of a set of that size among which any other set with the threshold's part of it has one."""
    return F.col(size) - F.ceil(F.col(size) * threshold) + 1


def common_items(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """pairs (i, j) with ni, nj and common."""
    a = left.select(F.col("id").alias("i"), "item", F.col("n").alias("ni"))
    b = right.select(F.col("id").alias("j"), "item", F.col("n").alias("nj"))
    return pairs.join(a, "i").join(b, ["j", "item"]).groupBy("i", "j", "ni", "nj").agg(F.count("*").alias("common"))


def _index(rows: DataFrame) -> DataFrame:
    """(id, n, items, item, freq, place): a row for each item, with the id's whole set in the order of rarity."""
    sets = ranked_items(rows).groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("place", "item", "freq"))).alias("s"))
    sets = written(sets, "sets")
    return sets.select("id", "n", F.col("s.item").alias("items"), F.explode("s").alias("x")).select("id", "n", "items", "x.item", "x.freq", "x.place")


def _met(left: DataFrame, right: DataFrame, when: Column) -> DataFrame:
    """Rows (a, b, an, bn, common) of two indexes that meet at their first common item, of those pairs for which `when` holds; columns of the left one begin with a, of the right one with b. Items of very many ids are dealt over several tasks."""
    parts = F.ceil(F.col("freq") / HOT).cast("int")
    a = left.select("item", F.pmod(F.xxhash64("id"), parts).cast("int").alias("salt"), F.col("id").alias("a"), F.col("n").alias("an"), F.col("items").alias("a_items"))
    b = right.select("item", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"), F.col("id").alias("b"), F.col("n").alias("bn"), F.col("items").alias("b_items"))
    # in full number: few bytes may hold very many pairs, and Spark would put such tasks together
    k = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = a.repartition(k, "item", "salt").join(b.repartition(k, "item", "salt"), ["item", "salt"])
    both = both.where(when).withColumn("c", F.array_intersect("a_items", "b_items"))
    return both.where(F.element_at("c", 1) == F.col("item")).select("a", "b", "an", "bn", F.size("c").cast("long").alias("common"))


def containment_pairs(members: DataFrame, threshold: float = 0.5) -> DataFrame:
    """members (id, item): (i, j, common, containment) with i < j and common / smaller size >= threshold > 0."""
    s = _index(coded(members)[0])
    smaller = F.expr("an < bn or an = bn and a < b")
    out = _met(s.where(F.col("place") <= prefix_places("n", threshold)), s, smaller).withColumn("containment", F.col("common") / F.col("an"))
    return out.where(F.col("containment") >= threshold).select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "common", "containment")


def jaccard_profiles(current: DataFrame, previous: DataFrame, threshold: float = 0.4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two tables (id, item): (p, q, common, score) of profiles with common / union >= threshold > 0, and their ids (p, i) of current and (q, j) of previous.

    An id's profile is its size and those of its items that both tables have: the other items only count, so ids of a table with equal profiles have the same
    pairs with the same scores. Copies, and sets that differ in what the other table hasn't, are one profile; the pairs of ids are never made here.
    """
    ti, tj = current.schema["id"].dataType, previous.schema["id"].dataType
    left = current.select(F.struct(F.lit(0).alias("side"), F.col("id").alias("i"), F.lit(None).cast(tj).alias("j")).alias("id"), "item").where("id.i is not null")
    right = previous.select(F.struct(F.lit(1).alias("side"), F.lit(None).cast(ti).alias("i"), F.col("id").alias("j")).alias("id"), "item").where("id.j is not null")
    m = written(left.unionByName(right).where("item is not null").distinct(), "members")
    both = m.groupBy("item").agg(F.min("id.side").alias("lo"), F.max("id.side").alias("hi")).where("lo < hi")
    both = written(both.select("item", F.monotonically_increasing_id().alias("code")), "items")
    sets = m.join(both, "item", "left").groupBy("id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("code")).alias("items"))
    # what an id has in common with any other is among these items
    sets = written(sets.where((F.size("items") > 0) & (F.size("items") >= threshold * F.col("n") - 1e-9)).withColumn("side", F.col("id.side")), "sets")
    profiles = written(sets.select("side", "n", "items").distinct().withColumn("profile", F.monotonically_increasing_id()), "profiles")
    ids = written(sets.join(profiles, ["side", "n", "items"]).select("profile", "id"), "profiled")
    s = _index(profiles.select(F.struct("side", "profile").alias("id"), F.explode("items").alias("item"), "n"))
    s = s.where(F.col("place") <= prefix_places("n", threshold))
    out = _met(s.where("id.side = 0"), s.where("id.side = 1"), F.least("an", "bn") >= threshold * F.greatest("an", "bn"))
    out = out.withColumn("score", F.col("common") / (F.col("an") + F.col("bn") - F.col("common"))).where(F.col("score") >= threshold)
    pairs = out.select(F.col("a.profile").alias("p"), F.col("b.profile").alias("q"), "common", "score")
    own = lambda side, c, to: ids.where(F.col("id.side") == side).select(F.col("profile").alias(to), F.col(f"id.{c}").alias(c))
    return written(pairs, "profile_pairs"), own(0, "i", "p"), own(1, "j", "q")


def jaccard_pairs(current: DataFrame, previous: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Two tables (id, item): (i, j, common, score) with i of current, j of previous, common / union >= threshold > 0."""
    pairs, left, right = jaccard_profiles(current, previous, threshold)
    a = written(pairs.join(left, "p").select("q", "i", "common", "score"), "half_pairs")
    # a profile of previous that very many ids meet is dealt over several tasks
    parts = written(a.groupBy("q").agg(F.ceil(F.count("*") / HOT).cast("int").alias("parts")), "parts")
    a = a.join(parts, "q").withColumn("salt", F.pmod(F.xxhash64("i"), F.col("parts")).cast("int"))
    b = right.join(parts, "q").select("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), "j")
    # in full number: few bytes may hold very many pairs, and Spark would put such tasks together
    k = int(current.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return a.repartition(k, "q", "salt").join(b.repartition(k, "q", "salt"), ["q", "salt"]).select("i", "j", "common", "score")

"""Benchmark decontamination by a broadcast hash set of n-grams, with DataFrame functions alone.

Every item is lower-cased (A-Z) and cut into windows of WINDOW consecutive words (a shorter item is one window). The
distinct windows' hashes are broadcast behind a check of their number; beyond it they are joined by
shuffle. Each document row hashes all its own windows, the join keeps those whose hash is in the set, and
the window's words are compared before a hit counts. What leaves a scan task is one row per document and one per hit.

Defined results: text null has no words; items without words are ignored; repeated items count by distinct item_id;
rows with equal doc_id are kept apart; further columns are ignored; an empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm._shared import ascii_lower, keep_rows, sha_of, written

WINDOW = 10
#: Distinct windows (about 200 bytes each) up to which the set is broadcast.
BROADCAST_WINDOWS = 250_000


def words_of(text: Column) -> Column:
    """[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased; null: none."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_remove(parts, "")


def _windows(words: Column, size: int) -> Column:
    """(k, at, h): size, position and hash of every window of size words."""
    at = F.sequence(F.lit(1), F.size(words) - size + 1)
    each = F.transform(at, lambda i: F.struct(F.lit(size).alias("k"), i.alias("at"), F.xxhash64(F.slice(words, i, size)).alias("h")))
    return F.when(F.size(words) >= size, each).otherwise(F.array().cast("array<struct<k:int,at:int,h:bigint>>"))


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """items (item_id, text): distinct windows as (k words, h hash, gram, items)."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words")).where("size(words) > 0")
    w = w.withColumn("k", F.least(F.size("words"), F.lit(size)))
    at = F.sequence(F.lit(1), F.size("words") - F.col("k") + 1)
    w = w.select("item", "k", F.explode(F.transform(at, lambda i: F.slice("words", i, F.col("k")))).alias("gram"))
    return w.groupBy("k", F.xxhash64("gram").alias("h"), "gram").agg(F.collect_set("item").alias("items"))


def hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text): rid, doc_id, n_words, spans (sorted (at, k), from 1), item_ids (sorted)."""
    windows = written(windows, "windows")
    sizes = sorted(r[0] for r in windows.select("k").distinct().collect())  # WINDOW numbers at most
    small = windows.count() <= BROADCAST_WINDOWS
    set_ = windows.select(F.col("k").alias("_k"), F.col("h").alias("_h"), "gram", "items")
    d = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", words_of(F.col("text")).alias("words"))
    # the first entry stands for the document itself
    probes = [F.array(F.struct(F.lit(0).alias("k"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("h")))]
    probes += [_windows(F.col("words"), k) for k in sizes]
    d = d.withColumn("probes", F.concat(*probes) if len(probes) > 1 else probes[0])
    d = d.select("rid", "doc_id", F.size("words").alias("n_words"), "words", F.explode_outer("probes").alias("p"))
    d = d.select("rid", "doc_id", "n_words", "words", "p.k", "p.at", "p.h")
    same = (F.col("h") == F.col("_h")) & (F.col("k") == F.col("_k"))
    if small:
        d = d.join(F.broadcast(set_), same, "left").where("k = 0 or (gram is not null and slice(words, at, k) = gram)")
    else:  # what is shuffled of each window is its own words
        own = d.where("k = 0").select("*", F.lit(None).cast("array<string>").alias("gram"), F.lit(None).cast("array<string>").alias("items"))
        met = d.where("k > 0").withColumn("words", F.slice("words", "at", "k"))
        met = met.join(set_, same & (F.col("words") == F.col("gram"))).drop("_k", "_h")
        d = own.unionByName(met)
    d = d.groupBy("rid", "doc_id", "n_words").agg(
        F.sort_array(F.collect_set(F.when(F.col("k") > 0, F.struct("at", "k")))).alias("spans"),
        F.collect_set(F.when(F.col("k") > 0, F.col("items"))).alias("item_sets"),
    )
    return d.select("rid", "doc_id", "n_words", "spans", F.sort_array(F.array_distinct(F.flatten("item_sets"))).alias("item_ids"))


def covered(spans: Column) -> Column:
    """Words inside any of the sorted spans (at, k)."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, x: Column) -> Column:
        end = x["at"] + x["k"]
        more = F.greatest(end - F.greatest(acc["upto"], x["at"]), F.lit(0))
        return F.struct(F.greatest(acc["upto"], end).alias("upto"), (acc["n"] + more).alias("n"))

    return F.aggregate(spans, start, add, lambda acc: acc["n"])


def decontaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """For each row of docs: rid, doc_id, n_words, n_hit, item_ids, spans, contaminated."""
    h = hits(docs, item_windows(items, size))
    return h.withColumn("n_hit", covered(F.col("spans"))).withColumn("contaminated", F.col("n_hit") > 0)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminated(docs, items).select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


OP3_SQL = r"""
WITH ascii AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
it AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark, ascii),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM it, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS s(i) WHERE len(w) > 0),
grams AS (SELECT k, g, list(DISTINCT item_id) AS items FROM win GROUP BY k, g),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents, ascii),
place AS (SELECT rid, w, unnest(generate_series(1, len(w))) AS i FROM d),
met AS (
  SELECT rid, i, z.k, items FROM (SELECT rid, i, k, array_to_string(w[i : i + k - 1], ' ') AS g, len(w) AS n
    FROM place, (SELECT DISTINCT k FROM grams) WHERE i + k - 1 <= len(w)) z JOIN grams USING (k, g)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + k - 1)) AS p FROM met) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS l FROM (SELECT DISTINCT rid, unnest(items) AS x FROM met) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids.l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN ids USING (rid)
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents with any hit go; rows that share doc_id and text share their fate."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    d = docs.select(F.struct("doc_id", sha_of(F.col("text")).alias("sha")).alias("doc_id"), "text")
    bad = decontaminated(d, items).where("contaminated").select("doc_id.doc_id", "doc_id.sha")
    return keep_rows(docs, bad, "left_anti")

"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions alone.

Sizes are summed by source and hash bucket (1,024 buckets), the buckets' running sums give the bucket at which a
source's budget ends, only that bucket is split by the next ten bits of the hash, and only what is left of it (a
millionth of a source) by the whole hash. A row is then taken by comparing its hash with its source's
threshold: nothing is sorted but sums, and a source of a third of all rows is one row per task and bucket.

A document's hash is 60 bits of md5 over the seed and doc_id, so reruns agree, and a larger budget takes a superset.

Defined results: text null has size 0; source null is a source of its own, last in order; rows with equal doc_id
share a hash and are taken together; a source of size 0 takes nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm._shared import fresh, written

WEIGHTS = (5, 2, 1)
#: A source is repeated this often at most.
REPEATS = 3
#: Sources up to which the table of thresholds (one row of about 60 bytes each) is broadcast; beyond it joins by shuffle.
BROADCAST_SOURCES = 20_000


def words_of(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text; null: 0."""
    parts = F.split(text, r"[\x20\x09-\x0D]+")
    empty = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.coalesce(F.size(parts) - empty, F.lit(0)).cast("long")


def hash_of(doc_id: Column, seed: str) -> Column:
    """60 bits of md5, as a long."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """sizes: (source, source_size), a row for each source. Adds target: shares by weight, stopped at repeats x size.

    Sources are stopped in order of size / weight, so those stopped are a prefix of that order and one pass of
    running sums finds where it ends. The window runs over one row per source, not over documents.
    """
    n = len(weights)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (rank % n + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * repeats)
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    s = s.withColumn("open", F.col("cap") * F.col("w_left") > F.col("left") * F.col("w"))
    # the first source that isn't stopped has the sums that all later ones share by
    s = s.withColumn("at", F.max(F.when(F.col("open"), F.struct("w_left", "left"))).over(everything))
    share = F.col("at.left").cast("double") * F.col("w") / F.col("at.w_left")
    return s.select("source", "source_size", F.when(F.col("open"), share).otherwise(F.col("cap").cast("double")).alias("target"))


def _boundary(hist: DataFrame) -> DataFrame:
    """hist: (source, rest, b, size). For each source, the bucket in which rest is reached and what is left of rest there."""
    running = Window.partitionBy("source").orderBy("b")
    h = hist.withColumn("upto", F.sum("size").over(running))
    h = h.where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("size") < F.col("rest")))
    return h.select("source", F.col("b"), (F.col("rest") - (F.col("upto") - F.col("size"))).alias("rest"))


def _same(a: DataFrame, b: DataFrame, how: str, small: bool) -> DataFrame:
    """a joined with b by source, null with null; b has a row for each source."""
    b = b.withColumnRenamed("source", "_source")
    if small:
        b = F.broadcast(b)
    return a.join(b, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def mixed(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: str = "mix") -> DataFrame:
    """docs: (doc_id, source, text). Rows (doc_id, source, h, size, source_size, target, copies, taken)."""
    base = docs.select("doc_id", "source", (words_of(F.col("text")) if size is None else size.cast("long")).alias("size"), hash_of(F.col("doc_id"), seed).alias("h"))
    base = written(base, "sizes")
    hist = written(base.groupBy("source", F.shiftright("h", 50).alias("b")).agg(F.sum("size").alias("size")), "histogram")
    per = targets(hist.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats)
    whole = F.floor(F.col("target") / F.col("source_size"))
    per = per.withColumn("full", F.coalesce(F.least(whole, F.lit(repeats)), F.lit(0)).cast("int"))
    per = written(per.withColumn("rest", F.col("target") - F.col("full") * F.col("source_size")), "targets")
    small = per.count() <= BROADCAST_SOURCES

    open_ = per.where("rest > 0").select("source", "rest")
    first = _boundary(_same(hist, open_, "inner", small))
    first = written(first.withColumnRenamed("b", "b1").withColumnRenamed("rest", "rest1"), "boundary")
    inside = _same(base, first, "inner", small).where("shiftright(h, 50) = b1")
    fine = inside.groupBy("source", F.col("rest1").alias("rest"), F.shiftright("h", 40).alias("b")).agg(F.sum("size").alias("size"))
    second = _boundary(fine)
    second = written(second.withColumnRenamed("b", "b2").withColumnRenamed("rest", "rest2"), "boundary")
    left = _same(base, second, "inner", small).where("shiftright(h, 40) = b2")
    left = left.groupBy("source", F.col("rest2").alias("rest"), F.col("h").alias("b")).agg(F.sum("size").alias("size"))
    running = Window.partitionBy("source").orderBy("b")
    # of the last hash, the side of its documents that comes nearer to the budget
    last = left.withColumn("upto", F.sum("size").over(running)).where(F.col("upto") - F.col("size") < F.col("rest"))
    last = last.where((F.col("upto") <= F.col("rest")) | (F.col("upto") - F.col("rest") < F.col("rest") - (F.col("upto") - F.col("size"))))
    last = last.groupBy("source").agg(F.max("b").alias("last"))
    edge = second.withColumnRenamed("source", "_s2").join(last, F.col("_s2").eqNullSafe(F.col("source")), "left").select(
        F.col("_s2").alias("source"), F.coalesce("last", F.shiftleft("b2", 40) - 1).alias("threshold")
    )
    per = _same(per, edge, "left", small).select("source", "source_size", "target", "full", F.coalesce("threshold", F.lit(-1)).alias("threshold"))
    per = written(per, "thresholds")
    out = _same(base, per, "inner", small)
    out = out.withColumn("copies", F.col("full") + F.when(F.col("h") <= F.col("threshold"), 1).otherwise(0))
    return out.select("doc_id", "source", "h", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS w
  FROM sized GROUP BY source),
water AS (
  SELECT *, source_size * 3 AS cap,
         sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER o, 0) AS rest_size,
         sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS rest_w
  FROM per WINDOW o AS (ORDER BY source_size * 3 / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
opened AS (SELECT *, cap * rest_w > rest_size * w AS is_open FROM water),
edge AS (SELECT rest_size, rest_w FROM opened WHERE is_open ORDER BY rest_w DESC LIMIT 1),
aim AS (
  SELECT o.source, o.source_size,
         CASE WHEN is_open THEN CAST(e.rest_size AS DOUBLE) * w / CAST(e.rest_w AS DOUBLE) ELSE CAST(cap AS DOUBLE) END AS target
  FROM opened o LEFT JOIN edge e ON true),
budget AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(CAST(floor(target / source_size) AS BIGINT), 3) END AS whole FROM aim),
by_hash AS (SELECT source, h, sum(size) AS size FROM sized GROUP BY source, h),
ran AS (
  SELECT b.source, b.h, b.size, sum(b.size) OVER (PARTITION BY b.source ORDER BY b.h) AS upto, t.target - t.whole * t.source_size AS rest
  FROM by_hash b JOIN budget t ON b.source IS NOT DISTINCT FROM t.source),
hit AS (
  SELECT source, max(h) AS last FROM ran
  WHERE rest > 0 AND upto - size < rest AND (upto <= rest OR upto - rest < rest - (upto - size)) GROUP BY source)
SELECT s.doc_id, s.size, t.source_size, t.target,
       CAST(s.size * (t.whole + CASE WHEN s.h <= coalesce(x.last, -1) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN budget t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN hit x ON s.source IS NOT DISTINCT FROM x.source
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline, last: the rows of docs that the mix takes, with copies (how often) and taken (words).

    The mix is by (source, doc_id), so rows that repeat a doc_id within a source are decided alike. Columns of docs that are themselves called copies
    or taken are replaced by these.
    """
    i, s = fresh([*docs.columns, "copies", "taken"], "key_id", "key_source")
    mix = mixed(docs.select("doc_id", "source", "text")).where("copies > 0")
    mix = mix.select(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("copies").alias("copies")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(i)) & F.col("source").eqNullSafe(F.col(s))
    cols = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("copies", "taken")]
    return docs.select(*cols).join(mix, same).select(*cols, "copies", (words_of(F.col("text")) * F.col("copies")).alias("taken"))

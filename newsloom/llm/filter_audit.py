"""Interaction of filters by a subset-zeta transform, with DataFrame functions alone.

Each document is reduced to a mask: bit i is set if it fails filter i. Rows are counted by (part, mask), with the labelled ones among
them; a part's 32 counts become an array, and five steps of the subset-zeta transform (one a bit) turn counts of masks into
counts of documents whose mask lies inside a set of bits. Survivors of a set of filters are those whose mask lies inside its
complement, so every order's steps are differences of neighbouring subsets: nothing is filtered 120 times.

Four filters look at a text alone; the fifth (a copy of a smaller doc_id's text) needs the smallest doc_id of each text. Rows are
first counted by (text, doc_id, part, labels), where repeats collapse before they are shuffled, and the smallest doc_id of a text is joined
back by (text, doc_id), so a text that a third of the rows hold is no hot key. Texts stand there as their 256-bit SHA-2 digest.

Defined results: text null is empty (it has no words: it fails A and holds nothing else); source null is part '', together with the empty
source; a doc_id of null is neither smaller nor larger than another, so such a row is no copy and makes none; rows that repeat doc_id and text aren't
copies of each other; a doc_id with several label rows counts as labelled if one of them says so; labels of unknown or null doc_ids and
label values other than 1 count for nothing; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm._shared import UPPER, drop_written, written

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: Null doc_ids have no partner in a join by doc_id: they are dealt to so many keys of their own.
SALTS = 4096


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: under 200 words; under half of them distinct; over 2 % of A-Z; a character of #$%&*|."""
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    capitals = F.length(t) - F.length(F.translate(t, UPPER, ""))
    fails = [n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals > 2 * F.length(t), t.rlike(r"[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, source, text), labels (doc_id, quality, toxic): rows (part, mask, n, good, toxic), one for each part and mask."""
    base = docs.select(
        F.col("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("sha"), text_mask(F.col("text")).alias("mask")
    )
    rows = base.groupBy("doc_id", "sha", "part", "mask").agg(F.count("*").alias("n"))
    rows = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.xxhash64("sha", "part"), F.lit(SALTS))).otherwise(0))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic")
    )
    marks = marks.select(F.col("doc_id").alias("of"), F.lit(0).cast("long").alias("of_salt"), "good", "toxic")
    rows = rows.join(marks, (F.col("doc_id") == F.col("of")) & (F.col("salt") == F.col("of_salt")), "left").drop("of", "of_salt", "salt")
    rows = written(rows.fillna(0, ["good", "toxic"]), "masks")
    first = rows.where("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("first")).select(F.col("sha").alias("of"), "first")
    kept = rows.join(first, (F.col("sha") == F.col("of")) & (F.col("doc_id") == F.col("first")), "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    out = kept.groupBy("part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask")).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )
    out = written(out, "mask_counts")
    drop_written(rows)
    return out


def survivors(counts: DataFrame) -> DataFrame:
    """counts of masks(): a row a part with arrays n, good, toxic (by subset of filters: how many documents fail none of it) and alone (by filter: how many fail it only)."""
    sums = [F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for c in ("n", "good", "toxic") for m in range(SUBSETS)]
    wide = counts.groupBy("part").agg(*[F.array(*sums[k * SUBSETS : (k + 1) * SUBSETS]).alias(c) for k, c in enumerate(("n", "good", "toxic"))])
    wide = wide.withColumn("alone", F.array(*[F.get("n", F.lit(1 << i)) for i in range(len(FILTERS))]))
    for b in range(len(FILTERS)):  # a projection a bit: the steps stay small expressions
        i = F.sequence(F.lit(0), F.lit(SUBSETS - 1))
        step = lambda c, b=b: F.transform(i, lambda s: F.get(c, s) + F.when(F.getbit(s, F.lit(b)) == 1, F.get(c, s - (1 << b))).otherwise(F.lit(0).cast("long")))
        wide = wide.select("part", *[step(F.col(c)).alias(c) for c in ("n", "good", "toxic")], "alone")
    return wide.select("part", *[F.reverse(c).alias(c) for c in ("n", "good", "toxic")], "alone")  # inside the complement of a set: from the other end


def orders(wide: DataFrame) -> DataFrame:
    """survivors() unfolded: a row for each part, order of the filters and step."""
    out = wide.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])))
    out = out.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = lambda k: F.instr(F.lit(FILTERS), F.substring("filter_order", k, 1)) - 1
    bit = lambda k: F.element_at(F.array(*[F.lit(1 << i) for i in range(len(FILTERS))]), place(k) + 1)
    earlier = sum((F.when(F.col("step") > k, bit(k)).otherwise(0) for k in range(1, len(FILTERS))), F.lit(0))
    at = F.instr(F.lit(FILTERS), F.expr("substring(filter_order, step, 1)"))
    out = out.withColumn("at", at).withColumn("before", earlier)
    out = out.withColumn("after", F.col("before") + F.element_at(F.array(*[F.lit(1 << i) for i in range(len(FILTERS))]), F.col("at")))
    gone = lambda c: F.get(c, F.col("before")) - F.get(c, F.col("after"))
    fails = F.get("n", F.lit(0)) - F.get("n", F.element_at(F.array(*[F.lit(1 << i) for i in range(len(FILTERS))]), F.col("at")))
    return out.select(
        "part", "filter_order", "step", F.get("n", F.col("after")).alias("kept"), gone("n").alias("removed"), (fails - gone("n")).alias("redundant"),
        F.element_at("alone", F.col("at")).alias("unique_fails"), gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), _shapley().alias("shapley"),
    )


def _shapley() -> Column:
    """What the step's filter removes, summed over all orders: each subset before it counts by its orders, and those behind it by theirs."""
    n = len(FILTERS)
    fact = [1, 1, 2, 6, 24, 120]
    by_filter = []
    for i in range(n):
        terms = [(s, fact[s.bit_count()] * fact[n - 1 - s.bit_count()]) for s in range(SUBSETS) if not s >> i & 1]
        by_filter.append(sum(((F.get("n", F.lit(s)) - F.get("n", F.lit(s | 1 << i))) * w for s, w in terms), F.lit(0).cast("long")))
    return F.element_at(F.array(*by_filter), F.col("at"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, source, text), labels (doc_id, quality, toxic). A row for each part, order and step, as told in op11's columns."""
    return orders(survivors(masks(docs, labels)))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return audit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic"))


OP11_SQL = r"""
WITH marked AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
worded AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
failing AS (
  SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
         len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS e
  FROM worded d LEFT JOIN marked m ON d.doc_id = m.doc_id),
masked AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM failing GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS bit),
ordered AS (
  SELECT p.l || q.l || r.l || s.l || t.l AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
  FROM letters p, letters q, letters r, letters s, letters t
  WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31 AND p.bit | q.bit | r.bit | s.bit | t.bit = 31),
steps AS (
  SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before
  FROM ordered, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
told AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM masked, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM told
"""

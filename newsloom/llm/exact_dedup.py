"""Exact dedup by deterministic block naming (Karp, Miller and Rosenberg 1972).

Each text is cut into blocks of BLOCK characters. Distinct blocks are sorted and their positions in the sort are their
names; then adjacent names of a document are paired, distinct pairs sorted and named, until one name is left: texts
are equal exactly if they have as many blocks and the same last name. Names stand for whole contents, never for
a digest alone, so no collision can join two texts.

Scale: a text is shuffled once, in blocks, after map-side combination (of a third of all rows being copies, each task
sends one); all that follows moves fixed-width rows. Digests of blocks are only used to find a block's name
again without moving the block a second time; where two contents share a digest (checked on every run), those blocks
are joined by content.

Defined results: null counts as empty; empty texts are equal; doc_id null sorts below every doc_id;
of equal rows with equal doc_id exactly one stays; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm._shared import drop_written, keep_rows, written

BLOCK = 32_768


def _digest(c):
    """96 bits in two longs, to find a block again."""
    return F.xxhash64(c).alias("h1"), F.hash(c, F.length(c)).cast("long").alias("h2")


def _named(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct rows of keys and their names: where they stand in the sort of their range."""
    distinct = keyed.groupBy(*keys).agg(F.count("*").alias("n"))
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (rid, doc_id, sha, n_blocks, name) for each row of docs (doc_id, text): equal texts have equal (n_blocks, name)."""
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    cut = F.when(F.length("text") <= block, F.array("text")).otherwise(
        F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    )
    blocks = docs.select("doc_id", text).select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", F.sha2("text", 256).alias("sha"), cut.alias("cut")
    )
    blocks = blocks.select("rid", "doc_id", "sha", F.size("cut").alias("n_blocks"), F.posexplode_outer("cut").alias("i", "block"))
    compact = written(blocks.select("rid", "doc_id", "sha", "n_blocks", "i", *_digest(F.col("block"))), "blocks")

    contents = docs.select(text).select(F.explode_outer(cut).alias("block")).select(*_digest(F.col("block")), "block")
    names = written(_named(contents, ["h1", "h2", "block"]).select("h1", "h2", "name"), "names")
    shared = names.groupBy("h1", "h2").agg(F.count("*").alias("k")).where("k > 1")
    if shared.isEmpty():
        level = compact.join(names, ["h1", "h2"]).select("rid", "doc_id", "sha", "n_blocks", "i", "name")
    else:  # contents that share a digest: named by content, with their rows
        own = _named(blocks.select("block"), ["block"]).select("block", "name")
        level = blocks.join(own, "block").select("rid", "doc_id", "sha", "n_blocks", "i", "name")

    longest = compact.agg(F.max("n_blocks")).first()[0] or 1
    done, rest, left = level.where("n_blocks = 1").drop("i"), level.where("n_blocks > 1"), longest
    drops = [compact, names]
    if longest > 1:
        rest = written(rest, "level")
    while left > 1:
        left = (left + 1) // 2
        pairs = rest.groupBy("rid", "doc_id", "sha", "n_blocks", F.floor(F.col("i") / 2).cast("int").alias("i")).agg(
            F.min(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"), F.min(F.when(F.col("i") % 2 == 1, F.col("name"))).alias("b")
        )
        pairs = written(pairs.withColumn("b", F.coalesce("b", F.lit(-1))), "pairs")
        named = written(_named(pairs, ["a", "b"]).select("a", "b", "name"), "names")
        drop_written(rest)
        rest = written(pairs.join(named, ["a", "b"]).select("rid", "doc_id", "sha", "n_blocks", "i", "name"), "level")
        drop_written(pairs)
        drop_written(named)
    out = written(done.unionByName(rest.drop("i")) if longest > 1 else done, "identities")
    for x in drops + ([rest] if longest > 1 else []):
        drop_written(x)
    return out


def exact_groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each row of docs: rid, doc_id, keep_id, group_size, kept, text_sha256."""
    ids = identities(docs, block)
    groups = ids.groupBy("n_blocks", "name").agg(
        F.count("*").alias("group_size"), F.max(F.struct("doc_id", F.col("rid").alias("r"))).alias("top")
    )
    groups = written(groups.select("n_blocks", "name", "group_size", F.col("top.doc_id").alias("keep_id"), F.col("top.r").alias("top_rid")), "groups")
    return ids.join(groups, ["n_blocks", "name"]).select(
        "rid", "doc_id", "keep_id", "group_size", (F.col("rid") == F.col("top_rid")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_groups(docs).drop("rid")


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: of equal texts one row stays."""
    g = exact_groups(docs.select("doc_id", "text"))
    # only where a row repeats doc_id and text can the join below keep more than one row of a group
    twice = not g.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return keep_rows(docs, g.where("kept").select("doc_id", F.col("text_sha256").alias("sha")), single=twice)

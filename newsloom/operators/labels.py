"""Bracket labels of title groups from the phrases their titles share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import STOP_WORDS, sentence_score, without_stop_words
from newsloom.functions.titles import bracket_label

MIN_CHARS, MAX_WORDS, TOP, OVERLAP = 3, 4, 3, 0.5


def normal_title(title: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Word characters, &, - and single spaces, without stop words."""
    x = F.trim(F.regexp_replace(F.regexp_replace(title, r"[^\p{L}\p{N}_\s\p{Z}&\-]", ""), r"[\s\p{Z}]+", " "))
    return F.array_join(without_stop_words(F.split(x, " "), stop), " ")


def pieces(title: str) -> list[tuple[str, str, bool]]:
    """(low, text, first): pieces of a title between word edges, MIN_CHARS or more, MAX_WORDS at most, each once; first: whether the piece's first place in the title is at word edges."""
    import regex

    # every character that is no word's stands for itself, so edges are where tokens begin and where the last one ends
    edges = [m.start() for m in regex.finditer(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]", title)] + [len(title)]
    at_edge, whole, found = set(edges), title.lower(), {}
    for k, a in enumerate(edges[:-1]):
        for b in edges[k + 1 :]:
            text = title[a:b].strip(" ")
            if text.count(" ") >= MAX_WORDS:
                break  # no longer piece has fewer words
            if b - a >= MIN_CHARS:
                found[title[a:b].lower(), text] = None
    out = []
    for low, text in found:
        at = whole.find(low)
        out.append((low, text, at in at_edge and at + len(low) in at_edge))
    return out


def phrases(t: Column) -> Column:
    """pieces() of a title, as array<struct<low, text, first>>: a short loop a title in Arrow batches, where lambdas over positions took far longer."""

    def run(titles: pa.Array) -> pa.Array:
        told = [[dict(zip(("low", "text", "first"), p, strict=True)) for p in pieces(x or "")] for x in titles.to_pylist()]
        return pa.array(told, pa.list_(pa.struct([("low", pa.string()), ("text", pa.string()), ("first", pa.bool_())])))

    return F.arrow_udf(run, "array<struct<low:string,text:string,first:boolean>>")(t)


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, text, words) in order of group and rank to (group, chosen): the first TOP phrases of which none has half of its words or more in one that stayed. What is held is a batch and TOP phrases."""
    group, kept = None, []
    for batch in batches:
        told: list[tuple] = []
        for g, text, words in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if kept and g != group:
                told.append((group, [x for x, _ in kept]))
                kept = []
            group = g
            if len(kept) < TOP and not any(sum(w in k for w in words) / len(words) >= OVERLAP for _, k in kept):
                kept.append((text, set(words)))
        yield _row(told, batch)
    if kept:
        yield _row([(group, [x for x, _ in kept])], batch)


def _row(told: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([g for g, _ in told], like.column(0).type), pa.array([c for _, c in told], pa.list_(pa.string()))], names=["group", "chosen"])


def labels(titles: DataFrame, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """titles (group, pos, title): (group, label). A phrase counts if a later title of the group has it too.

    Phrases meet by equality within a group, never titles pair by pair. Order: words, score, characters (all descending), text.
    """
    # in full number: a title is few bytes and very many phrases, and Spark would put all titles in one task
    k = int(titles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = titles.select("group", "pos", normal_title(F.col("title"), stop).alias("t")).repartition(k, "group", "pos")
    p = t.select("group", "pos", F.explode(phrases(F.col("t"))).alias("p")).select("group", "pos", "p.*")
    # equal phrases are one row from here on: one has a later title if the first that holds it has
    own = p.groupBy("group", "low", "text").agg(F.min("pos").alias("pos"), F.max(F.when(F.col("first"), F.col("pos"))).alias("until"))
    own = own.withColumn("until", F.max("until").over(Window.partitionBy("group", "low")))
    shared = own.where("pos < until and text <> ''").select("group", "text").distinct()
    rank = [-F.size(F.split("text", r"\s+")), -F.round(sentence_score(F.col("text")), 4), -F.length("text"), F.col("text")]
    # in order on disk, never gathered for a group
    best = shared.select("group", "text", F.array_distinct(F.split(F.lower("text"), r"\s+")).alias("words"), F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)]).alias("rank"))
    best = best.repartition(k, "group").sortWithinPartitions("group", "rank").select("group", "text", "words")
    best = best.mapInArrow(_greedy, f"group {titles.schema['group'].dataType.simpleString()}, chosen array<string>")
    out = best.select("group", bracket_label(F.col("chosen")).alias("label"))
    return titles.select("group").distinct().join(out, "group", "left").select("group", F.coalesce("label", F.lit("")).alias("label"))

"""Licence scan by diagonal voting.

Templates (phrases and typical sentences of licences) are cut into K-word grams with their positions. Every rolling K-gram hash
of every text is joined to the templates' grams (a few hundred fixed rows, broadcast), and a hit counts only if its words are the gram's words.
Hits vote for the diagonal text position minus template position; diagonals that lie within GAP words of each other are merged
(words put in or left out). From each hit of a merged diagonal a stretch of twice the template's length is looked at, the one that holds most of
the template's grams (the first of equals) is a span if they are enough, and what follows it is looked at in the same way, so a merged
diagonal of any length is searched to its end. A phrase counts as standing consecutively only if all of its grams are on one diagonal.

score: the largest share of a template's grams that a span holds. Defined results: text null has no words, no labels and score 0;
rows with equal doc_id are apart; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import textops
from newsloom.llm._shared import ship, written

K = 3
GAP = 4
#: Share of a template's grams that a span must hold; of a template of fewer than LONG grams it must hold all.
COVERAGE, LONG = 0.6, 8

#: (fixed values) phrases whose places are counted.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Typical sentences of public licence texts, and their labels.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0 you may not use this file except in compliance with the license": "apache-2",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "creative commons attribution 4 0 international license": "cc-by",
    "creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "apache-2",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software": "bsd-3",
    "spdx license identifier mit": "mit",
    "spdx license identifier apache 2 0": "apache-2",
    "spdx license identifier bsd 3 clause": "bsd-3",
    "spdx license identifier gpl 2 0": "gpl-2",
    "spdx license identifier gpl 3 0": "gpl-3",
    "spdx license identifier mpl 2 0": "mpl-2",
}


def _grams(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, tuple]]:
    """first row, words of each text, grams, grams of each text, (bytes, starts, ends) of the words."""
    sep = textops.separators("alnum")
    for at, data, off in textops.passes(texts):
        starts, ends, counts = textops.words(data, off, sep)
        g, per = textops.grams(textops.span_hashes(data, starts, ends), counts, K)
        yield at, counts, g, per, (data, starts, ends)


def templates(base: dict[str, str] = BASE, more: dict[str, str] = TEMPLATES) -> list[tuple]:
    """Rows (template, label, is_base, n_grams, place, hash, words)."""
    rows = []
    both = [(t, x, True) for t, x in base.items()] + [(t, x, False) for t, x in more.items()]
    for i, (text, label, is_base) in enumerate(both):
        w = text.split(" ")
        for _, _, g, per, _ in _grams(pa.array([text])):
            rows += [(i, label, is_base, int(per[0]), j, int(h), " ".join(w[j : j + K])) for j, h in enumerate(g.view(np.int64))]
    return rows


def _emit(known: np.ndarray):
    """known: the templates' hashes, sorted; only where a gram has one of them its words are put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(rid, doc_id, text): for each text a row with its number of words (at -1), and one for each gram."""
        for batch in batches:
            rid, ids = batch.column(0).to_numpy(), batch.column(1)
            for at, counts, g, per, (data, starts, ends) in _grams(batch.column(2)):
                n, own = len(counts), rid[at : at + len(counts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), ids.slice(at, n), pa.array(np.full(n, -1, np.int32)), textops.longs(counts), pa.nulls(n, pa.string())], names=["rid", "doc_id", "at", "h", "gram"]
                )
                if not len(g):
                    continue
                place = np.arange(len(g)) - np.repeat(np.cumsum(per) - per, per)
                h = g.view(np.int64)
                met = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h) if len(known) else ()
                gram: list[str | None] = [None] * len(g)
                first = np.repeat(np.cumsum(counts) - counts, per) + place
                for i in met:
                    w = first[i]
                    gram[i] = b" ".join(textops.FOLD[data[starts[w + j] : ends[w + j]]].tobytes() for j in range(K)).decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(own, per)), pa.nulls(len(g), ids.type), pa.array(place.astype(np.int32)), textops.longs(g), pa.array(gram, pa.string())],
                    names=["rid", "doc_id", "at", "h", "gram"],
                )

    return run


def stretches(at: np.ndarray, place: np.ndarray, n_grams: int) -> list[tuple[int, int, float]]:
    """(first word, end, coverage) of a template's spans among its hits (text position, place in the template)."""
    need = n_grams if n_grams < LONG else COVERAGE * n_grams
    out = []
    order = np.lexsort((at, at - place))
    cuts = np.flatnonzero(np.diff((at - place)[order]) > GAP) + 1
    for chain in np.split(order, cuts):
        if len(chain) < need:
            continue
        chain = chain[np.argsort(at[chain], kind="stable")]
        a, p = at[chain].tolist(), place[chain].tolist()
        # of the stretch from each hit: how many places it holds
        held, kinds, end = [0] * n_grams, 0, 0
        counts = []
        for i in range(len(a)):
            while end < len(a) and a[end] + K - a[i] <= 2 * (n_grams + K):
                kinds += held[p[end]] == 0
                held[p[end]] += 1
                end += 1
            counts.append((kinds, end))
            held[p[i]] -= 1
            kinds -= held[p[i]] == 0
        i = 0
        while i < len(a):
            if counts[i][0] < need:
                i += 1
                continue
            best = max(range(i, counts[i][1]), key=lambda k: (counts[k][0], -k))
            seen: set[int] = set()
            upto = best
            while len(seen) < counts[best][0]:
                seen.add(p[upto])
                upto += 1
            out.append((a[best], a[upto - 1] + K, counts[best][0] / n_grams))
            i = upto
            while i < len(a) and a[i] < out[-1][1]:
                i += 1
    return out


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, label, n_grams, hits) to (rid, label, first, last, coverage)."""
    for batch in batches:
        rows = []
        for rid, label, n, hits in zip(*(batch.column(i) for i in range(4)), strict=True):
            at, place = hits.values.field(0).to_numpy(), hits.values.field(1).to_numpy()
            rows += [(rid.as_py(), label.as_py(), *x) for x in stretches(at, place, n.as_py())]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["rid", "label", "first", "last", "coverage"])


def license_spans(docs: DataFrame, base: dict[str, str] = BASE, more: dict[str, str] = TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text): its rows as (rid, doc_id, n_words), and the spans (rid, label, is_base, first, last, coverage)."""
    spark = docs.sparkSession
    ship(spark)
    d = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    kind = d.schema["doc_id"].dataType.simpleString()
    rows = templates(base, more)
    grams = d.mapInArrow(_emit(np.unique(np.array([r[5] for r in rows], np.int64))), f"rid long, doc_id {kind}, at int, h long, gram string")
    table = spark.createDataFrame(rows, "template int, label string, is_base boolean, n_grams int, place int, _h long, words string")
    met = grams.join(F.broadcast(table), (F.col("h") == F.col("_h")) & (F.col("at") >= 0), "left").where("at < 0 or gram = words")
    met = written(met.drop("_h", "gram", "words"), "grams")
    rows = met.where("at < 0").select("rid", "doc_id", F.col("h").alias("n_words"))
    votes = met.where("is_base").groupBy("rid", "template", "label", "is_base", "n_grams", (F.col("at") - F.col("place")).alias("diagonal"))
    votes = votes.agg(F.count_distinct("place").alias("places"))
    whole = votes.where("places = n_grams").select(
        "rid", "label", "is_base", F.col("diagonal").cast("long").alias("first"), (F.col("diagonal") + F.col("n_grams") + K - 1).cast("long").alias("last"), F.lit(1.0).alias("coverage")
    )
    # the hits of one text and template: no more than the text has words, for each place of an equal gram
    hits = met.where("not is_base").groupBy("rid", "template", "label", "n_grams").agg(F.collect_list(F.struct(F.col("at").cast("long").alias("at"), F.col("place").cast("long").alias("place"))).alias("hits"))
    spans = hits.select("rid", "label", "n_grams", "hits").mapInArrow(_spans, "rid long, label string, first long, last long, coverage double")
    return rows, whole.unionByName(spans.withColumn("is_base", F.lit(False)))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, spans = license_spans(docs)
    base = F.col("is_base")
    per = spans.groupBy("rid").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("coverage").alias("score"),
    )
    none = F.lit("")
    return rows.join(per, "rid", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )

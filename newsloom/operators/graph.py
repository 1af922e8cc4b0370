"""Connected components as alternating star steps over an edge table, and small graphs in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.tables import drop_written, written


#: Edges that one task may hold: some 100 MB of Python objects at most. Whoever passes a bound like this to an operator lets it end in one task once no more are left.
LOCAL_EDGES = 1_000_000


def in_one_task(df: DataFrame, solve: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """solve(all rows of df), in a task; df is known to be small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from solve(pa.Table.from_batches(held)).to_batches()

    return df.coalesce(1).mapInArrow(run, schema)


def ranks(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The places of two columns' values in the sorted distinct values of both, and these values."""
    both = pa.chunked_array(a.chunks + b.chunks).combine_chunks().unique()
    both = both.take(pc.sort_indices(both))
    return np.asarray(pc.index_in(a.combine_chunks(), both)), np.asarray(pc.index_in(b.combine_chunks(), both)), both


def _components_of(t: pa.Table) -> pa.Table:
    """Labels fall to the smallest of a node's neighbours and to their label's label until nothing changes."""
    a, b, nodes = ranks(t["a"], t["b"])
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return pa.table({"node": nodes, "root": nodes.take(pa.array(label))})
        label = new


def components(edges: DataFrame, name: str = "cc", local: int = 0) -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, root), root the smallest node reachable.

    local: so many distinct edges, if there are no more, are taken by one task.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until no edge changes, so the number of
    rounds is about log2 of a component's size squared; every round is a written table. Only minima are gathered for a
    node (map-side combined), never its neighbours, so a node of any degree is one row per task.
    """
    e = written(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        name,
    )
    if local and e.count() <= local:
        kind = e.schema["a"].dataType.simpleString()
        return in_one_task(e, _components_of, f"node {kind}, root {kind}")
    stamp = None
    while True:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that the join below deals two plain tables and Spark can split a node of very many edges
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), name)
        # large star: every larger neighbour of a node goes to the node's least neighbour (or to the node itself)
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a <> b").distinct(), name)
        # small star: a node's smaller neighbours, and the node, go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("x")), F.struct(F.col("a").alias("x")))).alias("s"), "m"
        )
        new = written(small.select(F.col("s.x").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), name)
        drop_written(e)
        drop_written(large)
        drop_written(least)
        e = new
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == stamp:
            break
        stamp = now
    return e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").unionAll(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )

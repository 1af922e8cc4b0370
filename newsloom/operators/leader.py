"""Greedy leader clustering in input order, and greedy one-to-one matching, in bounded rounds over edge tables.

Leader: j joins the first leader i < j that it has an edge to; who joins never leads. Matching: the best edge first, then the best
one that touches neither of its ends, and so on. Both are sequential by nature; three kinds of steps decide the same:

* all at once: nodes without undecided smaller neighbours lead and take their neighbours; edges that are the best of both ends match. Few such
  rounds are enough for random orders (Blelloch, Fineman and Shun 2012), but a chain in order needs one a link;
* by rank: what comes first in the order, as many edges as one task holds, is decided in that task by the loop itself,
  then everything that follows from it is filtered, whatever lies behind;
* to the end: once no more edges are left than one task holds, the loop decides them all.

The first two alternate, so a round decides `local` edges at least and mostly a large part of all; every round is a written table, and
the driver only takes counts and one boundary.

Where the edges join all ids of one profile with all of another, matching works on profiles: of each, ids are used up from the largest on, so a profile is a queue.
An id's turns are the scores that its profile has, best first; of equal scores the larger id comes first and takes the largest id at the heads of its
profile's partners. The first turns, as many as one task holds with what they can reach, are decided in a task.
"""

from __future__ import annotations

import heapq
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.graph import LOCAL_EDGES, in_one_task, ranks
from newsloom.operators.tables import drop_written, written


def _members_of(t: pa.Table) -> pa.Table:
    """Edges (i, j) to (id, joins): whether each node joins a leader. In the order of j, all about i is known when j's turn comes."""
    i, j, nodes = ranks(t["i"], t["j"])
    order = j.argsort(kind="stable")
    joins = bytearray(len(nodes))
    for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
        if not joins[a]:
            joins[b] = 1
    return pa.table({"id": nodes, "joins": pa.array(joins, pa.uint8()).cast(pa.bool_())})


def _decided_first(alive: DataFrame) -> DataFrame:
    """Nodes without undecided smaller neighbours lead; their neighbours join: (id, joins)."""
    heads = alive.select("i").distinct().join(alive.select(F.col("j").alias("i")).distinct(), "i", "left_anti")
    heads = written(heads, "heads")
    joined = alive.join(heads, "i", "left_semi").select(F.col("j").alias("id")).distinct()
    return heads.select(F.col("i").alias("id"), F.lit(False).alias("joins")).unionByName(joined.withColumn("joins", F.lit(True)))


def _decided_by_rank(alive: DataFrame, edges: int, local: int) -> DataFrame:
    """The nodes up to the boundary below which about `local` edges lie are decided by the loop; who has an edge to a leader among them joins: (id, joins).

    Where one node alone has more edges, nothing is decided: such a node's smaller neighbours lead in the next round of the other kind.
    """
    share = local / 2 / edges
    while True:
        cut = alive.select(F.percentile_approx("j", F.lit(share), F.lit(1000)).alias("c")).first().c
        below = written(alive.where(F.col("j") < F.lit(cut)), "below")
        n = below.count()
        if n <= local:
            break
        share *= local / 2 / n
    kind = alive.schema["j"].dataType.simpleString()
    inner = written(in_one_task(below, _members_of, f"id {kind}, joins boolean"), "decided")
    across = alive.join(inner.where("not joins").select(F.col("id").alias("i")), "i", "left_semi").where(F.col("j") >= F.lit(cut))
    return inner.unionByName(across.select(F.col("j").alias("id"), F.lit(True).alias("joins")).distinct())


def leaders(nodes: DataFrame, edges: DataFrame, keep_single: bool, local: int = LOCAL_EDGES) -> DataFrame:
    """nodes (id), edges (i, j) with i < j: (id, leader). keep_single: a leader without members is a group of its own.

    Ids are numbers or, where there are no more than `local` edges, strings.
    """
    # an edge may come twice: every step takes minima or is the same for it
    edges = written(edges.select("i", "j"), "edges")
    kind = edges.schema["j"].dataType.simpleString()
    alive, members, by_rank = edges, None, False
    while n := alive.count():
        if n <= local:
            new = in_one_task(alive, _members_of, f"id {kind}, joins boolean")
        else:
            new = _decided_by_rank(alive, n, local) if by_rank else _decided_first(alive)
        new = written(new, "members")
        joined = new.where("joins").select("id")
        members = joined if members is None else members.unionByName(joined)
        if n <= local:
            break
        by_rank = not by_rank
        # nodes that lead have no say any more once all who have an edge to them have joined
        done = new.select(F.col("id").alias("x"))
        rest = written(alive.join(done, F.col("i") == F.col("x"), "left_anti").join(done, F.col("j") == F.col("x"), "left_anti"), "edges")
        if alive is not edges:  # who joins whom is read from it
            drop_written(alive)
        alive = rest
    if members is None:
        members = nodes.select("id").limit(0)
    joined = edges.join(members.select(F.col("id").alias("i")), "i", "left_anti").join(members.select(F.col("id").alias("j")), "j", "left_semi")
    joined = joined.groupBy("j").agg(F.min("i").alias("leader")).select(F.col("j").alias("id"), "leader")
    heads = nodes.select("id").join(members, "id", "left_anti")
    if not keep_single:
        heads = heads.join(joined.select(F.col("leader").alias("id")).distinct(), "id", "left_semi")
    return joined.unionByName(heads.select("id", F.col("id").alias("leader")))


ORDER = [("score", "descending"), ("i", "descending"), ("j", "descending")]


def _matched_of(t: pa.Table) -> pa.Table:
    t = t.sort_by(ORDER)
    left, right, take = set(), set(), []
    for k, (i, j) in enumerate(zip(t["i"].to_pylist(), t["j"].to_pylist(), strict=True)):
        if i not in left and j not in right:
            left.add(i)
            right.add(j)
            take.append(k)
    return t.take(take)


def matching(edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """edges (i, j, score): one-to-one, best score first; ties go to the larger i, then the larger j. Scores are numbers, never null or NaN."""
    alive, found, by_rank = written(edges.select("i", "j", "score"), "edges"), None, False
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in alive.schema)
    at = F.struct("score", "i", "j")
    while n := alive.count():
        rest = alive
        if n <= local:
            new = in_one_task(alive, _matched_of, schema)
        elif by_rank:
            head = written(alive.orderBy(at.desc()).limit(local), "head")
            low = head.agg(F.min(at).alias("m")).first().m
            new = in_one_task(head, _matched_of, schema)
            rest = alive.where(at < F.struct(*[F.lit(low[c]).cast(alive.schema[c].dataType).alias(c) for c in ("score", "i", "j")]))
        else:
            best = lambda side: alive.groupBy(side).agg(F.max(at).alias(f"best_{side}"))
            new = alive.join(best("i"), "i").join(best("j"), "j").where((at == F.col("best_i")) & (at == F.col("best_j"))).select("i", "j", "score").distinct()
        new = written(new, "matched")
        found = new if found is None else found.unionByName(new)
        if n <= local:
            break
        by_rank = not by_rank
        rest = written(rest.join(new.select("i"), "i", "left_anti").join(new.select("j"), "j", "left_anti").select("i", "j", "score"), "edges")
        drop_written(alive)
        alive = rest
    return edges.select("i", "j", "score").limit(0) if found is None else found


def _coded_ids(column: pa.ChunkedArray) -> tuple[list[int], pa.Array]:
    """The places of a column's values in their sorted distinct values, and these values."""
    values = column.unique()
    values = values.take(pc.sort_indices(values))
    return pc.index_in(column.combine_chunks(), values).to_pylist(), values


def _queues_of(t: pa.Table, low: tuple | None) -> pa.Table:
    """Rows (p, q, score) of edges, (p, i) and (q, j) of ids to the matches of all turns, or of those not behind low (score, i)."""
    e, a, b = t.filter(pc.is_valid(t["score"])), t.filter(pc.is_valid(t["i"])), t.filter(pc.is_valid(t["j"]))
    (i, names_i), (j, names_j) = _coded_ids(a["i"]), _coded_ids(b["j"])
    left, right, levels = {}, {}, {}
    for k, p in sorted(zip(i, a["p"].to_pylist(), strict=True)):
        left.setdefault(p, []).append(k)
    for k, q in sorted(zip(j, b["q"].to_pylist(), strict=True)):
        right.setdefault(q, []).append(k)
    for p, q, s in zip(*(e[c].to_pylist() for c in ("p", "q", "score")), strict=True):
        levels.setdefault(s, {}).setdefault(p, []).append(q)
    out_i, out_j, out_s = [], [], []
    for s in sorted(levels, reverse=True):
        if low and s < low[0]:
            break
        at = {p: [(-right[q][-1], q) for q in qs if right.get(q)] for p, qs in levels[s].items() if left.get(p)}
        for heads in at.values():
            heapq.heapify(heads)
        least = pc.sum(pc.less(names_i, pa.scalar(low[1], names_i.type))).as_py() or 0 if low and s == low[0] else 0
        for k, p in sorted(((k, p) for p in at for k in left[p]), reverse=True):
            if k < least:
                break
            heads = at[p]
            while heads:
                q = heads[0][1]
                if not right[q]:
                    heapq.heappop(heads)
                elif -heads[0][0] != right[q][-1]:  # others took from it
                    heapq.heapreplace(heads, (-right[q][-1], q))
                else:
                    # larger ids of p are matched already, so this is its last one
                    out_i.append(left[p].pop())
                    out_j.append(right[q].pop())
                    out_s.append(s)
                    break
    return pa.table({"i": names_i.take(pa.array(out_i, pa.int64())), "j": names_j.take(pa.array(out_j, pa.int64())), "score": pa.array(out_s, pa.float64())})


def _first_turns(edges: DataFrame, left: DataFrame, right: DataFrame, local: int) -> tuple[DataFrame, DataFrame, DataFrame, tuple]:
    """The first turns' parts of edges, left and right, `local` rows at most, and the last of these turns.

    k turns use up k ids: of a profile's partners of a score only those with the k largest heads are needed, and of a partner as many ids as there are turns that reach it.
    """
    turns = left.join(edges.select("p", "score").distinct(), "p").select("score", "i", "p")
    heads = written(right.groupBy("q").agg(F.max("j").alias("head"), F.min("place").alias("from")), "heads")
    k = max(1, local // 4)
    while True:
        head = written(turns.orderBy(F.desc("score"), F.desc("i")).limit(k), "turns")
        reached = edges.join(head.groupBy("p", "score").agg(F.count("*").alias("t")), ["p", "score"]).join(heads, "q")
        best = Window.partitionBy("p", "score").orderBy(F.desc("head"))
        e = written(reached.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).select("p", "q", "score", "t", "from"), "reached")
        b = right.join(e.groupBy("q").agg(F.sum("t").alias("t"), F.min("from").alias("from")), "q").where("place - from < t").select("q", "j")
        b = written(b, "partners")
        a = head.select("p", "i").distinct()
        if k == 1 or k + e.count() + b.count() <= local:
            low = head.agg(F.min(F.struct("score", "i")).alias("m")).first().m
            return e.select("p", "q", "score"), a, b, (low.score, low.i)
        k = max(1, k // 8)


def matching_profiles(edges: DataFrame, left: DataFrame, right: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """edges (p, q, score) of profiles, left (p, i) and right (q, j) their ids, each once: (i, j, score), the same as matching() of all pairs of their ids."""
    edges = written(edges.select("p", "q", "score"), "edges")
    kinds = {c: t for x in (edges, left, right) for c, t in x.dtypes}
    schema = f"i {kinds['i']}, j {kinds['j']}, score {kinds['score']}"

    def queue(ids: DataFrame, of: str, to: str, others: DataFrame) -> DataFrame:
        """An id that has more before it than its profile can meet is never matched."""
        met = edges.join(others.groupBy(to).agg(F.count("*").alias("met")), to).groupBy(of).agg(F.sum("met").alias("met"))
        c = next(x for x in ids.columns if x != of)
        place = F.row_number().over(Window.partitionBy(of).orderBy(F.desc(c)))
        return written(ids.join(met, of).withColumn("place", place).where("place <= met").select(of, c, "place"), "queue")

    left, right = queue(left, "p", "q", right), queue(right, "q", "p", left)
    found = None
    while n := edges.count():
        whole = n + left.count() + right.count() <= local
        e, a, b, low = (edges, left, right, None) if whole else _first_turns(edges, left, right, local)
        rows = e.unionByName(a.select("p", "i"), True).unionByName(b.select("q", "j"), True)
        new = written(in_one_task(rows, partial(_queues_of, low=low), schema), "matched")
        found = new if found is None else found.unionByName(new)
        if whole:
            break
        # who stays without a match has no partner left at that score, so its turns don't come again
        left = written(left.join(new.select("i"), "i", "left_anti"), "queue")
        right = written(right.join(new.select("j"), "j", "left_anti"), "queue")
        rest = edges.join(left.select("p").distinct(), "p", "left_semi").join(right.select("q").distinct(), "q", "left_semi")
        edges = written(rest, "edges")
    return edges.sparkSession.createDataFrame([], schema) if found is None else found

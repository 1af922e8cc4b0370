"""What a containment join connects, without its pairs.

Items are numbers, and those that one id alone has are only counted (similarity.coded).

1. Ids with equal sets are one class, found by two aggregates and proved by counting: in a class of k ids each item occurs k times.
2. Of each item, the smallest set that has it among its rarest items is a hub, and the other sets that hold the item are
   measured against it alone: as many candidates as there are rows. What passes is an edge.
3. Two sets that are connected already needn't be compared. What is left, pairs of an item whose sets lie in different components, is counted from the
   sizes of (item, component); if that is at most LINEAR times the rows, or ROUNDS rounds are done, exactly these pairs are measured, otherwise each
   item takes its next smallest set as its hub.

So equal or nested sets, of whatever number, give a candidate a row; pairs are looked at one by one only between sets that share a rare item
and aren't connected, of which each was to be measured anyway.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.graph import LOCAL_EDGES, components
from newsloom.operators.similarity import coded, common_items, prefix_places, ranked_items
from newsloom.operators.tables import drop_written, written

#: Candidates a row up to which the pairs left are measured at once, and rounds of hubs at most.
LINEAR, ROUNDS = 8, 6


def classes(members: DataFrame) -> DataFrame:
    """members (id, item), distinct: (id, rep), rep the smallest id with the same items."""
    prints = members.groupBy("id").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("item")).alias("x"), F.sum(F.hash("item").cast("long")).alias("s"))
    prints = written(prints, "prints")
    same = written(prints.groupBy("n", "x", "s").agg(F.min("id").alias("rep"), F.count("*").alias("k")), "classes")
    of = written(prints.join(same, ["n", "x", "s"]).select("id", "rep", "k"), "classes")
    # equal aggregates, unequal sets: an item isn't in all of the class
    per = members.join(of.where("k > 1"), "id").groupBy("rep", "item").agg(F.count("*").alias("c"), F.max("k").alias("k"))
    mixed = written(per.where("c <> k").select(F.col("rep").alias("mixed")).distinct(), "mixed")
    if not mixed.isEmpty():
        of = of.join(mixed, F.col("rep") == F.col("mixed"), "left").withColumn("rep", F.when(F.col("mixed").isNull(), F.col("rep")).otherwise(F.col("id")))
    return of.select("id", "rep")


def _measured(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """pairs (i, j) of which the smaller set has the threshold's part in common with the other, as edges."""
    got = common_items(pairs, sets, sets)
    return got.where(F.col("common") >= threshold * F.least("ni", "nj")).select(F.col("i").alias("a"), F.col("j").alias("b"))


def _rooted(sets: DataFrame, root: DataFrame | None) -> DataFrame:
    """The sets' rows with the root of their component so far."""
    if root is None:
        return sets.withColumn("root", F.col("id"))
    return sets.join(root.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))


def containment_components(members: DataFrame, threshold: float = 0.5, linear: float = LINEAR, rounds: int = ROUNDS) -> DataFrame:
    """members (id, item): (id, root), root the smallest id reachable over pairs with common / smaller size >= threshold > 0.

    The same as components(containment_pairs(members)), with a row for every id that has an item; items that are null are none.
    """
    m, every = coded(members)
    # who has an item of its own is equal to nobody
    whole = m.groupBy("id", "n").agg(F.count("*").alias("k")).where("k = n").select("id")
    equal = written(classes(m.join(whole, "id", "left_semi").select("id", "item")), "classes")
    of = written(every.select("id").join(equal, "id", "left").select("id", F.coalesce("rep", "id").alias("rep")), "classes")
    sets = ranked_items(m.join(of.where("id = rep").select("id"), "id", "left_semi"))
    sets = written(sets.select("id", "item", "n", (F.col("place") <= prefix_places("n", threshold)).alias("first"), F.struct("n", "id").alias("at")), "sets")
    rows = sets.count()
    hubs, edges, root = None, None, None
    for k in range(rounds + 1):
        now = written(_rooted(sets, root), "rooted")
        # hubs are taken in order, so what lies behind an item's last one hasn't been one
        open_ = now if hubs is None else now.join(hubs.select("item", F.col("hub").alias("last")), "item", "left")
        unused = F.col("first") if hubs is None else F.col("first") & (F.col("last").isNull() | (F.col("at") > F.col("last")))
        per = open_.groupBy("item", "root").agg(F.count_if(unused).alias("p"), F.count("*").alias("l")).groupBy("item")
        per = written(per.agg((F.sum("p") * F.sum("l") - F.sum(F.col("p") * F.col("l"))).alias("left")).where("left > 0"), "open")
        left = per.agg(F.coalesce(F.sum("left"), F.lit(0))).first()[0]
        if not left:
            break
        other = now.select("item", F.col("id").alias("j"), F.col("at").alias("at_j"), F.col("root").alias("root_j")).join(per.select("item"), "item", "left_semi")
        if left <= linear * rows or k == rounds:
            hub = open_.where(unused).select("item", F.col("id").alias("i"), F.col("at").alias("at_i"), F.col("root").alias("root_i"))
        else:
            step = open_.where(unused).join(per.select("item"), "item", "left_semi").groupBy("item").agg(F.min(F.struct("at", "root")).alias("h"))
            hub = written(step.select("item", F.col("h.at.id").alias("i"), F.col("h.at").alias("at_i"), F.col("h.root").alias("root_i")), "hubs")
            hubs = hub.select("item", F.col("at_i").alias("hub")) if hubs is None else written(
                hubs.join(hub, "item", "full").select("item", F.coalesce("at_i", "hub").alias("hub")), "hubs"
            )
        pairs = hub.join(other, "item").where("at_j > at_i and root_i <> root_j").select("i", "j").distinct()
        new = written(_measured(pairs, sets, threshold), "edges")
        edges = new if edges is None else written(edges.unionByName(new), "edges")
        root = written(components(edges, "stories", LOCAL_EDGES), "roots")
        drop_written(now)
        if left <= linear * rows or k == rounds:
            break
    if root is None:
        return of.select("id", F.col("rep").alias("root"))
    return of.join(root, F.col("rep") == F.col("node"), "left").select("id", F.coalesce("root", "rep").alias("root"))

import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import connect, graph, leader, stories


def _roots(sets, threshold):
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and len(sets[i] & sets[j]) >= threshold * min(len(sets[i]), len(sets[j])):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def _members(spark, sets):
    return spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "id long, item string")


@pytest.mark.parametrize(("threshold", "linear", "rounds"), [(0.5, 8, 6), (0.5, 0, 6), (0.5, 0, 1), (0.8, 0, 2), (1.0, 0.5, 3)])
def test_connected_like_all_pairs(spark, threshold, linear, rounds):
    """linear and rounds: how many candidates may be measured at once, so hubs alone, then what is left."""
    r = random.Random(int(10 * threshold) + rounds)
    sets = {}
    for i in range(90):
        kind = r.random()
        if kind < 0.3 and sets:  # a copy, a part or a widened one of an earlier set
            base = sorted(r.choice(list(sets.values())))
            part = base if r.random() < 0.5 else r.sample(base, max(1, len(base) // 2))
            sets[i] = set(part) | ({f"n{i}"} if r.random() < 0.5 else set())
        else:
            sets[i] = {"hot"} | {f"x{r.randrange(60)}" for _ in range(r.randint(0, 6))} if kind < 0.9 else {f"y{i}"}
    got = {x.id: x.root for x in connect.containment_components(_members(spark, sets), threshold, linear, rounds).collect()}
    assert got == _roots(sets, threshold)


def test_equal_sets_are_one_class(spark):
    """10,000 equal groups: no candidate is looked at, and a row a group is returned."""
    m = spark.range(10_000).select(F.col("id"), F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("item"))
    m = m.unionByName(spark.createDataFrame([(20_000, "a"), (20_000, "b"), (20_001, "z"), (20_002, None)], "id long, item string"))
    assert connect.classes(m.where("item is not null").distinct()).where("id < 10000").agg(F.countDistinct("rep")).first()[0] == 1
    got = connect.containment_components(m).groupBy("root").agg(F.count("*").alias("n")).collect()
    assert {(x.root, x.n) for x in got} == {(0, 10_001), (20_001, 1)}
    assert connect.containment_components(m.limit(0)).count() == 0


def test_classes_are_proved(spark, monkeypatch):
    """Unequal sets with equal aggregates are told apart."""
    monkeypatch.setattr(connect.F, "xxhash64", lambda *_: F.lit(1).cast("long"))
    monkeypatch.setattr(connect.F, "hash", lambda *_: F.lit(1))
    sets = {1: {"a", "b"}, 2: {"a", "b"}, 3: {"c", "d"}, 4: {"e"}}
    got = {x.id: x.rep for x in connect.classes(_members(spark, sets)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}, "a class that isn't one falls apart whole"
    monkeypatch.undo()
    assert {x.id: x.root for x in connect.containment_components(_members(spark, sets)).collect()} == _roots(sets, 0.5)


def test_merged_keeps_groups_without_links(spark):
    m = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "group long, key string")
    assert {(x.group, x.story) for x in stories.merged(m).collect()} == {(1, 1), (2, 1), (3, 3)}


def test_components_in_one_task(spark):
    r = random.Random(7)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1600)]
    e = spark.createDataFrame(edges, "a long, b long")
    assert set(map(tuple, graph.components(e, local=10_000).collect())) == set(map(tuple, graph.components(e).collect()))


def _greedy(n, edges):
    joins, out = set(), {}
    near = {}
    for i, j in edges:
        near.setdefault(j, set()).add(i)
    for j in range(n):
        heads = [i for i in near.get(j, ()) if i not in joins]
        if heads:
            joins.add(j)
            out[j] = min(heads)
    return {i: out.get(i, i) for i in range(n)}


def _rounds(monkeypatch):
    """Counts the tables of edges that a call writes: one a round."""
    n = [0]

    def counted(df, name, real=leader.written):
        n[0] += name == "edges"
        return real(df, name)

    monkeypatch.setattr(leader, "written", counted)
    return n


@pytest.mark.parametrize("local", [30, 100, 1_000_000])
def test_leaders_by_rank(spark, local):
    r = random.Random(local)
    n = 120
    edges = {(i, j) for i in range(n) for j in range(i + 1, n) if r.random() < 0.05} | {(i, i + 1) for i in range(n - 1)} | {(3, j) for j in range(60, n)} | {(i, 100) for i in range(90)}
    got = {x.id: x.leader for x in leader.leaders(spark.range(n), spark.createDataFrame(sorted(edges), "i long, j long"), True, local).collect()}
    assert got == _greedy(n, edges)


def test_a_chain_ends_in_few_rounds(spark, monkeypatch):
    n = 10_001
    edges = spark.range(n - 1).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"))
    rounds = _rounds(monkeypatch)
    got = {x.id: x.leader for x in leader.leaders(spark.range(n), edges, True).collect()}
    assert got == {i: i - i % 2 for i in range(n)} and rounds[0] == 1
    rounds[0] = 0
    got = {x.id: x.leader for x in leader.leaders(spark.range(n), edges, True, 2000).collect()}
    assert got == {i: i - i % 2 for i in range(n)} and rounds[0] <= 20


@pytest.mark.parametrize("local", [5, 40, 1_000_000])
def test_matching_by_rank(spark, local):
    r = random.Random(local)
    edges = [(i, f"p{j:02}", r.choice([0.4, 0.5, 0.5, 0.9])) for i in range(20) for j in range(20) if r.random() < 0.3] + [(0, "p00", 0.95), (0, "p00", 0.95)]
    edges += [(k, f"p{k:02}", 0.3) for k in range(20, 60)] + [(k, f"p{k + 1:02}", 0.3) for k in range(20, 60)]
    a, b, want = set(), set(), set()
    for s, i, j in sorted(((s, i, j) for i, j, s in edges), reverse=True):
        if i not in a and j not in b:
            a.add(i)
            b.add(j)
            want.add((i, j, s))
    got = [tuple(x) for x in leader.matching(spark.createDataFrame(edges, "i long, j string, score double"), local).collect()]
    assert len(got) == len(want) and set(got) == want


def test_matching_a_chain_ends_in_few_rounds(spark, monkeypatch):
    edges = spark.range(10_000).select(F.expr("cast((id + 1) div 2 as bigint)").alias("i"), F.expr("cast(id div 2 as bigint)").alias("j"), (F.col("id") + 1.0).alias("score"))
    rounds = _rounds(monkeypatch)
    got = {(x.i, x.j) for x in leader.matching(edges, 2000).collect()}
    assert got == {((k + 1) // 2, k // 2) for k in range(9999, -1, -2)} and rounds[0] <= 20


@pytest.mark.parametrize("local", [40, 1_000_000])
def test_matching_of_profiles_is_matching_of_their_ids(spark, local):
    r = random.Random(local)
    of_i = {i: r.randrange(8) for i in range(45)}
    of_j = {f"j{j:02}": r.randrange(9) for j in range(60)}
    edges = [(p, q, r.choice([0.4, 0.5, 0.5, 0.9])) for p in range(8) for q in range(9) if r.random() < 0.4] + [(20, 2, 1.0), (3, 20, 1.0)]
    a, b, want = set(), set(), set()
    for s, i, j in sorted(((s, i, j) for p, q, s in edges for i in of_i if of_i[i] == p for j in of_j if of_j[j] == q), reverse=True):
        if i not in a and j not in b:
            a.add(i)
            b.add(j)
            want.add((i, j, s))
    left = spark.createDataFrame([(p, i) for i, p in of_i.items()], "p long, i long")
    right = spark.createDataFrame([(q, j) for j, q in of_j.items()], "q long, j string")
    got = [tuple(x) for x in leader.matching_profiles(spark.createDataFrame(edges, "p long, q long, score double"), left, right, local).collect()]
    assert len(got) == len(want) and set(got) == want
    assert leader.matching_profiles(spark.createDataFrame([], "p long, q long, score double"), left, right, local).count() == 0


def test_copies_are_matched_without_their_pairs(spark, monkeypatch):
    # 4,000,000 pairs of ids, of which one in 2,000 is a match
    left = spark.range(2_000).select(F.lit(0).cast("long").alias("p"), F.col("id").alias("i"))
    right = spark.range(2_000).select((F.col("id") % 2).alias("q"), F.col("id").alias("j"))
    edges = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.5)], "p long, q long, score double")
    rounds = _rounds(monkeypatch)
    got = {(x.i, x.j) for x in leader.matching_profiles(edges, left, right, 2_000).collect()}
    assert got == {(k, k) for k in range(2_000)} and rounds[0] <= 6

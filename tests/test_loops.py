"""Components, cycles and depths by doubling, against plain loops and on long rings and chains."""

import random
import sys
import time

import pytest
from pyspark.sql import functions as F

from skerry.operators import iterate

sys.setrecursionlimit(10_000)


def plain(edges):
    """(components of two or more nodes by name, longest distances) by plain reachability."""
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
        after.setdefault(b, set())
    reach = {}
    for v in after:
        seen, todo = set(), [v]
        while todo:
            for w in after[todo.pop()]:
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        reach[v] = seen
    parts = {v: min(w for w in reach[v] if v in reach[w]) for v in after if any(v in reach[w] for w in reach[v] if w != v)}
    parts = {v: min([v, *[w for w in reach[v] if v in reach[w]]]) for v in parts}
    depth = {}

    def deep(v):
        if v not in depth:
            depth[v] = 1 + max(map(deep, after[v])) if after[v] else 0
        return depth[v]

    return parts, {v: None if v in reach[v] or any(w in reach[w] for w in reach[v]) else deep(v) for v in after}


def graphs():
    pick = random.Random(4)
    for n, m in ((12, 14), (30, 33), (40, 60), (25, 100)):
        yield [(f"n{pick.randrange(n):02d}", f"n{pick.randrange(n):02d}") for _ in range(m)]
    ladder = [(f"a{i}", f"a{i + 1}") for i in range(9)] + [(f"b{i}", f"b{i + 1}") for i in range(9)] + [(f"a{i}", f"b{i}") for i in range(10)]
    yield ladder
    yield [("a", "b"), ("b", "a"), ("b", "c1"), ("c1", "c2"), ("c2", "c3"), ("c3", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("f", "g"), ("x", "x"), ("a", "k"), ("k", "b")]


# one task finishes the whole graph, or contraction goes on to the end
@pytest.mark.parametrize("number,local", [*((i, iterate.LOCAL_EDGES) for i in range(6)), (1, 0), (4, 0), (5, 0)])
def test_components_and_depths_equal_plain_ones(spark, monkeypatch, number, local):
    monkeypatch.setattr(iterate, "LOCAL_EDGES", local)
    edges = list(graphs())[number]
    table = spark.createDataFrame(edges, "source string, target string")
    parts, depth = plain(edges)
    assert dict(iterate.strong_components(table).collect()) == parts
    nodes = spark.createDataFrame([("alone",)], "id string")
    assert dict(iterate.depths(table, nodes).collect()) == depth | {"alone": 0}


def test_a_long_ring(spark, monkeypatch):
    monkeypatch.setattr(iterate, "LOCAL_EDGES", 100)
    n = 20_000
    ring = spark.range(n).selectExpr("id as source", "(id + 1) % 20000 as target").union(spark.createDataFrame([(5, 30_000), (30_000, 30_001), (30_002, 7)], "source long, target long"))
    start = time.time()
    got = iterate.strong_components(ring)
    assert got.where("component = 0").count() == n == got.count()
    assert time.time() - start < 60
    (row,) = iterate.cycles(ring).collect()
    assert (row.first, row.length) == (0, n) and row.path == list(range(n))


def test_a_long_chain(spark, monkeypatch):
    monkeypatch.setattr(iterate, "LOCAL_EDGES", 100)
    n = 5_000
    chain = spark.range(n).selectExpr("id as source", "id + 1 as target")
    start = time.time()
    got = dict(iterate.depths(chain, spark.range(1)).collect())
    assert got == {i: n - i for i in range(n + 1)}
    assert time.time() - start < 60
    assert iterate.strong_components(chain).count() == 0


def test_reach_of_most_nodes_goes_by_doubling(spark, monkeypatch):
    """A chain of 60 took a round for each of its levels."""
    import random

    pick = random.Random(4)
    graphs = [[(i, i + 1) for i in range(60)], [(pick.randrange(25), pick.randrange(25)) for _ in range(60)], [(0, 0), (0, 1), (1, 0)]]
    rounds = []
    monkeypatch.setattr(iterate, "stored", lambda df, *a, f=iterate.stored: rounds.append(1) or f(df, *a))
    for pairs in graphs:
        e = spark.createDataFrame(pairs, "source long, target long")
        s = spark.createDataFrame([(i,) for i in {a for a, _ in pairs} if i % 4] + [(0,), (999,), (None,)], "id long")
        for depth in (0, 1, 5, 64):
            want = set()
            for (start,) in s.where("id is not null").collect():
                seen, front = {start}, {start}
                for d in range(1, depth + 1):
                    front = {b for a, b in pairs if a in front} - seen
                    seen |= front
                    want |= {(start, x, d) for x in front}
            rounds.clear()
            got = [tuple(r) for r in iterate.reach(e, s, depth).collect()]
            assert sorted(got) == sorted(want) and len(rounds) < (12 if pairs == graphs[0] else 99)


def test_rounds_broadcast_no_stored_tables(spark, monkeypatch):
    """Tables of small files were broadcast in every round."""
    plans = []
    seen = lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, *a)
    kept = iterate.stored
    monkeypatch.setattr(iterate, "stored", seen)
    monkeypatch.setattr(iterate, "LOCAL_EDGES", 1)
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(i, i + 2) for i in range(0, 40, 5)], "source long, target long")
    assert iterate.depths(e, e.select(F.col("source").alias("id"))).where("id = 0").first().depth == 40
    assert len(plans) > 5 and [p for p in plans if "BroadcastHashJoin" in p] == []

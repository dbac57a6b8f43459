"""As-of joins, paths, tree scans and vector scores against brute force."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from skerry.operators import graph, iterate, search
from skerry.sources import tree


@pytest.mark.parametrize("ranges", [1, 7])
@pytest.mark.parametrize("inclusive", [False, True])
def test_enclosing_of_a_busy_key(spark, ranges, inclusive):
    draw = random.Random(3)
    marks = [("hot", draw.randrange(400), f"m{i}") for i in range(40)] + [("cold", 5, "c"), ("cold", None, "x"), (None, 1, "y"), ("cold", 6, None)]
    symbols = [("hot", draw.randrange(400), i) for i in range(600)] + [("cold", 5, 600), ("cold", 9, 601), ("cold", None, 602), (None, 3, 603), ("none", 1, 604)] + [("hot", 7, 605)] * 2
    s = spark.createDataFrame(symbols, "path string, line int, parent_id int")
    got = graph.enclosing(s, spark.createDataFrame(marks, "path string, line int, name string"), inclusive=inclusive, ranges=ranges)

    def parent(path, line):
        found = [(at, m) for p, at, m in marks if None not in (p, at, m, line) and p == path and (at <= line if inclusive else at < line)]
        return max(found)[1] if found else None

    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(((*r, parent(*r[:2])) for r in symbols), key=key)


def first_paths(edges, pairs, most):
    onward = {}
    for a, b in edges:
        onward.setdefault(a, set()).add(b)
    found = {}
    for a, b in pairs:
        fronts = [[a]]
        for _ in range(most):
            hits = [p for p in fronts if p[-1] == b]
            if hits:
                found[a, b] = min(hits)
                break
            fronts = [[*p, x] for p in fronts for x in onward.get(p[-1], ()) if x not in p]
    return found


@pytest.mark.parametrize("local", [0, 1000])
def test_paths_with_cycles_and_ties(spark, local):
    draw = random.Random(5)
    names = [f"n{i}" for i in range(14)]
    edges = [(draw.choice(names), draw.choice(names)) for _ in range(34)] * 2 + [("é", "n1"), (None, "n2"), ("n2", None)]
    pairs = list(itertools.product([*names[:8], "é"], names)) + [("n1", "n1"), ("gone", "gone"), ("n1", "gone")]
    for most in (1, 3, 9):
        got = iterate.shortest_paths(spark.createDataFrame(edges, "source string, target string"), spark.createDataFrame([*pairs, ("n1", None), (None, None)], "from string, to string"), most, local)
        assert {(r["from"], r["to"]): r.path for r in got.collect()} == first_paths([e for e in edges if None not in e], set(pairs), most)


@pytest.mark.parametrize("local", [0, 1000])
def test_paths_of_nothing(spark, local):
    none = spark.createDataFrame([], "source long, target long")
    assert iterate.shortest_paths(none, spark.createDataFrame([], "from long, to long"), 5, local).count() == 0
    assert [r.path for r in iterate.shortest_paths(none, spark.createDataFrame([(1, 2), (3, 3)], "from long, to long"), 5, local).collect()] == [[3]]


def test_tree_scan(spark, tmp_path):
    texts = {"a.py": "x = 1", ".git/b.ex": "y", "_own/c.ex": "", "deps/d.ex": "left out", "one/two/three/e.ts": "é\n", "one/f.bin": "no", "one/G.PY": "g"}
    rows = spark.createDataFrame(list(texts.items()), "path string, content string")
    folder = str(tmp_path / "tree")
    assert tree.write_files(rows, folder) == 7 and tree.write_files(rows, folder) == 7
    seen = lambda df: sorted((r.relative_path, r.content) for r in df.collect())
    kept = sorted((p, t) for p, t in texts.items() if p not in ("deps/d.ex", "one/f.bin"))
    for partitions in ("1", "3", "64"):
        assert seen(tree.scan_tree(spark, folder, partitions=partitions)) == kept
    assert seen(tree.scan_tree(spark, folder, hidden="false")) == [k for k in kept if not k[0].startswith(".")]
    assert seen(tree.scan_tree(spark, folder, folder)) == sorted(kept * 2)
    assert seen(tree.scan_tree(spark, f"file://{folder}/one", exclude='["G.*"]')) == [("two/three/e.ts", "é\n")]
    found = tree.scan_tree(spark, folder).where("language in ('python', 'elixir') and relative_path like 'one/%'")
    assert seen(found) == [("one/G.PY", "g")] and {r.size for r in found.collect()} == {1}
    os.makedirs(tmp_path / "empty")
    assert seen(tree.scan_tree(spark, str(tmp_path / "empty"))) == []


def test_vector_scores(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [2.0, 0.0]), ("c", None)], "id string, v array<double>")
    means = search.mean_vectors(rows, "id", "v")
    assert {r.id: r.v for r in means.collect()} == {"a": [0.5, 0.5], "b": [2.0, 0.0]}
    q = spark.createDataFrame([(1, [3.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0])], "query_id int, v array<double>")
    got = {(r.query_id, r.id): r.score for r in search.vector_scores(q, means, vector_col="v").collect()}
    assert got == {(1, "a"): pytest.approx(0.5**0.5), (1, "b"): pytest.approx(1.0)}


def test_usage_hits(spark):
    docs = spark.createDataFrame([("1", "calls to parse here"), ("2", "nothing")], "id string, content string")
    got = search.usage_hits(docs, spark.createDataFrame([("parse",)], "symbol string")).where(F.col("rank") == 1).first()
    assert (got.query_id, got.id) == ("parse", "1")


def test_source_files_are_dealt_to_all_cores(spark):
    from skerry.plans.base import files

    dealt = files(spark, "/root/testdata/sf0.001")
    assert dealt.where("content is not null and path like '%1%'").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_chunks_of_derived_files_send_no_text_to_the_driver(spark):
    from skerry.operators import chunking, extract

    names = spark.range(6).select(F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".py")).alias("path"), F.lit("python").alias("language"), "id")
    files = names.withColumn("content", F.when(F.col("id") == 0, "x = 1\n").when(F.col("id") == 1, None).otherwise("import os\n\ndef a():\n    pass\nclass B:\n    pass"))
    out = chunking.by_symbol(files, extract.symbols(files), ("function", "class"))
    got = sorted((tuple(r) for r in out.where("path < 'f3'").collect()), key=str)
    assert got == [
        ("f0.py", "section", None, 1, 2, "x = 1\n"), ("f1.py", "section", None, 1, 1, ""),
        ("f2.py", "class", "B", 5, 6, "class B:\n    pass"), ("f2.py", "function", "a", 3, 4, "def a():\n    pass"),
    ]
    whole = chunking.as_documents(chunking.hybrid(files, extract.symbols(files)))
    for plan in (out, whole):
        assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()


def test_module_contexts_send_no_derived_table_to_the_driver(spark):
    module = F.concat(F.lit("App.M"), F.col("id").cast("string"))
    content = F.concat(F.lit("defmodule "), module, F.lit(" do\nend"))
    hits = spark.range(4).select(F.col("id").alias("query_id"), content.alias("content"))
    questions = spark.range(4).select(F.col("id").alias("query_id"), F.lit("of m2").alias("query"))
    f = F.concat(module, F.lit(".get/1"))
    nodes = spark.range(4).select(module.alias("id"), F.lit("module").alias("type"), module.alias("name")).union(spark.range(4).select(f, F.lit("function"), F.lit("get/1")))
    edges = spark.range(4).select(module.alias("source"), f.alias("target"), F.lit("defines").alias("type")).union(spark.range(4).select(module, F.lit("Enum"), F.lit("imports")))
    out = search.module_contexts(hits, questions, nodes, edges)
    text = lambda i: f"Module App.M{i}:\n  - Imports: Enum\n  - Functions: App.M{i}.get"
    assert {(r.query_id, r.text) for r in out.collect()} == {(i, text(i)) for i in range(4)} | {(i, text(2)) for i in range(4)}
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kept", [0, 5, 1000])
def test_kept_places_are_the_best_of_all(monkeypatch, kept):
    """The best of two batches, of which the second leaves out what is worse than the best of the first."""
    import numpy as np

    monkeypatch.setattr(search, "KEPT", kept)
    draw = np.random.default_rng(kept)
    order = lambda x: (x[0], str(x[1]) if isinstance(x[1], str) else (bool(np.isnan(x[1])), x[1]))
    for names in (draw.permutation(60), draw.permutation(60).astype(str), np.where(np.arange(60) % 41 == 7, np.nan, draw.permutation(60))):
        best, every, found, sizes = search._Kept(7, 3), [], [], []
        for batch in (names[:40], names[40:]):
            best.begin(batch)
            assert best.merge() is None
            for _ in range(20):
                part = draw.integers(0, 7, 50), draw.integers(0, len(batch), 50), draw.integers(0, 4, 50) / 2
                best.add(*part)
                sizes.append(best.size)
                every += [(r, (-s, batch[c])) for r, c, s in zip(*part, strict=True)]
            rows, cols, score = best.merge()
            found += [(r, (-s, n)) for r, n, s in zip(rows, batch[cols], score, strict=True)]
        for row in range(7):
            first = lambda pairs: [str(x) for x in sorted((x for r, x in pairs if r == row), key=order)[:3]]  # noqa: B023, E731
            assert first(found) == first(every)
        assert kept > 100 or max(sizes) <= 150

"""Values pinned on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from skerry.operators import changes, chunking, classify, docs, evaluate, extract, graph, iterate, metrics, repositories, search
from skerry.streaming import metrics as stream


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def calls(spark, pairs):
    names = sorted({x for p in pairs for x in p})
    nodes = spark.createDataFrame([(n, "function", n) for n in names], "id string, type string, name string")
    return nodes, spark.createDataFrame([(*p, "calls") for p in pairs], "source string, target string, type string")


def test_retrieval_metrics(spark):
    runs = spark.createDataFrame([("q", i + 1, d) for i, d in enumerate("axbyc")], "query_id string, rank int, doc_id string")
    qrels = spark.createDataFrame([("q", d, 1) for d in "abc"], "query_id string, doc_id string, grade int")
    r = evaluate.retrieval_metrics(runs, qrels, 10).first()
    assert (r.recall, r.precision, r.mrr, r.hit_rate) == (1.0, 0.6, 1.0, 1.0)
    assert r.average_precision == pytest.approx((1 + 2 / 3 + 3 / 5) / 3)
    assert r.ndcg == pytest.approx((1 + 1 / math.log2(4) + 1 / math.log2(6)) / (1 + 1 / math.log2(3) + 1 / math.log2(4)))


def test_search_exact_and_partial(spark):
    d = spark.createDataFrame([("1", "user user user"), ("2", "some other content with user"), ("3", "users only"), ("4", None)], "id string, content string")
    q = spark.createDataFrame([("q", "user")], "query_id string, query string")
    got = {r.id: r.score for r in search.search(d, q).collect()}
    assert got["1"] == pytest.approx(math.log(4 / 2) + 1) and got["2"] == pytest.approx((math.log(2) + 1) / 5) and got["3"] == pytest.approx(0.1) and "4" not in got


def test_call_graph(spark):
    nodes, edges = calls(spark, [("a", "b"), ("b", "c")])
    start = nodes.where("id = 'a'")
    assert rows(graph.transitive_callees(edges, start, 0), "node") == [("b",)]
    assert rows(graph.transitive_callees(edges, start, 1), "node") == [("b",), ("c",)]
    assert rows(iterate.depths(edges, nodes)) == [("a", 2), ("b", 1), ("c", 0)]
    pair = spark.createDataFrame([("a", "c")], "from string, to string")
    assert iterate.shortest_paths(edges, pair, 3).first().path == ["a", "b", "c"] and iterate.shortest_paths(edges, pair, 2).count() == 0


def test_cycles(spark):
    nodes, edges = calls(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("p", "q"), ("q", "p"), ("z", "z")])
    assert rows(iterate.strong_components(edges)) == [("a", "a"), ("b", "a"), ("c", "a"), ("p", "p"), ("q", "p")]
    assert {r.id for r in iterate.depths(edges, nodes).where("depth is null").collect()} == set("abcxpqz")


def test_hub_and_cohesion(spark):
    nodes, edges = calls(spark, [("c1", "hub"), ("c2", "hub"), ("c3", "hub"), ("hub", "d1"), ("hub", "d2")])
    assert tuple(graph.hot_paths(nodes, edges, 1).first()) == ("hub", 3, 2, 5)
    m = spark.createDataFrame([("M", "module", "M"), ("f", "function", "f"), ("g", "function", "g"), ("h", "function", "h")], "id string, type string, name string")
    e = spark.createDataFrame([("M", x, "defines") for x in "fgh"] + [("f", "g", "calls"), ("g", "h", "calls"), ("f", "out", "calls")], "source string, target string, type string")
    assert tuple(graph.module_cohesion(m, e).first()) == ("M", 3, 2, 1, pytest.approx(2 / 3))


def test_repositories(spark):
    deps = spark.createDataFrame([("web", "core", None, "runtime"), ("web", "phoenix", "~> 1.7", "runtime"), ("api", "core", None, "runtime"), ("api", "phoenix", "~> 2.6", "runtime")], "repo string, dep string, version string, scope string")
    nodes, edges = repositories.repo_graph(spark.createDataFrame([("core",), ("web",), ("api",)], "repo string"), deps)
    assert rows(repositories.impact(nodes, edges)) == [("api", 0, 0, "low"), ("core", 2, 0, "critical"), ("web", 0, 0, "low")]
    assert rows(repositories.version_conflicts(deps), "dep", "listings") == [("phoenix", 2)]
    assert rows(repositories.upgrade_order(nodes, edges)) == [("api", 1), ("core", 0), ("web", 1)]


def test_extract_python_and_elixir(spark):
    python = "import os\nfrom a.b import (c, d as e)\n\nclass Admin(User):\n    async def fetch_user(self, id: int = 3, *args):\n        pass\n\ndef _validate(x):\n    return x\n"
    elixir = "defmodule MyApp.Parser do\n  alias MyApp.User, as: U\n  import Enum\n  def parse(x), do: x\n  defp hidden(a, b) when a > b, do: a\nend\n"
    files = spark.createDataFrame([("a.py", "python", python), ("p.ex", "elixir", elixir), ("x.rb", "ruby", "x")], "path string, language string, content string")
    assert rows(extract.symbols(files), "name", "type", "line", "visibility", "arity") == [
        ("Admin", "class", 4, "public", None), ("MyApp.Parser", "module", 1, "public", None), ("_validate", "function", 8, "private", 1),
        ("fetch_user", "function", 5, "public", 3), ("hidden/2", "function", 5, "private", 2), ("parse/1", "function", 4, "public", 1),
    ]
    assert rows(extract.references(files), "module", "type") == [("Enum", "import"), ("MyApp.User", "alias"), ("a.b", "from_import"), ("os", "import")]
    nodes, edges = extract.code_graph(files)
    assert ("MyApp.Parser.parse/1", "function") in rows(nodes, "id", "type") and ("MyApp.Parser", "Enum", "imports") in rows(edges, "source", "target", "type")
    assert rows(extract.unsupported(files)) == [("x.rb", "unsupported_language")]


def test_line_windows(spark):
    f = spark.createDataFrame([("f", "\n".join(str(i) for i in range(1, 61)))], "path string, content string")
    assert rows(chunking.line_windows(f, 1500, 200), "start_line", "end_line") == [(1, 25), (23, 47), (45, 60)]


def test_review(spark):
    bad = 'diff --git a/lib/a.ex b/lib/a.ex\n+++ b/lib/a.ex\n+password = "hunter2"\n+System.cmd("ls")\n-old'
    fine = "diff --git a/test/a_test.ex b/test/a_test.ex\n+ok"
    got = {r.diff_id: r for r in classify.review(spark.createDataFrame([(1, bad), (2, fine)], "diff_id int, diff string")).collect()}
    assert (got[1].security, got[1].status, got[2].status) == (2, "request_changes", "approved")


def test_changes_and_tables(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, hash string")
    assert rows(changes.detect_changes(old, new)) == [("b", "modified"), ("c", "deleted"), ("d", "added")]
    added, rejected = changes.add_rows(old, new, "path")
    assert added.count() == 4 and rejected.count() == 2


def test_docs(spark):
    f = spark.createDataFrame([("lib/a.ex", 'defmodule Aa do\n@moduledoc """\nFirst line\n"""\ndef f(x), do: x\nend'), ("lib/b.ex", "defmodule Bb do\nend"), ("test/a_test.exs", 'defmodule AaTest do\n test "x" do\n end\nend')], "path string, content string")
    assert rows(docs.modules(f), "module", "documented", "description") == [("Aa", True, "First line"), ("AaTest", False, ""), ("Bb", False, "")]
    assert rows(docs.untested_modules(f), "module") == [("Bb",)]


def test_metric_percentile_and_stream(spark, tmp_path):
    s = spark.createDataFrame([("m", float(v), f"2024-01-01 00:0{i}:00") for i, v in enumerate((100, 150, 200))], "name string, value double, t string").select("name", "value", F.to_timestamp("t").alias("ts"))
    assert metrics.histogram_summary(s).first().p50 == 150
    s.write.parquet(str(tmp_path / "in"))
    live = stream.windowed(spark.readStream.schema(s.schema).parquet(str(tmp_path / "in")))
    q = live.writeStream.outputMode("complete").format("memory").queryName("live_metrics").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("live_metrics")) == rows(stream.windowed(s))


def test_judged_documents_beyond_the_top_ten_count(spark, tmp_path):
    from skerry.plans import registry

    spark.createDataFrame([(i, "needle " + "hay " * i, "en", "s") for i in range(1, 21)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i in (1, 20)), 0) for i in range(1, 21)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "needle")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    r = registry.QUERIES["ir_metrics_judged"](spark, str(tmp_path)).first()
    assert (r.recall, r.average_precision, r.ndcg) == (0.5, 0.5, pytest.approx(1 / (1 + 1 / math.log2(3)), abs=1e-6))


def test_provider_states_hold_one_row_of_a_batch():
    """The rows of a provider came together in one frame."""
    import random

    import pandas as pd

    class State:
        exists, get = False, None

        def update(self, new):
            self.exists, self.get = True, new

    class Calls:
        columns = ["provider", "ts", "id", "ok"]

        def __getattr__(self, name):
            return lambda *a: setattr(self, "keep", a[0]) if name == "applyInPandasWithState" else self

    calls, pick, sizes, concat = Calls(), random.Random(1), [], pd.concat
    stream.provider_states(calls)
    pd.concat = lambda frames: sizes.append(sum(map(len, frames))) or concat(frames)
    try:
        for trial in range(60):
            state, n, failed, healthy = State(), 0, 0, True
            for _ in range(3):
                rows_ = [(pick.choice([None, pd.Timestamp(pick.randrange(5), unit="s")]), i, pick.random() < trial / 60) for i in range(pick.randrange(1, 12))]
                for _, _, ok in sorted(rows_, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
                    n, failed = n + 1, failed + (not ok)
                    healthy = True if ok else False if n >= 3 and failed / n > 0.5 else healthy
                pick.shuffle(rows_)
                frame = pd.DataFrame(rows_, columns=["ts", "id", "ok"]).astype({"ts": "datetime64[ns]"})
                out = next(calls.keep(("p",), iter([frame[i : i + 2] for i in range(0, len(frame), 2)]), state))
                assert out.iloc[0].tolist() == ["p", n, failed, healthy]
    finally:
        pd.concat = concat
    assert max(sizes) <= 3


def test_vectors_are_scored_a_few_at_a_time(spark, monkeypatch):
    import numpy as np

    v = np.random.default_rng(1).normal(size=(40, 3))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(98, None), (99, [0.0] * 3), (97, [1.0])], "id long, v array<double>")
    q = df.where("id % 10 = 0 or id > 90")
    want = sorted(tuple(r) for r in search.vector_top(df, q, 4, "id", "v", digits=6).collect())
    monkeypatch.setattr(search, "CELLS", 80)
    assert sorted(tuple(r) for r in search.vector_top(df, q, 4, "id", "v", digits=6).collect()) == want and len(want) == 17
    most = []
    monkeypatch.setattr(search, "_best", lambda s, ids, limit, f=search._best: most.append(s.size) or f(s, ids, limit))
    import pyarrow as pa

    batches = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema, f=type(df).mapInArrow: batches.append(run) or f(self, run, schema))
    search.vector_top(df, q, 4, "id", "v", digits=6)
    list(batches[0](iter([pa.RecordBatch.from_pylist([{"id": i, "v": x.tolist()} for i, x in enumerate(v)])])))
    assert max(most) <= 24

"""Files, sinks, streams and row steps on small data."""

import pytest
from pyspark.sql import functions as F

from skerry.operators import classify, docs, extract, graph, iterate, metrics, portfolio, search, steps
from skerry.sources import files
from skerry.streaming import metrics as stream


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_scan_and_listing(spark, tmp_path):
    for name, text in {"src/a/src/b.py": "def f():\n    pass", "src/c.ex": "x", "src/deps/d.ex": "x", "src/.hid/e.js": "x", "src/f.rb": "x"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    found = files.scan(spark, str(tmp_path / "src"))
    assert rows(found, "relative_path", "language") == [("a/src/b.py", "python"), ("c.ex", "elixir")]
    assert rows(files.scan(spark, str(tmp_path / "src"), languages=("elixir",)), "relative_path") == [("c.ex",)]
    assert rows(files.listing(found), "name", "extension") == [("b.py", ".py"), ("c.ex", ".ex")]
    with_hidden = found.unionByName(found.withColumn("relative_path", F.concat(F.lit(".hid/"), "relative_path")))
    assert files.listing(with_hidden).count() == 2 and files.listing(with_hidden, hidden=True).count() == 4
    assert rows(files.listing(with_hidden, hidden=True, limit=3), "truncated") == [(True,)] * 3
    assert files.from_list(spark, [str(tmp_path / "src/c.ex"), str(tmp_path / "src/f.rb")]).count() == 1
    big = spark.createDataFrame([("p", "x\n" * 600_000), ("q", "a\nb\nc")], "path string, content string")
    asked = spark.createDataFrame([("p", 1, 2), ("q", 2, None)], "path string, start_line int, end_line int")
    assert rows(files.line_range(big, asked), "path", "text", "error") == [("p", None, "file_too_large"), ("q", "   2 | b\n   3 | c", None)]


def test_round_trips(spark, tmp_path):
    state = spark.createDataFrame([("a", "h", 1, 2)], "path string, hash string, mtime long, size long")
    files.write_state(state, str(tmp_path / "state"))
    assert rows(files.read_state(spark, str(tmp_path / "state"))) == rows(state)
    cases = spark.createDataFrame([("q", "c\n1", "a", {"k": "v"})], files.CASE)
    files.write_cases(cases, str(tmp_path / "cases"))
    assert files.read_cases(spark, str(tmp_path / "cases")).collect() == cases.collect()
    repos = spark.createDataFrame([("r", None, "/p", "go", "library", None, None, None, None, None)], portfolio.REPO)
    repos.write.parquet(str(tmp_path / "repos"))
    kept = portfolio.read_repos(spark, str(tmp_path / "repos"), 5).first()
    assert (kept.name, kept.status, kept.tags) == ("r", "active", [])


def test_heads_over_lines_and_comments(spark):
    python = "class C(\n    Base,\n):\n    pass\n\nasync def f(\n    a,\n    b: int = 2,\n):\n    return a\n"
    script = "import {\n  one,\n  two as t\n} from 'x'\n// function ghost(q) {}\nclass A {} class B {}\nfunction *g(x) {}\n"
    df = spark.createDataFrame([("a.py", "python", python), ("b.js", "javascript", script), ("c.js", "javascript", None)], "path string, language string, content string")
    assert rows(extract.symbols(df), "name", "line", "arity") == [("A", 6, None), ("B", 6, None), ("C", 1, None), ("f", 6, 2), ("g", 7, 1)]
    assert [(r.module, r.line, [n.alias for n in r.names]) for r in extract.references(df).collect()] == [("x", 1, [None, "t"])]
    assert rows(extract.unsupported(df)) == [("c.js", "unreadable")]


def test_two_modules_in_a_file(spark):
    df = spark.createDataFrame([("lib/a.ex", 'defmodule A.B do\n@moduledoc "One"\nend\ndefmodule Cc do\n def f(x), do: x\nend')], "path string, content string")
    assert rows(docs.modules(df), "module", "description", "functions") == [("A.B", "One", 0), ("Cc", "", 1)]


def test_cycles_with_ties_and_loops(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("d", "d"), ("x", "a")], "source string, target string")
    assert rows(iterate.cycles(e).withColumn("path", F.array_join("path", ""))) == [("a", 2, "ab"), ("a", 3, "abc")]
    assert ("d", 1, "dd") in rows(iterate.cycles(e, closed=True, loops=True).withColumn("path", F.array_join("path", "")))
    assert iterate.cycles(e.where("source = 'x'")).count() == 0


def test_exact_percentiles(spark):
    values = [(n, float(v)) for n, top in (("a", 1000), ("b", 3), ("c", 1)) for v in range(top)] + [("d", None), ("e", 5.0), ("e", 5.0)]
    got = {r.name: (r.p50, r.p95) for r in metrics.percentiles(spark.createDataFrame(values, "name string, value double"), {"p50": 0.5, "p95": 0.95}).collect()}
    assert got == {"a": (499.0, 949.0), "b": (1.0, 2.0), "c": (0.0, 0.0), "e": (5.0, 5.0)}


def test_joins_give_what_products_give(spark, monkeypatch):
    d = spark.createDataFrame([(str(i), f"user{i % 3} item alpha{i % 5} us") for i in range(40)] + [("x", None)], "id string, content string")
    q = spark.createDataFrame([(k, t) for k, t in enumerate(("user us", "alpha1 item", "", "zzz"))], "query_id int, query string")
    want = rows(search.search(d, q, 5, digits=9))
    monkeypatch.setattr(search, "MATCH_BYTES", 0)
    assert rows(search.search(d, q, 5, digits=9)) == want and {r[0] for r in want} == {0, 1}


def test_error_policies(spark):
    df = spark.createDataFrame([(1, 2.0), (0, 1.0), (None, 3.0)], "n int, v double")
    step = lambda r: {"x": r["v"] / r["n"]}
    assert len(steps.apply_step(df.where("n is not null"), step, "x double").collect()) in (1, 2)
    bad = lambda r: {"x": 1 // int(r["n"])}
    kept = steps.apply_step(df.where("n is not null"), bad, "x int", "collect").collect()
    assert sorted((r.x, r.error is None) for r in kept if r.error is None) == [(1, True)] and any("ZeroDivisionError" in (r.error or "") and '"n":0' in r.item for r in kept)
    with pytest.raises(Exception, match="ZeroDivisionError"):
        steps.apply_step(df.where("n = 0"), bad, "x int", "raise").collect()
    with pytest.raises(ValueError):
        steps.apply_step(df, bad, "x int", "other")


def test_streams_keep_state_over_batches(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    one = spark.createDataFrame([("g", "t", 1.0, "2024-01-01 00:00:01"), ("g", "t", 9.0, "2024-01-01 00:00:00")], "name string, tag string, value double, s string").withColumn("ts", F.to_timestamp("s")).drop("s")
    two = one.withColumns({"value": F.lit(5.0), "ts": F.to_timestamp(F.lit("2023-12-31 00:00:00"))})
    three = one.withColumns({"value": F.lit(7.0), "ts": F.to_timestamp(F.lit("2024-01-02 00:00:00"))})
    seen = []
    (tmp_path / "in").mkdir()
    live = stream.latest_gauges(spark.readStream.schema(one.schema).parquet(str(tmp_path / "in")))
    for n, batch in enumerate((one, two, three)):
        batch.write.mode("append").parquet(str(tmp_path / "in"))
        q = live.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda df, b: seen.append((b, [r.value for r in df.collect()]))).start()
        q.awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [v for _, values in seen for v in values] == [1.0, 7.0]


def test_reviews_and_routes(spark):
    diffs = spark.createDataFrame([(1, "diff --git a/lib/a.ex b/lib/a.ex\n" + "+x\n" * 501)], "diff_id int, diff string")
    assert {r.rule for r in classify.comments(diffs).collect()} == {"size", "tests"}
    assert classify.change_summary(diffs).first().risk == "high"
    nodes = spark.createDataFrame([("m", "module", "m"), ("e", "external", "e")], "id string, type string, name string")
    edges = spark.createDataFrame([("m", "e", "imports")], "source string, target string, type string")
    rules = spark.createDataFrame([("x", "core", 1)], "prefix string, category string, rank int")
    assert tuple(graph.external_usage(nodes, edges, rules).first()) == ("e", 1, "other")


def test_index_stream_upserts_and_deletes(spark, tmp_path):
    kinds = "path string, language string, content string, version long, deleted boolean"
    make = lambda *rows: spark.createDataFrame([(p, "elixir", c, v, d) for p, c, v, d in rows], kinds)
    one = make(("a.ex", "defmodule A do\n  def f(x), do: x\nend", 1, False), ("a.ex", "defmodule A2 do\n  def g(x), do: x\nend", 2, False), ("b.ex", "defmodule B do\nend", 1, False), ("c.ex", "defmodule C do\nend", 5, False))
    two = make(("b.ex", None, 2, True), ("c.ex", "defmodule Old do\nend", 4, False), ("d.ex", "defmodule D do\nend", 1, False))
    final = make(("a.ex", "defmodule A2 do\n  def g(x), do: x\nend", 2, False), ("c.ex", "defmodule C do\nend", 5, False), ("d.ex", "defmodule D do\nend", 1, False))
    steps_, whole, small = (str(tmp_path / n) for n in ("steps", "whole", "small"))
    for n, batch in ((0, one), (1, two), (1, two), (0, one)):  # both come again
        stream.index_batch(steps_)(batch, n)
    stream.index_batch(whole)(final, 0)
    of = lambda folder: rows(stream.indexed(spark, folder), "path", "content", "hash")
    assert of(steps_) == of(whole) and {p for p, _, _ in of(steps_)} == {"a.ex", "c.ex", "d.ex"} and len(set(of(steps_))) == len(of(steps_))
    stream.compact(spark, steps_, small)
    assert of(small) == of(whole)
    stream.index_batch(small)(make(("b.ex", "defmodule Late do\nend", 1, False), ("d.ex", None, 3, True)), 2)
    assert {p for p, _, _ in of(small)} == {"a.ex", "c.ex"}


def test_steps_see_nulls_as_none_and_whole_numbers_as_int(spark):
    df = spark.createDataFrame([(1, 2.0, "x"), (None, None, None), (2**60 + 1, float("nan"), "y")], "n long, v double, s string")
    step = lambda r: {"x": f"{r['n']!r} {type(r['n']).__name__} {r['v']!r} {r['s']!r}"}
    assert rows(steps.apply_step(df, step, "x string")) == [("1 int 2.0 'x'",), (f"{2**60 + 1} int nan 'y'",), ("None NoneType None None",)]


def test_containing_equals_comparing_all_pairs(spark):
    import random

    pick = random.Random(2)
    words = sorted({"".join(pick.choice("abc") for _ in range(pick.randrange(2, 9))) for _ in range(150)} | {"ab", "ünal", "na", "naüna"})
    asked = words[::3] + ["zz", "abcabcabcabc", "xünalx"]
    got = search.containing(spark.createDataFrame([(w,) for w in words], "term string"), spark.createDataFrame([(w,) for w in asked], "q string"))
    assert rows(got) == sorted((w, q) for w in words for q in asked if w != q and (w in q or q in w))


def test_a_stored_index_gives_what_documents_give(spark, tmp_path):
    d = spark.createDataFrame([(i, f"user{i % 3} item alpha{i % 5} us", "en" if i % 2 else "de") for i in range(40)] + [(99, None, "en"), (98, "x" * 1_000_000 + " item", "en")], "doc int, body string, lang string")
    q = spark.createDataFrame([(1, "user us"), (2, "alpha1 item"), (3, "")], "query_id int, query string")
    index = search.build(d, str(tmp_path / "index"), id_col="doc", text_col="body")
    again = search.opened(spark, str(tmp_path / "index"))
    for where in (None, F.col("lang") == "en"):
        want = rows(search.search(d, q, 5, where=where, digits=9, id_col="doc", text_col="body"))
        assert want and rows(search.search(None, q, 5, where=where, digits=9, index=index)) == want == rows(search.search(None, q, 5, where=where, digits=9, index=again))
    assert rows(search.search(None, q, 5, where=F.col("lang") == "en", filter_first=False, index=again)) == rows(search.search(d, q, 5, where=F.col("lang") == "en", filter_first=False, id_col="doc", text_col="body"))


def test_words_meet_query_terms_inside_tasks(spark, monkeypatch):
    """A search makes no table of the vocabulary's words that hold query terms: it grows with the input and went through the driver."""
    import random

    pick = random.Random(5)
    word = lambda most: "".join(pick.choice("ab_1") for _ in range(pick.randrange(1, most)))
    d = spark.createDataFrame([(i, " ".join(word(9) for _ in range(pick.randrange(0, 30)))) for i in range(60)] + [(-1, None), (-2, "ab" * 5000)], "id long, content string")
    q = spark.createDataFrame([(i, " ".join(word(6) for _ in range(4))) for i in range(30)] + [(99, ""), (98, "ab" * 300 + " zz")], "query_id int, query string")
    with monkeypatch.context() as m:
        m.setattr(search, "MATCH_BYTES", 0)
        want = rows(search.search(d, q, 5, digits=6))
    monkeypatch.setattr(search, "containing", None)
    assert want and rows(search.search(d, q, 5, digits=6)) == want
    for name, small in {"PASS_PAIRS": 20, "BLOCK_PAIRS": 5, "QUERY_BLOCK": 3, "WORD_BLOCK": 40, "CELLS": 9, "DOC_BLOCK": 7}.items():
        monkeypatch.setattr(search, name, small)
    assert rows(search.search(d, q, 5, digits=6)) == want
    carried = search.scores(None, q, digits=6, index=search.build(d.withColumn("more", F.col("id") * 2)), carry=("more",))
    assert carried.where("more <> 2 * id").count() == 0 and carried.count() >= len(want)


def test_places_of_short_in_long_strings(monkeypatch):
    import random

    import pyarrow as pa

    monkeypatch.setattr(search, "CANDIDATES", 4)
    pick = random.Random(7)
    words = sorted({"".join(pick.choice("abc") for _ in range(pick.randrange(2, 9))) for _ in range(200)} | {"ab" * 40, "é_a", "na"})
    asked = words[::3] + ["zz", "abcabcabc", "xé_ab"]
    start, count, met, equal = search._met(pa.array(words), pa.array(asked), True)
    got = sorted((w, asked[met[p]], bool(equal[p])) for i, w in enumerate(words) for p in range(start[i], start[i] + count[i]))
    assert got == sorted((w, q, w == q) for w in words for q in asked if w in q or q in w)


def test_ideal_gains_of_many_judged_documents(spark):
    from skerry.operators import evaluate

    runs = spark.createDataFrame([("q", 1, "x"), ("q", 2, "d3"), ("r", 1, "y")], "query_id string, rank int, doc_id string")
    grades = [("q", f"d{i}", float(i % 4)) for i in range(60)] + [("q", "d3", 3.0), ("q", "n", None)]
    got = {r.query_id: r for r in evaluate.retrieval_metrics(runs, spark.createDataFrame(grades, "query_id string, doc_id string, grade double"), 5).collect()}
    import math

    gains = sorted((2.0**g - 1 for _, _, g in grades if g is not None), reverse=True)[:5]
    assert got["q"].ndcg == pytest.approx(2 * 7 / math.log2(3) / sum(g / math.log2(i + 2) for i, g in enumerate(gains)))
    assert got["q"].recall == pytest.approx(2 / sum(1 for _, _, g in grades if g)) and got["r"].recall == 0.0


def test_queries_with_shared_terms_are_scored_by_group(spark, monkeypatch):
    """Many queries that differ in one term only: no task scores every document for every one of them."""
    import random

    pick = random.Random(3)
    d = spark.createDataFrame([(i, f"tool{pick.randrange(12)} helper{i} mod" + " more" * (i % 2)) for i in range(300)] + [(7, "tool1 helper7"), (-1, None)], "id long, content string").repartition(3)
    q = spark.createDataFrame([(i, f"needs tool{i % 12} and helper{(i * 7) % 330}") for i in range(120)] + [(998, ""), (999, "tool1 tool1")], "query_id int, query string")
    with monkeypatch.context() as m:
        m.setattr(search, "_shared_sets", lambda asked: None)
        want = rows(search.search(d, q, 5, digits=6))
    monkeypatch.setattr(search, "_scorer", None)
    for name, small in {"SHARED": 3, "QUERY_BLOCK": 8, "SHARED_PAIRS": 100, "DOC_BLOCK": 7, "WORD_BLOCK": 40, "MOST_GROUPS": 40}.items():
        monkeypatch.setattr(search, name, small)
    got = rows(search.search(d, q, 5, digits=6))
    assert want and got == want
    monkeypatch.setattr(search, "SHARED", 1000)  # no term is shared
    assert rows(search.search(d, q.withColumn("query", F.concat(F.lit("helper"), "query_id")), 2, digits=6, index=search.build(d))) != []


def test_terms_with_a_common_start_are_not_compared_one_by_one():
    import pyarrow as pa

    terms = [f"helper{i}" for i in range(100, 20_100)]
    tree = search._Tree(search._spelt(pa.array(terms)))
    steps = []
    step = tree.step
    tree.step = lambda t, node, byte: steps.append(len(node)) or step(t, node, byte)
    i, j = search._inside(tree, search._spelt(pa.array(terms)))
    assert len(i) == sum(a[:n] in set(terms) for a in terms for n in range(9, len(a) + 1)) and sum(steps) < 40 * len(terms)


def test_source_reports_take_one_pass(spark):
    """Files were matched again for each report's part, and symbols twice for a filter."""
    from skerry.operators import extract

    ts = "import { a } from 'p';\nimport 'p';\nimport 'q';\nexport { x as y, z };\nexport default class {}\ntype T = 1;\nconst f = (a) => a;"
    files = [("a", "typescript", ts), ("a", "python", "import os\nclass A(B):\n    def f(self): pass"), (None, "python", "import re"), ("n", "python", None), ("r", "ruby", "puts"), ("e", "elixir", ""), ("l", None, "x")]
    f = spark.createDataFrame(files, "path string, language string, content string")
    found, used, made = extract.symbols(f), extract.references(f), extract.exports(f)
    mods = sorted({r.module for r in used.where("path = 'a'").collect()})
    names = sorted({r.name or "default" for r in made.collect()})
    deps = extract.file_dependencies(f)
    assert sorted((r.path or "", r.modules, r.exported) for r in deps.collect()) == [("", [], []), ("a", mods, names), ("a", mods, names), ("e", [], [])] and len(mods) == 3 and len(names) == 3
    counts = extract.type_counts(f)
    want = {("language", r[0]): r[1] for r in f.groupBy("language").count().collect()} | {("symbol", r[0]): r[1] for r in found.groupBy("type").count().collect()}
    want |= {("reference", r[0]): r[1] for r in used.groupBy("type").count().collect()} | {("file", "parsed"): 4, ("file", "failed"): 3}
    assert {(r.kind, r.type): r.n for r in counts.collect()} == want
    some = extract.symbols(f, extract.DEFINED)
    assert rows(extract.definitions(some), "name") == rows(extract.definitions(found), "name") and some.where("type = 'function'").count() == 0
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(deps) and plan(counts).count("LogicalRDD") + plan(counts).count("LocalRelation") == 1
    assert "defmacro" not in plan(some)
    assert "Filter (size(" not in plan(found)

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.llm.jaccard import jaccard_groups
from skerry.llm.vectors import near_vectors


def least_reachable(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingle_set(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def corpus():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    common = rnd.sample(words, 30)
    texts = []
    for _ in range(25):
        base = rnd.choices(words, k=rnd.choice([3, 4, 8, 20, 60, 150, 400]))
        for _ in range(rnd.choice([1, 1, 3, 9])):
            own = list(base)
            for _ in range(rnd.randrange(1 + len(own) // 40)):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            texts.append(" ".join(own + (common if rnd.random() < 0.3 else [])).title())
    return texts + texts[:5] + [None, "", " \t", "one", "ONE", "a b", "é é é é é é", "x " * 5000]


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_groups_match_brute_force(spark, width, percent):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumns({"row": F.lit("clash"), "n": F.lit(0)})
    got = sorted(tuple(r) for r in jaccard_groups(docs.repartition(3), width, percent).collect())
    sets = [shingle_set(t, width) for t in texts]
    edges = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] & sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    assert got == [(i, len(s), c) for i, (s, c) in enumerate(zip(sets, least_reachable(len(sets), edges), strict=True))]


def test_jaccard_empty_and_null_ids(spark):
    assert jaccard_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = jaccard_groups(spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (None, "z")], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == [("4", "4"), ("None", "4"), ("None", "None")]


def test_vectors_match_brute_force(spark):
    rnd = np.random.default_rng(1)
    base = rnd.normal(size=(30, 8))
    rows = [(i, [float(x) for x in np.float32(base[i % 30] * (1 + i % 3) + rnd.normal(size=8) * 0.06)], i % 2) for i in range(150)]
    rows += [(150, rows[3][1], 1), (151, rows[3][1], None), (152, None, 1), (153, [0.0] * 8, 1), (154, [1.0, None] * 4, 1), (155, [float("nan")] * 8, 1), (156, [], 1), (157, rows[3][1][:4], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit(1))
    fine = [v is not None and len(v) == 8 and all(x is not None and x == x for x in v) and any(v) and lab is not None for _, v, lab in rows]
    unit = [np.array(v, float) / np.linalg.norm(v) if ok else None for ok, (_, v, _) in zip(fine, rows, strict=True)]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if fine[i] and fine[j] and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.98]
    part = least_reachable(len(rows), edges)
    want = [(i, sum(i in e for e in edges), part[i], part[i] == i) for i in range(len(rows))]
    assert sorted(tuple(r) for r in near_vectors(df.repartition(3)).collect()) == want
    assert near_vectors(df.where("false")).count() == 0


def test_vectors_in_many_cells_meet_without_copies(spark, monkeypatch):
    """Blocks of many cells, of which some are near copies of one vector: links as by brute force, and no exchange where blocks meet."""
    from skerry.llm import vectors

    monkeypatch.setattr(vectors, "PER_PIVOT", 12)
    monkeypatch.setattr(vectors, "BLOCK", 8)
    plans = []
    pairs = vectors._pairs
    monkeypatch.setattr(vectors, "_pairs", lambda *a: plans.append(out := pairs(*a)) or out)
    rnd = np.random.default_rng(2)
    x = np.concatenate([rnd.normal(size=(250, 6)), np.ones((60, 6)) + rnd.normal(size=(60, 6)) * 0.1])
    x = np.concatenate([x, x[:80] * 3 + rnd.normal(size=(80, 6)) * 0.3])
    for kind in ("float", "double"):
        own = x.astype(np.float32 if kind == "float" else np.float64).astype(float)
        rows = [(i, v.tolist(), i % 2) for i, v in enumerate(own)]
        got = near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3))
        unit = own / np.linalg.norm(own, axis=1, keepdims=True)
        edges = [(i, j) for i in range(len(x)) for j in range(i) if (i - j) % 2 == 0 and unit[i] @ unit[j] >= 0.98]
        part, n = least_reachable(len(x), edges), np.bincount(np.array(edges).ravel(), minlength=len(x))
        assert len(edges) > 900 and sorted(tuple(r) for r in got.collect()) == [(i, n[i], part[i], part[i] == i) for i in range(len(x))]
    for plan in plans:
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in text and "Exchange" not in text


def test_links_of_blocks_by_tiles(monkeypatch):
    from skerry.llm import vectors

    rnd = np.random.default_rng(3)
    for spread in (0.05, 1.0):
        x, y = (vectors._unit(rnd.normal(size=5) + rnd.normal(size=(n, 5)) * spread) for n in (40, 33))
        for cells in (10, 200, 1 << 20):
            monkeypatch.setattr(vectors, "CELLS", cells)
            for a, b, same in ((x, y, False), (x, x, True)):
                got = [p for i, j in vectors._links(a, b, 0.9, same) for p in zip(i.tolist(), j.tolist(), strict=True)]
                want = [(i, j) for i in range(len(a)) for j in range(len(b)) if a[i] @ b[j] >= 0.9 and not (same and i >= j)]
                assert sorted(got) == want
    edges = rnd.integers(0, 200, (150, 2))
    root = np.arange(200)
    for some in np.array_split(edges, 5):
        root = vectors._joined(root, some[:, 0], some[:, 1])
    assert root.tolist() == least_reachable(200, edges.tolist())

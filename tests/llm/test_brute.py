"""Brute-force versions of the trained operators, the licence scan and the whole pipeline."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from skerry.llm import langid, licences, toxicity

from .test_joins import least_reachable, shingle_set
from .test_pipeline import write
from .test_rows import jump, leaf_shares

MASK = 2**64 - 1


def mixed(x):
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> shift)) * by & MASK
    return x


def gram_hash(gram):
    h = len(gram) * 0x1F3D5B79
    for c in gram:
        h = (h * 0x9E3779B97F4A7C15 + mixed((32 if c == " " else ord(c)) + 1)) & MASK
    h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & MASK
    return h ^ (h >> 32)


def grams(text, n):
    s = re.sub(" +", " ", " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " ")
    return [gram_hash(s[i : i + n]) for i in range(len(s) - n + 1)]


@pytest.mark.parametrize("at_once", [64, 2, 1])
def test_language_posteriors(spark, monkeypatch, at_once):
    monkeypatch.setattr(langid, "LANGUAGES_A_PASS", at_once)
    rows = [(0, "Der Hund, der bellt", "de"), (1, "the dog that barks", "en"), (2, "die Katze schläft", "de"), (3, "a cat", "en"), (4, "ein Tag am See", None), (5, "chat noir", "fr"), (6, "12 !", None), (7, None, "de"), (8, "the the the", None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    counts, texts = {}, Counter()
    for _, t, lang in rows:
        if t is not None and lang is not None:
            texts[lang] += 1
            counts.setdefault(lang, Counter()).update(h & (langid.FEATURES - 1) for n in langid.ORDERS for h in grams(t, n))
    want = {}
    for i, t, _ in rows:
        if not any(c.isalpha() for c in t or ""):
            want[i] = ("und", 0.0)
            continue
        score = {}
        for lang, c in sorted(counts.items()):
            total = sum(c.values()) + 0.5 * langid.FEATURES
            score[lang] = math.log(texts[lang] / sum(texts.values())) + sum(math.log((c[h & (langid.FEATURES - 1)] + 0.5) / total) for n in langid.ORDERS for h in grams(t, n))
        best = max(score, key=score.get)
        want[i] = (best, 1 / sum(math.exp(s - score[best]) for s in score.values()))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs.repartition(2), langid.fit(docs, F.lit(True))).collect()}
    assert {i: g[0] for i, g in got.items()} == {i: w[0] for i, w in want.items()}
    assert all(got[i][1] == pytest.approx(want[i][1], abs=1e-9) for i in want)


def toxic_score(model, text):
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    total = model.bias + sum(weight.get(h, 0.0) for n in toxicity.ORDERS for h in set(grams(text, n)))
    return 1 / (1 + math.exp(-max(-700, min(700, total))))


def test_toxicity_features_and_scores(spark):
    rows = [(i, f"you {'idiot' if i % 3 == 0 else 'garden'} number {i % 7} é", int(i % 3 == 0)) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(99, None)], "doc_id int, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id int, toxic int"))
    n, pos = Counter(), Counter()
    for _, t, y in rows:
        for h in {h for o in toxicity.ORDERS for h in grams(t, o)}:
            n[h] += 1
            pos[h] += y
    assert set(model.features.tolist()) == {h for h, c in n.items() if c >= 4}
    got = {r.doc_id: r.score for r in toxicity.score(docs.repartition(3), model).collect()}
    assert all(got[i] == pytest.approx(toxic_score(model, t), abs=1e-9) for i, t, _ in rows) and got[99] == pytest.approx(toxic_score(model, ""))
    # the weights are those of the ratio-scaled regression: its gradient is about zero
    ratio = {h: math.log((pos[h] + 1) / 22) - math.log((n[h] - pos[h] + 1) / 42) for h in model.features.tolist()}
    r = np.array([ratio[h] for h in model.features.tolist()])
    x = np.array([[float(h in {g for o in toxicity.ORDERS for g in grams(t, o)}) for h in model.features.tolist()] for _, t, _ in rows]) * r
    w, y = np.divide(model.weights, r, out=np.zeros_like(r), where=r != 0), np.array([y for *_, y in rows])
    p = 1 / (1 + np.exp(-(x @ w + model.bias)))
    assert np.abs(x.T @ (p - y) + 2.0 * w).max() < 0.05


TEMPLATES = [("A", "alpha beta gamma delta"), ("B", "epsilon zeta eta theta iota"), ("A", "kappa lambda"), ("C", "alpha beta mu")]


def words(text):
    return [w for w in re.split("[^a-z0-9]+", (text or "").lower()) if w]


def best_licence(text, threshold=0.75):
    """The greatest cosine of the text, its lines and all runs of its lines that are not blank."""
    df = Counter(w for _, t in TEMPLATES for w in set(words(t)))
    idf = lambda w: math.log((len(TEMPLATES) + 1) / (df[w] + 1)) + 1
    vector = lambda ws: {w: c * idf(w) for w, c in Counter(ws).items()}
    lines = [x for x in (text or "").split("\n") if words(x)]
    units = [("whole", words(text))] + [("part", [w for x in lines[i:j] for w in words(x)]) for i in range(len(lines)) for j in range(i + 1, len(lines) + 1)]
    found = []
    for kind, ws in units:
        v = vector(ws)
        for name, t in TEMPLATES:
            u = vector(words(t))
            norm = math.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in u.values()))
            c = round(sum(x * v.get(w, 0) for w, x in u.items()) / norm, 9) if norm else 0
            if c >= threshold:
                found.append((-c, name, kind))
    if not found:
        return None
    far, name, _ = min(found)
    return name, -far, any(n == name and k == "whole" for _, n, k in found)


@pytest.mark.parametrize("at_once", [5000, 2, 1])
def test_licences(spark, monkeypatch, at_once):
    monkeypatch.setattr(licences, "TEMPLATES_A_PASS", at_once)
    texts = ["alpha beta gamma delta", "x\nalpha beta\n\ngamma delta y\nz", "alpha beta mu", "epsilon zeta\neta theta iota", "alpha", "nothing here", None, "", "kappa\nlambda\nkappa lambda", "alpha beta gamma delta one two three four five", "q\nq\nkappa\nlambda"]
    files = [(i, f"{'abc'[i % 3]}/{'d/' * (i % 2)}{'LICENSE' if i % 4 == 0 else 'x.py'}{i if i % 4 else ''}", t) for i, t in enumerate(texts * 2)]
    own = {i: best_licence(t) for i, _, t in files}
    as_file = lambda i, p: own[i] is not None and (own[i][2] or re.search(r"(?i)(^|/)licen[cs]e(\.[a-z]+)?$", p))
    given = {}
    for i, p, _ in files:
        if as_file(i, p):
            d = p.rpartition("/")[0]
            given[d] = min(given.get(d, (9,)), (-own[i][1], p, own[i][0]))
    want = []
    for i, p, _ in files:
        d = p.rpartition("/")[0]
        if own[i]:
            want.append((i, own[i][0], "file" if as_file(i, p) else "line", own[i][1], d if as_file(i, p) else None))
            continue
        above = [d[:k] for k in range(len(d), -1, -1) if k == len(d) or d[k] == "/" or k == 0]
        near = next((a for a in above if a in given), None)
        want.append((i, given[near][2], "inherited", -given[near][0], near) if near is not None else (i, None, None, None, None))
    df = spark.createDataFrame(files, "doc_id int, p string, text string")
    table = spark.createDataFrame(TEMPLATES, "licence string, text string")
    got = licences.scan(df, F.col("p"), table).select("doc_id", "licence", "how", "cosine", "from_dir").collect()
    assert sorted(map(tuple, got)) == want


def test_run_matches_brute_force(spark, tmp_path):
    write(spark, str(tmp_path))
    read = lambda t: spark.read.parquet(f"{tmp_path}/{t}.parquet")
    docs = [tuple(r) for r in read("documents").collect()]
    model = toxicity.fit(read("documents"), read("labels"))
    docs = [d for d in docs if toxic_score(model, d[1]) < 0.5]
    sets = [shingle_set(d[1], 5) for d in docs]
    edges = [(i, j) for i in range(len(docs)) for j in range(i) if sets[i] & sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    groups = {}
    for d, g in zip(docs, least_reachable(len(docs), edges), strict=True):
        groups.setdefault(g, []).append(d)
    docs = [min(g) for g in groups.values()]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    windows = {tuple(w[s : s + 10]) for r in read("benchmark").collect() for w in [split(r.text)] for s in range(max(1, len(w) - 9))}
    docs = [d for d in docs if not any(tuple(split(d[1])[s : s + len(w)]) == w for w in windows for s in range(len(split(d[1]))))]
    tokens = lambda d: len((d[1] or "").split())
    leaf = lambda d: ("null" if d[3] is None else f"domain{int(d[3][3:]) % 4}", d[2] or "null", d[3] or "null")
    leaves = Counter()
    for d in docs:
        leaves[leaf(d)] += tokens(d)
    tree = {"kids": {}}
    for path, n in leaves.items():
        at = tree
        for k, name in enumerate(path, 1):
            at = at["kids"].setdefault(name, {"kids": {}, "w": sum(v for p, v in leaves.items() if p[:k] == path[:k]) ** 0.8})
        at["tokens"] = n
    budgets = {p: math.floor(v + 1e-6) for p, v in leaf_shares(tree, 1.5 * sum(leaves.values()), 4).items()}
    want = []
    for path, n in leaves.items():
        own, budget = [d for d in docs if leaf(d) == path], budgets[path]
        for epoch in range(budget // n + 1 if n else 0):
            key = lambda d, e=epoch: int(hashlib.md5(f"7|{e}|{d[0]}".encode()).hexdigest()[:12], 16) >> 3
            used, left = 0, n if epoch < budget // n else budget % n
            for d in sorted(own, key=key):
                if epoch < budget // n or used < left:
                    want.append((d[0], jump(xxhash.xxh64(str(d[0]).encode(), seed=42).intdigest(), corpus_pipeline.SHARDS)))
                    used += tokens(d)
    got = [(r.doc_id, r["shard"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    write(spark, f"{tmp_path}/full")
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/full/{t}.parquet").where("false").write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_toxicity_keeps_the_labels_shares_when_the_sample_is_bounded(spark):
    import random

    from skerry.llm import toxicity

    pick = random.Random(1)
    words = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor".split()
    rows = [(i, " ".join(pick.choice(words) for _ in range(25)), int(pick.random() < 0.033)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    means = [toxicity.score(docs, toxicity.fit(docs, docs, rows_per_class=n)).agg({"score": "avg"}).first()[0] for n in (4000, 100)]
    assert abs(means[0] - 0.033) < 0.01 and abs(means[0] - means[1]) < 0.02, means


def test_toxicity_learns_from_long_labelled_texts(spark):
    from skerry.llm import toxicity

    calm, rude = "quiet words of peace " * 40_000, "rotten filthy insult here " * 40_000  # each over one piece
    rows = [(i, (calm if i % 2 else rude) + f" {i}", 1 - i % 2) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    model = toxicity.fit(docs, docs)
    asked = spark.createDataFrame([(1, "rotten filthy insult here"), (2, "quiet words of peace")], "doc_id long, text string")
    score = dict(toxicity.score(asked, model).select("doc_id", "score").collect())
    assert score[1] > 0.5 > score[2]

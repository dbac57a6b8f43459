import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.llm import decontaminate, langid, licences, mixing, queries, sharding, toxicity


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_and_slots(spark):
    keys = np.array([0, 1, -5, 2**62, -(2**63)], np.int64)
    assert sharding.jump(keys, 10).tolist() == [jump(int(k) % 2**64, 10) for k in keys]
    docs = spark.createDataFrame([(i % 90, "é" * (i % 4) if i % 9 else None) for i in range(300)] + [(None, "x")] * 3, "doc_id int, text string").withColumn("shard", F.lit("clash")).repartition(5)
    rows = sharding.shard_slots(docs, 16).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert len(rows) == 303 and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert {r.size for r in rows if r.doc_id is None} == {2} and all(r.text_crc32 == zlib.crc32(("é" * ((r.size - 1) // 2)).encode()) for r in rows if r.doc_id is not None)
    assert len({(r.doc_id, r.shard) for r in rows}) == 91 and sharding.shard_slots(docs.where("false"), 16).count() == 0


def leaf_shares(tree, budget, epochs):
    """Brute force: pour by weight, freeze what is full, again."""

    def cap(n):
        return n["tokens"] * epochs if "tokens" in n else sum(map(cap, n["kids"].values()))

    def pour(n, b):
        if "tokens" in n:
            return {(): b}
        open_, got = dict(n["kids"]), dict.fromkeys(n["kids"], 0.0)
        left = b
        while open_ and left > 1e-9:
            w = sum(k["w"] for k in open_.values())
            full = {x: k for x, k in open_.items() if cap(k) <= left * k["w"] / w}
            for x, k in (full or open_).items():
                got[x] = cap(k) if full else left * k["w"] / w
            if not full:
                break
            left -= sum(cap(k) for k in full.values())
            open_ = {x: k for x, k in open_.items() if x not in full}
        return {(x, *path): v for x, k in n["kids"].items() for path, v in pour(k, got[x]).items()}

    return pour(tree, budget)


def test_budgets(spark):
    leaves = [("a", "en", "s1", 100), ("a", "en", "s2", 10), ("a", "fr", "s1", 5), ("b", "en", "s3", 400), ("b", "de", "s4", 1)]
    weights = {1: {("a",): 3, ("b",): 1}, 2: {("a", "en"): 1, ("a", "fr"): 1, ("b", "en"): 2, ("b", "de"): 5}, 3: {("a", "en", "s1"): 1, ("a", "en", "s2"): 4, ("a", "fr", "s1"): 1, ("b", "en", "s3"): 1, ("b", "de", "s4"): 1}}
    tree = {"kids": {}}
    for *path, n in leaves:
        at = tree
        for depth, name in enumerate(path, 1):
            at = at["kids"].setdefault(name, {"kids": {}, "w": weights[depth][tuple(path[:depth])]})
        at["tokens"] = n
    tables = {level: spark.createDataFrame([(*k, float(v)) for k, v in weights[d].items()], [*mixing.TREE[:d], "weight"]) for d, level in enumerate(mixing.TREE, 1)}
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    for budget in (50, 300, 700, 5000):
        got = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(df, tables, budget, 2).collect()}
        assert got == {k: math.floor(v + 1e-6) for k, v in leaf_shares(tree, budget, 2).items()}


def test_target_weights_fall_short_at_all_levels(spark):
    share = {"en": 62, "de": 15, "fr": 14, "es": 9}
    leaves = [(f"domain{n % 4}", lang, f"src{n}", 100 * k) for n in range(20) for lang, k in share.items()] + [("null", "null", "null", 50)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    budget = 1.5 * sum(x[-1] for x in leaves)
    weigh = lambda table, name: table.get(name, 1)
    tree = {"kids": {}}
    for domain, lang, source, n in leaves:
        d = tree["kids"].setdefault(domain, {"kids": {}, "w": weigh(queries.DOMAIN_WEIGHTS, domain)})
        at = d["kids"].setdefault(lang, {"kids": {}, "w": weigh(queries.LANG_WEIGHTS, lang)})
        at["kids"][source] = {"tokens": n, "w": weigh(queries.SOURCE_WEIGHTS, str(int(source[3:]) % 5) if source != "null" else None)}
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(df, queries.target_weights(df), budget, 4).collect()}
    assert got == {k: math.floor(v + 1e-6) for k, v in leaf_shares(tree, budget, 4).items()}
    full = {tuple(x[:3]) for x in leaves if got[tuple(x[:3])] == 4 * x[3]}
    whole = lambda *path: all(tuple(x[:3]) in full for x in leaves if tuple(x[: len(path)]) == path)
    assert whole("domain0") and not whole("domain1")  # a domain, whose rest its siblings have
    assert whole("domain1", "de") and not whole("domain1", "en")  # a language
    assert ("domain1", "es", "src5") in full and not whole("domain1", "es")  # a leaf


def test_mix_prefix(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7), "x" if i < 60 else None, i) for i in range(80)], "doc_id long, text string, lang string, n long")
    out = mixing.mix(docs, {"domain": F.lit("d"), "lang": F.col("lang"), "source": F.lit(None)}, budget_ratio=0.6, power=1.0, max_epochs=1)
    assert out.columns == [*docs.columns, "_mix"]
    key = lambda i: int(hashlib.md5(f"7|0|{i}".encode()).hexdigest()[:12], 16) >> 3
    rows = out.collect()
    for lang in ("x", None):
        ids = sorted((i for i in range(80) if (i < 60) == (lang == "x")), key=key)
        budget, used, want = next(r._mix.leaf_budget for r in rows if r.lang == lang), 0, set()
        for i in ids:
            if used >= budget:
                break
            want.add(i)
            used += i % 7
        assert {r.doc_id for r in rows if r.lang == lang} == want
    assert mixing.mix(docs.where("false"), {"domain": F.lit("d"), "lang": F.col("lang"), "source": F.lit("s")}).count() == 0


def test_contamination(spark):
    item = " ".join(f"q{i}" for i in range(14))
    items = spark.createDataFrame([("1", item), ("2", "Short one!"), ("10", "a b c d e f g h i j"), (None, "zz"), ("5", None), ("6", "...")], "item_id string, text string")
    texts = [item, "x " + item.upper().replace(" ", ", ") + " y", " ".join(item.split()[:9]), "a short ONE here", "a b c d e f g h i j k a b c d e f g h i j", None, "", "zz", "short", "q " * 3000 + item, "short one short one"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(0, item, "clash")], "doc_id int, text string, words string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    wins = {(i, tuple(w[s : s + 10])) for i, t in [tuple(r) for r in items.collect()] for w in [split(t)] if w for s in range(max(1, len(w) - 9))}
    want = []
    for i, t in [*enumerate(texts), (0, item)]:
        w = split(t)
        met = [(n, s, len(x)) for n, x in wins for s in range(len(w) - len(x) + 1) if tuple(w[s : s + len(x)]) == x]
        hit = {p for _, s, n in met for p in range(s, s + n)}
        want.append((i, len(w), len(hit), ",".join(sorted({n for n, _, _ in met if n})), bool(hit)))
    got = decontaminate.contamination(docs, items).select("id", "n_words", "n_hit", F.array_join("items", ","), "contaminated").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == sorted(i for i, *_, bad in want if not bad)
    assert decontaminate.clean(docs, items.where("false")).count() == docs.count() and decontaminate.contamination(docs.where("false"), items).count() == 0


def test_language(spark):
    rows = [(i, ("the quick brown fox " if i % 2 else "der schnelle braune fuchs ") * (1 + i % 3), "en" if i % 2 else "de") for i in range(40)] + [(90, None, "en"), (91, "12 !", "en"), (92, "the fox", None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.fit(docs, F.col("doc_id") < 30)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    assert all(got[i][0] == ("en" if i % 2 else "de") for i in range(40)) and got[92][0] == "en" and got[90] == got[91] == ("und", 0.0)
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(docs, F.lit(False))).collect()} == {"und"}


def test_toxicity(spark):
    rows = [(i, f"you are such an idiot person{i}" if i % 3 == 0 else f"what a lovely garden number{i}", int(i % 3 == 0)) for i in range(120)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(200, None), (201, "")], "doc_id int, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 90] + [(None, 1), (5, None)], "doc_id int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert all(got[i].predicted == t for i, _, t in rows) and 0 <= got[200].score == got[201].score <= 1
    assert {r.predicted for r in toxicity.score(docs, toxicity.fit(docs, labels.where("false"))).collect()} == {0}


def test_licences(spark):
    rows = [("a/LICENSE", "Intro\nReleased under the MIT License.\n"), ("a/b/x.py", "code"), ("a/b/y.py", "Licensed under the Apache License, Version 2.0."), ("c/z.py", "nothing"), (None, "x"), ("a/n.py", None), ("a/m.py", "the license of this text is long and says nothing of the sort at all"), ("c/x/q", "text before\nLicensed under CC BY-NC 4.0.\nafter")]
    files = spark.createDataFrame([(i, *r, 1) for i, r in enumerate(rows)], "doc_id int, p string, text string, licence int")
    got = {r.doc_id: (r.licence, r.how, r.from_dir) for r in licences.scan(files, F.col("p")).collect()}
    assert got == {0: ("MIT", "file", "a"), 1: ("MIT", "inherited", "a"), 2: ("Apache-2.0", "file", "a/b"), 3: (None, None, None), 4: (None, None, None), 5: ("MIT", "inherited", "a"), 6: ("MIT", "inherited", "a"), 7: ("CC-BY-NC-4.0", "line", None)} or got[1] == ("Apache-2.0", "inherited", "a/b")
    assert got[7] == ("CC-BY-NC-4.0", "line", None) and got[0] == ("MIT", "file", "a") and got[3][0] is None and got[5] == ("MIT", "inherited", "a")
    assert licences.scan(files.where("false"), F.col("p")).count() == 0


def test_wrapped_licences(spark):
    gpl = "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.\n"
    bsd = "# Redistribution and use in source and binary forms, with or without\n#\n# modification, are permitted provided that the following conditions\r\n# are met:\n"
    narrow = "\n".join(licences.TEMPLATES[7][1].split())
    code = "\n".join(f"def f{i}(x):\n    return x + alpha{i} * beta{i} - gamma{i}" for i in range(60))
    apart = gpl.replace("\n", "\n" + code + "\n")
    texts = [gpl + code, bsd + code, code + "\n" + narrow + "\n" + code, code + "\n" + gpl, apart, code, code + "\n" + gpl + code + "\n" + gpl]
    files = spark.createDataFrame([(i, f"d{i}/x.py", t) for i, t in enumerate(texts)], "doc_id int, p string, text string")
    got = {r.doc_id: (r.licence, r.how) for r in licences.scan(files, F.col("p")).collect()}
    wrapped = ("GPL-3.0", "line")
    assert got == {0: wrapped, 1: ("BSD-3-Clause", "line"), 2: wrapped, 3: wrapped, 4: (None, None), 5: (None, None), 6: wrapped}
    kept = licences.scan(files.where("doc_id = 2"), F.col("p")).first()
    assert kept.cosine == 1.0

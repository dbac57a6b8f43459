import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skerry.llm import phrases


def brute(rows, least, top, covered=50):
    """All counts by plain loops."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            if any(100 * b >= covered * a for (lg, q), b in f.items() if lg == lang and len(p) == 2 and len(q) == 3 and b >= least and (q[:2] == p or q[1:] == p)):
                continue
            cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, rows in found.items() for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top])}


def texts(seed, size):
    pick = random.Random(seed)
    words = "the of and to a in is it you that he was for on are with as I his they Ünal naïve ½ x".split()
    out = []
    for _ in range(size):
        body = [pick.choice(words[: pick.choice([3, 8, 24])]) + pick.choice(["", "", "", "", ",", ".", "\n", "\t", "!? "]) for _ in range(pick.randrange(60))]
        out.append((pick.choice(["en", "de", None, "und"]), " ".join(body)))
    return [*out, (None, None), ("en", ""), ("en", " \t "), ("fr", "nothing twice here"), *[("en", "the very same passage of words, again")] * 40]


# group sizes that keep all words whole, split frequent words, and split frequent pairs too
@pytest.mark.parametrize("group_suffixes", [phrases.GROUP_SUFFIXES, 300, 20])
def test_equals_brute_force(spark, group_suffixes, monkeypatch):
    rows = texts(7, 300)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5).withColumns({c: F.lit("clash") for c in ("t", "word", "n", "group", "t1")})
    got = phrases.collocations(docs, least=4, top=50, group_suffixes=group_suffixes)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in got.collect()} == brute(rows, 4, 50)


def test_long_texts_are_cut_between_words(spark):
    part = "alpha beta gamma, delta alpha beta gamma " * 9
    rows = [("en", part * 8000 + "tail"), ("en", "y" * 3_000_000 + " alpha beta")]
    assert len(rows[0][1]) > 2_900_000
    got = phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), least=10)
    assert {tuple(r) for r in got.collect()} == brute(rows, 10, 2000)


def test_large_numbers_and_empty_table(spark):
    a, left, right = 4_000_000_000_000_000, 9_000_000_000_000_007, 5_000_000_000_000_003
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(phrases._score(F.col("a"), F.col("l"), F.col("r"))).first()
    assert row[0] == 1_000_000 * a * a // (left * right)
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []

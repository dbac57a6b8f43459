import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from skerry.llm.katz import discounts, katz_scores

TEXTS = [
    (0, "the cat sat on the mat. the cat ran", 1), (1, "The CAT sat on a mat", 1), (2, "a dog sat on the cat", 0), (3, None, 1), (4, "", 0),
    (5, "unknown words only", 0), (6, "the the the the the the the the", 1), (7, "a\tdog\x0bran é ü", 1), (7, "a\tdog\x0bran é ü", 1), (8, "the cat " * 400, 1),
]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) + [None]


def brute(rows, order, k=5):
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for _, text, train in rows:
        w = words(text)
        for i, x in enumerate(w if train else []):
            for n in range(1, order + 1):
                counts[n][tuple(["<s>"] * max(0, n - 1 - i) + w[max(0, i - n + 1) : i])][x] += 1
    d = [None]
    for n in range(1, order + 1):
        all_counts = Counter(c for by in counts[n].values() for c in by.values())
        d.append(discounts([all_counts[r] for r in range(1, k + 2)], k))

    def prob(n, h, x):
        if n == 0:
            return 1.0
        by, lower = counts[n].get(h), prob(n - 1, h[1:], x) if n > 1 else 1.0
        if not by:
            return lower
        total = sum(by.values())
        dis = lambda c: d[n][c] if c <= k else 1.0
        left = 1 - sum(dis(c) * c for c in by.values()) / total
        if left < 1e-12:
            total, left = total + 1, 1 / (total + 1)
        if x in by:
            return dis(by[x]) * by[x] / total
        seen = sum(prob(n - 1, h[1:], y) for y in by) if n > 1 else 0.0
        return left / (1 - seen) * lower

    vocabulary = set(counts[1][()])
    for n in range(1, order + 1):
        for h in counts[n]:
            assert abs(sum(prob(n, h, x) for x in vocabulary) + prob(n, h, "\0never") - 1) < 1e-9
    total, types = sum(counts[1][()].values()), len(vocabulary)
    out = []
    for i, text, _ in rows:
        w = words(text)
        hist = lambda j: tuple(["<s>"] * max(0, order - 1 - j) + w[max(0, j - order + 1) : j])
        c = [counts[1][()][x] for x in w]
        out.append((i, len(w), sum(x > 0 for x in c), total, sum(math.log10((x + 0.5) / (total + 0.5 * (types + 1))) for x in c), sum(math.log10(prob(order, hist(j), x)) for j, x in enumerate(w))))
    return sorted(out)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_matches_brute_force(spark, order):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, t int").withColumns({"score": F.lit(1), "block": F.lit("x")})
    got = sorted(tuple(r) for r in katz_scores(docs.repartition(3), F.col("t") == 1, order=order).scores.select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect())
    for a, b in zip(got, brute(TEXTS, order), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-9)


def test_empty_table_and_no_training(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, t int")
    assert katz_scores(docs.where("false"), F.lit(True)).scores.count() == 0
    rows = katz_scores(docs, F.lit(None).cast("boolean")).scores.collect()
    assert len(rows) == len(TEXTS) and all(r.score == 0 and r.n_known == 0 for r in rows)


def test_model_table_holds_all_counts(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, t int")
    out = katz_scores(docs, F.col("t") == 1)
    n = sum(len(words(t)) for _, t, x in TEXTS if x)
    assert [out.model(spark, o).agg(F.sum("count")).first()[0] for o in (1, 2)] == [n, n]

import random

import pytest
from pyspark.sql import functions as F

from skerry.llm.lines import line_duplicates, without_duplicate_lines


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    """Removed lines by (id, text): an equal or near line earlier by (id, row, line)."""
    texts = sorted({(i, t) for _, i, t in rows}, key=lambda x: (x[0] is not None, x[0] or 0))
    lines = []
    row_of = {(i, t): r for r, i, t in rows}
    for i, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, row_of[x])):
        lines += [(i, t, k, x.strip().lower()) for k, x in enumerate((t or "").split("\n")) if x.strip()]
    out = {}
    for at, (i, t, k, x) in enumerate(lines):
        out.setdefault((i, t), [0, []])[0] += 1
        if any(within_one(x, y[3]) for y in lines[:at]):
            out[i, t][1].append(k)
    return out


def fixture(kind):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("ab é") for _ in range(n)) for n in (1, 2, 3, 7, 8, 9, 15, 16, 17, 40)]
    docs = []
    for i in range(40):
        lines = []
        for _ in range(rnd.randrange(6)):
            x = rnd.choice(base)
            for _ in range(rnd.randrange(3)):
                p = rnd.randrange(len(x) + 1)
                x = rnd.choice([x[:p] + x[p + 1 :], x[:p] + "z" + x[p:], x[:p] + "y" + x[p + 1 :]])
            lines.append(x)
        docs.append((i if i % 7 else None, "\n".join(lines)))
    docs += [(50, None), (51, ""), (52, "\n \n\t"), (3, docs[3][1]), (60, "x" * 30_000), (61, "x" * 30_000 + "y"), (62, "A Line\na line\nA LINE!")]
    return docs


def test_matches_brute_force(spark):
    docs = spark.createDataFrame(fixture(0), "doc_id long, text string")
    keyed = [tuple(r) for r in docs.select(F.xxhash64("doc_id", "text"), "doc_id", "text").collect()]
    want = {next(r for r, i, t in keyed if (i, t) == key): tuple(v) for key, v in brute(keyed).items()}
    got = {r.row: (r.n_lines, r.removed) for r in line_duplicates(docs.repartition(3)).collect()}
    assert got == want


def test_texts_lose_only_duplicates(spark):
    docs = spark.createDataFrame([(1, "a b c d\nkeep this"), (2, "a b c e\n\nother words"), (3, None)], "doc_id long, text string").withColumns({"row": F.lit(1), "n_lines": F.lit("clash")})
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in without_duplicate_lines(docs).collect()}
    assert got == {1: ("a b c d\nkeep this", 2, 0), 2: ("\nother words", 2, 1), 3: (None, 0, 0)}


def test_empty_table(spark):
    assert without_duplicate_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0

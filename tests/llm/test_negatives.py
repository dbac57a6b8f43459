import math
import random

import pytest
from pyspark.sql import functions as F

from skerry.llm import negatives

KINDS = "vec_id long, embedding array<double>, label int"


def brute(rows, is_anchor, scale=256):
    good = [(i, lb, [math.floor(scale * x) for x in v]) for i, v, lb in rows if None not in (i, v, lb) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, lb, a in good:
        if is_anchor(i):
            score = [(-sum(x * y for x, y in zip(a, b)), j, other) for j, other, b in good if j != i and len(a) == len(b)]
            for p, pid, _ in sorted(s for s in score if s[2] == lb)[:5]:
                near = sorted(s for s in score if s[2] != lb and -80 * p <= -100 * s[0] <= -100 * p)[:5]
                out += [(i, pid, rank + 1, nid, -p, -n) for rank, (n, nid, _) in enumerate(near)]
    return sorted(out)


def vectors(seed, size, spread=1.0):
    pick = random.Random(seed)
    centres = [[pick.gauss(0, spread) for _ in range(20)] for _ in range(4)]
    return [(i, [c + pick.gauss(0, spread / 2) for c in centres[pick.randrange(4)]], pick.randrange(3)) for i in range(size)]


@pytest.mark.parametrize("block,pass_bytes", [(4096, negatives.PASS_BYTES), (16, 500)])
def test_equals_brute_force(spark, monkeypatch, block, pass_bytes):
    monkeypatch.setattr(negatives, "BLOCK", block)
    rows = vectors(3, 300)
    rows += [(900, None, 1), (901, [1.0] * 20, None), (902, [None] * 20, 1), (903, [math.nan] * 20, 1), (904, [math.inf] * 20, 2), (None, [1.0] * 20, 1), (905, [0.5] * 3, 1), (906, [0.5] * 3, 2), (907, [], 1), (908, [], 2)]
    rows += [(910, rows[7][1], 0), (911, rows[7][1], 1), (911, rows[7][1], 1), (910, rows[7][1], 0), (920, [0.0] * 20, 1)]  # repeats, ties and zeros
    docs = spark.createDataFrame(rows, KINDS).repartition(4).withColumns({c: F.lit("clash") for c in ("id", "n", "vector", "query", "window", "anchor")})
    got = negatives.hard_negatives(docs, F.col("vec_id") % 10 == 0, pass_bytes=pass_bytes)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 10 == 0)


def test_large_components_are_exact(spark):
    rows = [(i, [x * 2.0**18 for x in v], lb) for i, v, lb in vectors(5, 60)]
    got = negatives.hard_negatives(spark.createDataFrame(rows, KINDS), F.col("vec_id") % 10 == 0)
    want = brute(rows, lambda i: i % 10 == 0)
    assert max(abs(r[4]) for r in want) > 2**53 and sorted(map(tuple, got.collect())) == want


def test_empty_tables_and_no_anchors(spark):
    rows = spark.createDataFrame(vectors(1, 5), KINDS)
    assert negatives.hard_negatives(rows.where("false"), F.lit(True)).collect() == []
    assert negatives.hard_negatives(rows, F.lit(False)).collect() == []


def test_the_bitmap_shrinks(spark):
    """Far rows leave before all dimensions are read; near ones stay."""
    import numpy as np

    x = np.zeros((3, 64))
    x[0, :8], x[1, :8], x[2] = 100, 90, -1
    block = negatives._Block(64, np.arange(3).tobytes(), ["a"] * 3, negatives._columns(x))
    a = np.r_[np.full(8, 50.0), np.full(56, 1.0)]
    rows, score = negatives._scan(block, a, np.arange(3), [(35_000, float("inf"))])
    assert rows.tolist() == [0, 1] and score.tolist() == [40_000, 36_000]

import tracemalloc

import numpy as np
import pyarrow as pa

from skerry.llm import chargrams, jaccard


def texts(n, words, seed):
    rnd = np.random.default_rng(seed)
    return [" ".join(map(str, rnd.integers(0, 1 << 40, words))) for _ in range(n)]


def peak_mb(batches):
    """MB that going through batches takes at most, their own included."""
    tracemalloc.start()
    try:
        for _ in batches:
            pass
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def documents(batch, batches):
    for k in range(batches):
        ids = pa.array(np.arange(batch) + k * batch)
        yield pa.RecordBatch.from_arrays([ids, ids, pa.array(texts(batch, 300, k))], names=["id", "row", "text"])


def test_workers_hold_little(monkeypatch):
    some = list(documents(4000, 4))
    assert peak_mb(jaccard._profile(5)(iter(some))) < 100
    assert peak_mb(jaccard._prefixes(5, 80, 60, np.zeros(0, np.uint64), np.zeros(0, int))(iter(some))) < 40
    assert peak_mb(chargrams.grams((t.as_py() for t in some[0]["text"]), (4, 5, 6))) < 60


def family(n, spread):
    """Entries of one block of a list, and their sketches: n sets of 100 members that all can be linked."""
    sketch = np.zeros((n, jaccard.BITS // 8), np.uint8)
    sketch[np.arange(n), np.arange(n) % spread] = 1
    column = lambda v, t: pa.array(np.full(n, v), t)
    return pa.RecordBatch.from_arrays(
        [column(7, pa.int64()), column(0, pa.int32()), column(0, pa.int32()), pa.array(np.arange(n)), pa.array(np.arange(n)), column(100, pa.int32()), column(0, pa.int32()), column(0, pa.int32()), pa.array([s.tobytes() for s in sketch])],
        names=["key", "x", "y", "row", "part", "n", "at", "block", "sketch"],
    )


def test_a_block_of_near_copies_is_met_in_bounded_memory():
    n = 2048
    block = family(n, 100)
    assert peak_mb(jaccard._meet(80, True)(iter([block]))) < 90
    assert peak_mb(jaccard._meet(80, False)(iter([block]))) < 90
    forest = [b for batch in jaccard._meet(80, True)(iter([block])) for b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True)]
    assert len(forest) == n - 1  # a forest that links all of them
    root = list(range(n))
    for a, b in sorted(forest):
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)
    assert sum(r == i for i, r in enumerate(root)) == 1
    every = {p for batch in jaccard._meet(80, False)(iter([block])) for p in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True)}
    assert len(every) == n * (n - 1) // 2


def test_keys_and_counts_do_not_depend_on_what_is_held(monkeypatch):
    some = list(documents(40, 1)) * 4
    run = lambda: [pa.Table.from_batches(f(iter(some))).to_pylist() for f in (jaccard._prefixes(5, 80, 60, np.zeros(0, np.uint64), np.zeros(0, int)), jaccard._profile(5))]
    keys, profile = run()
    monkeypatch.setattr(jaccard, "KEYS", 10)
    assert run()[0] == keys
    shared = {r["h1"]: r["n"] for r in profile if r["row"] is None}
    assert set(shared.values()) == {4} and len(shared) == 40 * 296
    monkeypatch.setattr(jaccard, "HELD", 100)  # less than a set
    assert [r for r in run()[1] if r["row"] is not None] == [r for r in profile if r["row"] is not None]

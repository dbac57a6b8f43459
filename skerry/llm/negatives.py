"""Hard negatives by a vertical scan of vectors (BOND).

Vectors are made integers and stored by blocks of rows, one column a dimension. For each anchor a task reads a block's
columns in the order of the anchor's falling magnitudes. What the dimensions not yet read can still add lies between sums
over their least and greatest values in the block; with it, rows that can't reach any of the anchor's windows of
scores, nor its best rows so far, leave the candidate bitmap. What stays until all dimensions are read has its exact score.

The scan runs twice: for the positives (best rows of the anchor's label, any score), then for the negatives (best
rows of other labels in the window below each positive). Anchors come in passes of bounded bytes; each pass scans all
blocks. A few blocks are scanned ahead for scores that every anchor reaches anyway, so that tasks send little.

Scores are exact: doubles where all sums stay below 2**53, else Python's integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, stored

#: Rows of a block; dimensions read between two looks at the bitmap; bytes of the anchors of a pass; blocks scanned ahead.
BLOCK, STEP, PASS_BYTES, AHEAD = 4096, 8, 16 << 20, 4
_BLOCKS = "dims int, ids binary, labels array<string>, columns array<binary>"
_FOUND = "query int, window int, score long, id long"


def _columns(vectors: np.ndarray) -> list[bytes]:
    """Columns of integers held in doubles, in the narrowest type that holds them all exactly."""
    most = np.abs(vectors).max(initial=0)
    kind = next((k for k in (np.int8, np.int16, np.int32) if most <= np.iinfo(k).max), np.float64)
    return [np.ascontiguousarray(c).astype(kind).tobytes() for c in vectors.T]


def _blocks(scale: float) -> Callable:
    """Rows (id, label, vector) as blocks; rows of different lengths go into different blocks."""

    def block(rows: list) -> dict:
        vectors = np.floor(scale * np.stack([v for _, _, v in rows]).astype(np.float64))
        return {"dims": vectors.shape[1], "ids": np.array([i for i, _, _ in rows], np.int64).tobytes(), "labels": [lb for _, lb, _ in rows], "columns": _columns(vectors)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        kinds = pa.schema([("dims", pa.int32()), ("ids", pa.binary()), ("labels", pa.list_(pa.string())), ("columns", pa.list_(pa.binary()))])
        for batch in batches:
            flat, at = batch.column("vector").flatten().to_numpy(zero_copy_only=False), 0
            for i, label, n in zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(), batch.column("n").to_pylist(), strict=True):
                rows = held.setdefault(n, [])
                rows.append((i, label, flat[at : at + n]))
                at += n
                if len(rows) == BLOCK:
                    yield pa.RecordBatch.from_pylist([block(held.pop(n))], kinds)
        for rows in held.values():
            yield pa.RecordBatch.from_pylist([block(rows)], kinds)

    return run


class _Block:
    def __init__(self, dims: int, ids: bytes, labels: list[str], columns: list[bytes]):
        self.ids, self.dims = np.frombuffer(ids, np.int64), dims
        width = len(columns[0]) // len(self.ids) if dims else 8
        kind = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.float64}[width]
        self.x = np.stack([np.frombuffer(c, kind) for c in columns]).astype(np.float64) if dims else np.zeros((0, len(self.ids)))
        self.least, self.most = self.x.min(axis=1), self.x.max(axis=1)
        self.size = max(np.abs(self.least).max(initial=0), np.abs(self.most).max(initial=0))
        names, self.label = np.unique(np.array(labels, object), return_inverse=True)
        self.label_of = {name: i for i, name in enumerate(names)}
        self._exact: tuple | None = None

    def data(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """a, columns, least and most, in a type in which all sums are exact."""
        if np.abs(a).max(initial=0) * self.size * max(self.dims, 1) < 2**52:
            return a, self.x, self.least, self.most
        if self._exact is None:
            whole = np.vectorize(int, otypes=[object])
            self._exact = (whole(self.x), whole(self.least), whole(self.most))
        return np.array([int(v) for v in a], object), *self._exact


def _scan(block: _Block, a: np.ndarray, candidates: np.ndarray, windows: list[tuple[float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Of the candidate rows, those whose score lies in a window (least, most), and their exact scores."""
    a, x, least, most = block.data(a)
    order = np.argsort(-np.abs(a.astype(np.float64)), kind="stable")
    low, high = np.minimum(a * least, a * most), np.maximum(a * least, a * most)
    score = np.zeros(len(candidates), x.dtype)
    for at in range(0, max(block.dims, 1), STEP):
        read, rest = order[at : at + STEP], order[at + STEP :]
        some = x[read] if len(candidates) == x.shape[1] else x[read][:, candidates]
        if len(read):
            score = score + (a[read] @ some)
        down, up = low[rest].sum(), high[rest].sum()
        keep = np.zeros(len(score), bool)
        for lowest, highest in windows:
            keep |= ((score + up >= lowest) & (score + down <= highest)).astype(bool)
        if not keep.all():
            candidates, score = candidates[keep], score[keep]
        if not len(candidates):
            break
    return candidates, score


def _search(anchors: list[tuple], same: bool, k: int) -> Callable:
    """(query, window, score, id): for each anchor (query, id, label, vector, windows) and window (least, most, reached) the best k
    rows of the task with its label (same) or another; reached: a score that k rows of the window are known to have."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], list[tuple]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(**row)
                for query, own, label, a, windows in anchors:
                    if len(a) != block.dims:
                        continue
                    mine = block.label == block.label_of.get(label, -1)
                    rows = np.flatnonzero((mine if same else ~mine) & (block.ids != own))
                    if not len(rows):
                        continue
                    ends = []
                    for w, (least, most, reached) in enumerate(windows):
                        held = best.get((query, w), ())
                        ends.append((max(least, reached, held[k - 1][0] if len(held) == k else least), most))
                    rows, score = _scan(block, a, rows, ends)
                    for w, (least, most) in enumerate(ends):
                        inside = np.flatnonzero(((score >= least) & (score <= most)).astype(bool))
                        if len(inside):
                            s, ids = score[inside], block.ids[rows[inside]]
                            first = np.lexsort((ids, -s))[:k] if s.dtype != object else np.array(sorted(range(len(s)), key=lambda i: (-s[i], ids[i]))[:k])
                            found = [(int(s[i]), int(ids[i])) for i in first]
                            best[query, w] = sorted([*best.get((query, w), []), *found], key=lambda r: (-r[0], r[1]))[:k]
        rows = [(q, w, s, i) for (q, w), found in best.items() for s, i in found]
        for at in range(0, len(rows), 1 << 16):
            q, w, s, i = zip(*rows[at : at + (1 << 16)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(w, pa.int32()), pa.array(s, pa.int64()), pa.array(i, pa.int64())], ["query", "window", "score", "id"])

    return run


def _best(blocks: DataFrame, anchors: list[tuple], same: bool, k: int) -> DataFrame:
    """The best k of all blocks, with their rank."""
    shared = blocks.sparkSession.sparkContext.broadcast(anchors)
    found = blocks.mapInArrow(lambda batches: _search(shared.value, same, k)(batches), _FOUND)
    rank = F.row_number().over(Window.partitionBy("query", "window").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _ahead(blocks: DataFrame, anchors: list[tuple], same: bool, k: int) -> list[tuple]:
    """anchors with the k-th score that a few blocks hold for each window, which is a bound from below for all."""
    reached = {(r["query"], r["window"]): r["score"] for r in _best(blocks.limit(AHEAD), anchors, same, k).where(F.col("rank") == k).collect()}
    return [(*rest, [(least, most, reached.get((rest[0], w), least)) for w, (least, most, _) in enumerate(windows)]) for *rest, windows in anchors]


def hard_negatives(
    rows: DataFrame, anchor: Column, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0,
    positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where anchor is true.

    A score is the inner product of floor(scale * x). An anchor's positives are its first rows of the same label, its
    negatives for each positive the first of other labels with low * positive <= 100 * negative <= high * positive, by falling score, then
    id. Rows take no part if their id, label or vector is null or a component is null or not finite. Vectors of
    different lengths don't meet. Rows with the anchor's id are never its own positives or negatives; other repeated rows count
    each time, repeated anchors too. No rows, no anchors, no window with a row: no result. Scores beyond 64 bits are an error.
    """
    spark, label = rows.sparkSession, F.col("label") if label is None else label
    vector, finite = F.col(vector_col).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    used = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), vector.alias("vector"), anchor.alias("anchor"))
    used = used.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", finite)).withColumn("n", F.size("vector"))
    blocks = stored(used.select("id", "label", "vector", "n").mapInArrow(_blocks(scale), _BLOCKS), "blocks")
    chosen = stored(used.where("anchor").select("id", "label", "vector"), "anchors")
    passes = -(-(chosen.agg(F.sum(F.size("vector") * 8 + 64)).first()[0] or 0) // pass_bytes)
    out = new_path(spark, "negatives")
    kinds = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], kinds).write.parquet(out)
    for i in range(passes):
        own = chosen.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == i).collect()
        anchors = [(q, r["id"], r["label"], np.floor(scale * np.array(r["vector"], np.float64)), [(float("-inf"), float("inf"), float("-inf"))]) for q, r in enumerate(own)]
        found: dict[int, list[tuple[int, int]]] = {}
        for r in _best(blocks, _ahead(blocks, anchors, True, positives), True, positives).collect():  # a few rows for each anchor of the pass
            found.setdefault(r["query"], []).append((r["rank"], r["score"], r["id"]))
        asked = []
        for q, own_id, name, a, _ in anchors:
            if q in found:
                ends = [(-((-low * s) // 100), (high * s) // 100) for _, s, _ in sorted(found[q])]
                asked.append((q, own_id, name, a, [(least, most, least) for least, most in ends]))
        pairs = [(q, w, anchors[q][1], i, s) for q, hits in found.items() for w, (_, s, i) in enumerate(sorted(hits))]
        pairs = spark.createDataFrame(pairs, "query int, window int, anchor_id long, positive_id long, positive_score long")
        met = _best(blocks, _ahead(blocks, asked, False, negatives), False, negatives)
        met.join(F.broadcast(pairs), ["query", "window"]).select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        ).write.mode("append").parquet(out)
    return spark.read.schema(kinds).parquet(out)

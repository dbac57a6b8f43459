"""Katz backoff language-model scoring.

Texts are cut into blocks of a few MB that stay together in one bucketed table. For each order n every block sends its
distinct n-grams, once, to the bucket of their history; the bucket merges the counts of all blocks, writes its part of
the model table and answers each block; its answer numbers the n-grams, and longer ones are sent as pairs of such
numbers (the (n-1)-grams that end before and at the last word). So an n-gram crosses the network once per block and not once per occurrence,
and neither the model nor the texts pass through the driver or a broadcast. Histories with more than an even share of
the corpus ("hot": their number is bounded by twice the number of buckets) are dealt over all buckets by whole n-gram
and their sums are added up afterwards.

P_n(w | h) = d(c(hw)) c(hw) / c(h) for n-grams seen in training, else alpha(h) P_(n-1)(w | shorter h), else, for an
unseen history, P_(n-1). d is the Good-Turing discount for counts up to k. alpha(h) is the freed mass of h divided by
the lower-order mass of the words not seen after h, so that each P_n(. | h) sums to 1 over the vocabulary and one
class of unknown words. Where a history frees no mass (all its counts exceed k), one count is added to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import chunks, mix, pair, words

END = mix(np.array([11], np.uint64))[0]
#: Bytes of text in a block and, about, behind a bucket of the model.
BLOCK_BYTES, BUCKET_BYTES = 12 << 20, 12 << 20
_CODEC = "zstd"
#: kind: answer (to a block), model (a bucket's n-grams), hot (a bucket's share of a hot history), total (counts of counts).
MERGED = "kind string, block long, bucket int, history long, mass long, lower double, low array<long>, data binary"
CELL = "block long, bucket int, data binary"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; unsigned integers are narrowed to what their largest value needs."""
    out = []
    for a in arrays:
        if a.dtype.kind in "iu" and a.size:
            a = a.astype(np.min_scalar_type(int(a.max())))
        out += [np.array([len(a)], np.int64).tobytes(), a.dtype.str.ljust(4).encode(), a.tobytes()]
    raw = b"".join(out)
    return np.array([len(raw)], np.int64).tobytes() + pa.compress(raw, codec=_CODEC, asbytes=True)


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int(np.frombuffer(data[:8], np.int64)[0]), codec=_CODEC, asbytes=True)
    out, at = [], 0
    while at < len(raw):
        n, kind = int(np.frombuffer(raw, np.int64, 1, at)[0]), np.dtype(raw[at + 8 : at + 12].decode().strip())
        out.append(np.frombuffer(raw, kind, n, at + 12))
        at += 12 + n * kind.itemsize
    return out


@dataclass(frozen=True)
class Level:
    """What all blocks need to know of one order: discounts by count (0 unused), and the sums of hot histories."""

    discounts: np.ndarray
    tokens: int
    types: int
    hot: np.ndarray  # sorted histories
    hot_mass: np.ndarray
    hot_lower: np.ndarray
    hot_low: np.ndarray  # by history: number of n-grams seen 1..k times


def discounts(counts: list[int], k: int) -> np.ndarray:
    """Good-Turing factors for counts 0..k from the numbers of n-grams seen 1..k+1 times.

    Where a factor is undefined or outside (0, 1), as in small corpora, that count r is discounted by (r - 0.5) / r.
    """
    out = np.ones(k + 1)
    n = [0.0, *map(float, counts)]
    cut = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * n[r + 1] / (n[r] * r) - cut) / (1 - cut) if n[r] and cut < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


class _Block:
    """The tokens of a block's texts, in the order of its rows."""

    def __init__(self, table: pa.Table):
        self.ids, self.train = table["_id"], table["_train"].to_numpy(zero_copy_only=False).astype(bool)
        hashes, sizes = [], []
        for part in chunks(x.as_py() for x in table["_text"]):
            h, n = words(part)
            hashes.append(h)
            sizes.append(n)
        sizes, n = np.concatenate(sizes), sum(map(len, hashes))
        self.sizes = sizes + 1
        self.first = np.cumsum(self.sizes) - self.sizes
        self.word = np.full(n + len(sizes), END, np.uint64)
        inner = np.ones(n + len(sizes), bool)
        inner[self.first + sizes] = False
        self.word[inner] = np.concatenate(hashes)
        self.doc = np.repeat(np.arange(len(sizes)), self.sizes)
        self.at = np.arange(len(self.word)) - self.first[self.doc]

    def keys(self, shorter: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """History and suffix of the n-gram that ends at each token: the numbers of the (n-1)-grams that end before and
        at it; 0 is the start of a text. Of a unigram: 0 and the word's hash."""
        if shorter is None:
            return np.zeros(len(self.word), np.uint64), self.word
        before = np.roll(shorter, 1)
        before[self.at == 0] = 0
        return before, shorter


class _Entries:
    """The distinct n-grams of a block, sorted by bucket, history and suffix."""

    def __init__(self, block: _Block, shorter: np.ndarray | None, buckets: int, hot_token: np.ndarray, lower: np.ndarray):
        history, suffix = block.keys(shorter)
        key = pair(history, suffix)
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        history, suffix, key, hot = history[first], suffix[first], key[first], hot_token[first]
        bucket = (np.where(hot, key, mix(history)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((suffix, history, bucket))
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.inverse = rank[inverse]
        self.count = np.bincount(self.inverse, weights=block.train[block.doc], minlength=len(order)).astype(np.int64)
        self.history, self.suffix, self.bucket, self.lower, self.hot = history[order], suffix[order], bucket[order], lower[first][order], hot[order]
        self.cuts = np.flatnonzero(np.diff(self.bucket, prepend=-1, append=-1))

    def spans(self) -> Iterator[tuple[int, int, int]]:
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            yield int(self.bucket[a]), int(a), int(b)


def _starts(history: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(history, prepend=~history[:1]))


def _encode(history, suffix, count, lower, hot) -> bytes:
    """N-grams sorted by history and suffix; each distinct suffix is written once, with its lower-order probability."""
    start = _starts(history)
    names, at, index = np.unique(suffix, return_index=True, return_inverse=True)
    steps = lambda x: np.diff(x, prepend=np.uint64(0))
    values, value = np.unique(lower[at], return_inverse=True)
    return _pack(steps(history[start]), np.diff(start, append=len(history)), hot[start], steps(names), values, value, index, count)


def _decode(data: bytes) -> tuple[np.ndarray, ...]:
    histories, runs, hot, names, values, value, index, count = _unpack(data)
    lower = values[value]
    histories, names, runs = np.cumsum(histories.astype(np.uint64)), np.cumsum(names.astype(np.uint64)), runs.astype(np.int64)
    return np.repeat(histories, runs), names[index], count.astype(np.int64), lower[index], np.repeat(hot, runs)


def _merge(k: int, last: bool):
    """Merge the n-grams of a bucket and answer each block in the order in which it sent them.

    Unless the order is the last, answers number the n-grams: next orders name them by these small numbers.
    """

    def run(key, table):
        sent = [(b.as_py(), _decode(d.as_py())) for b, d in zip(table["block"], table["data"], strict=True)]
        history, suffix, count, lower, hot = (np.concatenate([x[1][i] for x in sent]) for i in range(5))
        _, first, inverse = np.unique(pair(history, suffix), return_index=True, return_inverse=True)
        by = np.lexsort((suffix[first], history[first]))
        rank = np.empty_like(by)
        rank[by] = np.arange(len(by))
        inverse, first = rank[inverse], first[by]
        total = np.bincount(inverse, weights=count).astype(np.int64)
        history, suffix, lower, hot = history[first], suffix[first], lower[first], hot[first]
        start = _starts(history)
        group = np.repeat(np.arange(len(start)), np.diff(start, append=len(history)))
        seen = total > 0
        sums = lambda w: np.bincount(group, weights=w, minlength=len(start))
        mass, freed = sums(total).astype(np.int64), sums(np.where(seen, lower, 0.0))
        low = np.stack([sums(total == r) for r in range(1, k + 1)], 1).astype(np.int64)
        rows, at = [], 0
        for block, cell in sent:
            own = inverse[at : at + len(cell[0])]
            at += len(own)
            g = group[own][_starts(cell[0])]
            rows.append(("answer", block, 0, 0, 0.0, [], _pack(own[:0] if last else np.diff(own, prepend=0), total[own], mass[g], freed[g], *low[g].T)))
        if seen.any():
            rows.append(("model", None, 0, int(seen.sum()), 0.0, [], _encode(history[seen], suffix[seen], total[seen], lower[seen], hot[seen])))
        exact = [int((total == r).sum()) for r in range(1, k + 2)]
        rows.append(("total", None, 0, int(total.sum()), 0.0, [*exact, int(seen.sum())], b""))
        for i in np.flatnonzero(hot[start] & (mass > 0)):
            rows.append(("hot", None, int(history[start][i].view(np.int64)), int(mass[i]), float(freed[i]), low[i].tolist(), b""))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.binary()]
        cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
        cols.insert(2, pa.array([key[0].as_py()] * len(rows), pa.int32()))
        return pa.table(cols, names=["kind", "block", "bucket", "history", "mass", "lower", "low", "data"])

    return run


def _probabilities(block: _Block, answers: pa.Table, levels: list[Level], buckets: int, k: int):
    """Of each token, by all orders known so far: probability, training count of its n-gram, and whether that is hot."""
    lower, hot, seen, shorter = np.ones(len(block.word)), np.ones(len(block.word), bool), [], None
    by = {(o.as_py(), b.as_py()): d.as_py() for o, b, d in zip(answers["order"], answers["bucket"], answers["data"], strict=True)}
    for n, level in enumerate(levels, 1):
        own = _Entries(block, shorter, buckets, hot, lower)
        parts = [_unpack(by[n, b]) for b, _, _ in own.spans()]
        total, mass, freed, *low = (np.concatenate([p[i] for p in parts]) for i in range(1, 4 + k))
        rank = np.concatenate([np.cumsum(p[0].astype(np.uint64)) for p in parts])
        if len(rank):
            shorter = (rank * np.uint64(buckets) + own.bucket.astype(np.uint64) + np.uint64(1))[own.inverse]
        start = np.flatnonzero((np.diff(own.history, prepend=~own.history[:1]) != 0) | (np.diff(own.bucket, prepend=-1) != 0))
        group = np.repeat(np.arange(len(start)), np.diff(start, append=len(own.history)))
        mass, low = mass.astype(np.int64), np.stack(low, 1).astype(np.int64)
        if len(level.hot):
            at = np.minimum(np.searchsorted(level.hot, own.history[start]), len(level.hot) - 1)
            swap = own.hot[start] & (level.hot[at] == own.history[start])
            mass[swap], freed[swap], low[swap] = level.hot_mass[at[swap]], level.hot_lower[at[swap]], level.hot_low[at[swap]]
        free = (low * (np.arange(1, k + 1) * (1 - level.discounts[1:]))).sum(1)
        bare = (free <= 0) & (mass > 0)
        scale = np.where(bare, mass + 1, np.maximum(mass, 1)).astype(float)
        left = np.where(bare, 1.0, free) / scale
        back = np.where(mass > 0, left / np.maximum(1 - (freed if n > 1 else 0.0), 1e-300), 1.0)
        total = total.astype(np.int64)
        found = np.where(total <= k, level.discounts[np.minimum(total, k)], 1.0) * total / scale[group]
        lower = np.where(total > 0, found, back[group] * own.lower)[own.inverse]
        seen.append(total[own.inverse])
        hot = (block.at == 0) | (np.roll(seen[-1], 1) >= levels[0].tokens / (2 * buckets))
    return lower, seen, hot, shorter


def _send(levels: list[Level], buckets: int, k: int):
    def run(key, texts, answers):
        if not texts.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "bucket": pa.array([], pa.int32()), "data": pa.array([], pa.binary())})
        block = _Block(texts)
        lower, _, hot, shorter = _probabilities(block, answers, levels, buckets, k)
        own = _Entries(block, shorter, buckets, hot, lower)
        name = key[0].as_py()
        rows = [(name, b, _encode(own.history[x:y], own.suffix[x:y], own.count[x:y], own.lower[x:y], own.hot[x:y])) for b, x, y in own.spans()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["block", "bucket", "data"])

    return run


def _score(levels: list[Level], buckets: int, k: int):
    def run(key, texts, answers):
        block = _Block(texts) if texts.num_rows else None
        if block is None:
            sums = [np.zeros(0)] * 3
        else:
            p, seen, *_ = _probabilities(block, answers, levels, buckets, k)
            per = lambda x: np.add.reduceat(x, block.first)
            base = np.log10((seen[0] + 0.5) / (levels[0].tokens + 0.5 * (levels[0].types + 1)))
            sums = [per((seen[0] > 0).astype(np.int64)), per(base), per(np.log10(p))]
        return pa.table({
            "_id": texts["_id"], "n_tokens": pa.array(block.sizes if block else [], pa.int64()), "n_known": pa.array(sums[0].astype(np.int64)),
            "train_tokens": pa.array(np.full(texts.num_rows, levels[0].tokens, np.int64)), "base_score": pa.array(sums[1]), "score": pa.array(sums[2]), "_train": texts["_train"],
        })

    return run


@dataclass
class KatzScores:
    """scores: a row for each text. model: the stored table, in folders order=n/kind=model."""

    scores: DataFrame
    path: str
    levels: list[Level]

    def model(self, spark, order: int) -> DataFrame:
        """The n-grams of an order: history and suffix as numbers (a unigram's suffix: the word's hash), training count, lower-order probability of the suffix."""

        def rows(batches):
            for batch in batches:
                for data in batch["data"]:
                    h, s, c, p, _ = _decode(data.as_py())
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(s.view(np.int64)), pa.array(c), pa.array(p)], names=["history", "suffix", "count", "lower"])

        return spark.read.schema(MERGED).parquet(f"{self.path}/order={order}").where("kind = 'model'").select("data").mapInArrow(rows, "history long, suffix long, count long, lower double")


def katz_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 2, k: int = 5) -> KatzScores:
    """Score every text by a Katz model of the texts for which train holds.

    Words are the maximal runs of bytes other than space and 0x09-0x0D, A-Z lowered; each text ends with an end token,
    which is scored too. A null text is empty; a null in train is false. Without training text every token is unknown
    and its probability is 1. Repeated rows are scored (and learned from) each by itself. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.coalesce(train, F.lit(False)).alias("_train"))
    size = rows.agg(F.sum(F.octet_length("_text") + F.lit(1))).first()[0] or 0
    parts = max(1, rows.rdd.getNumPartitions())
    split = -(-max(32, size // BLOCK_BYTES) // parts)
    buckets = int(max(64, size // BUCKET_BYTES))
    path = common.new_path(spark, "katz")
    name = path.rpartition("/")[2].replace("-", "_")
    block = F.spark_partition_id().cast("long") * split + F.pmod(F.xxhash64("_id", "_text"), F.lit(split))
    rows.withColumn("block", block).write.bucketBy(min(parts * split, 20_000), "block").option("path", f"{path}/texts").saveAsTable(name)
    texts = spark.table(name).groupBy("block")
    empty = spark.createDataFrame([], "order int, block long, bucket int, data binary")
    kept, levels = f"{path}/model", []

    def answers() -> DataFrame:
        if not levels:
            return empty
        return spark.read.schema(f"{MERGED}, order int").parquet(kept).where("kind = 'answer'").select("order", "block", "bucket", "data")

    for n in range(1, order + 1):
        cells = texts.cogroup(answers().groupBy("block")).applyInArrow(_send(levels, buckets, k), CELL)
        cells.groupBy("bucket").applyInArrow(_merge(k, n == order), MERGED).write.partitionBy("kind").parquet(f"{kept}/order={n}")
        table = spark.read.schema(MERGED).parquet(f"{kept}/order={n}")
        sums = table.where("kind = 'total'").agg(F.sum("mass"), *(F.sum(F.col("low")[i]) for i in range(k + 2))).first()
        mass, *counts, types = (x or 0 for x in sums)
        hot = table.where("kind = 'hot'").groupBy("history").agg(F.sum("mass"), F.sum("lower"), *(F.sum(F.col("low")[i]) for i in range(k))).toPandas().to_numpy(dtype=object)
        names = hot[:, 0].astype(np.int64).view(np.uint64)
        by = np.argsort(names)
        level = Level(discounts(counts, k), mass, types, names[by], hot[by, 1].astype(np.int64), hot[by, 2].astype(float), hot[by, 3:].astype(np.int64))
        levels.append(level)
    out = texts.cogroup(answers().groupBy("block")).applyInArrow(_score(levels, buckets, k), f"_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double, _train boolean")
    return KatzScores(out.withColumnRenamed("_id", id_col).withColumnRenamed("_train", "trained"), kept, levels)

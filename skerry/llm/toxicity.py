"""Toxicity: a linear classifier of binary character n-grams scaled by naive Bayes log-count ratios (NB-SVM's features,
logistic loss), trained on labelled text.

The classifier is fitted on a bounded sample of the labelled rows: at most `rows_per_class` rows of either label, those
with the least hashes, none longer than `longest` bytes, and at most `max_bytes` of text. The labels' shares among all
labelled rows, not those that the bounds give the sample, set the bias. N-grams that `least` texts of the sample have are
counted, and the `max_features` with the greatest weight chosen, by many tasks; one task then solves the regression on
the sample's feature numbers. Scoring covers every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chargrams import batches, grams
from .common import stored

ORDERS = (4, 5, 6)
#: Bounds of the sample and of the model.
ROWS_PER_CLASS, MAX_BYTES, MAX_FEATURES = 4000, 32 << 20, 60_000
#: Tasks that count the sample's n-grams, n-grams that such a task holds before it sends their counts, bytes of a text in the sample.
SAMPLE_PARTS, HELD, LONGEST = 16, 1_000_000, 4 << 20
#: Feature numbers that the regression handles at a time.
SLAB = 1 << 20


@dataclass(frozen=True)
class ToxicityModel:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float


def _distinct(texts: list[str]):
    """The distinct n-grams of each text, order by order: hashes and text numbers, by text. The pieces of a long text, which comes alone, count as one."""
    if len(texts) == 1:
        pieces = [np.unique(np.concatenate([h for h, _ in found])) for _, _, found, _ in grams(texts, ORDERS)]
        h = np.unique(np.concatenate(pieces)) if pieces else np.zeros(0, np.uint64)
        yield h, np.zeros(len(h), np.int64)
        return
    for _, _, found, _ in grams(texts, ORDERS):
        while found:
            h, number = found.pop()
            order = np.lexsort((h, number))
            h, number = h[order], number[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (number[1:] != number[:-1])
            yield h[new], number[new]


def _count(parts):
    """How many texts, and how many of label 1, have each n-gram: counts of some texts at a time."""
    names, ones, size = [], [], 0

    def counted():
        flat, one = np.concatenate(names), np.concatenate(ones)
        order = np.argsort(flat)
        flat, one = flat[order], one[order]
        first = np.flatnonzero(np.diff(flat, prepend=~flat[:1]))
        n, pos = np.diff(first, append=len(flat)), np.add.reduceat(one, first, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(flat[first].view(np.int64)), pa.array(n.astype(np.int64)), pa.array(pos)], names=["feature", "n", "pos"])

    for part in parts:
        y, at = part["_y"].to_numpy(), 0
        for some in batches(t.as_py() for t in part["_text"]):
            for h, number in _distinct(some):
                names.append(h)
                ones.append(y[at + number].astype(np.int8))
                size += len(h)
                if size > HELD:
                    yield counted()
                    names, ones, size = [], [], 0
            at += len(some)
    if size:
        yield counted()


def _index(features: np.ndarray):
    """The numbers of the features that each text has."""

    def run(parts):
        for part in parts:
            first = 0
            for some in batches(t.as_py() for t in part["_text"]):
                at, number = [], []
                for h, of in _distinct(some):
                    place = np.minimum(np.searchsorted(features, h), len(features) - 1)
                    hit = features[place] == h
                    at.append(place[hit].astype(np.int32))
                    number.append(of[hit])
                at, number = np.concatenate(at), np.concatenate(number)
                order = np.argsort(number, kind="stable")
                places = np.split(at[order], np.searchsorted(number[order], np.arange(1, len(some))))
                own = part.slice(first, len(some))
                yield pa.RecordBatch.from_arrays([own["_h"], own["_y"], pa.array(places, pa.list_(pa.int32()))], names=["_h", "_y", "at"])
                first += len(some)

    return run


def _regression(sizes: np.ndarray, at: np.ndarray, y: np.ndarray, r: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps with conjugate gradients. sizes[i] of the feature numbers `at`, one after
    another, are text i's; r: the ratios. Feature numbers are handled in slabs, so memory is little more than theirs."""
    ends = np.cumsum(sizes)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(SLAB, int(ends[-1]) if len(ends) else 0, SLAB)), [len(sizes)]]))
    slabs = [(a, b, at[ends[a] - sizes[a] : ends[b - 1]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def times(w):
        by, out = r * w[:-1], np.full(len(y), w[-1])
        for a, b, own in slabs:
            some = np.flatnonzero(sizes[a:b])
            if len(some):
                out[a + some] += np.add.reduceat(by[own], (ends[a:b] - sizes[a:b] - (ends[a] - sizes[a]))[some])
        return out

    def back(u):
        out = np.zeros(len(r))
        for a, b, own in slabs:
            out += np.bincount(own, weights=np.repeat(u[a:b], sizes[a:b]), minlength=len(r))
        return np.append(out * r, u.sum())

    w, hold, goal = np.zeros(len(r) + 1), np.append(np.full(len(r), penalty), 1e-6), None
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        gradient = back(p - y) + hold * w
        goal = max(1e-3, 1e-4 * np.abs(gradient).max(initial=0)) if goal is None else goal
        if np.abs(gradient).max(initial=0) < goal:
            break
        curve = p * (1 - p) + 1e-9
        step, res = np.zeros_like(w), -gradient
        way, size = res.copy(), res @ res
        for _ in range(15):
            h = back(curve * times(way)) + hold * way
            a = size / max(way @ h, 1e-300)
            step, res = step + a * way, res - a * h
            new = res @ res
            if new < 1e-4 * (gradient @ gradient):
                break
            way, size = res + new / size * way, new
        loss = lambda v: np.logaddexp(0, np.where(y > 0, -1, 1) * times(v)).sum() + (hold * v * v).sum() / 2
        scale, now = 1.0, loss(w)
        while scale > 1e-4 and loss(w + scale * step) > now:
            scale /= 2
        w = w + scale * step
    return r * w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows_per_class: int = ROWS_PER_CLASS, max_bytes: int = MAX_BYTES, max_features: int = MAX_FEATURES, least: int = 4, penalty: float = 2.0, longest: int = LONGEST) -> ToxicityModel:
    """Learn from the given labels (0 or 1; other values and nulls are ignored; of contradicting ones 1 holds).

    Without rows of both labels the model is a bias only: the score is then the share of label 1, 0 without labels.
    """
    labels = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").groupBy("_id").agg(F.max("_y").alias("_y"))
    every = stored(labels, "labels")
    whole = {row["_y"]: row["count"] for row in every.groupBy("_y").count().collect()}
    labels, by = every, F.xxhash64("_id")
    picked = labels.where("_y = 1").orderBy(by, "_id").limit(rows_per_class).union(labels.where("_y = 0").orderBy(by, "_id").limit(rows_per_class))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).join(F.broadcast(picked), "_id")
    rows = stored(rows.withColumn("_h", F.xxhash64("_id", "_text")), "labelled")
    sizes = rows.select("_id", "_h", F.octet_length("_text").alias("_n")).where((F.col("_n") <= F.least(F.lit(max_bytes), F.lit(longest)))).distinct().orderBy("_h").limit(2 * rows_per_class)
    within = sizes.withColumn("_sum", F.sum("_n").over(Window.orderBy("_h", "_id").rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_sum") <= max_bytes).select("_h")
    sample = stored(rows.join(F.broadcast(within), "_h").dropDuplicates(["_h"]).repartition(SAMPLE_PARTS, "_h").select("_h", "_text", "_y"), "sample")
    total, ones = (int(x or 0) for x in sample.agg(F.count("*"), F.sum("_y")).first())
    if not 0 < ones < total:
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), 30.0 if ones else -30.0)
    shift = float(np.log(whole[1] / whole[0]) - np.log(ones / (total - ones)))  # from the sample's shares to those of all labels
    counts = sample.mapInArrow(_count, "feature long, n long, pos long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).where(F.col("n") >= least)
    ratio = F.log((F.col("pos") + 1) / (ones + 2)) - F.log((F.col("n") - F.col("pos") + 1) / (total - ones + 2))
    weight = F.abs("ratio") * F.sqrt("n")
    chosen = counts.select("feature", "n", ratio.alias("ratio")).orderBy(weight.desc(), "feature").limit(max_features).select("feature", "ratio").toPandas()
    names, ratios = chosen["feature"].to_numpy(np.int64).view(np.uint64), chosen["ratio"].to_numpy(float)
    order = np.argsort(names)
    names, ratios = names[order], ratios[order]
    if not len(names):
        return ToxicityModel(names, ratios, float(np.log(whole[1] / whole[0])))

    def train(parts):
        held: list[tuple[int, int, np.ndarray]] = []
        for part in parts:
            flat, ends = part["at"].flatten().to_numpy(), part["at"].offsets.to_numpy()
            ends = ends - ends[0]
            held += [(k, y, flat[a:b].copy()) for k, y, a, b in zip(part["_h"].to_pylist(), part["_y"].to_pylist(), ends[:-1], ends[1:], strict=True)]
        held.sort(key=lambda t: t[0])  # texts in one order, however tasks end
        sizes, y = np.array([len(t[2]) for t in held]), np.array([t[1] for t in held], float)
        at = np.concatenate([t[2] for t in held])
        held.clear()
        weights, bias = _regression(sizes, at, y, ratios, penalty)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(weights)), -1)), pa.array(np.append(weights, bias))], names=["place", "weight"])

    found = sample.mapInArrow(_index(names), "_h long, _y int, at array<int>").repartition(1).mapInArrow(train, "place long, weight double").toPandas().sort_values("place")["weight"].to_numpy(float)
    model = ToxicityModel(names, found[1:], float(found[0]) + shift)
    if total >= whole[0] + whole[1]:
        return model
    # A bounded sample fits its own rows too well: the bias is set so that labelled rows score their share of label 1 on average.
    again = F.xxhash64("_id", F.lit("again"))
    asked = every.where("_y = 1").orderBy(again, "_id").limit(rows_per_class).union(every.where("_y = 0").orderBy(again, "_id").limit(rows_per_class))
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).join(F.broadcast(asked), "_id")
    seen = score(texts, model, "_text", ("_score", "_predicted")).select("_y", "_score").toPandas()
    y, p = seen["_y"].to_numpy(), np.clip(seen["_score"].to_numpy(float), 1e-12, 1 - 1e-12)
    weight = np.where(y == 1, whole[1] / max((y == 1).sum(), 1), whole[0] / max((y == 0).sum(), 1)) / (whole[0] + whole[1])
    low, high, logit = -40.0, 40.0, np.log(p / (1 - p))
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (weight / (1 + np.exp(-logit - middle))).sum() < whole[1] / (whole[0] + whole[1]) else (low, middle)
    return ToxicityModel(model.features, model.weights, model.bias + low)


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out: tuple[str, str] = ("score", "predicted"), threshold: float = 0.5) -> DataFrame:
    """docs with a probability of label 1 and whether it reaches the threshold (int), whole texts, no shuffle.

    A null text is scored as the empty one. Existing columns with the new names are replaced; all others are kept.
    """
    docs = docs.drop(*out)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index(text_col)

    def run(parts):
        m = shared.value
        bits = 1 << 20
        may = np.zeros(bits, bool)
        may[(m.features & np.uint64(bits - 1)).astype(np.int64)] = True
        for part in parts:
            sums, open_ = np.full(part.num_rows, m.bias), (0, np.zeros(0, np.int64))

            def close(first, pairs):
                np.add.at(sums, first + pairs // max(1, len(m.features)), m.weights[pairs % max(1, len(m.features))])  # noqa: B023

            for first, _, found, _ in grams((t.as_py() for t in part.column(column).cast(pa.string())), ORDERS):
                if first != open_[0]:
                    close(*open_)
                    open_ = (first, np.zeros(0, np.int64))
                pairs = [open_[1]]  # of a long text: also what its pieces so far have
                for h, number in found:
                    hit = np.flatnonzero(may[(h & np.uint64(bits - 1)).astype(np.int64)])
                    if len(hit) and len(m.features):
                        at = np.minimum(np.searchsorted(m.features, h[hit]), len(m.features) - 1)
                        same = m.features[at] == h[hit]
                        pairs.append(number[hit][same] * len(m.features) + at[same])
                open_ = (first, np.unique(np.concatenate(pairs)))
            close(*open_)
            p = 1 / (1 + np.exp(-np.clip(sums, -700, 700)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*part.schema.names, *out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out[0], T.DoubleType()), T.StructField(out[1], T.IntegerType())]))

"""Phrases of two or three words that occur together, by a suffix tree of words built in independent parts.

The suffixes of all pieces, cut to three words, form a tree whose node totals are the counts of all phrases. Its first
words are counted over all texts; prefixes are packed in hash order into groups of at most about `group_suffixes`
suffixes. A word with more suffixes than that is a prefix too long for one group: it is split by second words, whose
counts are taken in one more pass, and a pair of words that is still too frequent by ranges of third words. Tasks add up
equal suffixes before they send them, sorted and packed, to the group of their prefix; a group sorts what it gets, which
is its subtree with the suffixes as leaves, and reads the counts off the leaf totals. Neither a frequent word nor a
frequent pair is gathered in one task.

A word is identified by a 63-bit hash of language and bytes; among n distinct words two collide with a chance of about n*n / 2**64.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_side, stored
from .tokens import _LOWER, _VALUE, mix, prefix_hashes

#: Bytes between the words of a piece, and bytes that end a piece.
SPACES, STOPS = b" \t", b".,;:!?\n\x0b\x0c\r"
#: Bytes of text handled at a time; a longer text is handled in parts.
CHUNK = 1 << 21
#: Suffixes of a group, at most about twice as many; suffixes that a task holds before it sends; how many groups there are at most.
GROUP_SUFFIXES, HELD, MAX_GROUPS = 1 << 21, 1 << 20, 1 << 20
_IN_WORD = np.ones(256, bool)
_IN_WORD[list(SPACES + STOPS)] = False
_STOP = np.zeros(256, bool)
_STOP[list(STOPS)] = True
_GAP = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")
_MASK = np.uint64((1 << 63) - 1)


def _parts(text: bytes) -> Iterator[bytes]:
    """A long text in parts of about CHUNK bytes that end between words."""
    at = 0
    while len(text) - at > CHUNK:
        gap = _GAP.search(text, at + CHUNK)
        to = gap.end() if gap else len(text)
        yield text[at:to]
        at = to
    yield text[at:]


class _Words:
    """The words of some bytes: hashes, numbers of their pieces, and where they are."""

    def __init__(self, raw: bytes, seed: np.uint64):
        self.low = _LOWER[np.frombuffer(raw, np.uint8)]
        inside = np.zeros(len(self.low) + 2, np.int8)
        inside[1:-1] = _IN_WORD[self.low]
        step = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        h, back = prefix_hashes(_VALUE[self.low])
        self.word = np.maximum(mix(mix((h[self.ends] - h[self.starts]) * back[self.starts]) ^ seed) & _MASK, np.uint64(1)).astype(np.int64)
        stops = np.cumsum(_STOP[self.low])
        self.piece, self.stops = stops[self.starts] if len(stops) else self.starts, int(stops[-1]) if len(stops) else 0

    def text(self, i: int) -> str:
        return self.low[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")


def _batches(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(language, bytes) of columns lang and text: short texts of a language together, a long one in parts."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            if len(raw) > CHUNK:
                yield lang, list(_parts(raw))
                continue
            held.setdefault(lang, []).append(raw)
            sizes[lang] = sizes.get(lang, 0) + len(raw) + 1
            if sizes[lang] > CHUNK:
                yield lang, [b"\n".join(held.pop(lang)) + b"\n"]
                del sizes[lang]
    for lang, texts in held.items():
        yield lang, [b"\n".join(texts) + b"\n"]


def _seed(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def _words(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, _Words]]:
    for lang, parts in _batches(batches):
        for part in parts:
            yield lang, _Words(part, _seed(lang))


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, t, n) added up over what a task holds."""
    held: dict[str, tuple[list, list, dict]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, (hashes, counts, texts) in held.items():
            t, place = np.unique(np.concatenate(hashes), return_inverse=True)
            n = np.bincount(place, np.concatenate(counts)).astype(np.int64)
            for at in range(0, len(t), 1 << 16):
                some = t[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array([texts[x] for x in some.tolist()]), pa.array(some), pa.array(n[at : at + (1 << 16)])], ["lang", "word", "t", "n"])
        held.clear()

    for lang, words in _words(batches):
        t, first, n = np.unique(words.word, return_index=True, return_counts=True)
        hashes, counts, texts = held.setdefault(lang, ([], [], {}))
        for x, i in zip(t.tolist(), first.tolist(), strict=True):
            if x not in texts:
                texts[x] = words.text(i)
        hashes.append(t)
        counts.append(n)
        size += len(t)
        if size > HELD:
            yield from flush()
            size = 0
    yield from flush()


def _suffixes(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(t1, t2, t3) of each word that another follows in its piece; t3 is 0 where no third follows. The last two words of a part wait for the next."""
    for lang, parts in _batches(batches):
        seed, base = _seed(lang), 0
        word = piece = np.zeros(0, np.int64)
        for i, part in enumerate(parts):
            now = _Words(part, seed)
            word, piece = np.concatenate([word, now.word]), np.concatenate([piece, now.piece + base])
            base += now.stops
            pad, n = np.zeros(2, np.int64), len(word) if i == len(parts) - 1 else max(len(word) - 2, 0)
            after, its = np.concatenate([word, pad]), np.concatenate([piece, pad - 1])
            second, third = its[1 : n + 1] == piece[:n], its[2 : n + 2] == piece[:n]
            yield word[:n][second], after[1 : n + 1][second], np.where(third, after[2 : n + 2], 0)[second]
            word, piece = word[n:], piece[n:]


def _added(parts: list[tuple[np.ndarray, ...]], counts: list[np.ndarray]) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Rows of several columns, sorted, each once, with the sum of its counts."""
    columns = tuple(np.concatenate(c) for c in zip(*parts, strict=True))
    n, order = np.concatenate(counts), np.lexsort(columns[::-1])
    columns = tuple(c[order] for c in columns)
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    starts = np.flatnonzero(new)
    return tuple(c[starts] for c in columns), np.add.reduceat(n[order], starts) if len(starts) else n


def _held(batches: Iterable[pa.RecordBatch], pick: Callable) -> Iterator[tuple[tuple[np.ndarray, ...], np.ndarray]]:
    """What pick takes of each part's suffixes, added up over what a task holds."""
    parts, size = [], 0
    for t1, t2, t3 in _suffixes(batches):
        parts.append(pick(t1, t2, t3))
        size += len(parts[-1][0])
        if size > HELD:
            yield _added(parts, [np.ones(len(p[0]), np.int64) for p in parts])
            parts, size = [], 0
    if size:
        yield _added(parts, [np.ones(len(p[0]), np.int64) for p in parts])


def _count_pairs(heavy: np.ndarray) -> Callable:
    """(t1, t2, n) of the suffixes that begin with a heavy word."""

    def run(batches):
        def pick(t1, t2, t3):
            some = np.isin(t1, heavy)
            return t1[some], t2[some]

        for (t1, t2), n in _held(batches, pick):
            yield pa.RecordBatch.from_arrays([pa.array(t1), pa.array(t2), pa.array(n)], ["p", "t", "n"])

    return run


def _keys(*columns: np.ndarray) -> np.ndarray:
    """Rows of non-negative integers as byte strings in their order."""
    return np.ascontiguousarray(np.stack(columns, axis=1).astype(">i8")).view(f"S{8 * len(columns)}").ravel()


def _send(bounds: np.ndarray, heavy: np.ndarray) -> Callable:
    """(group, data): the suffixes of each group, packed. bounds: the least (t1, t2, t3) of each group, in order."""
    first, keys = bounds[:, 0].copy(), _keys(bounds[:, 0], bounds[:, 1], bounds[:, 2])

    def run(batches):
        for (t1, t2, t3), n in _held(batches, lambda *t: t):
            group = np.searchsorted(first, t1, "right") - 1
            split = np.isin(t1, heavy)
            group[split] = np.searchsorted(keys, _keys(t1[split], t2[split], t3[split]), "right") - 1
            starts = np.flatnonzero(np.diff(group, prepend=-1))
            cells = [_pack(t1[a:b], t2[a:b], t3[a:b], n[a:b]) for a, b in zip(starts, [*starts[1:], len(group)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(group[starts], pa.int32()), pa.array(cells, pa.binary())], ["group", "data"])

    return run


def _pack(t1: np.ndarray, t2: np.ndarray, t3: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted suffixes: first words with the lengths of their runs, second words likewise, third words, counts."""
    new1 = np.flatnonzero(np.diff(t1, prepend=-1))
    new2 = np.flatnonzero((np.diff(t1, prepend=-1) != 0) | (np.diff(t2, prepend=-1) != 0))
    body = b"".join(x.tobytes() for x in (t1[new1], np.diff(np.append(new1, len(t1))).astype(np.int32), t2[new2], np.diff(np.append(new2, len(t1))).astype(np.int32), t3, n.astype(np.int32)))
    return np.array([len(new1), len(new2), len(t1)], np.int64).tobytes() + pa.compress(body, "zstd", asbytes=True) + len(body).to_bytes(8, "little")


def _unpack(data: bytes) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    n1, n2, n = np.frombuffer(data, np.int64, 3)
    body = pa.decompress(data[24:-8], int.from_bytes(data[-8:], "little"), "zstd", asbytes=True)
    out, at = [], 0
    for size, kind in ((n1, np.int64), (n1, np.int32), (n2, np.int64), (n2, np.int32), (n, np.int64), (n, np.int32)):
        out.append(np.frombuffer(body, kind, size, at))
        at += int(size) * np.dtype(kind).itemsize
    return (np.repeat(out[0], out[1]), np.repeat(out[2], out[3]), out[4]), out[5].astype(np.int64)


def _subtree(least: int) -> Callable:
    """The nodes of a group's subtree with a total of at least `least`: (t1, t2, t3, f), t3 is 0 for pairs."""

    def run(table: pa.Table) -> pa.Table:
        parts, counts = zip(*(_unpack(data) for data in table.column("data").to_pylist()), strict=True)
        (t1, t2, t3), leaf = _added(list(parts), list(counts))
        inner = np.flatnonzero((np.diff(t1, prepend=-1) != 0) | (np.diff(t2, prepend=-1) != 0))
        total = np.add.reduceat(leaf, inner)
        deep, wide = np.flatnonzero((leaf >= least) & (t3 > 0)), total >= least
        at = inner[wide]
        columns = [np.concatenate(c) for c in ((t1[deep], t1[at]), (t2[deep], t2[at]), (t3[deep], np.zeros(len(at), np.int64)), (leaf[deep], total[wide]))]
        return pa.table(dict(zip(("t1", "t2", "t3", "f"), columns, strict=True)))

    return run


def _cuts(counts: DataFrame, budget: int) -> list[tuple[int, int]]:
    """(p, t): for each p of counts (p, t, n), the least t of each run of t, in order, that holds about budget. Sums by ranges of t first."""
    counts = counts.withColumn("b", F.shiftright("t", 51))
    sums = counts.groupBy("p", "b").agg(F.sum("n").alias("own"))
    sums = stored(sums.select("p", "b", (F.sum("own").over(Window.partitionBy("p").orderBy("b")) - F.col("own")).alias("before")), "sums")
    before = F.col("before") + F.sum("n").over(Window.partitionBy("p", "b").orderBy("t")) - F.col("n")
    runs = counts.join(small_side(sums), ["p", "b"]).select("p", "t", F.floor(before / budget).alias("run"))
    return [(row["p"], row["t"]) for row in runs.groupBy("p", "run").agg(F.min("t").alias("t")).select("p", "t").collect()]


def _partition(texts: DataFrame, words: DataFrame, budget: int) -> tuple[np.ndarray, np.ndarray, DataFrame | None]:
    """The least (t1, t2, t3) of each group; the words with more than budget suffixes; pairs (p, t, n) of such words."""
    cuts = {(0, 0, 0)} | {(t, 0, 0) for _, t in _cuts(words.where(F.col("n") <= budget).select(F.lit(0).cast("long").alias("p"), "t", "n"), budget)}
    heavy = np.array(sorted(row["t"] for row in words.where(F.col("n") > budget).select("t").collect()), np.int64)  # fewer than MAX_GROUPS
    if not len(heavy):
        return np.array(sorted(cuts), np.int64), heavy, None
    cuts |= {(t + i, 0, 0) for t in heavy.tolist() for i in (0, 1)}
    pairs = stored(texts.mapInArrow(_count_pairs(heavy), "p long, t long, n long").groupBy("p", "t").agg(F.sum("n").alias("n")), "pairs")
    cuts |= {(p, t, 0) for p, t in _cuts(pairs.where(F.col("n") <= budget), budget)}
    for row in pairs.where(F.col("n") > budget).collect():
        ranges = -(-row["n"] // budget)
        cuts |= {(row["p"], row["t"], (1 << 63) // ranges * i) for i in range(ranges)} | {(row["p"], row["t"] + 1, 0)}
    return np.array(sorted(cuts), np.int64), heavy, pairs


def _score(a: Column, left: Column, right: Column) -> Column:
    big = [c.cast("decimal(19,0)") for c in (a, left, right)]
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (big[0] * big[0]), big[1] * big[2])


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 10, top: int = 2000, covered: int = 50, group_suffixes: int = GROUP_SUFFIXES
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of two or three words.

    A-Z are lower-cased; pieces end at STOPS, words at SPACES. a: occurrences of the phrase, overlaps included, at least
    `least`; n: all words of the language. For each cut of the phrase into two, l and r count its parts; the cut with the least
    floor(1000000 a a / (l r)) counts, the first of equals; numbers are exact while 1000000 a a is below 10**38. Phrases inside
    a longer one that has at least `covered` hundredths of their count are left out. Order: score, a, both falling, then the phrase
    in byte order. Null texts are empty, null languages `und`; no text or no phrase gives no row; repeated rows count each time.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = stored(texts.mapInArrow(_count_words, "lang string, word string, t long, n long").groupBy("lang", "word", "t").agg(F.sum("n").alias("n")), "words")
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    budget = max(group_suffixes, -(-(words.agg(F.sum("n")).first()[0] or 0) // MAX_GROUPS))
    bounds, heavy, pairs = _partition(texts, words, budget)
    cells = texts.mapInArrow(_send(bounds, heavy), "group int, data binary")
    nodes = cells.groupBy("group").applyInArrow(_subtree(least), "t1 long, t2 long, t3 long, f long")
    nodes = stored(nodes, "nodes")
    two = nodes.where("t3 = 0").select("t1", "t2", "f")
    if pairs is not None:  # pairs that were split lie in several groups
        split = stored(pairs.where(F.col("n") > budget).select(F.col("p").alias("t1"), F.col("t").alias("t2"), F.col("n").alias("f")), "split")
        two = two.join(small_side(split), ["t1", "t2"], "left_anti").union(split)
    three, two = nodes.where("t3 > 0"), stored(two, "two")
    known = stored(words.where(F.col("n") >= least).select("t", "word", "lang", F.col("n").alias("count")), "known")
    word = lambda i: small_side(known.select(F.col("t").alias(f"t{i}"), F.col("word").alias(f"w{i}"), F.col("count").alias(f"n{i}"), *(["lang"] if i == 1 else [])))
    longer = F.explode(F.array(F.struct("t1", "t2"), F.struct(F.col("t2").alias("t1"), F.col("t3").alias("t2")))).alias("e")
    around = three.select(longer, "f").groupBy("e.t1", "e.t2").agg(F.max("f").alias("most"))
    short = two.join(around, ["t1", "t2"], "left").where(F.coalesce(100 * F.col("most") < covered * F.col("f"), F.lit(True)))
    short = short.join(word(1), "t1").join(word(2), "t2").select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("f").alias("a"), F.col("n1").alias("l"), F.col("n2").alias("r"))
    pair = lambda x, y: small_side(two).select(F.col("t1").alias(x), F.col("t2").alias(y), F.col("f").alias(f"{x}{y}"))
    long = three.join(pair("t1", "t2"), ["t1", "t2"]).join(pair("t2", "t3"), ["t2", "t3"]).join(word(1), "t1").join(word(2), "t2").join(word(3), "t3")
    early, late = _score(F.col("f"), F.col("n1"), F.col("t2t3")), _score(F.col("f"), F.col("t1t2"), F.col("n3"))
    cut = F.when(early <= late, F.struct(F.col("n1").alias("l"), F.col("t2t3").alias("r"))).otherwise(F.struct(F.col("t1t2").alias("l"), F.col("n3").alias("r")))
    long = long.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("f").alias("a"), cut.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r")
    scored = short.union(long).withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = scored.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(64)))  # a language's best are sought in 64 shares first
    best = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(sizes) if sizes.count() < 1 << 16 else sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

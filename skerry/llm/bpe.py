"""Byte-level BPE with the ranks of a given vocabulary: encoding by higher-order functions, decoding by joining binary pieces.

A text is split into pieces by the vocabulary's pattern. The distinct pieces of all texts are counted; those that occur
more than once are folded once, the most frequent of them, up to a stated number of bytes, form a word table that each
task reads; any other piece is folded where it stands. Both give the same ids, so the size of the table changes only the
time. Texts are never shuffled.

The fold: a word's state is an array of its parts, at first all bytes, each as the rank of what it forms with the next
part and, in the low bits, its start; the least entry is the leftmost pair of least rank. Each step merges that pair and
looks up two ranks anew. Ranks are looked up in a literal array of slots by the hash of the bytes. Slots are small maps: in
lambdas a map's key is found by a loop, a place in an array by an exception, which takes longer. A step copies the array, so
words of over LONG bytes are merged with a heap in a pandas UDF.

Null is the empty text, which has no ids. A text's pieces are held by one task.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Callable

import pandas as pd
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, unused

#: Slots of the literal rank map and of the word table; bytes of a word up to which it is folded; entries of a state in which one is found by counting.
RANK_SLOTS, WORD_SLOTS, LONG, SEVERAL = 1 << 17, 1 << 18, 256, 24
#: Bytes of the word table, as Spark keeps it, and what a word takes besides its own bytes and ids.
WORD_BYTES, ENTRY_BYTES = 96 << 20, 72
#: Bits of a part's start in the fold's state, an array of integers, and the rank of pairs that don't merge: words of 2**PLACE - 3 bytes can be folded.
PLACE, NONE = 9, (1 << 22) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file's byte sequences and ids: lines of base64, a space, and a decimal number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once: the end of a fold over nothing. (A transform of one element would copy its result.)"""
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, use)


def _slot(key: Column, slots: int) -> Column:
    return F.hash(key).bitwiseAND(slots - 1)  # slots: a power of two


def _table(spark: SparkSession, value: object, kind: str) -> DataFrame:
    """A literal value as a stored table of one row. Read back as a scalar subquery it reaches tasks as one block of bytes."""
    return stored(spark.range(1).select(F.from_json(F.lit(json.dumps(value)), kind).alias("value")), "literal")


def _by_slot(entries: DataFrame, slots: int) -> DataFrame:
    """One row: an array of so many slots, each a map of the entries (key, value) whose hash falls into it, or null."""
    filled = entries.groupBy(_slot(F.col("key"), slots).alias("slot")).agg(F.collect_list("key").alias("k"), F.collect_list("value").alias("v"))
    all_ = entries.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot")).join(filled, "slot", "left")
    return all_.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "k", "v"))), lambda s: F.map_from_arrays(s["k"], s["v"])).alias("value"))


def rank_map(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    """The ranks, as they stand in the fold's state, in slots: a stored table of one row."""
    if max(ranks.values(), default=0) >= NONE:
        raise ValueError(f"ranks have to be less than {NONE}")
    rows = spark.createDataFrame([(word, rank << PLACE) for word, rank in ranks.items()], "key binary, value int")
    return stored(_by_slot(rows, RANK_SLOTS), "ranks")


def _using(df: DataFrame, tables: dict[str, DataFrame], out: str, use: Callable[[Column], Column]) -> DataFrame:
    """df with out = use(struct of the tables' values). Each value is used once, so it becomes part of the projection and of no row."""
    names = dict(zip(tables, unused(df.columns, *tables), strict=True))
    whole = F.struct(*(F.col(own).alias(name) for name, own in names.items()))
    return df.withColumns({own: tables[name].scalar() for name, own in names.items()}).withColumn(out, _let(whole, use)).drop(*names.values())


def _rank(table: Column, binary: Column) -> Column:
    return F.coalesce(F.get(table, _slot(binary, RANK_SLOTS))[binary], F.lit(NONE << PLACE))


def fold(word: Column, table: Column) -> Column:
    """The ids of one word (binary, not empty): as it stands if it has a rank, else its bytes with ranked merges folded over them.

    Starts count from 1. Besides the parts the state holds an entry before them, whose start lies beyond any word, one
    after them with the start that a further part would have, and a last one of start 0: what is cut out of the word from
    the first, or up to the last, is empty and has no rank, so the ends need no conditions.
    """
    n, none, low = F.octet_length(word), F.lit(NONE << PLACE), F.lit((1 << PLACE) - 1)
    rank = lambda a, b: _rank(table, F.substring(word, a, b - a))
    start = lambda state, i: F.get(state, i).bitwiseAND(low)

    def place_of(state: Column, least: Column, a: Column) -> Column:
        """Where the entry least is, from 1: parts are in the order of their starts, so as many have no later start; the last entry counts for the first."""
        counted = F.size(F.filter(state, lambda e: e.bitwiseAND(low) <= a))
        return F.when(F.size(state) > SEVERAL, F.array_position(state, least).cast("int")).otherwise(counted)

    def merged(state: Column, a: Column, at: Column) -> Column:
        """The part at place `at`, which starts at a, goes together with the next one: its own entry and the one before it change."""
        before = _let(start(state, at - 2), lambda b: rank(b, start(state, at + 1)) + b)
        return F.flatten(F.array(F.slice(state, F.lit(1), at - 2), F.array(before, rank(a, start(state, at + 2)) + a), F.slice(state, at + 2, F.size(state))))

    def step(state: Column, _: Column) -> Column:
        merge = lambda least: _let(least.bitwiseAND(low), lambda a: _let(place_of(state, least, a), lambda at: merged(state, a, at)))
        return _let(F.array_min(state), lambda least: F.when(least < none, merge(least)).otherwise(state))

    pairs = F.transform(F.sequence(F.lit(1), n), lambda a: F.when(a < n, rank(a, a + 2)).otherwise(none) + a)
    first = F.flatten(F.array(F.array(none + low), pairs, F.array(none + n + 1, none)))
    read = lambda state: F.transform(F.slice(state, F.lit(2), F.size(state) - 3), lambda e, i: F.shiftright(rank(e.bitwiseAND(low), start(state, i + 2)), PLACE))
    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), first, step, read)
    return _let(_rank(table, word), lambda whole: F.when(whole < none, F.array(F.shiftright(whole, PLACE))).otherwise(folded))


def heap_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word, in n log n: a linked list of parts and a heap of (rank, place)."""
    if word in ranks:
        return [ranks[word]]
    end, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(at: int) -> None:
        if at >= 0 and end[at] < len(word) and (rank := ranks.get(word[at : end[end[at]]])) is not None:
            heapq.heappush(heap, (rank, at, end[end[at]]))

    for at in range(len(word) - 1):
        offer(at)
    while heap:
        _, at, to = heapq.heappop(heap)
        if end[at] < 0 or end[at] == len(word) or end[end[at]] != to:
            continue  # a part has changed since
        gone, end[at] = end[at], to
        end[gone] = -1
        if to < len(word):
            before[to] = at
        offer(at)
        offer(before[at])
    out, at = [], 0
    while at < len(word):
        out.append(ranks[word[at : end[at]]])
        at = end[at]
    return out


def _ranges(points: list[int]) -> str:
    """Code points as the inside of a Java character class."""
    out: list[list[int]] = []
    for c in points:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in out)


def java_pattern(spark: SparkSession, pattern: str) -> str:
    r"""pattern for Java, whose Unicode is older: the letters and digits that the tokenizer library knows and Java doesn't join \p{L} and \p{N}.

    Java names what it doesn't know; of that, the library is asked which code points it puts into one piece with a letter or a digit.
    """
    known = regex.findall(r"[\p{L}\p{N}]", "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF))
    left = spark.range(1).select(F.regexp_replace(F.lit("".join(known)), r"[\p{L}\p{N}]", "")).first()[0]
    unknown = sorted(map(ord, left))
    added = {}
    for name, mate in (("L", "a"), ("N", "1")):
        words = [(mate + chr(c)).encode() for c in unknown]
        asked = tiktoken.Encoding(f"classes-{name}", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)} | {w: 256 + i for i, w in enumerate(words)}, special_tokens={})
        added[name] = _ranges([c for c in unknown if len(asked.encode_ordinary(mate + chr(c))) == 1])
    for name, ranges in added.items():
        if ranges:  # the guard spares ASCII the long list
            pattern = pattern.replace(rf"\p{{{name}}}", rf"[\p{{{name}}}[\x{{100}}-\x{{10FFFF}}&&[{ranges}]]]")
    return "(?U)" + pattern


def pieces(text: Column, java: str) -> Column:
    """The pieces of a text in order; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java), F.lit(0))


def word_table(docs: DataFrame, java: str, table: DataFrame, text_col: str = "text", limit: int = WORD_BYTES) -> tuple[DataFrame, bool]:
    """The word table in one row, and whether any piece is longer than LONG bytes.

    All pieces of all texts are counted. Words that occur once, and the least frequent of the others if the table would
    take more than limit bytes, are left to be folded at their place.
    """
    counts = stored(docs.select(F.explode(pieces(F.col(text_col), java)).alias("piece")).groupBy("piece").count(), "pieces")
    size, level = F.octet_length("piece"), F.floor(F.log2("count") * 8)
    long = counts.where(size > LONG).limit(1).count() > 0
    again = counts.where((F.col("count") > 1) & (size <= LONG))
    total, least = 0, 1 << 20
    for row in sorted(again.groupBy(level.alias("level")).agg(F.sum(size * 3 + ENTRY_BYTES).alias("bytes")).collect(), key=lambda row: -row["level"]):  # some hundred levels
        total += row["bytes"]
        if total + WORD_SLOTS * 40 > limit:
            break
        least = row["level"]
    words = _using(again.where(level >= least).select("piece"), {"ranks": table}, "ids", lambda t: fold(F.col("piece").cast("binary"), t["ranks"]))
    return stored(_by_slot(words.select(F.col("piece").alias("key"), F.col("ids").alias("value")), WORD_SLOTS), "words"), long


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", out: str = "ids", word_bytes: int = WORD_BYTES) -> DataFrame:
    """docs with an array of the ids of each text, as the tokenizer library's encode_ordinary gives them.

    A column named as out is replaced. Null and empty texts give an empty array.
    """
    java, table = java_pattern(docs.sparkSession, pattern), rank_map(docs.sparkSession, ranks)
    words, long = word_table(docs.select(F.col(text_col).alias("text")), java, table, "text", word_bytes)
    split, by_heap = unused(docs.columns, "pieces", "long")

    @F.pandas_udf("array<array<int>>")
    def heap_ids(lists: pd.Series) -> pd.Series:
        return lists.map(lambda texts: [heap_merge(text.encode(), ranks) for text in texts])

    def ids(tables: Column, piece: Column) -> Column:
        one = fold(piece.cast("binary"), tables["ranks"])
        if long:
            one = F.when(F.octet_length(piece) > LONG, F.get(F.col(by_heap), F.array_position(longs, piece).cast("int") - 1)).otherwise(one)
        slot = F.get(tables["words"], _slot(piece, WORD_SLOTS))
        return F.coalesce(slot[piece], one)

    longs = F.array_distinct(F.filter(F.col(split), lambda p: F.octet_length(p) > LONG))
    found = docs.withColumn(split, pieces(F.col(text_col), java))
    if long:
        found = found.withColumn(by_heap, heap_ids(longs))
    return _using(found, {"words": words, "ranks": table}, out, lambda t: F.transform(F.col(split), lambda piece: ids(t, piece))).withColumn(out, F.flatten(out)).drop(split, by_heap)


def decode(docs: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with the bytes of an array of ids: their binary pieces, in hexadecimal until all are joined. Null stays null; an id without a piece is an error."""
    hexes: list[str | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for word, rank in ranks.items():
        hexes[rank] = word.hex()
    table = _table(docs.sparkSession, hexes, "array<string>")
    return _using(docs, {"words": table}, out, lambda t: F.unhex(F.array_join(F.transform(F.col(ids), lambda i: t["words"][i]), "")))

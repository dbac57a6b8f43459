"""Line dedup: a deletion-neighbourhood join within one edit.

Two lines within one edit have equal deletion variants: the one minus a character equals the other (insertion or
deletion), or both minus the character at one place are equal (substitution). All variants are hashed keys that hold the
kind, and for substitutions length and place, so lines that share one are within the bound of each other and a group
needs its earliest line only, never its pairs. Equal lines are merged first.

Before variants are made, lines that cannot have a partner are set aside. With m the length of the shorter of two lines
within one edit, and m + 1 places cut into k equal blocks, the edit lies in one block, and what stands before and behind
it is equal. So partners share (m, block, hash of the rest) for m their own length or one less: 2 k keys a line. First
two blocks are tried on all lines, then FINE blocks on those that are left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_side, stored, unused
from .tokens import _INVERSE, mix, pair, prefix_hashes

COARSE, FINE = 2, 16
#: Characters whose variants are made at a time; a longer line is handled alone.
VARIANT_CHARS = 1 << 18
#: Characters whose lines are hashed at a time, at about 100 bytes a character; a longer line is handled alone.
CHUNK = 1 << 18
#: Code points under this are looked up; the others are hashed one by one.
TABLE = 1 << 14
_POINT = mix(np.arange(1, TABLE + 1, dtype=np.uint64))
PARTS = [f"part{i}" for i in range(2 * COARSE)]


def _normal(line: str) -> str:
    return line.strip().lower()


def _points(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _POINT[np.minimum(code, TABLE - 1)]
    rare = np.flatnonzero(code >= TABLE)
    out[rare] = mix(code[rare].astype(np.uint64) + np.uint64(1))
    return out


def _hashed(lines: list[str]):
    """Of lines as one sequence: where each starts and ends, the characters' values, prefix hashes, inverse powers."""
    v = _points("".join(lines))
    ends = np.cumsum([len(x) for x in lines])
    return ends - np.array([len(x) for x in lines]), ends, v, *prefix_hashes(v)


def _blocks(s, e, h, back, k: int) -> np.ndarray:
    """2 k keys of each line: the hash of what stands before and behind each block, with the length and the block."""
    out = []
    for m in (e - s, e - s - 1):
        b = -(-(m + 1) // k)
        for i in range(k):
            p, q = np.minimum(i * b, m), e - np.maximum(m - (i + 1) * b, 0)
            rest = pair((h[s + p] - h[s]) * back[s], (h[e] - h[q]) * back[q])
            out.append(pair(rest, (m * 64 + i).astype(np.uint64)))
    return np.stack(out, 1)


def _grouped(items, size: int):
    """Items (..., line) in lists of about `size` characters."""
    held, n = [], 0
    for item in items:
        if held and n + len(item[-1]) > size:
            yield held
            held, n = [], 0
        held.append(item)
        n += len(item[-1])
    if held:
        yield held


def _ints(x) -> pa.Array:
    return pa.array(np.ascontiguousarray(x, np.uint64).view(np.int64))


def _describe(parts):
    """Every line that is not blank: its text's id, row and number of lines, its place, two hashes, and coarse block keys."""
    for part in parts:

        def found(part=part):
            for at, text in enumerate(part["text"]):
                lines = [(i, x) for i, line in enumerate((text.as_py() or "").split("\n")) if (x := _normal(line))]
                for i, x in lines:
                    yield at, len(lines), i, x

        for some in _grouped(found(), CHUNK):
            at, of, place = (pa.array([x[c] for x in some], t) for c, t in ((0, pa.int64()), (1, pa.int32()), (2, pa.int32())))
            s, e, v, h, back = _hashed([x[-1] for x in some])
            sums, by_place = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (v, v * np.arange(len(v), dtype=np.uint64)))
            whole = mix((h[e] - h[s]) * back[s] + np.uint64(1))
            second = pair(whole, by_place[e] - by_place[s] - s.astype(np.uint64) * (sums[e] - sums[s]))
            keys = _blocks(s, e, h, back, COARSE)
            own = [part["id"].take(at), part["row"].take(at), of, place, _ints(whole), _ints(second)]
            yield pa.RecordBatch.from_arrays([*own, *(_ints(k) for k in keys.T)], names=["id", "row", "of", "line", "h1", "h2", *PARTS])


def _wanted(parts):
    """The normal text of each asked line; a text is split once."""
    for part in parts:
        out = []
        for text, wanted in zip(part["text"], part["wanted"], strict=True):
            lines = (text.as_py() or "").split("\n")
            out += [(w["h1"], _normal(lines[w["line"]])) for w in wanted.as_py()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], names=["h1", "text"])


def _fine(parts):
    """Fine block keys of lines."""
    for part in parts:
        for some in _grouped(zip(part["h1"].to_pylist(), part["text"].to_pylist(), strict=True), CHUNK):
            s, e, _, h, back = _hashed([x[1] for x in some])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([x[0] for x in some], 2 * FINE), pa.int64()), _ints(_blocks(s, e, h, back, FINE).ravel())], names=["h1", "part"])


def _variants(parts):
    """Keys of lines: substitution variants (role 0), shorter variants (role 1) and the line itself (role 2)."""
    one = np.array([1], np.uint64)
    for part in parts:
        for some in _grouped(enumerate(part["text"].to_pylist()), VARIANT_CHARS):
            s, e, v, h, back = _hashed([x[1] for x in some])
            i, line = np.arange(len(v)), np.repeat(np.arange(len(some)), e - s)
            shorter = mix(((h[i] - h[s[line]]) + (h[e[line]] - h[i + 1]) * _INVERSE) * back[s[line]])
            place = (i - s[line]).astype(np.uint64) * np.uint64(4) + (e - s)[line].astype(np.uint64) * np.uint64(1 << 32)
            new = np.ones(len(v), bool)  # of a run of one character any one may go, with the same result
            new[:-1] = (v[:-1] != v[1:]) | (line[:-1] != line[1:])
            keys = np.concatenate([pair(shorter, place + np.uint64(2)), pair(shorter[new], one), pair(mix((h[e] - h[s]) * back[s]), one)])
            role = np.repeat(np.arange(3), [len(v), new.sum(), len(some)]).astype(np.int8)
            owner = pa.array(np.concatenate([line, line[new], np.arange(len(some))]) + some[0][0])
            yield pa.RecordBatch.from_arrays([_ints(keys), pa.array(role), *(part[c].take(owner) for c in ("h1", "id", "row", "line"))], names=["key", "role", "h1", "id", "row", "line"])


def _met(keys: DataFrame, name: str) -> DataFrame:
    """The lines (h1) of keys (h1, part) that share a part with another line."""
    shared = stored(keys.groupBy("part").count().where("count > 1").select("part"), name)
    return keys.join(small_side(shared), "part", "left_semi").select("h1").distinct()


def line_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, n_lines, removed): for each text with lines, how many, and the sorted numbers (from 0) of those to remove.

    row: hash of id and text. A line, trimmed and in lower case, goes if an equal line, or a different one within one
    edit of it, comes earlier (by id, then row, then line); the earliest of each stays. Blank lines are not counted and
    stay. Null texts have no lines. Repeated rows (equal id and text) count as one text. Null ids come first.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"), F.col(text_col).cast("string").alias("text"))
    at = F.struct("id", "row", "line")
    lines = stored(base.mapInArrow(_describe, "id long, row long, of int, line int, h1 long, h2 long, " + ", ".join(f"{p} long" for p in PARTS)), "lines")
    heads = stored(lines.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.count("*").alias("copies"), *(F.min(p).alias(p) for p in PARTS)), "heads")
    near = _met(heads.select("h1", F.explode(F.array(*PARTS)).alias("part")), "parts")
    asked = stored(heads.join(small_side(stored(near, "near")), "h1").select("h1", "first.id", "first.row", "first.line"), "asked")
    wanted = stored(asked.groupBy("row").agg(F.collect_list(F.struct("line", "h1")).alias("wanted")), "wanted")
    texts = base.select("row", "text").join(small_side(wanted), "row").mapInArrow(_wanted, "h1 long, text string").dropDuplicates(["h1"])
    texts = stored(texts, "line-texts")
    texts = stored(texts.join(_met(stored(texts.mapInArrow(_fine, "h1 long, part long"), "fine"), "fine-parts"), "h1", "left_semi"), "near-texts")
    variants = asked.join(texts, "h1").mapInArrow(_variants, "key long, role byte, h1 long, id long, row long, line int")
    mine = F.struct("id", "row", "line", "h1")
    group = variants.groupBy("key").agg(*(F.min(F.when(F.col("role") == i, mine)).alias(f"m{i}") for i in range(3)), F.count("*").alias("size")).where("size > 1").drop("size")
    group = small_side(stored(group, "groups"))
    partner = F.when(F.col("role") == 0, F.col("m0")).when(F.col("role") == 1, F.col("m2")).otherwise(F.col("m1"))
    pairs = variants.join(group, "key").select("h1", mine.alias("own"), partner.alias("other")).where("other.h1 <> h1 and other < own").select("h1", F.col("other.h1").alias("other")).distinct()
    pairs = pairs.join(texts, "h1").join(texts.select(F.col("h1").alias("other"), F.col("text").alias("other_text")), "other")
    gone = pairs.where(F.levenshtein("text", "other_text", 1) >= 0).select("h1").distinct().withColumn("gone", F.lit(True))
    marked = heads.select("h1", "h2", "first", "copies").join(small_side(stored(gone, "gone")), "h1", "left").where("copies > 1 or gone").drop("copies")
    out = lines.select("h1", "h2", *("id", "row", "line")).join(small_side(stored(marked, "marked")), ["h1", "h2"])
    out = out.where(F.col("gone").isNotNull() | (at != F.col("first"))).groupBy("row").agg(F.array_sort(F.collect_set("line")).alias("removed"))
    sizes = lines.groupBy("row").agg(F.min("of").cast("long").alias("n_lines"))
    found = sizes.join(out, "row", "left").select("row", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
    return stored(found, "removed")


def without_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with duplicate lines cut out of the text, and the columns n_lines and n_removed (existing ones are replaced)."""
    rows = docs.drop("n_lines", "n_removed")
    key, row, n, removed, cut = unused(rows.columns, "key", "row", "n", "removed", "cut")
    found = line_duplicates(docs, id_col, text_col).select(F.col("row").alias(row), F.col("n_lines").alias(n), F.col("removed").alias(removed))
    rows = rows.withColumn(key, F.xxhash64(F.col(id_col), F.col(text_col))).join(small_side(found), F.col(key) == F.col(row), "left")

    def kept(x):
        """What stands between removed lines; x.l and x.r are looked up, not made again, for each piece."""
        start = lambda i: F.coalesce(F.get(x["r"], i - 1) + 1, F.lit(0))
        end = lambda i: F.coalesce(F.get(x["r"], i), F.size(x["l"]))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(x["r"])), lambda i: F.slice(x["l"], start(i) + 1, end(i) - start(i))))

    pieces = F.transform(F.array(F.struct(F.split(F.col(text_col), "\n").alias("l"), F.col(removed).alias("r"))), kept)
    rows = rows.withColumn(cut, F.when(F.size(removed) > 0, F.array_join(F.get(pieces, F.lit(0)), "\n")).otherwise(F.col(text_col)))
    rows = rows.withColumns({text_col: F.col(cut), "n_lines": F.coalesce(n, F.lit(0)), "n_removed": F.greatest(F.size(removed), F.lit(0)).cast("long")})
    return rows.drop(key, row, n, removed, cut)

"""Shingle-set near-duplicates: a size-aware heavy-light Jaccard join, reduced to connected groups.

Equal sets are merged first. A set of n shingles that reaches similarity t with another shares at least a = ceil(t n)
with it, so by any one global order both share l members among their first n - a + l ("prefix"). Small ("light") sets
are keyed by all pairs of members (fixed-size subsets, l = 2) of that prefix; large ("heavy") sets scan the inverted
lists of its single members (l = 1), as do the light sets near enough in size to meet a heavy one. The boundary is the
size with the least estimated cost on the histogram of sizes. The order puts members that many documents of a task
share last, by how many, so that lists of common passages are rarely in a prefix; it affects cost, not results.

Groups, not pairs, are wanted, so candidates are verified in two rounds. A round meets the members of each list inside
tasks and sends on only pairs that can still be linked: by size, by the place of the common member in both prefixes, and
by sketch. Members without a partner by size and place are set aside before sketches are fetched. A sketch holds, for
each of BITS buckets, whether the set has an odd number of members in it; the number of buckets in which two sketches
differ is at most the number of members that one set has and the other lacks. First, lists are dealt into blocks of about
BLOCK members; each block is met for itself, and a task sends a spanning forest of its nearest pairs, so a large family
of near-copies costs a few verifications for each member. Then the lists that still hold several groups are met whole, in
pairs of blocks: the members outside of a list's largest group against each other and against that group. So no link
between groups is left untested, and members of one group are not compared again. Verification computes the exact overlap
of the whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_side, stored
from .components import components
from .tokens import chunks, pair, shingles, words

#: Members that at least this many documents of a task share are counted over all tasks; the most frequent are ordered last.
SHARED_IN_TASK, MAX_COMMON = 3, 200_000
#: Members that a task sorts at a time to count them, keys that it sends at a time, and pairs that it holds before they become a forest or are sent.
HELD, KEYS, PAIRS = 4_000_000, 200_000, 1 << 19
#: Buckets of a sketch, one bit each.
BITS = 1024
MAX_LIGHT = 60
#: Members of a block of a list; lists up to SHORT members are met many at a time; pairs compared at a time.
BLOCK, SHORT, SLAB = 2048, 32, 1 << 18


def _sets(texts, width):
    """The shingle set of each text, in order."""
    for part in chunks(texts):
        hashes, sizes = words(part)
        at = 0
        for n in sizes.tolist():
            yield shingles(hashes[at : at + n], width)
            at += n


def _profile(width: int):
    """For each row its set's size, two sums that identify the set, and its sketch; and for each task, members that many rows share."""

    def run(parts):
        held, seen = np.empty(HELD, np.uint64), 0

        def common():
            all_ = held[:seen]
            all_.sort()
            names = np.unique(all_[SHARED_IN_TASK - 1 :][all_[SHARED_IN_TASK - 1 :] == all_[: 1 - SHARED_IN_TASK or None]])
            n = np.searchsorted(all_, names, "right") - np.searchsorted(all_, names)
            return pa.RecordBatch.from_arrays([pa.nulls(len(names), pa.int64()), pa.nulls(len(names), pa.int64()), pa.array(n.astype(np.int64)), pa.array(names.view(np.int64)), pa.nulls(len(names), pa.int64()), pa.nulls(len(names), pa.binary())], names=["id", "row", "n", "h1", "h2", "sketch"])

        for part in parts:
            n, h1, h2, sketches = [], [], [], []
            for s in _sets((t.as_py() for t in part["text"]), width):
                n.append(len(s))
                h1.append(s.sum(dtype=np.uint64))
                h2.append(pair(s, s).sum(dtype=np.uint64))
                odd = np.bincount((s >> np.uint64(54)).astype(np.int64), minlength=BITS) & 1
                sketches.append(np.packbits(odd.astype(np.uint8)).tobytes())
                for at in range(0, len(s), HELD):
                    some = s[at : at + HELD]
                    if seen + len(some) > HELD:
                        yield common()
                        seen = 0
                    held[seen : seen + len(some)] = some
                    seen += len(some)
            ints = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([part["id"], part["row"], pa.array(n, pa.int64()), ints(h1), ints(h2), pa.array(sketches, pa.binary())], names=["id", "row", "n", "h1", "h2", "sketch"])
        yield common()

    return run


def _prefixes(width: int, percent: int, light: int, names: np.ndarray, rank: np.ndarray):
    """Keys of each set: (key, row, n, at). Pairs of members for light sets, single members for those that meet a heavy one,
    or one of so few members that a link with it may need no more than one common member (at 50 percent or less)."""
    few = 100 // percent if percent <= 50 else 0
    flat = lambda x, t: pa.array(np.concatenate(x).astype(t, copy=False))

    def sent(rows, sizes, keys, places):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), flat(rows, np.int64), flat(sizes, np.int32), flat(places, np.int32)], names=["key", "row", "n", "at"])

    def run(parts):
        for part in parts:
            rows, sizes, keys, places, held = [], [], [], [], 0
            for row, s in zip(part["row"].to_numpy(), _sets((t.as_py() for t in part["text"]), width), strict=True):
                n = len(s)
                if n < (1 if few else 2):
                    continue
                spare = n - -(-percent * n // 100)
                late = np.zeros(n, np.int64)
                if len(names):
                    at = np.minimum(np.searchsorted(names, s), len(names) - 1)
                    late = np.where(names[at] == s, rank[at] + 1, 0)
                first = s[np.lexsort((s, late))[: spare + 2]]
                if n <= light:
                    i, j = np.triu_indices(len(first), 1)
                    rows.append(np.full(len(i), row))
                    sizes.append(np.full(len(i), n, np.int32))
                    keys.append(pair(pair(first[i], first[j]), np.uint64(2)))
                    places.append(np.maximum(i, j).astype(np.int32))
                    held += len(i)
                if n * 100 >= percent * (light + 1) or n * percent <= 100 * few:
                    own = first[: spare + 1]
                    rows.append(np.full(len(own), row))
                    sizes.append(np.full(len(own), n, np.int32))
                    keys.append(own)
                    places.append(np.arange(len(own), dtype=np.int32))
                    held += len(own)
                if held > KEYS:
                    yield sent(rows, sizes, keys, places)
                    rows, sizes, keys, places, held = [], [], [], [], 0
            if rows:
                yield sent(rows, sizes, keys, places)

    return run


def _verify(width: int, percent: int):
    """Rows (a, b, side, text), sorted: the left and then the right text of each pair."""

    def run(parts):
        left, sides = None, []
        for part in parts:
            out = []
            sets = _sets((t.as_py() for t in part["text"]), width)
            for a, b, side, own in zip(part["a"].to_pylist(), part["b"].to_pylist(), part["side"].to_pylist(), sets, strict=True):
                if side == 0:
                    left, sides = own, (a, b)
                elif sides == (a, b):
                    both = len(np.intersect1d(left, own, assume_unique=True))
                    out.append((a, b, both > 0 and 100 * both >= percent * (len(left) + len(own) - both)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], names=["a", "b", "linked"])

    return run


def _forest(a: np.ndarray, b: np.ndarray, apart: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Which pairs (a[i], b[i]) form a spanning forest of the nearest ones over the parts of their ends."""
    order = np.argsort(apart, kind="stable")
    _, group = np.unique(part, return_inverse=True)
    taken = []
    while len(order):
        x, y = group[a[order]], group[b[order]]
        order, x, y = order[x != y], x[x != y], y[x != y]
        if not len(order):
            break
        names, first = np.unique(np.stack([x, y], 1).ravel(), return_index=True)  # each group's nearest pair
        first = np.unique(first // 2)
        taken.append(order[first])
        root = np.arange(len(group) and group.max() + 1)
        x, y = x[first], y[first]
        while (root[x] != root[y]).any():  # the least name goes along the taken pairs
            low = np.minimum(root[x], root[y])
            np.minimum.at(root, root[x], low)
            np.minimum.at(root, root[y], low)
            root = root[root]
        group = root[group]
    return np.concatenate(taken) if taken else np.zeros(0, np.int64)


GROUP = ("key", "x", "y")


def _pairs(g: dict[str, np.ndarray], percent: int):
    """Pairs of rows of different parts that meet in a group (blocks x and y of a list) and are near by size and place."""
    n, at, part = g["n"].astype(np.int64), g["at"].astype(np.int64), g["part"]

    def near(i, j):
        ok = (part[i] != part[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        most = 1 + np.minimum(n[i] - at[i], n[j] - at[j])  # no more can be shared than follows
        return ok & ((100 + percent) * most >= percent * (n[i] + n[j]))

    new = np.logical_or.reduce([np.diff(g[c], prepend=~g[c][:1]) != 0 for c in GROUP])
    start = np.flatnonzero(new)
    size = np.diff(start, append=len(n))
    small = np.repeat(size <= SHORT, size) & (g["x"] == g["y"])
    rows, group = np.flatnonzero(small), np.cumsum(new)[small]
    for d in range(1, SHORT):
        i = np.flatnonzero(group[:-d] == group[d:])
        if not len(i):
            break
        i, j = rows[i], rows[i + d]
        ok = near(i, j)
        yield i[ok], j[ok]
    for s, e in zip(start, start + size, strict=True):
        if small[s]:
            continue
        one = g["x"][s] == g["y"][s]
        left = np.arange(s, e) if one else s + np.flatnonzero(g["block"][s:e] == g["x"][s])
        right = left if one else s + np.flatnonzero(g["block"][s:e] == g["y"][s])
        for some in np.array_split(left, max(1, -(-len(left) * len(right) // SLAB))):
            i, j = np.nonzero(near(some[:, None], right[None]))
            i, j = some[i], right[j]
            yield (i[i < j], j[i < j]) if one else (i, j)


def _close(percent: int):
    """Which entries have a partner that is near by size and place."""

    def met(table: pa.Table):
        g = {c: table[c].to_numpy() for c in (*GROUP, "part", "n", "at", "block")}
        hit = np.zeros(len(g["n"]), bool)
        for i, j in _pairs(g, percent):
            hit[i] = hit[j] = True
        yield table.filter(pa.array(hit))

    return _whole_groups(met)


def _meet(percent: int, forest: bool):
    """Pairs (a, b), a > b, of different parts that can be linked; forest: only those of a spanning forest of the parts."""

    def met(table: pa.Table):
        g = {c: table[c].to_numpy() for c in (*GROUP, "row", "part", "n", "at", "block")}
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(-1, BITS // 64)
        n, found, held = g["n"].astype(np.int64), [(np.zeros(0, np.int64),) * 3], 0

        def joined():
            return tuple(np.concatenate([f[i] for f in found]) for i in range(3))

        def nearest(a, b, apart):
            kept = _forest(a, b, apart, g["part"])
            return a[kept], b[kept], apart[kept]

        def ends(a, b, _):
            a, b = g["row"][a], g["row"][b]
            return pa.table({"a": pa.array(np.maximum(a, b), pa.int64()), "b": pa.array(np.minimum(a, b), pa.int64())})

        for i, j in _pairs(g, percent):
            for k in range(0, len(i), SLAB // 8):
                a, b = i[k : k + SLAB // 8], j[k : k + SLAB // 8]
                apart = np.bitwise_count(sketch[a] ^ sketch[b]).sum(1, dtype=np.int64)
                ok = (100 + percent) * apart <= (100 - percent) * (n[a] + n[b])
                found.append((a[ok], b[ok], apart[ok]))
                held += np.count_nonzero(ok)
                if held > PAIRS:  # a forest has fewer pairs than the table rows, and keeps what is linked
                    if forest:
                        found = [nearest(*joined())]
                    else:
                        yield ends(*joined())
                        found = found[:1]
                    held = 0
        yield ends(*(nearest(*joined()) if forest else joined()))

    return _whole_groups(met)


def _whole_groups(met):
    """met, applied to tables of whole groups, its tables sent on; rows come sorted by group, and a group may go on in the next batch."""

    def run(parts):
        held: list[pa.RecordBatch] = []
        for part in parts:
            if not part.num_rows:
                continue
            last = [part[c][-1].as_py() for c in GROUP]
            same = np.logical_and.reduce([part[c].to_numpy() == v for c, v in zip(GROUP, last, strict=True)])
            start = 0 if same.all() else int(np.flatnonzero(~same)[-1]) + 1
            if start or held and [held[-1][c][-1].as_py() for c in GROUP] != last:
                held.append(part.slice(0, start))
                for found in met(pa.Table.from_batches([h for h in held if h.num_rows])):
                    yield from found.to_batches()
                held = []
            held.append(part.slice(start))
        if held:
            for found in met(pa.Table.from_batches(held)):
                yield from found.to_batches()

    return run


def boundary(histogram: list[tuple[int, int]], percent: int, repeats: float) -> int:
    """The light size with the least cost: keys of light sets plus keys, and list entries met, of sets that scan lists."""

    def pairs(n):
        p = n - -(-percent * n // 100) + 2
        return p * (p - 1) / 2

    def scan(n):
        return (n - -(-percent * n // 100) + 1) * (1 + repeats)

    cost = {s: sum(c * (pairs(n) * (n <= s) + scan(n) * (100 * n >= percent * (s + 1))) for n, c in histogram if n > 1) for s in range(MAX_LIGHT + 1)}
    return min(cost, key=lambda s: (cost[s], s))


def row_hash(id_col: str = "doc_id", text_col: str = "text") -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def jaccard_groups(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", with_rows: bool = False) -> DataFrame:
    """For each row of docs: id, n_shingles, component_id (the least id reachable by links, its own included).

    Words: maximal runs of bytes other than space and 0x09-0x0D, A-Z lowered. A row's set: its distinct width-word
    shingles; with fewer words, all of them as one; no word or a null text: the empty set, which links with nothing. Two
    rows link when 100 |A and B| >= percent |A or B|. Repeated rows link with each other. Rows with a null id are grouped
    too, but name a component only where it has no other id (component_id is then null). Other columns are ignored.
    with_rows adds row (row_hash of id and text) and part, which names the component also where it has no id; null for
    the empty set.
    """
    least_size = 2 if percent > 50 else 1  # beyond half, a set of one links with equal sets only
    base = docs.select(F.col(id_col).cast("long").alias("id"), row_hash(id_col, text_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    profile = stored(base.mapInArrow(_profile(width), "id long, row long, n long, h1 long, h2 long, sketch binary"), "profile")
    rows, shared = profile.where("row is not null"), profile.where("row is null")
    heads = stored(rows.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("row").alias("head"), F.min("id").alias("least")), "heads")
    common = shared.groupBy("h1").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h1").limit(MAX_COMMON).toPandas()
    names = common["h1"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(names)
    names, rank = names[order], common["n"].to_numpy(np.int64)[order]
    size = F.when(F.col("n") <= 2 * MAX_LIGHT, F.col("n")).otherwise(F.lit(2 * MAX_LIGHT + 1))
    histogram = [(int(n), int(c)) for n, c in heads.where(F.col("n") >= least_size).groupBy(size).count().collect()]
    copies = float(common["n"].sum()) / max(1, sum(n * c for n, c in histogram))
    light = boundary(histogram, percent, min(1.0, copies))

    def only(table: DataFrame, ids: DataFrame) -> DataFrame:
        return table.join(small_side(ids), "row", "left_semi")

    total, distinct = rows.agg(F.count("*"), F.countDistinct("row")).first()
    tried = base.select("row", "text")
    if total > heads.count():
        tried = only(tried, heads.where(F.col("n") >= least_size).select(F.col("head").alias("row")))
    if total > distinct:
        tried = tried.dropDuplicates(["row"])
    postings = stored(tried.mapInArrow(_prefixes(width, percent, light, names, rank), "key long, row long, n int, at int"), "postings")
    lists = postings.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    entries = stored(postings.join(lists, "key"), "lists")

    def verified(pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (a, b): linked or not. Pairs go to the texts, so that a text moves once for each of its pairs."""
        end = lambda c, side: F.struct(F.col(c).alias("row"), "a", "b", F.lit(side).alias("side"))
        ends = stored(pairs.select(F.explode(F.array(end("a", 0), end("b", 1))).alias("e")).select("e.*"), "ends")
        found = base.select("row", "text").join(small_side(ends), "row").select("a", "b", "side", "text")
        if total > distinct:
            found = found.dropDuplicates(["a", "b", "side"])
        found = found.repartition("a", "b").sortWithinPartitions("a", "b", "side")
        return stored(found.mapInArrow(_verify(width, percent), "a long, b long, linked boolean"), "tested")

    def grouped(dealt: DataFrame, *more: str) -> DataFrame:
        return dealt.select(*GROUP, "row", "part", "n", "at", "block", *more).repartition(*GROUP).sortWithinPartitions(*GROUP)

    def close(dealt: DataFrame) -> DataFrame:
        """Of entries with size, part, block, x and y: those with a near partner in their group."""
        out = grouped(dealt, "size").mapInArrow(_close(percent), "key long, x int, y int, row long, part long, n int, at int, block int, size long")
        return stored(out, "close")

    def meet(near: DataFrame, forest: bool) -> DataFrame:
        sketches = only(rows.select("row", "sketch"), stored(near.select("row").distinct(), "rows")).dropDuplicates(["row"])
        with_sketch = near.join(small_side(stored(sketches, "sketches")), "row")
        return grouped(with_sketch, "sketch").mapInArrow(_meet(percent, forest), "a long, b long").distinct()

    def of(blocks: Column) -> Column:
        return F.pmod(F.xxhash64("row"), blocks).cast("int")

    def upto(n: Column) -> Column:
        return F.ceil(n / F.lit(BLOCK)).cast("int")

    alone = entries.withColumn("block", of(upto(F.col("size")))).withColumns({"x": F.col("block"), "y": F.col("block"), "part": F.col("row")})
    near = close(alone)
    tested = verified(stored(meet(near, True), "pairs"))
    links = tested.where("linked").select("a", "b")
    groups = components(links)
    entries = near.where(F.col("size") <= BLOCK).select(*entries.columns).unionByName(entries.where(F.col("size") > BLOCK))
    placed = entries.join(small_side(groups), F.col("row") == F.col("id"), "left").withColumn("part", F.coalesce("component", "row"))
    sizes = placed.groupBy("key", "part").agg(F.count("*").alias("own")).groupBy("key").agg(F.max(F.struct("own", "part")).alias("most"), F.count("*").alias("parts"), F.sum("own").alias("all"))
    split = stored(sizes.where("parts > 1").select("key", F.col("most.part").alias("major"), upto(F.col("all") - F.col("most.own")).alias("few"), upto(F.col("most.own")).alias("many")), "split")
    placed = placed.join(small_side(split), "key").withColumn("block", F.when(F.col("part") == F.col("major"), F.col("few") + of(F.col("many"))).otherwise(of(F.col("few"))))
    others = F.sequence(F.lit(0), F.when(F.col("part") == F.col("major"), F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)
    dealt = placed.withColumn("other", F.explode(others)).withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")})
    more = verified(stored(meet(close(dealt), False).join(small_side(tested.select("a", "b")), ["a", "b"], "left_anti"), "more-pairs"))
    groups = components(links.union(more.where("linked").select("a", "b")))
    named = heads.join(small_side(groups), F.col("head") == F.col("id"), "left").select("n", "h1", "h2", "least", F.coalesce("component", "head").alias("part"))
    least = named.groupBy("part").agg(F.min("least").alias("component_id"))
    named = stored(named.join(least, "part").select("n", "h1", "h2", "component_id", "part"), "named")
    out = rows.join(small_side(named), ["n", "h1", "h2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), *(["row", "part"] if with_rows else []))

"""Loops over edge tables: every round is a stored table, the driver sees counts only.

Frontiers go a level a round. Chains and cycles are followed by doubling instead: each round a pointer is replaced by the
one it points to, so that after i rounds it spans 2**i edges. Components and depths contract the graph so until at most
LOCAL_EDGES edges are left, which one task then finishes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import is_small

#: Edges of a contracted graph that one task may finish; results are the same for any number.
LOCAL_EDGES = 100_000


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """As common.stored, for rounds: joins of the table are shuffled. By the size of its file Spark would broadcast a table of millions of
    short rows, and each round anew, all through the driver."""
    return common.stored(df, name).hint("merge")


def reach(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, distance): all nodes within so many edges of each start, itself left out. edges (source, target).

    A level a round; where most sources are starts, by doubling instead: what lies up to n edges beyond the nodes at a distance of n is
    found already, as that of other starts. Such a round is taken if it makes few rows more than are found, else one goes an edge on.
    """
    edges = stored(edges.select("source", "target").distinct(), "edges")
    starts = starts.select(F.col("id").alias("start")).where("start is not null").distinct()
    sources = edges.where("source is not null").select(F.col("source").alias("start")).distinct()
    if 2 * sources.join(starts, "start", "left_semi").count() >= sources.count():
        return _reach_of_all(edges, depth).join(starts, "start", "left_semi").select("start", "node", "distance")
    front = starts.withColumn("node", F.col("start"))
    found = stored(front.withColumn("distance", F.lit(0)))
    front = found
    for d in range(1, depth + 1):
        step = front.select("start", "node").join(edges, F.col("node") == F.col("source")).select("start", F.col("target").alias("node")).distinct()
        front = stored(step.join(found.hint("merge"), ["start", "node"], "left_anti").withColumn("distance", F.lit(d)))
        if front.isEmpty():
            break
        found = found.union(front)
    return found.where("distance > 0")


#: A round of doubling may join so many times the rows found so far.
DOUBLING = 4


def _reach_of_all(edges: DataFrame, depth: int) -> DataFrame:
    """reach from all sources. edges: stored, each once."""
    found = stored(edges.where("source is not null and not source <=> target").select(F.col("source").alias("start"), F.col("target").alias("node"), F.lit(1).alias("distance")).where(F.lit(depth >= 1)))
    span, total = 1, found.count()
    while span < depth:
        far = found.where(F.col("distance") == span).select("start", F.col("node").alias("mid"))
        wide = min(span, depth - span)
        onward = found.where(F.col("distance") <= wide).select(F.col("start").alias("mid"), "node", F.col("distance").alias("_d"))
        if wide > 1:
            both = far.groupBy("mid").agg(F.count("*").alias("a")).join(onward.groupBy("mid").agg(F.count("*").alias("b")), "mid")
            if (both.agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0) > DOUBLING * total:
                wide, onward = 1, onward.where("_d = 1")
        met = far.join(onward.hint("merge"), "mid").where("not start <=> node").groupBy("start", "node").agg(F.min(F.lit(span) + F.col("_d")).alias("distance"))
        new = stored(met.join(found.hint("merge"), ["start", "node"], "left_anti").select("start", "node", F.col("distance").cast("int").alias("distance")))
        span, more = span + wide, new.count()
        if not more:
            break
        found, total = found.union(new), total + more
    return found


def _paths_in_tasks(edges: DataFrame, pairs: DataFrame, max_depth: int) -> DataFrame:
    """Paths for few edges: these go to all tasks, which search from their own starts."""
    own = edges.where("source is not null and target is not null").toArrow()
    sources, targets = own["source"].to_pylist(), own["target"].to_pylist()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        onward: dict = {}
        for a, b in sorted(zip(sources, targets, strict=True)):
            onward.setdefault(a, []).append(b)
        for part in parts:
            ends: dict = {}
            for a, b in zip(part["from"].to_pylist(), part["to"].to_pylist(), strict=True):
                ends.setdefault(a, set()).add(b)
            for start, left in ends.items():
                before, front, found = {start: None}, [start], []
                for n in range(max_depth):  # a front is in the order of its first paths, so the first to reach a node gives its first path
                    found += left.intersection(front)
                    left = left.difference(front)
                    if not left or not front or n == max_depth - 1:
                        break
                    reached = []
                    for node in front:
                        for other in onward.get(node, ()):
                            if other not in before:
                                before[other] = node
                                reached.append(other)
                    front = reached
                paths = []
                for node in found:
                    path = [node]
                    while path[-1] != start:
                        path.append(before[path[-1]])
                    paths.append(path[::-1])
                kind = part["from"].type
                yield pa.RecordBatch.from_arrays([pa.array([start] * len(found), kind), pa.array(found, part["to"].type), pa.array(paths, pa.list_(kind))], names=["from", "to", "path"])

    types = T.StructType([T.StructField("from", pairs.schema["from"].dataType), T.StructField("to", pairs.schema["to"].dataType), T.StructField("path", T.ArrayType(pairs.schema["from"].dataType))])
    return pairs.where("from is not null and to is not null").repartition("from").mapInArrow(run, types)


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_depth: int = 10, local: int = LOCAL_EDGES) -> DataFrame:
    """(from, to, path): the first shortest path (by node names) of at most max_depth nodes. A null node has no path.

    At most `local` edges of few bytes go to all tasks. With more of them:

    Two fronts, onward from the distinct starts and back from the distinct ends, grow by turns, the smaller one next. A pair whose
    distance is n is found when both together have gone n steps. A node carries the first path of its own half only, which
    all pairs of that start or end share; a start or end whose pairs are all found grows no further.
    """
    edges = stored(edges.select("source", "target").distinct(), "edges")
    if edges.count() <= local and is_small(edges):
        return _paths_in_tasks(edges, pairs.select("from", "to").distinct(), max_depth)
    left = pairs = stored(pairs.select("from", "to").distinct(), "pairs")
    steps = {"from": edges.toDF("node", "next"), "to": edges.select(F.col("target").alias("node"), F.col("source").alias("next"))}
    longer = {"from": F.concat("path", F.array("next")), "to": F.concat(F.array("next"), "path")}
    fronts = {s: stored(pairs.select(F.col(s).alias("end"), F.col(s).alias("node"), F.array(s).alias("path")).distinct(), "front") for s in steps}
    seen = {s: fronts[s].select("end", "node") for s in steps}
    sizes, open_, found = {s: fronts[s].count() for s in steps}, pairs.count(), None
    for n in range(max_depth):
        if n:
            side = min(steps, key=sizes.get)
            active = left.select(F.col(side).alias("end")).distinct()
            grown = fronts[side].join(active, "end", "left_semi").join(steps[side], "node").select("end", F.col("next").alias("node"), longer[side].alias("path"))
            fronts[side] = stored(grown.join(seen[side], ["end", "node"], "left_anti").groupBy("end", "node").agg(F.min("path").alias("path")), "front")
            sizes[side] = fronts[side].count()
            if not sizes[side]:
                break
            seen[side] = seen[side].union(fronts[side].select("end", "node"))
        onward, back = fronts["from"].toDF("from", "node", "_onward"), fronts["to"].toDF("to", "node", "_back")
        whole = F.concat("_onward", F.slice("_back", F.lit(2), F.size("_back")))
        met = stored(left.join(onward, "from").join(back, ["to", "node"]).groupBy("from", "to").agg(F.min(whole).alias("path")), "met")
        found = met if found is None else found.union(met)
        open_ -= met.count()
        if not open_:
            break
        left = pairs.join(found.select("from", "to"), ["from", "to"], "left_anti")
    return found.select("from", "to", "path")


def follow(pointers: DataFrame, merge: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """pointers (id, to, and columns of merge), one row an id: each `to` followed as far as there are pointers, with the columns
    merged along the way. Pointers that still lead to an id are on a cycle or lead into one; they have gone at least as many
    steps as there are pointers."""
    now = stored(pointers)
    n, span = now.count(), 1
    while True:
        onward = now.select(F.col("id").alias("to"), F.col("to").alias("_to"), *(F.col(c).alias(f"_{c}") for c in merge))
        joined = now.join(onward, "to", "left")
        new = [F.when(F.col("_to").isNull(), F.col(c)).otherwise(f(F.col(c), F.col(f"_{c}"))).alias(c) for c, f in merge.items()]
        step = joined.select("id", F.coalesce("_to", "to").alias("to"), *new, F.col("_to").isNotNull().alias("_more"))
        step = stored(step)
        now, span = step.drop("_more"), 2 * span
        if span > n or not step.where("_more").limit(1).count():
            return now


def depths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, depth): the longest distance to a node without out-edges; null for nodes that reach a cycle.

    Each round settles nodes whose targets are all settled and follows nodes with one open target by doubling: their
    depth is max(base, w + depth of the target), and such functions compose. A chain or a tree of chains takes a
    number of rounds in the logarithm of its length.
    """
    every = nodes.select("id").union(edges.select("source")).union(edges.select("target")).distinct()
    open_ = stored(edges.select("source", "target").distinct().withColumn("w", F.lit(1)))
    base = open_.sparkSession.createDataFrame([], "id string, b int").select(F.col("id").cast(open_.schema["source"].dataType), "b")
    left = stored(every.join(open_.select(F.col("source").alias("id")), "id", "left_semi"))
    done = stored(every.join(left, "id", "left_anti").select("id", F.lit(0).alias("depth"), F.lit(False).alias("cyclic")))
    news = done
    while not left.isEmpty():
        if open_.count() <= LOCAL_EDGES:  # settled targets may still stand in it; they have no open edges
            settled = news.select(F.col("id").alias("source"), F.lit(None).cast(open_.schema["target"].dataType).alias("target"), F.when(F.col("cyclic"), -1).otherwise(F.col("depth")).alias("w"))
            known = base.where("b is not null").select(F.col("id").alias("source"), F.lit(None).cast(open_.schema["target"].dataType).alias("target"), F.col("b").alias("w"))
            met = settled.join(open_.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
            rest = open_.select("source", "target", "w").union(known).union(met).repartition(1)
            own = rest.mapInPandas(_local_depths, done.select("id", "depth").schema).join(left, "id", "left_semi")
            return done.select("id", "depth").union(stored(own))
        # what leads to settled nodes goes into the base
        met = open_.join(news.withColumnRenamed("id", "target"), "target")
        reached = met.groupBy(F.col("source").alias("id")).agg(F.max(F.col("w") + F.col("depth")).alias("b2"), F.max("cyclic").alias("cyclic"))
        base = stored(left.join(base, "id", "left").join(reached.hint("merge"), "id", "left").select("id", F.greatest("b", "b2").alias("b"), F.coalesce("cyclic", F.lit(False)).alias("cyclic")))
        open_ = open_.join(news.select(F.col("id").alias("target")), "target", "left_anti").select("source", "target", "w")
        out = open_.groupBy(F.col("source").alias("id")).agg(F.countDistinct("target").alias("targets"), F.first("target").alias("to"), F.max("w").alias("w"))
        state = stored(base.join(out.hint("merge"), "id", "left").withColumn("targets", F.coalesce("targets", F.lit(0))))
        news = state.where("targets = 0 or cyclic").select("id", F.when(~F.col("cyclic"), F.col("b")).alias("depth"), "cyclic")
        single = state.where("targets = 1 and not cyclic").select("id", "to", "w", "b")
        single = _followed(single)
        lost = single.join(single.select(F.col("id").alias("to")), "to", "left_semi").select("id", F.lit(None).cast("int").alias("depth"), F.lit(True).alias("cyclic"))
        news = stored(news.union(lost))
        if news.isEmpty() and single.isEmpty():  # every node has two open targets or more: all reach cycles
            return done.select("id", "depth").union(left.select("id", F.lit(None).cast("int").alias("depth")))
        done = stored(done.union(news))
        left = stored(left.join(news.hint("merge"), "id", "left_anti"))
        # open edges to followed nodes lead on to where these lead; their bases count for the sources
        keep = single.join(lost.hint("merge"), "id", "left_anti").select(F.col("id").alias("target"), F.col("to"), F.col("w").alias("w2"), F.col("b").alias("b2"))
        through = open_.join(left.select(F.col("id").alias("source")), "source", "left_semi").join(keep.hint("merge"), "target", "left")
        through = stored(through.select("source", "target", "w", "to", "w2", "b2"))
        open_ = stored(through.select("source", F.coalesce("to", "target").alias("target"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w")).groupBy("source", "target").agg(F.max("w").alias("w")))
        gained = through.groupBy(F.col("source").alias("id")).agg(F.max(F.col("w") + F.col("b2")).alias("b3"))
        base = stored(base.select("id", "b").join(left, "id", "left_semi").join(gained.hint("merge"), "id", "left").select("id", F.greatest("b", "b3").alias("b")))
    return done.select("id", "depth")


def _local_depths(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Depths in the edges (source, target, w) of a small graph; without a target w is a depth that the source has at least, -1 that it reaches a cycle."""
    rows = pd.concat(list(parts))
    into: dict = {}
    waits: dict = {}
    depth: dict = {}
    cyclic = set()
    for source, target, w in zip(rows["source"].tolist(), rows["target"].tolist(), rows["w"].tolist(), strict=True):
        if pd.isna(target):
            depth[source] = max(depth.get(source, 0), int(w))
            if w < 0:
                cyclic.add(source)
        else:
            into.setdefault(target, []).append((source, int(w)))
            waits[source] = waits.get(source, 0) + 1
    nodes = {*into, *waits, *depth}
    ready = [v for v in nodes if not waits.get(v) and v not in cyclic]
    out = {}
    while ready:
        v = ready.pop()
        out[v] = depth.get(v, 0)
        for source, w in into.get(v, ()):
            depth[source] = max(depth.get(source, 0), w + out[v])
            waits[source] -= 1
            if not waits[source] and source not in cyclic:
                ready.append(source)
    yield pd.DataFrame({"id": list(nodes), "depth": pd.array([out.get(v) for v in nodes], "Int32")})


def _local_components(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, into): of the edges of a small graph, the nodes in components of two or more and the least node of each. Two depth-first
    passes, forwards for the order of ending and backwards for the components."""
    rows = pd.concat(list(parts))
    after: dict = {}
    before: dict = {}
    for a, b in zip(rows["source"].tolist(), rows["target"].tolist(), strict=True):
        after.setdefault(a, []).append(b)
        before.setdefault(b, []).append(a)
    ended, seen = [], set()
    for start in after:
        if start in seen:
            continue
        seen.add(start)
        todo = [(start, iter(after[start]))]
        while todo:
            v, rest = todo[-1]
            w = next((w for w in rest if w not in seen), None)
            if w is None:
                ended.append(v)
                todo.pop()
            else:
                seen.add(w)
                todo.append((w, iter(after.get(w, ()))))
    out, taken = [], set()
    for start in reversed(ended):
        if start in taken:
            continue
        taken.add(start)
        part, at = [start], 0
        while at < len(part):
            for w in before.get(part[at], ()):
                if w not in taken:
                    taken.add(w)
                    part.append(w)
            at += 1
        if len(part) > 1:
            least = min(part)
            out += [(v, least) for v in part]
    yield pd.DataFrame({"id": [v for v, _ in out], "into": [w for _, w in out]}) if out else rows[:0].rename(columns={"source": "id", "target": "into"})


def _followed(single: DataFrame) -> DataFrame:
    """single (id, to, w, b), depth(id) = max(b, w + depth(to)), followed by doubling."""
    pair = follow(single.select("id", "to", F.struct("w", "b").alias("f")), {"f": lambda x, y: F.struct((x["w"] + y["w"]).alias("w"), F.greatest(x["b"], x["w"] + y["b"]).alias("b"))})
    return pair.select("id", "to", "f.w", "f.b")


def cycles(edges: DataFrame, closed: bool = False, loops: bool = False) -> DataFrame:
    """(first, length, path): for each node on a cycle its shortest one (ties by node names), each set of nodes once, from its least
    node on; closed: the first node is repeated at the end; loops: edges from a node to itself count too."""
    edges = stored(edges.select("source", "target").distinct())
    part = strong_components(edges)
    inner = edges.join(part.withColumnRenamed("id", "source").withColumnRenamed("component", "_a"), "source").join(part.withColumnRenamed("id", "target").withColumnRenamed("component", "_b"), "target")
    inner = stored(inner.where("_a = _b and source <> target").select("source", "target", F.col("_a").alias("part")))
    only = inner.groupBy("part").agg((F.count("*") == F.countDistinct("source")).alias("ring"))
    rings = _rings(inner.join(only.where("ring"), "part", "left_semi"))
    inner = stored(inner.join(only.where("not ring"), "part", "left_semi").select("source", "target"))
    front = stored(inner.select(F.col("source").alias("start"), F.col("target").alias("node"), F.array("source", "target").alias("path")))
    seen, done = front.select("start", "node"), None
    while not front.isEmpty():
        step = front.join(inner, F.col("node") == F.col("source")).select("start", F.col("target").alias("node"), "path")
        back = stored(step.where("node = start").groupBy("start").agg(F.min("path").alias("path")))
        done = back if done is None else done.union(back)
        more = step.join(done.select("start"), "start", "left_anti").join(seen, ["start", "node"], "left_anti")
        front = stored(more.groupBy("start", "node").agg(F.min(F.concat("path", F.array("node"))).alias("path")))
        seen = seen.union(front.select("start", "node"))
    found = edges.where("source = target" if loops else "false").select(F.col("source").alias("start"), F.array("source").alias("path"))
    found = found.unionByName(rings)
    found = found if done is None else found.unionByName(done.select("start", "path"))
    at = F.array_position("path", F.array_min("path")).cast("int")
    turned = found.select(F.concat(F.slice("path", at, F.size("path")), F.slice("path", F.lit(1), at - 1)).alias("path"))
    once = turned.groupBy(F.array_sort("path").alias("_k")).agg(F.min("path").alias("path"))
    return once.select(F.get("path", F.lit(0)).alias("first"), F.size("path").alias("length"), (F.concat("path", F.slice("path", 1, 1)) if closed else F.col("path")).alias("path"))


def _rings(edges: DataFrame) -> DataFrame:
    """(start, path): edges (source, target, part) of components with as many edges as nodes are one cycle each, given from its least node on."""
    cut = edges.where("source <> part").select(F.col("source").alias("id"), F.col("target").alias("to"), F.lit(1).alias("far"))
    back = follow(cut, {"far": lambda x, y: x + y})  # how far from each node to the least one
    whole = back.groupBy("to").agg(F.array_sort(F.collect_list(F.struct((-F.col("far")).alias("at"), "id"))).alias("l"))
    return whole.select(F.col("to").alias("start"), F.concat(F.array("to"), F.transform("l", lambda x: x["id"])).alias("path"))


def _ends(edges: DataFrame) -> DataFrame:
    """(id, ins, outs): the degrees of the nodes of edges."""
    both = edges.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("target", F.lit(0), F.lit(1)))
    return both.groupBy("id").agg(F.sum("i").alias("ins"), F.sum("o").alias("outs"))


def _chains(edges: DataFrame, inner: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """inner (id): nodes with one edge in and one out. Returns rings of such nodes (id, into: the least), chains (id, head, tail:
    the nodes around the chain), and the edges with each chain as one edge."""
    onward = edges.join(inner.withColumnRenamed("id", "source"), "source").select(F.col("source").alias("id"), F.col("target").alias("to"))
    lead = follow(onward.withColumns({"last": F.col("id"), "least": F.col("id")}), {"last": lambda x, y: y, "least": F.least})
    own = inner.withColumnRenamed("id", "to")
    rings = lead.join(own, "to", "left_semi").select("id", F.col("least").alias("into"))
    lead = lead.join(own, "to", "left_anti").select("id", F.col("to").alias("tail"), "last")
    heads = edges.join(inner.withColumnRenamed("id", "source"), "source", "left_anti").join(lead, F.col("target") == F.col("id")).select(F.col("source").alias("head"), "tail", "last")
    heads = stored(heads)
    chains = lead.join(heads.select("head", "last"), "last").select("id", "head", "tail")
    rest = edges.join(inner.withColumnRenamed("id", "source"), "source", "left_anti").join(inner.withColumnRenamed("id", "target"), "target", "left_anti").select("source", "target")
    return stored(rings), stored(chains), stored(rest.union(heads.select("head", "tail")).where("source <> target").distinct())


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) of nodes in strongly connected components of two or more, named by the least node.

    Each round drops nodes without in- or out-edges, replaces chains of nodes with one edge in and one out by one edge (such a
    node is in the component of both ends of its chain, or in none) and merges the cycles that arise when each node points to
    one of its targets; chains and cycles are followed by doubling. Rings, paths and trees of any length take a
    number of rounds in the logarithm of their length; a dense graph without cycles, of many layers, takes a round for every few layers.
    """
    left, steps, turn = stored(edges.select("source", "target").where("source <> target").distinct()), [], 0
    kinds = left.select(F.col("source").alias("id"), F.col("target").alias("into")).schema
    while True:
        if left.count() <= LOCAL_EDGES:
            steps.append(stored(left.repartition(1).mapInPandas(_local_components, kinds)))
            break
        degrees = stored(_ends(left))
        inside = degrees.where("ins > 0 and outs > 0").select("id")
        if degrees.where("ins = 0 or outs = 0").limit(1).count():
            left = stored(left.join(inside.withColumnRenamed("id", "source"), "source", "left_semi").join(inside.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target"))
            degrees = stored(_ends(left))
        if left.isEmpty():
            break
        inner = stored(degrees.where("ins = 1 and outs = 1").select("id"))
        if not inner.isEmpty():
            rings, chains, left = _chains(left, inner)
            steps += [rings, chains]
            if left.isEmpty():
                break
        turn += 1
        mark = F.xxhash64("source", "target", F.lit(turn))
        to = left.groupBy(F.col("source").alias("id")).agg(F.min_by("target", mark).alias("to"))
        to = to.join(left.select(F.col("source").alias("to")).distinct(), "to", "left_semi").select("id", "to")  # not into nodes without out-edges
        lead = follow(to.withColumn("least", F.col("id")), {"least": F.least})
        onto = lead.join(to.select(F.col("id").alias("to")), "to", "left_semi").select(F.col("to").alias("id")).distinct()
        merged = stored(lead.join(onto, "id", "left_semi").select("id", F.col("least").alias("into")))
        if not merged.isEmpty():
            steps.append(merged)
            for end in ("source", "target"):
                left = left.join(merged.select(F.col("id").alias(end), "into"), end, "left").withColumn(end, F.coalesce("into", end)).select("source", "target")
            left = stored(left.where("source <> target").distinct())
    found = stored(edges.select(F.col("source").alias("id"), F.col("source").alias("component")).where("false"))
    for step in reversed(steps):
        of = lambda c: found.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}"))  # noqa: B023, E731
        for c in step.columns[1:]:
            step = step.join(of(c), c, "left").withColumn(f"of_{c}", F.coalesce(f"of_{c}", c))
        own = step.where("of_head = of_tail").select("id", "of_head") if "of_head" in step.columns else step.select("id", "of_into")
        found = stored(found.union(own))
    members = found.union(found.select("component", "component")).distinct()
    names = members.groupBy("component").agg(F.min("id").alias("name"))
    return members.join(names.hint("merge"), "component").select("id", F.col("name").alias("component"))

"""Near-duplicate vectors: an exact metric range join.

Equal vectors are merged first. Pivots partition the unit vectors of a label into cells, and a cell is packed into blocks, one
row each. Two blocks meet in a task unless the triangle inequality keeps their cells farther apart than the join radius, and of
their vectors only those that are near enough to the other cell. Blocks are read where they are stored (a cartesian product, which
shuffles nothing), so what is written grows with the vectors, whatever share of the blocks meets. Tasks emit the number of
neighbours of each vector and a spanning star of each connected piece, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_path, small_side, stored
from .components import components

#: A pivot for about so many vectors; at most so many pivots, which bounds what is broadcast; rows of a block.
PER_PIVOT, MAX_PIVOTS, BLOCK = 2000, 20_000, 4096
#: Cells of a matrix of vectors at a time; pairs of blocks that are sent to Python at a time.
CELLS, PAIRS = 1 << 20, 4


def _unit(vectors) -> np.ndarray:
    """Unit vectors; each is first divided by its greatest component, so that no square over- or underflows."""
    x = np.stack(vectors).astype(np.float64) if len(vectors) else np.zeros((0, 1))
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _assign(pivots: dict[tuple, np.ndarray], kind: str):
    """The cell of each vector (0 where its label has no pivots), and the vector as bytes."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            dims, values, cell = part["dim"].to_numpy(), part["embedding"].flatten().to_numpy().astype(kind), np.zeros(part.num_rows, np.int32)
            starts = np.cumsum(dims) - dims
            for key, rows in pd.DataFrame({"label": part["label"].to_pylist(), "dim": dims}).groupby(["label", "dim"], sort=False).indices.items():
                at = pivots.get(key)
                step = max(1, CELLS // len(at)) if at is not None else len(rows)
                for first in range(0, len(rows) if at is not None else 0, step):
                    some = rows[first : first + step]
                    cell[some] = (_unit(values[starts[some][:, None] + np.arange(key[1])]) @ at.T).argmax(1)
            packed = pa.array([values[s : s + d].tobytes() for s, d in zip(starts, dims, strict=True)], pa.binary())
            kept = ["h1", "h2", "n", "least", "label", "dim"]
            yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), pa.array(cell), packed], names=[*kept, "pivot", "vector"])

    return run


def _pack(pivots: dict[tuple, np.ndarray], kind: str):
    """A block as one row: its vectors one after the other, the pivot of its cell, and how far from it they go (a pivot's bytes are empty
    where there is none)."""

    def run(key, table):
        label, dim, pivot, block = (k.as_py() for k in key)
        flat = b"".join(table["vector"].to_pylist())
        center, reach = pivots.get((label, dim)), 0.0
        if center is not None:
            center = center[pivot]
            reach = float(_apart(_unit(np.frombuffer(flat, kind).reshape(len(table), -1)) @ center).max())
        numbers = [table[c].combine_chunks().to_numpy().astype(np.int64).tobytes() for c in ("h1", "n")]
        values = [label, dim, pivot, block, [] if center is None else center.tolist(), reach, *numbers, flat]
        return pa.table({f.name: pa.array([v], f.type) for f, v in zip(_ARROW, values, strict=True)})

    return run


_BLOCKS = "label string, dim int, pivot int, block int, center array<double>, reach double, reps binary, ns binary, vectors binary"
_ARROW = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("pivot", pa.int32()), ("block", pa.int32()), ("center", pa.list_(pa.float64())), ("reach", pa.float64()), ("reps", pa.binary()), ("ns", pa.binary()), ("vectors", pa.binary())])
#: What two distances may differ by from rounding.
EPS = 1e-7


def _apart(cosines: np.ndarray) -> np.ndarray:
    """Distances of unit vectors with these cosines."""
    return np.sqrt(np.maximum(2 - 2 * cosines, 0))


def _near(x: np.ndarray, own: np.ndarray, other: np.ndarray, reach: float, radius: float) -> np.ndarray:
    """Which unit vectors x of the cell of pivot `own` can have a neighbour in the cell of pivot `other`, whose vectors are within `reach` of it
    and no nearer to `own`."""
    there, here = _apart(x @ other), _apart(x @ own)
    between = float(_apart(own @ other))
    plane = (there**2 - here**2) / (2 * between) if between > EPS else np.zeros(len(x))
    return np.flatnonzero((there <= reach + radius + EPS) & (plane <= radius + EPS))


def _joined(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """root: for each node the root of its piece. With the edges (u, v) too: roots are hung on lesser ones until each edge is in one piece."""
    while True:
        a, b = root[u], root[v]
        open_ = a != b
        if not open_.any():
            return root
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (up := root[root])).any():
            root = up


def _links(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of unit vectors with x[i] @ y[j] >= threshold, i < j if they are the same. Single precision, with room for its error, sifts
    the pairs that are then compared in double."""
    small, few, step = x.astype(np.float32), y.astype(np.float32), max(1, CELLS // max(1, len(y)))
    room = threshold - (x.shape[1] + 8) * 2.0**-22
    for first in range(0, len(x), step):
        low = first if same else 0
        maybe = small[first : first + step] @ few[low:].T >= room
        if 16 * np.count_nonzero(maybe) > maybe.size:
            i, j = np.nonzero(x[first : first + step] @ y[low:].T >= threshold)
        else:
            i, j = np.nonzero(maybe)
            fine = np.einsum("ij,ij->i", x[first + i], y[low + j]) >= threshold
            i, j = i[fine], j[fine]
        i, j = first + i, low + j
        yield (i[i < j], j[i < j]) if same else (i, j)


def _join(threshold: float, radius: float, kind: str):
    """Pairs of blocks: (a, null, links) for vectors and their number of links here, (a, b, 0) for the stars of pieces."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for pair in part.to_pylist():
                a, b = pair["a"], pair["b"]
                same = (a["pivot"], a["block"]) == (b["pivot"], b["block"])
                rep, n, x = zip(*((np.frombuffer(s["reps"], np.int64), np.frombuffer(s["ns"], np.int64), _unit(np.frombuffer(s["vectors"], kind).reshape(-1, s["dim"]))) for s in (a, b)), strict=True)
                rows = [np.arange(len(r)) for r in rep]
                if a["pivot"] != b["pivot"]:
                    own, other = (np.array(s["center"]) for s in (a, b))
                    rows = [_near(x[0], own, other, b["reach"], radius), _near(x[1], other, own, a["reach"], radius)]
                rep, n, x = ([v[r] for v, r in zip(values, rows, strict=True)] for values in (rep, n, x))
                shift = 0 if same else len(rep[0])
                names, counts = (v[0] if same else np.concatenate(v) for v in (rep, n))
                links, root = np.zeros(len(names)), np.arange(len(names))
                for i, j in _links(x[0], x[1], threshold, same):
                    j = j + shift
                    links += np.bincount(i, counts[j], len(names)) + np.bincount(j, counts[i], len(names))
                    root = _joined(root, i, j)
                some, stars = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(names)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([names[some], names[stars]])), pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(names[root[stars]])]),
                    pa.array(np.concatenate([links[some], np.zeros(len(stars))]).astype(np.int64)),
                ], names=["a", "b", "links"])

    return run


def _pairs(blocks: DataFrame, radius: float) -> DataFrame:
    """(a, b): pairs of blocks of a label whose cells are within the radius, each block also with itself. blocks: stored."""
    a, b = (blocks.select(F.struct(*blocks.columns).alias(s)) for s in ("a", "b"))
    at = lambda s: F.struct(F.col(s)["pivot"], F.col(s)["block"])
    square = F.aggregate(F.zip_with(F.col("a")["center"], F.col("b")["center"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda x, y: x + y)
    near = F.sqrt(square) <= F.col("a")["reach"] + F.col("b")["reach"] + radius + EPS
    same = (F.col("a")["label"] == F.col("b")["label"]) & (F.col("a")["dim"] == F.col("b")["dim"])
    return a.hint("shuffle_replicate_nl").join(b, same & (at("a") <= at("b")) & near)


def _few_at_once(df: DataFrame, name: str) -> DataFrame:
    """stored, with few of the large rows in a batch that goes to Python."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(PAIRS))
    try:
        return stored(df, name)
    finally:
        conf.set(key, before)


def near_vectors(rows: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """For each row: id, n_links (other rows linked directly), component_id (least id reachable), kept (id = component_id).

    Rows link when their labels are equal and not null, their vectors have the same length and their cosine in double
    precision is at least the threshold. A vector that is null, empty, zero or has a null or non-finite component links
    with nothing. Equal rows link with each other; equal ids count as rows of their own, and a row with a null id links
    too but is never a component's name unless the component has no other. An empty table gives an empty result.
    """
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("embedding"))
    base = base.withColumn("ok", F.coalesce(fine & F.col("label").isNotNull(), F.lit(False)))
    sums = [F.when(F.col("ok"), F.xxhash64("label", "embedding", F.lit(i))) for i in (1, 2)]
    base = base.withColumns({"h1": sums[0], "h2": sums[1]})
    spark, narrow = rows.sparkSession, rows.schema[vector_col].dataType
    kind = "<f4" if isinstance(narrow, T.ArrayType) and isinstance(narrow.elementType, T.FloatType) else "<f8"
    fine_rows = base.where("ok").withColumn("embedding", F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>"))
    rate = max(PER_PIVOT, -(-fine_rows.count() // MAX_PIVOTS))
    picked = fine_rows.where(F.pmod("h2", F.lit(rate)) == 0).dropDuplicates(["h1", "h2"]).orderBy("h2").limit(MAX_PIVOTS).select("label", F.size("embedding").alias("dim"), "embedding").toPandas()
    pivots = {k: _unit(g["embedding"].to_list()) for k, g in picked.groupby(["label", "dim"])}
    heads = fine_rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    heads = heads.select("h1", "h2", "n", "least", "label", F.size("embedding").alias("dim"), "embedding")
    heads = heads.mapInArrow(_assign(pivots, kind), "h1 long, h2 long, n long, least long, label string, dim int, pivot int, vector binary")
    heads.write.option("parquet.enable.dictionary", "false").parquet(path := new_path(spark, "cells"))
    heads = spark.read.schema(heads.schema).parquet(path)
    sizes = heads.groupBy("label", "dim", "pivot").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    cells = heads.select("label", "dim", "pivot", "h1", "n", "vector").join(small_side(stored(sizes, "sizes")), ["label", "dim", "pivot"])
    cells = cells.withColumn("block", F.pmod(F.xxhash64("h1"), F.col("blocks")).cast("int")).drop("blocks")
    blocks = stored(cells.groupBy("label", "dim", "pivot", "block").applyInArrow(_pack(pivots, kind), _BLOCKS), "blocks")
    found = _few_at_once(_pairs(blocks, radius).mapInArrow(_join(threshold, radius, kind), "a long, b long, links long"), "links")
    groups = components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    known = heads.select("h1", "h2", "n", "least").join(links, F.col("h1") == F.col("a"), "left").join(groups, F.col("h1") == F.col("id"), "left")
    known = known.select("h1", "h2", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "h1").alias("component"))
    named = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = stored(known.join(named, "component").select("h1", "h2", "n_links", "component_id"), "classes")
    out = base.select("id", "h1", "h2").join(small_side(known), ["h1", "h2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))

"""Sharding by jump consistent hashing: no ring table, and one more shard takes only the rows that move into it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, text_crc


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key: jump ahead until the next jump would pass the last shard."""
    key = keys.astype(np.int64).view(np.uint64).copy()
    bucket, ahead = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        bucket[live] = ahead[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        ahead[live] = ((bucket[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(float) + 1))).astype(np.int64)
        live = live[ahead[live] < shards]
    return bucket


def shard_of(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a key column (cast to text; null is a key of its own)."""
    if shards < 1:
        raise ValueError("there must be a shard")

    @F.pandas_udf(T.IntegerType())
    def at(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(jump(part.to_numpy(), shards).astype(np.int32))

    return at(F.xxhash64(key.cast("string")))


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id") -> DataFrame:
    """docs with a column shard, without a shuffle. An existing column of that name is replaced."""
    return docs.withColumn("shard", shard_of(F.col(id_col), shards))


def shard_slots(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, size (UTF-8 bytes + 1; null text: 1), text_crc32, law, shard, slot, grown_shard.

    slot numbers the rows of a shard from 0 without gaps. Rows are numbered within a shard and an input partition, and
    each partition starts where the ones before it end, so a shard is never gathered. Repeated rows get slots of their
    own; equal keys, nulls too, share a shard. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), text_crc(text).alias("text_crc32"), F.monotonically_increasing_id().alias("_row")
    )
    rows = stored(rows.withColumns({"shard": shard_of(F.col(id_col), shards), "grown_shard": shard_of(F.col(id_col), shards + 1)}), "shards")
    rows = rows.withColumn("_part", F.shiftright("_row", 33))
    counts = rows.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    order = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_part", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_start"))
    inner = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("_row"))
    out = rows.withColumn("_at", inner).join(starts, ["shard", "_part"])
    return out.select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_start") + F.col("_at") - 1).alias("slot"), "grown_shard")


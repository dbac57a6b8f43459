"""Streams of metric samples, activity, provider calls and files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skerry.operators import changes, chunking, extract, search


def windowed(samples: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Histogram of (name, value, ts) by window; the same for batch and stream. Rows later than the watermark are dropped."""
    rows = samples.withWatermark("ts", late) if samples.isStreaming else samples
    out = rows.groupBy(F.window("ts", width, slide), "name").agg(F.count("*").alias("count"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"), F.percentile_approx("value", 0.5).alias("p50"))
    return out.select(F.col("window.start").alias("window_start"), "name", "count", "sum", "min", "max", "p50")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, started, n, kinds): sessions end after the gap."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.approx_count_distinct("event_type").alias("kinds"))
    return out.select("user_id", F.col("session_window.start").alias("started"), "n", "kinds")


def latest_gauges(samples: DataFrame) -> DataFrame:
    """(name, tag, value, ts): the latest gauge of each name and tag, kept as state and sent when it changes; of equal times the
    greatest value."""

    def keep(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        for part in parts:
            part = part.dropna(subset=["ts"])
            if len(part):
                last = part.sort_values(["ts", "value"]).iloc[-1]
                new = (pd.Timestamp(last["ts"]).value // 1000, float(last["value"]))
                best = new if best is None or new > tuple(best) else best
        if best is not None and (not state.exists or tuple(state.get) != tuple(best)):
            state.update(tuple(best))
            yield pd.DataFrame({"name": [key[0]], "tag": [key[1]], "value": [best[1]], "ts": [pd.Timestamp(best[0] * 1000)]})

    rows = samples.select("name", "tag", "value", "ts")
    return rows.groupBy("name", "tag").applyInPandasWithState(keep, "name string, tag string, value double, ts timestamp", "ts long, value double", "update", GroupStateTimeout.NoTimeout)


def provider_states(calls: DataFrame) -> DataFrame:
    """calls (provider, ts, ok, and if there is such: id): (provider, calls, failures, healthy) after each batch, by the rule of
    metrics.provider_health. Calls of a batch count in order of time, then id, batches in order of arrival."""
    order = [c for c in ("ts", "id") if c in calls.columns]

    def keep(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, failed, healthy = state.get if state.exists else (0, 0, True)
        last = None  # the last row of the parts so far: no more of them is held
        for part in parts:
            last = pd.concat([part] if last is None else [last, part]).sort_values(order, kind="stable").iloc[-1:]
            good = int(part["ok"].eq(True).sum())
            n, failed, healthy = n + len(part), failed + len(part) - good, healthy or good > 0
        if last is not None:  # after the last good call the share of failures only grows, so its end tells whether any call made it too high
            healthy = True if last["ok"].iloc[0] is not None and last["ok"].iloc[0] else False if n >= 3 and failed / n > 0.5 else healthy
        state.update((n, failed, healthy))
        yield pd.DataFrame({"provider": [key[0]], "calls": [n], "failures": [failed], "healthy": [healthy]})

    return calls.select("provider", *order, "ok").groupBy("provider").applyInPandasWithState(keep, "provider string, calls long, failures long, healthy boolean", "n long, failed long, healthy boolean", "update", GroupStateTimeout.NoTimeout)


def index_batch(index: str, size: int = 1000, overlap: int = 200) -> Callable[[DataFrame, int], None]:
    """For foreachBatch of a stream of files (path, language, content, and if there are such: version, of any order, and deleted):
    an upsert into the table of the folder index.

    Each batch writes its own folders: files/batch=n, a row for each path, which is a tombstone where the file was deleted, and
    chunks/batch=n, the chunks of its other files with their terms. Of several versions of a path in a batch the greatest
    counts, of equal ones the one with the greatest hash. A batch that comes again overwrites what it wrote.
    """

    def write(files: DataFrame, batch: int) -> None:
        given = lambda name, default: F.coalesce(F.col(name), default) if name in files.columns else default
        rows = changes.with_hash(files.select("path", "language", "content", given("version", F.lit(0)).cast("long").alias("version"), given("deleted", F.lit(False)).alias("deleted")))
        greatest = F.max_by(F.struct(*rows.columns), F.struct("version", "deleted", "hash"))
        latest = rows.groupBy("path").agg(greatest.alias("d")).select("d.*").persist()
        latest.select("path", "hash", "version", "deleted").write.mode("overwrite").parquet(f"{index.rstrip('/')}/files/batch={batch}")
        here = latest.where("not deleted")
        chunks = chunking.as_documents(chunking.hybrid(here, extract.symbols(here), size, overlap))
        out = chunks.join(here.select("path", "language", "hash"), "path").withColumn("terms", search.terms(F.col("content")))
        out.write.mode("overwrite").parquet(f"{index.rstrip('/')}/chunks/batch={batch}")
        latest.unpersist()

    return write


def _holding(spark: SparkSession, index: str) -> DataFrame:
    """The last row of each path: of the greatest version, of equal ones that of the last batch."""
    files = spark.read.parquet(f"{index.rstrip('/')}/files")
    return files.groupBy("path").agg(F.max_by(F.struct(*files.columns), F.struct("version", "batch")).alias("l")).select("l.*")


def indexed(spark: SparkSession, index: str) -> DataFrame:
    """The chunks that hold: those of the last row of each path that is no tombstone."""
    last = _holding(spark, index).where("not deleted").select("path", "batch")
    return spark.read.parquet(f"{index.rstrip('/')}/chunks").join(last, ["path", "batch"], "left_semi")


def compact(spark: SparkSession, index: str, into: str) -> None:
    """What holds of index as a new table with one batch, numbered as the last; a stream may go on writing there.

    Tombstones are kept with their version, so that an older version of a deleted file that comes late stays out.
    """
    files = spark.read.parquet(f"{index.rstrip('/')}/files")
    last = files.agg(F.max("batch")).first()[0]
    _holding(spark, index).drop("batch").write.mode("overwrite").parquet(f"{into.rstrip('/')}/files/batch={last}")
    indexed(spark, index).drop("batch").write.mode("overwrite").parquet(f"{into.rstrip('/')}/chunks/batch={last}")

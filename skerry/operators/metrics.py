"""Operational metrics: histograms, counters, gauges, health and provider statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_side

#: Ranges into which the values of a name are counted before one of them is looked at exactly.
RANGES = 4096


def last_samples(samples: DataFrame, keep: int = 1000, tie: str = "ts") -> DataFrame:
    """The newest samples of each metric."""
    return samples.withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("ts"), F.desc(tie)))).where(F.col("_r") <= keep).drop("_r")


def percentiles(samples: DataFrame, shares: dict[str, float], name: str = "name", value: str = "value") -> DataFrame:
    """(name, a column for each share): exact nearest-rank percentiles. Values are counted by range, then the values of the one
    range that holds the rank are counted one by one, so no task holds all values of a name."""
    rows = samples.select(F.col(name).alias("name"), F.col(value).cast("double").alias("value")).where("value is not null")
    ends = rows.groupBy("name").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    at = F.least(F.floor((F.col("value") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * F.lit(RANGES)), F.lit(RANGES - 1))
    by = Window.partitionBy("name").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(small_side(ends), "name").select("name", "value", "n", F.coalesce(at, F.lit(0)).alias("at"))
    ranges = placed.groupBy("name", "at").agg(F.count("*").alias("c"), F.first("n").alias("n")).withColumn("upto", F.sum("c").over(by))
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.greatest(F.ceil(F.col("n") * F.lit(p)), F.lit(1)).alias("rank")) for k, p in shares.items()]))
    one = ranges.select("name", "at", "c", "upto", wanted.alias("w")).where((F.col("w.rank") <= F.col("upto")) & (F.col("w.rank") > F.col("upto") - F.col("c")))
    one = one.select("name", "at", "w.k", (F.col("w.rank") - F.col("upto") + F.col("c")).alias("rank"))
    inner = placed.select("name", "at", "value").join(small_side(one.select("name", "at").distinct()), ["name", "at"], "left_semi").groupBy("name", "at", "value").agg(F.count("*").alias("c"))
    inner = inner.withColumn("upto", F.sum("c").over(Window.partitionBy("name", "at").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)))
    met = inner.join(one, ["name", "at"]).where(F.col("upto") >= F.col("rank")).groupBy("name").pivot("k", list(shares)).agg(F.min("value"))
    return met


def histogram_summary(samples: DataFrame) -> DataFrame:
    """count, min, max, mean and nearest-rank percentiles by name. Names without a value have null percentiles."""
    own = samples.groupBy("name").agg(F.count("*").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"))
    return own.join(percentiles(samples, {"p50": 0.5, "p95": 0.95, "p99": 0.99}), "name", "left")


def counters_rollup(samples: DataFrame, tag: str) -> DataFrame:
    """Totals by name and by name and tag (tag null: the total)."""
    return samples.rollup("name", tag).agg(F.sum("value").alias("total"), F.count("*").alias("n")).where("name is not null")


def gauges_latest(samples: DataFrame, *tags: str, tie: str | None = None) -> DataFrame:
    """The latest value by name and tags; of equal times that with the greatest tie column, else the greatest value."""
    return samples.groupBy("name", *tags).agg(F.max_by("value", F.struct("ts", tie or "value")).alias("value"))


def metric_detail(samples: DataFrame, names: DataFrame) -> DataFrame:
    """samples (name, type, value, ts), names (name): (name, type, count, value, p50, p95, p99): for counters the total, for gauges the
    latest value, for histograms the mean and percentiles. Unknown names have no row."""
    rows = samples.join(names.select("name").distinct(), "name", "left_semi")
    own = rows.groupBy("name", "type").agg(F.count("*").alias("count"), F.sum("value").alias("_sum"), F.avg("value").alias("_mean"), F.max_by("value", F.struct("ts", "value")).alias("_last"))
    value = F.when(F.col("type") == "counter", F.col("_sum")).when(F.col("type") == "gauge", F.col("_last")).otherwise(F.col("_mean"))
    parts = percentiles(rows.where("type = 'histogram'"), {"p50": 0.5, "p95": 0.95, "p99": 0.99}).withColumn("type", F.lit("histogram"))
    return own.select("name", "type", "count", value.alias("value")).join(parts, ["name", "type"], "left")


def span_outcomes(calls: DataFrame) -> DataFrame:
    """calls (name, started, ended, status): (name, status, n, mean_seconds, share) of each outcome; seconds with fractions."""
    seconds = F.col("ended").cast("double") - F.col("started").cast("double")
    own = calls.groupBy("name", "status").agg(F.count("*").alias("n"), F.avg(seconds).alias("mean_seconds"))
    return own.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("name")))


def aggregate_stats(histograms: DataFrame, counters: DataFrame, gauges: DataFrame) -> DataFrame:
    """One row from summaries: operations (counts of histograms), mean latency weighed by them, errors (totals of counters whose names
    hold `error`), error rate in percent and how many metrics there are."""
    h = histograms.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("operations"), (F.sum(F.col("mean") * F.col("count")) / F.sum("count")).alias("mean_latency"), F.count("*").alias("_h"))
    c = counters.agg(F.coalesce(F.sum(F.when(F.col("name").contains("error"), F.col("total"))), F.lit(0)).alias("errors"), F.count("*").alias("_c"))
    rows = h.crossJoin(c).crossJoin(gauges.agg(F.countDistinct("name").alias("_g")))
    rate = F.when(F.col("operations") > 0, F.col("errors") * 100.0 / F.col("operations")).otherwise(0.0)
    out = rows.select("operations", F.coalesce("mean_latency", F.lit(0.0)).alias("mean_latency"), "errors", (F.col("_h") + F.col("_c") + F.col("_g")).alias("metric_count"), rate.alias("error_rate"))
    return out.withColumn("status", _status(1_000_000.0))


def _status(latency_limit: float) -> Column:
    return F.when(F.col("error_rate") > 10, "unhealthy").when((F.col("error_rate") > 5) | (F.col("mean_latency") > latency_limit), "degraded").otherwise("healthy")


def health(samples: DataFrame, latency_limit: float = 1_000_000.0) -> DataFrame:
    """One row: operations, mean latency, errors (names with `error`), error rate in percent and a status."""
    out = samples.agg(F.count("*").alias("operations"), F.avg("value").alias("mean_latency"), F.count_if(F.col("name").contains("error")).alias("errors"), F.countDistinct("name").alias("metric_count"))
    rate = F.when(F.col("operations") > 0, F.col("errors") * 100.0 / F.col("operations")).otherwise(0.0)
    out = out.withColumn("error_rate", rate)
    return out.withColumn("status", _status(latency_limit))


def _plain(name: str = "name") -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9_]", "_")


def _labels(tags: Column) -> Column:
    """tags (map) as {a="x",b="y"}, by key; empty for none."""
    pairs = F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')))
    return F.when(F.size(pairs) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")


def prometheus_counters(counters: DataFrame) -> DataFrame:
    """counters (name, total): a text block (line) each."""
    n = F.concat(_plain(), F.lit("_total"))
    return counters.select("name", F.concat(F.lit("# HELP "), n, F.lit(" Total "), F.col("name"), F.lit("\n# TYPE "), n, F.lit(" counter\n"), n, F.lit(" "), F.col("total").cast("string")).alias("line"))


def prometheus_gauges(gauges: DataFrame) -> DataFrame:
    """gauges (name, tags map, value): a text block (line) for each name, its values by label."""
    one = F.concat(_plain(), _labels(F.col("tags")), F.lit(" "), F.col("value").cast("string"))
    rows = gauges.groupBy("name").agg(F.array_join(F.array_sort(F.collect_list(one)), "\n").alias("_v"))
    return rows.select("name", F.concat(F.lit("# HELP "), _plain(), F.lit(" Current "), F.col("name"), F.lit("\n# TYPE "), _plain(), F.lit(" gauge\n"), F.col("_v")).alias("line"))


def text_summary(histograms: DataFrame, counters: DataFrame, gauges: DataFrame) -> DataFrame:
    """(kind, name, line): a readable line for each histogram, counter and gauge value."""
    n = lambda c: F.round(c, 2).cast("string")
    h = histograms.select(F.lit("histogram").alias("kind"), "name", F.concat(F.col("name"), F.lit(": count="), F.col("count").cast("string"), F.lit(", mean="), n("mean"), F.lit("µs, p95="), n("p95"), F.lit("µs")).alias("line"))
    c = counters.select(F.lit("counter").alias("kind"), "name", F.concat(F.col("name"), F.lit(": "), F.col("total").cast("string")).alias("line"))
    tags = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return h.unionByName(c).unionByName(gauges.select(F.lit("gauge").alias("kind"), "name", F.concat(F.col("name"), F.lit("["), tags, F.lit("]: "), F.col("value").cast("string")).alias("line")))


def as_json(summary: DataFrame) -> DataFrame:
    """(name, line): each summary row as JSON."""
    return summary.select("name", F.to_json(F.struct(*summary.columns)).alias("line"))


def prometheus(summary: DataFrame) -> DataFrame:
    """A text block (line) for each histogram summary row."""
    n = lambda c: F.col(c).cast("string")
    name = F.regexp_replace("name", "[^A-Za-z0-9_]", "_")
    quantiles = [F.concat(name, F.lit(f'{{quantile="{q}"}} '), n(c)) for q, c in (("0.5", "p50"), ("0.95", "p95"), ("0.99", "p99"))]
    return summary.select("name", F.concat_ws("\n", F.concat(F.lit("# HELP "), name, F.lit(" "), F.col("name")), F.concat(F.lit("# TYPE "), name, F.lit(" summary")), F.concat(name, F.lit("_count "), n("count")), F.concat(name, F.lit("_sum "), (F.col("mean") * F.col("count")).cast("string")), *quantiles).alias("line"))


def provider_stats(calls: DataFrame) -> DataFrame:
    """calls (provider, ts, ok, latency): successes, failures and the mean latency of successes."""
    return calls.groupBy("provider").agg(F.count_if("ok").alias("success_count"), F.count_if(~F.col("ok")).alias("failure_count"), F.coalesce(F.avg(F.when(F.col("ok"), F.col("latency"))), F.lit(0.0)).alias("avg_latency"))


def provider_health(calls: DataFrame, tie: str = "ts", width: str = "hour") -> DataFrame:
    """calls with healthy after each: a success heals; a failure makes unhealthy if over half of at least 3 calls failed.

    Running counts are kept for spans of time of each provider and added up, so a busy provider is many groups, not one."""
    rows = calls.withColumn("_span", F.date_trunc(width, "ts"))
    spans = rows.groupBy("provider", "_span").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("f"))
    past = Window.partitionBy("provider").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("provider", "_span", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("_n"), F.coalesce(F.sum("f").over(past), F.lit(0)).alias("_f"))
    w = Window.partitionBy("provider", "_span").orderBy("ts", tie)
    rows = rows.join(spans, ["provider", "_span"])
    n, failed = F.col("_n") + F.count("*").over(w), F.col("_f") + F.sum((~F.col("ok")).cast("int")).over(w)
    rows = rows.withColumn("_e", F.when(F.col("ok"), True).when((n >= 3) & (failed / n > 0.5), False))
    last = rows.where("_e is not null").groupBy("provider", "_span").agg(F.max_by("_e", F.struct("ts", tie)).alias("_l"))
    before = spans.select("provider", "_span").join(last, ["provider", "_span"], "left").select("provider", "_span", F.last("_l", ignorenulls=True).over(past).alias("_before"))
    rows = rows.join(before, ["provider", "_span"])
    return rows.withColumn("healthy", F.coalesce(F.last("_e", ignorenulls=True).over(w), "_before", F.lit(True))).select(*calls.columns, "healthy")


def cheapest_provider(requests: DataFrame, providers: DataFrame) -> DataFrame:
    """For each request (request_id, min_quality) the cheapest healthy provider of enough quality; ties by name.

    Only providers that no better one undercuts are met, by each distinct quality once."""
    p = providers.where(F.coalesce("healthy", F.lit(True))).select("name", F.coalesce("cost", F.lit(0.0)).alias("cost"), F.coalesce("quality", F.lit(1.0)).alias("quality"))
    better = Window.orderBy(F.desc("quality"), "cost", "name").rowsBetween(Window.unboundedPreceding, -1)
    one = p.groupBy("quality").agg(F.min(F.struct("cost", "name")).alias("b")).select("quality", "b.cost", "b.name")
    least = F.min(F.struct("cost", "name")).over(better)
    edge = one.withColumn("_l", least).where(F.col("_l").isNull() | (F.struct("cost", "name") < F.col("_l"))).drop("_l")
    wanted = requests.select("min_quality").distinct()
    met = wanted.join(small_side(edge), F.col("quality") >= F.col("min_quality")).groupBy("min_quality").agg(F.min(F.struct("cost", "name")).alias("b"))
    return requests.join(met, "min_quality").select("request_id", F.col("b.name").alias("provider"))

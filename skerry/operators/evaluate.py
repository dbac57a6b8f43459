"""Retrieval metrics and answer scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions.text import content_tokens

from .common import small_side, stored


def retrieval_metrics(runs: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """runs (query_id, rank, doc_id), qrels (query_id, doc_id, grade): a row for each query with all metrics.

    Relevant means a grade above 0. Queries without relevant documents score 0.
    """
    rel = qrels.select("query_id", "doc_id", F.col("grade").cast("double").alias("grade"))
    ranked = small_side(runs.select("query_id", "doc_id").distinct().withColumn("_in", F.lit(True)))
    rel = rel.join(ranked, ["query_id", "doc_id"], "left").withColumn("doc_id", F.when(F.col("_in"), F.col("doc_id")))
    rel = stored(rel.groupBy("query_id", "doc_id", "grade").agg(F.count("*").alias("n")), "judged")  # read twice; documents that no run holds are counts
    held = rel.where("doc_id is not null").select("query_id", "doc_id", "grade", F.explode(F.sequence(F.lit(1), "n")).alias("_n")).drop("_n")
    rows = runs.join(held, ["query_id", "doc_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0.0)))
    rows = rows.withColumn("rel", (F.col("grade") > 0).cast("int"))
    sofar = F.sum("rel").over(Window.partitionBy("query_id").orderBy("rank"))
    rows = rows.withColumn("sofar", sofar)
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1.0)
    per = rows.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= k, F.col("rel"))).alias("hits"), F.count("*").alias("n"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rel") == 1, F.col("sofar") / F.col("rank"))).alias("ap"), F.sum(F.when(F.col("rank") <= k, gain)).alias("dcg"),
    )
    graded = rel.groupBy("query_id", "grade").agg(F.sum("n").alias("n"))
    graded = graded.withColumn("last", F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("grade"))))
    places = F.when(F.col("last") - F.col("n") < k, F.sequence(F.col("last") - F.col("n") + 1, F.least("last", F.lit(k))))  # of the grade, in the ideal order
    discount = F.aggregate(places, F.lit(0.0), lambda s, r: s + 1.0 / F.log2(r + 1.0))
    ideal = graded.groupBy("query_id").agg(F.sum((F.pow(F.lit(2.0), F.col("grade")) - 1) * discount).alias("idcg"), F.sum(F.when(F.col("grade") > 0, F.col("n")).otherwise(0)).alias("relevant"))
    m = per.join(ideal, "query_id", "left")
    ratio = lambda a, b: F.when(F.coalesce(b, F.lit(0)) > 0, F.coalesce(a, F.lit(0)) / b).otherwise(0.0)
    m = m.withColumns({"recall": ratio(F.col("hits"), F.col("relevant")), "precision": ratio(F.col("hits"), F.least(F.lit(k), F.col("n")))})
    return m.select(
        "query_id", "recall", "precision", F.when(F.col("recall") + F.col("precision") > 0, 2 * F.col("recall") * F.col("precision") / (F.col("recall") + F.col("precision"))).otherwise(0.0).alias("f1"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0).alias("hit_rate"),
        ratio(F.col("ap"), F.col("relevant")).alias("average_precision"), ratio(F.col("dcg"), F.col("idcg")).alias("ndcg"),
    )


def _jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def triad(cases: DataFrame, weights: tuple[float, float, float] = (1 / 3, 1 / 3, 1 / 3)) -> DataFrame:
    """cases (question, context, answer): context_relevance, groundedness, answer_relevance, overall (weighed sum) and passed (>= 0.5)."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = cases.withColumns({"_q": content_tokens(blank("question")), "_c": content_tokens(blank("context")), "_a": content_tokens(blank("answer"))})
    keys = F.slice(F.filter(F.split(F.lower(blank("question")), r"\s+"), lambda w: F.length(w) > 3), 1, 5)
    bonus = F.when(F.exists(keys, lambda w: F.lower(blank("context")).contains(w)), 0.2).otherwise(0.0)
    context = F.when((blank("context") == "") | (blank("question") == ""), 0.0).otherwise(F.least(F.lit(1.0), _jaccard(F.col("_q"), F.col("_c")) + bonus))
    held = F.size(F.filter("_a", lambda w: F.array_contains("_c", w))) / F.size("_a")
    grounded = F.when((F.size("_a") == 0) | (F.size("_c") == 0), 0.0).otherwise(held * F.when(F.size("_a") > 2 * F.size("_c"), 0.8).otherwise(1.0))
    q, a = F.lower(blank("question")), F.lower(blank("answer"))
    kind = (
        F.when(q.contains("what") | q.contains("how"), F.when(F.length(blank("answer")) > 20, 0.8).otherwise(0.4))
        .when(q.contains("is ") | q.contains("does "), F.when(a.contains("yes") | a.contains("no"), 0.9).otherwise(0.5))
        .when(q.contains("why"), F.when(a.contains("because") | a.contains("since"), 0.9).otherwise(0.5))
        .otherwise(0.6)
    )
    answer = F.when(blank("answer") == "", 0.0).otherwise(0.6 * _jaccard(F.col("_q"), F.col("_a")) + 0.4 * kind)
    rows = rows.withColumns({"context_relevance": context, "groundedness": grounded, "answer_relevance": answer})
    parts = ("context_relevance", "groundedness", "answer_relevance")
    equal = len(set(weights)) == 1 and abs(sum(weights) - 1) < 1e-12
    overall = sum((F.col(p) for p in parts[1:]), F.col(parts[0])) / 3 if equal else sum((F.col(p) * w for p, w in zip(parts[1:], weights[1:], strict=True)), F.col(parts[0]) * weights[0])
    rows = rows.withColumn("overall", overall)
    return rows.withColumn("passed", F.col("overall") >= 0.5).drop("_q", "_c", "_a")


def triad_summary(scored: DataFrame) -> DataFrame:
    means = [F.avg(c).alias(c) for c in ("context_relevance", "groundedness", "answer_relevance", "overall")]
    return scored.agg(F.count("*").alias("cases"), *means, F.avg(F.col("passed").cast("int")).alias("pass_rate"))


def hallucinations(cases: DataFrame) -> DataFrame:
    """Adds sentences, unsupported (more than 3 tokens, under 0.3 of them in the context) and confidence."""
    context = content_tokens(F.col("context"))
    sentences = F.filter(F.transform(F.split(F.coalesce("answer", F.lit("")), r"[.!?]"), lambda s: F.trim(s)), lambda s: s != "")
    rows = cases.withColumns({"_c": context, "_s": sentences})

    def bad(s):
        t = content_tokens(s)
        return (F.size(t) > 3) & (F.size(F.filter(t, lambda w: F.array_contains("_c", w))) / F.size(t) < 0.3)

    rows = rows.withColumns({"sentences": F.size("_s"), "unsupported": F.size(F.filter("_s", bad))})
    return rows.withColumn("confidence", F.when(F.col("sentences") > 0, F.col("unsupported") / F.col("sentences")).otherwise(0.0)).drop("_c", "_s")

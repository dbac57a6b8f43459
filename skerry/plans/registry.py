"""All registered queries and their SQL: each operator over the driver's tables, and what DuckDB must return."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from skerry.functions.text import STOP_WORDS
from skerry.operators import changes, chunking, classify, evaluate, graph, iterate, metrics, repositories, search
from skerry.operators.common import small_side, stored
from skerry.streaming import metrics as stream

from . import code, reports  # noqa: F401
from .base import FILES_SQL, IMPORTS_SQL, ORACLES, QUERIES, query, table  # noqa: F401

# Search

_TOKENS = "list_filter(string_split_regex(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 2)"
_SEARCH = (
    "WITH post AS (SELECT doc_id AS id, unnest(list_distinct(t)) AS term, len(list_distinct(t)) AS n FROM (SELECT doc_id, "
    + _TOKENS.format("text")
    + " AS t FROM documents)), df AS (SELECT term, count(*) AS df FROM post GROUP BY 1), asked AS (SELECT item_id AS query_id, unnest(list_distinct(t)) AS q FROM (SELECT item_id, "
    + _TOKENS.format("text")
    + """ AS t FROM benchmark)),
exact AS (SELECT query_id, id, (ln((SELECT count(*) FROM documents) / df::DOUBLE) + 1) / n AS score FROM asked JOIN df ON q = df.term JOIN post ON post.term = q),
alike AS (SELECT df.term, q FROM df JOIN (SELECT DISTINCT q FROM asked) a ON df.term <> q AND (contains(df.term, q) OR contains(q, df.term))),
near AS (SELECT id, q, count(*) AS n FROM alike JOIN post USING (term) GROUP BY ALL),
bonus AS (SELECT query_id, id, n * 0.1::DOUBLE AS score FROM near JOIN asked USING (q) WHERE NOT EXISTS (SELECT 1 FROM post WHERE post.id = near.id AND post.term = near.q)),
sums AS (SELECT query_id, id, round(sum(score), 6) AS score FROM (FROM exact UNION ALL FROM bonus) GROUP BY ALL)
"""
)


def _asked(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_indexes: dict[tuple[str, str], search.Index] = {}


def _index(spark, d):
    """The index of documents, built by the first query of a session that needs it."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _indexes:
        _indexes[key] = search.build(table(spark, d, "documents"), id_col="doc_id", text_col="text")
    return _indexes[key]


def _ranked(spark, d, limit, **more):
    return search.search(None, _asked(spark, d), limit=limit, digits=6, index=_index(spark, d), **more)


@query(_SEARCH + "SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM sums WHERE score > 0 QUALIFY rank <= 10")
def search_topk(spark, d):
    return _ranked(spark, d, 10)


@query(_SEARCH + "SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM sums WHERE score > 0 AND id IN (SELECT doc_id FROM documents WHERE lang = 'en' AND source LIKE '%1%') QUALIFY rank <= 5")
def search_filtered(spark, d):
    return _ranked(spark, d, 5, where=(F.col("lang") == "en") & F.col("source").contains("1"))


@query("SELECT (SELECT count(*) FROM documents) AS document_count, (SELECT count(DISTINCT t) FROM (SELECT unnest(" + _TOKENS.format("text") + ") AS t FROM documents)) AS term_count")
def index_stats(spark, d):
    return search.index_stats(table(spark, d, "documents"), "doc_id", "text")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0)
SELECT query_id, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], e), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], e), 6) DESC, vec_id)::INT AS rank FROM embeddings, q QUALIFY rank <= 10""")
def vector_topk(spark, d):
    rows = table(spark, d, "embeddings")
    return search.vector_top(rows, rows.where("vec_id % 50 = 0"), 10, "vec_id", "embedding", digits=6)


@query("""WITH c AS (SELECT * FROM (VALUES ('common', 'Common words', ['the', 'and', 'of'], 'frequent function words'), ('verbs', 'Verbs', ['ing', 'ed'], 'doing and done'), ('names', 'Names', ['tion', 'ly'], 'nouns')) t(id, name, patterns, about)),
p AS (SELECT id, list_concat(patterns, [lower(id), lower(name)]) AS ps, string_split(lower(about), ' ') AS ab FROM c),
q AS (SELECT item_id AS query_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '') AS ws FROM benchmark),
w AS (SELECT query_id, unnest(ws) AS w FROM q),
s AS (SELECT query_id, id, any_value(len(ps)) AS n, count(*) FILTER (WHERE len(list_filter(ps, lambda x: contains(w, x) OR contains(x, w))) > 0) + 0.5 * count(*) FILTER (WHERE len(list_filter(ab, lambda x: contains(w, x) OR contains(x, w))) > 0) AS total FROM w, p GROUP BY query_id, id)
SELECT query_id, id, least(1.0, total * 2 / n)::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY least(1.0, total * 2 / n) DESC, id)::INT AS rank FROM s WHERE total > 0 QUALIFY rank <= 3""")
def route_collections(spark, d):
    rows = [("common", "Common words", ["the", "and", "of"], "frequent function words"), ("verbs", "Verbs", ["ing", "ed"], "doing and done"), ("names", "Names", ["tion", "ly"], "nouns")]
    collections = spark.createDataFrame(rows, "id string, name string, patterns array<string>, description string")
    return search.route(table(spark, d, "benchmark"), collections, 3, "item_id", "text")


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\\b(th\\w*)', 1)) AS word FROM documents) GROUP BY 1 ORDER BY n DESC, word LIMIT 10")
def completion_terms(spark, d):
    return search.completions(table(spark, d, "documents"), "th", 10, "text")


# Evaluation

_RUNS = _SEARCH + ", ranked AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sums WHERE score > 0 QUALIFY rank <= 10)"


@query(_RUNS + """, qrels AS (SELECT DISTINCT query_id, doc_id, quality::DOUBLE AS grade FROM (SELECT query_id, id AS doc_id FROM ranked) JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)),
j AS (SELECT r.query_id, rank, coalesce(grade, 0) AS grade, (coalesce(grade, 0) > 0)::INT AS rel FROM ranked r LEFT JOIN qrels q ON r.query_id = q.query_id AND r.id = q.doc_id),
k AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) AS sofar FROM j),
m AS (SELECT query_id, sum(rel) AS hits, count(*) AS n, min(CASE WHEN rel = 1 THEN rank END) AS f, sum(CASE WHEN rel = 1 THEN sofar / rank END) AS ap, sum((2 ** grade - 1) / log2(rank + 1)) AS dcg FROM k GROUP BY 1),
i AS (SELECT query_id, sum((2 ** grade - 1) / log2(r + 1)) FILTER (WHERE r <= 10) AS idcg, sum((grade > 0)::INT) AS relevant FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS r FROM qrels) GROUP BY 1),
e AS (SELECT m.*, CASE WHEN relevant > 0 THEN hits / relevant ELSE 0 END AS recall, hits / least(10, n) AS precision, idcg, relevant FROM m LEFT JOIN i USING (query_id))
SELECT query_id, round(recall, 6) AS recall, round(precision, 6) AS precision, round(CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0 END, 6) AS f1, round(coalesce(1.0 / f, 0), 6) AS mrr, CASE WHEN f IS NULL THEN 0.0 ELSE 1.0 END AS hit_rate, round(CASE WHEN relevant > 0 THEN coalesce(ap, 0) / relevant ELSE 0 END, 6) AS average_precision, round(CASE WHEN idcg > 0 THEN coalesce(dcg, 0) / idcg ELSE 0 END, 6) AS ndcg FROM e""")
def ir_metrics(spark, d):
    runs = stored(_ranked(spark, d, 10).select("query_id", F.col("id").alias("doc_id"), "rank"), "runs")
    grades = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("grade"))
    out = evaluate.retrieval_metrics(runs, runs.select("query_id", "doc_id").join(grades, "doc_id"))
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in out.columns if c != "query_id"])


@query(_RUNS + """, qrels AS (SELECT DISTINCT query_id, doc_id, quality::DOUBLE AS grade FROM (SELECT query_id, id AS doc_id FROM sums WHERE score > 0) JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)),
j AS (SELECT r.query_id, rank, coalesce(grade, 0) AS grade, (coalesce(grade, 0) > 0)::INT AS rel FROM ranked r LEFT JOIN qrels q ON r.query_id = q.query_id AND r.id = q.doc_id),
k AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) AS sofar FROM j),
m AS (SELECT query_id, sum(rel) AS hits, count(*) AS n, min(CASE WHEN rel = 1 THEN rank END) AS f, sum(CASE WHEN rel = 1 THEN sofar / rank END) AS ap, sum((2 ** grade - 1) / log2(rank + 1)) AS dcg FROM k GROUP BY 1),
i AS (SELECT query_id, sum((2 ** grade - 1) / log2(r + 1)) FILTER (WHERE r <= 10) AS idcg, sum((grade > 0)::INT) AS relevant FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS r FROM qrels) GROUP BY 1),
e AS (SELECT m.*, CASE WHEN relevant > 0 THEN hits / relevant ELSE 0 END AS recall, hits / least(10, n) AS precision, idcg, relevant FROM m LEFT JOIN i USING (query_id))
SELECT query_id, round(recall, 6) AS recall, round(precision, 6) AS precision, round(CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0 END, 6) AS f1, round(coalesce(1.0 / f, 0), 6) AS mrr, CASE WHEN f IS NULL THEN 0.0 ELSE 1.0 END AS hit_rate, round(CASE WHEN relevant > 0 THEN coalesce(ap, 0) / relevant ELSE 0 END, 6) AS average_precision, round(CASE WHEN idcg > 0 THEN coalesce(dcg, 0) / idcg ELSE 0 END, 6) AS ndcg FROM e""")
def ir_metrics_judged(spark, d):
    """As ir_metrics, but all scored documents with a label are judged, so relevant ones that the top 10 miss count."""
    grades = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("grade"))
    index = _index(spark, d)
    judged = replace(index, documents=index.documents.join(small_side(stored(grades, "grades")), "doc_id"))
    qrels = search.scores(None, _asked(spark, d), digits=6, index=judged, carry=("grade",)).withColumnRenamed("id", "doc_id")
    runs = stored(_ranked(spark, d, 10).select("query_id", F.col("id").alias("doc_id"), "rank"), "runs")
    out = evaluate.retrieval_metrics(runs, qrels)
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in out.columns if c != "query_id"])


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_CONTENT = "list_filter(" + _TOKENS + ", lambda w: NOT list_contains([" + _STOP + "], w))"
_CASES = """WITH turns AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, lead(role) OVER w AS nr, lead(text) OVER w AS nt, string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
cases AS (SELECT conv_id, turn, text AS question, coalesce(before, '') AS context, coalesce(nt, '') AS answer FROM turns WHERE role = 'user' AND nr = 'assistant'),
s AS (SELECT *, """ + ", ".join(f"{_CONTENT.format(c)} AS {c[0]}" for c in ("question", "context", "answer")) + """, lower(question) AS lq, lower(answer) AS la FROM cases),
j AS (SELECT *, CASE WHEN len(list_distinct(list_concat(q, c))) > 0 THEN len(list_distinct(list_intersect(q, c))) / len(list_distinct(list_concat(q, c))) ELSE 0 END AS qc, CASE WHEN len(list_distinct(list_concat(q, a))) > 0 THEN len(list_distinct(list_intersect(q, a))) / len(list_distinct(list_concat(q, a))) ELSE 0 END AS qa FROM s),
t AS (SELECT conv_id, turn, CASE WHEN context = '' OR question = '' THEN 0 ELSE least(1.0, qc + CASE WHEN len(list_filter(list_filter(string_split_regex(lq, '\\s+'), lambda w: length(w) > 3)[1:5], lambda w: contains(lower(context), w))) > 0 THEN 0.2 ELSE 0 END) END AS context_relevance,
CASE WHEN len(a) = 0 OR len(c) = 0 THEN 0 ELSE len(list_filter(a, lambda w: list_contains(c, w))) / len(a) * CASE WHEN len(a) > 2 * len(c) THEN 0.8 ELSE 1.0 END END AS groundedness,
CASE WHEN answer = '' THEN 0 ELSE 0.6 * qa + 0.4 * CASE WHEN contains(lq, 'what') OR contains(lq, 'how') THEN CASE WHEN length(answer) > 20 THEN 0.8 ELSE 0.4 END WHEN contains(lq, 'is ') OR contains(lq, 'does ') THEN CASE WHEN contains(la, 'yes') OR contains(la, 'no') THEN 0.9 ELSE 0.5 END WHEN contains(lq, 'why') THEN CASE WHEN contains(la, 'because') OR contains(la, 'since') THEN 0.9 ELSE 0.5 END ELSE 0.6 END END AS answer_relevance FROM j)
"""


def _cases(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations")
    before = F.array_join(F.collect_list("text").over(w.rowsBetween(Window.unboundedPreceding, -1)), " ")
    rows = rows.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("question"), F.coalesce(before, F.lit("")).alias("context"), F.coalesce(F.lead("text").over(w), F.lit("")).alias("answer"), F.lead("role").over(w).alias("_next"))
    return rows.where("role = 'user' and _next = 'assistant'").drop("role", "_next")


@query(_CASES + "SELECT conv_id, turn, round(context_relevance::DOUBLE, 6) AS context_relevance, round(groundedness::DOUBLE, 6) AS groundedness, round(answer_relevance::DOUBLE, 6) AS answer_relevance, round((context_relevance + groundedness + answer_relevance)::DOUBLE / 3, 6) AS overall FROM t")
def rag_triad(spark, d):
    out = evaluate.triad(_cases(spark, d))
    return out.select("conv_id", "turn", *[F.round(c, 6).alias(c) for c in ("context_relevance", "groundedness", "answer_relevance", "overall")])


@query(_CASES + "SELECT count(*) AS cases, round(avg(context_relevance::DOUBLE), 6) AS context_relevance, round(avg(groundedness::DOUBLE), 6) AS groundedness, round(avg(answer_relevance::DOUBLE), 6) AS answer_relevance FROM t")
def triad_summary(spark, d):
    out = evaluate.triad_summary(evaluate.triad(_cases(spark, d)))
    return out.select("cases", *[F.round(c, 6).alias(c) for c in ("context_relevance", "groundedness", "answer_relevance")])


@query(_CASES + ", u AS (SELECT conv_id, turn, c, unnest(list_filter(list_transform(string_split_regex(answer, '[.!?]'), lambda x: trim(x)), lambda x: x <> '')) AS x FROM s), v AS (SELECT conv_id, turn, c, " + _CONTENT.format("x") + " AS k FROM u) SELECT conv_id, turn, count(*)::INT AS sentences, count(*) FILTER (WHERE len(k) > 3 AND len(list_filter(k, lambda w: list_contains(c, w))) / len(k) < 0.3)::INT AS unsupported FROM v GROUP BY ALL")
def hallucination(spark, d):
    return evaluate.hallucinations(_cases(spark, d)).select("conv_id", "turn", "sentences", "unsupported").where("sentences > 0")


# Metrics

_HIST = "SELECT event_type AS name, count(*) AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1"


def _samples(spark, d):
    return table(spark, d, "events").withColumnRenamed("event_type", "name")


def _calls(spark, d):
    return table(spark, d, "events").select("event_id", (F.col("user_id") % 7).cast("string").alias("provider"), "ts", (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency"))


@query(_HIST)
def metric_summary(spark, d):
    return metrics.histogram_summary(_samples(spark, d)).withColumn("mean", F.round("mean", 6))


@query("SELECT event_type AS name, user_id, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY ROLLUP (event_type, user_id) HAVING event_type IS NOT NULL")
def counters_rollup(spark, d):
    return metrics.counters_rollup(_samples(spark, d), "user_id").withColumn("total", F.round("total", 4))


@query("SELECT event_type AS name, user_id, arg_max(value, ts) AS value FROM events GROUP BY ALL")
def gauges_latest(spark, d):
    return metrics.gauges_latest(_samples(spark, d), "user_id")


@query("SELECT count(*) AS operations, round(avg(value), 6) AS mean_latency, count(*) FILTER (WHERE event_type LIKE '%error%') AS errors, count(DISTINCT event_type) AS metric_count, round(100.0 * count(*) FILTER (WHERE event_type LIKE '%error%') / count(*), 6) AS error_rate, CASE WHEN 100.0 * count(*) FILTER (WHERE event_type LIKE '%error%') / count(*) > 10 THEN 'unhealthy' WHEN 100.0 * count(*) FILTER (WHERE event_type LIKE '%error%') / count(*) > 5 OR avg(value) > 1000000 THEN 'degraded' ELSE 'healthy' END AS status FROM events")
def metric_health(spark, d):
    return metrics.health(_samples(spark, d)).withColumns({c: F.round(c, 6) for c in ("mean_latency", "error_rate")})


@query("SELECT event_id, event_type AS name, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 1000")
def last_n(spark, d):
    return metrics.last_samples(_samples(spark, d), 1000, "event_id").select("event_id", "name", "value")


@query("SELECT (user_id % 7)::VARCHAR AS provider, count(*) FILTER (WHERE event_type <> 'error') AS success_count, count(*) FILTER (WHERE event_type = 'error') AS failure_count, round(coalesce(avg(value) FILTER (WHERE event_type <> 'error'), 0), 6) AS avg_latency FROM events GROUP BY 1")
def provider_stats(spark, d):
    return metrics.provider_stats(_calls(spark, d)).withColumn("avg_latency", F.round("avg_latency", 6))


@query("""WITH c AS (SELECT event_id, (user_id % 7)::VARCHAR AS provider, ts, event_type <> 'error' AS ok FROM events),
r AS (SELECT *, count(*) OVER w AS n, sum((NOT ok)::INT) OVER w AS f FROM c WINDOW w AS (PARTITION BY provider ORDER BY ts, event_id)),
e AS (SELECT *, CASE WHEN ok THEN true WHEN n >= 3 AND f / n > 0.5 THEN false END AS e FROM r)
SELECT event_id, provider, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY provider ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), true) AS healthy FROM e""")
def provider_health(spark, d):
    return metrics.provider_health(_calls(spark, d), "event_id").select("event_id", "provider", "healthy")


@query("""WITH p AS (SELECT (s_suppkey % 20)::VARCHAR AS name, max(s_acctbal) AS cost, (s_suppkey % 20) / 20.0 AS quality FROM supplier GROUP BY ALL)
SELECT c_custkey AS request_id, arg_min(name, (cost, name)) AS provider FROM customer, p WHERE quality >= (c_custkey % 19) / 20.0 GROUP BY 1""")
def cheapest_provider(spark, d):
    p = table(spark, d, "supplier").groupBy((F.col("s_suppkey") % 20).alias("k")).agg(F.max("s_acctbal").alias("cost"))
    p = p.select(F.col("k").cast("string").alias("name"), "cost", (F.col("k") / 20.0).alias("quality"), F.lit(True).alias("healthy"))
    return metrics.cheapest_provider(table(spark, d, "customer").select(F.col("c_custkey").alias("request_id"), ((F.col("c_custkey") % 19) / 20.0).alias("min_quality")), p)


@query("WITH h AS (" + _HIST + ") SELECT name, count, p50, p95, p99 FROM h")
def prometheus_lines(spark, d):
    s = metrics.histogram_summary(_samples(spark, d))
    t = metrics.prometheus(s)
    pick = lambda p: F.regexp_extract("line", p, 1).cast("double")
    return t.select("name", pick(r"_count (\d+)").cast("long").alias("count"), *[pick(rf'quantile="{q}"\}} (\S+)').alias(n) for q, n in (("0.5", "p50"), ("0.95", "p95"), ("0.99", "p99"))])


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS name, count(*) AS count, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max FROM events GROUP BY ALL")
def metric_windows(spark, d):
    return stream.windowed(_samples(spark, d)).withColumn("sum", F.round("sum", 4)).drop("p50")


@query("""WITH g AS (SELECT *, (lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, sid""")
def activity_sessions(spark, d):
    return stream.sessions(table(spark, d, "events")).select("user_id", "started", "n")


# Changes and registry tables

_OLD = "SELECT o_orderkey AS path, sha256(o_orderstatus || o_totalprice::INT::VARCHAR) AS hash FROM orders WHERE o_orderkey % 10 <> 3"
_NEW = "SELECT o_orderkey AS path, sha256(CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END || o_totalprice::INT::VARCHAR) AS hash FROM orders WHERE o_orderkey % 10 <> 5"


def _snapshots(spark, d):
    o = table(spark, d, "orders").withColumn("p", F.round("o_totalprice").cast("int").cast("string"))
    old = changes.with_hash(o.where("o_orderkey % 10 <> 3").select(F.col("o_orderkey").alias("path"), F.concat("o_orderstatus", "p").alias("content")))
    status = F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))
    return old, changes.with_hash(o.where("o_orderkey % 10 <> 5").select(F.col("o_orderkey").alias("path"), F.concat(status, "p").alias("content")))


@query(f"SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' ELSE 'modified' END AS change_type FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR o.hash <> n.hash")
def changed_files(spark, d):
    return changes.detect_changes(*_snapshots(spark, d))


@query(f"SELECT n.path, (o.hash IS DISTINCT FROM n.hash) AS needs_reindex FROM ({_NEW}) n LEFT JOIN ({_OLD}) o ON o.path = n.path")
def reindex_list(spark, d):
    old, new = _snapshots(spark, d)
    return changes.needs_reindex(new, old).select("path", "needs_reindex")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents")
def content_hash(spark, d):
    return changes.with_hash(table(spark, d, "documents"), "text").select("doc_id", "hash")


@query("SELECT 'total' AS field, NULL AS value, count(*) AS n FROM customer UNION ALL SELECT 'c_mktsegment', c_mktsegment, count(*) FROM customer GROUP BY ALL UNION ALL SELECT 'c_nationkey', c_nationkey::VARCHAR, count(*) FROM customer GROUP BY ALL")
def status_summary(spark, d):
    return changes.counts_by(table(spark, d, "customer"), "c_mktsegment", "c_nationkey")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN upper(s_name) ELSE s_name END AS s_name, s_nationkey FROM supplier")
def upsert(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return changes.update_rows(s, s.where("s_suppkey % 3 = 0").select("s_suppkey", F.upper("s_name").alias("s_name")), "s_suppkey")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey <> 3")
def remove_rows(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return changes.remove_rows(s, s.where("s_nationkey = 3"), "s_suppkey").drop("s_nationkey")


@query("WITH t AS (SELECT max(ts)::DATE AS today FROM events) SELECT event_type AS repo, substr(arg_max(sha256(event_id::VARCHAR), (ts, event_id)), 1, 8) AS sha, max(ts) AS ts, count(*) FILTER (WHERE ts >= today - 30) AS commits_30d FROM events, t GROUP BY 1")
def commit_activity(spark, d):
    e = table(spark, d, "events")
    today = e.agg(F.max("ts").cast("date")).first()[0]
    rows = e.select(F.col("event_type").alias("repo"), F.sha2(F.col("event_id").cast("string"), 256).alias("sha"), F.to_json(F.struct("event_id")).alias("message"), "ts")
    return changes.commit_activity(rows, F.lit(today)).drop("message")


# Graphs: part p calls (7 p + 3) mod N (with cycles); in the tree p calls p div 2

_CALLS = "calls AS (SELECT p_partkey AS source, (7 * p_partkey + 3) % (SELECT count(*) FROM part) AS target FROM part)"
_TREE = "calls AS (SELECT p_partkey AS source, p_partkey // 2 AS target FROM part WHERE p_partkey > 0)"


def _parts(spark, d, tree=False):
    part = table(spark, d, "part")
    nodes = part.select(F.col("p_partkey").alias("id"), F.lit("function").alias("type"), F.col("p_name").alias("name"))
    if tree:
        return nodes, part.where("p_partkey > 0").select(F.col("p_partkey").alias("source"), F.expr("p_partkey div 2").alias("target"), F.lit("calls").alias("type"))
    n = part.agg(F.count("*").alias("_n"))
    return nodes, part.crossJoin(F.broadcast(n)).select(F.col("p_partkey").alias("source"), ((7 * F.col("p_partkey") + 3) % F.col("_n")).alias("target"), F.lit("calls").alias("type"))


_PAGES = """links AS (SELECT page_id AS source, h AS target FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS h FROM pages))"""


def _links(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").cast("string").alias("source"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("target"), F.lit("calls").alias("type"))


@query(f"WITH {_PAGES}, t AS (SELECT target AS id, count(*) AS callers FROM links GROUP BY 1) SELECT id, callers AS connectivity FROM t ORDER BY callers DESC, id LIMIT 10")
def degree_hot(spark, d):
    e = _links(spark, d)
    nodes = e.select(F.col("target").alias("id"), F.lit("function").alias("type")).distinct()
    return graph.hot_paths(nodes, e).select("id", "connectivity")


@query(f"WITH {_PAGES} SELECT source, target, count(*) AS n FROM links GROUP BY ALL")
def link_graph(spark, d):
    return _links(spark, d).groupBy(F.col("source").cast("long").alias("source"), "target").agg(F.count("*").alias("n"))


@query(f"WITH {_TREE} SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT target FROM calls)")
def entry_points(spark, d):
    return graph.entry_points(*_parts(spark, d, True))


@query(f"WITH {_TREE} SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT source FROM calls)")
def leaf_functions(spark, d):
    return graph.leaf_functions(*_parts(spark, d, True))


@query("SELECT 'node' AS kind, 'function' AS type, count(*) AS n FROM part UNION ALL SELECT 'node', NULL, count(*) FROM part UNION ALL SELECT 'edge', 'calls', count(*) FROM part UNION ALL SELECT 'edge', NULL, count(*) FROM part")
def graph_stats(spark, d):
    return graph.graph_stats(*_parts(spark, d))


@query(f"WITH {_TREE}, o AS (SELECT source AS id, count(*) AS e FROM calls GROUP BY 1), i AS (SELECT target AS id, count(*) AS a FROM calls GROUP BY 1) SELECT p_partkey AS id, coalesce(a, 0) AS afferent, coalesce(e, 0) AS efferent, round(CASE WHEN coalesce(a, 0) + coalesce(e, 0) > 0 THEN coalesce(e, 0) / (coalesce(a, 0) + coalesce(e, 0)) ELSE 0.5 END, 6) AS instability FROM part LEFT JOIN o ON o.id = p_partkey LEFT JOIN i ON i.id = p_partkey")
def coupling(spark, d):
    nodes, edges = _parts(spark, d, True)
    return graph.coupling(nodes, edges.withColumn("type", F.lit("imports"))).withColumn("instability", F.round("instability", 6))


_STARTS = "WITH RECURSIVE {0}, r AS (SELECT p_partkey AS start, p_partkey AS node, 0 AS distance FROM part UNION ALL SELECT start, {2}, distance + 1 FROM r JOIN calls ON {1} = node WHERE distance < {3}) SELECT start, node, min(distance)::INT AS distance FROM r GROUP BY ALL HAVING min(distance) > 0"


@query(_STARTS.format(_CALLS, "source", "target", 4))
def reach_callees(spark, d):
    nodes, edges = _parts(spark, d)
    return graph.transitive_callees(edges, nodes, 3)


@query(_STARTS.format(_TREE, "target", "source", 3))
def reach_callers(spark, d):
    nodes, edges = _parts(spark, d, True)
    return graph.transitive_callers(edges, nodes, 4)


@query(_STARTS.format(_TREE, "target", "source", 49))
def reach_callers_deep(spark, d):
    """All callers at the default depth; the tree ends before it."""
    nodes, edges = _parts(spark, d, True)
    return graph.transitive_callers(edges, nodes)


@query(f"WITH RECURSIVE {_TREE}, r AS (SELECT p_partkey AS f, p_partkey AS node, [p_partkey] AS path FROM part UNION ALL SELECT f, target, list_append(path, target) FROM r JOIN calls ON source = node WHERE len(path) < 20) SELECT f AS \"from\", 1::BIGINT AS \"to\", array_to_string(path, '>') AS path FROM r WHERE node = 1")
def shortest_path(spark, d):
    nodes, edges = _parts(spark, d, True)
    pairs = nodes.select(F.col("id").alias("from"), F.lit(1).cast("long").alias("to"))
    return iterate.shortest_paths(edges, pairs, 20).withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))


@query(f"""WITH RECURSIVE {IMPORTS_SQL}, steps AS (SELECT DISTINCT source, target FROM imports), pairs AS (SELECT 's' || k AS "from", 's' || ((k * 5 + 1) % m) AS "to" FROM mods, m UNION SELECT 's' || k, 'ext' || (k % 5) FROM mods UNION SELECT 's' || k, 's' || k FROM mods WHERE k % 10 = 0),
ends AS (SELECT DISTINCT "to" FROM pairs), r AS (SELECT "to", "to" AS node, 0 AS d FROM ends UNION SELECT "to", source, d + 1 FROM r JOIN steps ON target = node WHERE d < 5),
dist AS (SELECT "to", node, min(d) AS d FROM r GROUP BY ALL),
w AS (SELECT "from", pairs."to", "from" AS node, d AS rest, ["from"] AS path FROM pairs JOIN dist ON dist."to" = pairs."to" AND node = "from"
  UNION ALL SELECT w."from", w."to", target, rest - 1, list_append(path, target) FROM w JOIN steps ON source = w.node JOIN dist ON dist."to" = w."to" AND dist.node = target AND dist.d = rest - 1 WHERE rest > 0)
SELECT "from", "to", array_to_string(min(path), '>') AS path FROM w WHERE rest = 0 GROUP BY ALL""")
def shortest_path_pairs(spark, d):
    """Many targets in a graph with cycles and ties: each module to another one, to an external one, and some to themselves."""
    from .base import imports

    nodes, edges = imports(spark, d)
    modules = nodes.where("type = 'module'").select("id", F.substring("id", 2, 20).try_cast("long").alias("k"))
    m = modules.agg(F.count("*").alias("m"))
    other = modules.crossJoin(F.broadcast(m)).select(F.col("id").alias("from"), F.concat(F.lit("s"), ((F.col("k") * 5 + 1) % F.col("m")).cast("string")).alias("to"))
    outside = modules.select(F.col("id").alias("from"), F.concat(F.lit("ext"), (F.col("k") % 5).cast("string")).alias("to"))
    same = modules.where("k % 10 = 0").select(F.col("id").alias("from"), F.col("id").alias("to"))
    return iterate.shortest_paths(edges, other.union(outside).union(same), 6).withColumn("path", F.array_join("path", ">"))


@query(f"WITH RECURSIVE {_TREE}, r AS (SELECT p_partkey AS id, p_partkey AS node, 0 AS depth FROM part UNION ALL SELECT id, target, depth + 1 FROM r JOIN calls ON source = node) SELECT id, max(depth)::INT AS depth FROM r GROUP BY 1")
def call_depths(spark, d):
    nodes, edges = _parts(spark, d, True)
    return iterate.depths(edges, nodes)


@query(f"WITH RECURSIVE {_CALLS}, r AS (SELECT p_partkey AS start, p_partkey AS node FROM part UNION SELECT start, target FROM r JOIN calls ON source = node), m AS (SELECT a.start AS id, min(a.node) AS component, count(*) AS n FROM r a JOIN r b ON a.start = b.node AND a.node = b.start GROUP BY 1) SELECT id, component FROM m WHERE n > 1")
def strong_components(spark, d):
    return iterate.strong_components(_parts(spark, d)[1])


# Repository dependencies: a supplier is a repository, the brands it ships are its dependencies

_DEPS = "deps AS (SELECT DISTINCT 'supplier' || l_suppkey AS repo, p_brand AS dep, '~> ' || (p_size // 10) || '.0' AS version FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _deps(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    version = F.concat(F.lit("~> "), F.expr("p_size div 10").cast("string"), F.lit(".0"))
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").join(part, "l_partkey")
    return rows.select(F.concat(F.lit("supplier"), F.col("l_suppkey").cast("string")).alias("repo"), F.col("p_brand").alias("dep"), version.alias("version"), F.lit("runtime").alias("scope")).distinct()


@query(f"WITH {_DEPS} SELECT dep, count(DISTINCT repo)::INT AS n FROM deps GROUP BY 1 HAVING count(*) >= 2")
def shared_deps(spark, d):
    return repositories.shared_dependencies(_deps(spark, d)).select("dep", "n")


@query(f"WITH {_DEPS} SELECT dep, string_agg(DISTINCT m::VARCHAR, ',' ORDER BY m::VARCHAR) AS majors, count(*) AS listings, 'major' AS severity FROM (SELECT *, regexp_extract(version, '([0-9]+)', 1)::INT AS m FROM deps) GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT m) > 1")
def version_conflicts(spark, d):
    out = repositories.version_conflicts(_deps(spark, d))
    return out.withColumn("majors", F.array_join(F.transform("majors", lambda x: x.cast("string")), ","))


@query(f"""WITH RECURSIVE {_TREE}, r AS (SELECT p_partkey AS start, p_partkey AS node, 0 AS distance FROM part UNION ALL SELECT start, source, distance + 1 FROM r JOIN calls ON target = node),
g AS (SELECT start, count(*) FILTER (WHERE distance = 1) AS direct, count(*) FILTER (WHERE distance > 1) AS transitive FROM r GROUP BY 1), t AS (SELECT count(*) AS t FROM part)
SELECT start AS repo, direct, transitive, CASE WHEN (direct + transitive) / t >= 0.5 THEN 'critical' WHEN (direct + transitive) / t >= 0.3 THEN 'high' WHEN (direct + transitive) / t >= 0.1 THEN 'medium' ELSE 'low' END AS risk FROM g, t""")
def repo_impact(spark, d):
    nodes, edges = _parts(spark, d, True)
    return repositories.impact(nodes.withColumn("type", F.lit("repo")), edges)


@query(f"WITH RECURSIVE {_TREE}, r AS (SELECT p_partkey AS id, p_partkey AS node, 0 AS depth FROM part UNION ALL SELECT id, target, depth + 1 FROM r JOIN calls ON source = node) SELECT id AS repo, max(depth)::INT AS level FROM r GROUP BY 1")
def upgrade_order(spark, d):
    nodes, edges = _parts(spark, d, True)
    return repositories.upgrade_order(nodes.withColumn("type", F.lit("repo")), edges)


@query(f"WITH {_DEPS} SELECT dep, count(DISTINCT repo) AS dependents FROM deps GROUP BY 1 ORDER BY dependents DESC, dep LIMIT 10")
def most_depended_on(spark, d):
    deps = _deps(spark, d)
    return repositories.most_depended_on(deps.select(F.col("repo").alias("source"), F.col("dep").alias("target")))


# Chunks and lines

@query("""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
s AS (SELECT doc_id, l, unnest(range(0, len(l))) AS k FROM l), w AS (SELECT doc_id, l, 1 + k * 2 AS a FROM s WHERE k = 0 OR (1 + (k - 1) * 2 + 2 < len(l)))
SELECT doc_id, a::INT AS start_line, least(a + 2, len(l))::INT AS end_line, sha256(array_to_string(l[a:a + 2], chr(10))) AS h FROM w""")
def line_chunks(spark, d):
    out = chunking.line_windows(table(spark, d, "documents"), 180, 60, "doc_id", "text")
    return out.select("doc_id", "start_line", "end_line", F.sha2("content", 256).alias("h"))


@query("WITH s AS (SELECT doc_id, text, unnest(range(0, ((length(text) - 1) // 800 + 1)::BIGINT)) AS n FROM documents WHERE length(text) > 0) SELECT doc_id, n::INT AS n, sha256(substr(text, (n * 800 + 1)::BIGINT, 1000)) AS h FROM s")
def char_chunks(spark, d):
    out = chunking.char_windows(table(spark, d, "documents"), 1000, 200, "doc_id", "text")
    return out.select("doc_id", "n", F.sha2("content", 256).alias("h"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents)
SELECT doc_id, count(*)::INT AS total, count(*) FILTER (WHERE NOT regexp_full_match(l, '\\s*'))::INT AS code, count(*) FILTER (WHERE regexp_matches(l, '^\\s*#'))::INT AS comment, count(*) FILTER (WHERE regexp_full_match(l, '\\s*'))::INT AS blank FROM l GROUP BY 1""")
def line_metrics(spark, d):
    return chunking.line_metrics(table(spark, d, "documents"), "doc_id", "text")


@query("""WITH m AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'signup'), s AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase')
SELECT s.event_id, max(m.ts) AS parent FROM s LEFT JOIN m ON m.user_id = s.user_id AND m.ts < s.ts GROUP BY 1""")
def asof_parent(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    marks = e.where("event_type = 'signup'").select("user_id", "ts", F.col("ts").alias("name"))
    return graph.enclosing(e.where("event_type = 'purchase'").drop("event_type"), marks, "user_id", "ts").select("event_id", "parent")


# Classification

_WORDS = "string_split_regex(lower(coalesce(text, '')), '[^a-z0-9_]+')"


@query("SELECT conv_id, turn, CASE WHEN list_has_any({w}, {c}) THEN 'code' WHEN list_has_any({w}, {q}) AND length(text) < 50 THEN 'quick' WHEN list_has_any({w}, {r}) THEN 'reasoning' ELSE 'general' END AS task FROM conversations".format(w=_WORDS, c=classify.CODE_WORDS, q=classify.QUICK_WORDS, r=classify.REASONING_WORDS))
def task_type(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", classify.task_type(F.col("text")).alias("task"))


@query("SELECT conv_id, turn, array_to_string(list_filter(list_distinct_ordered, lambda w: true)[1:10], ' ') AS keywords FROM (SELECT conv_id, turn, list_filter(ws, lambda w, i: list_position(ws, w) = i) AS list_distinct_ordered FROM (SELECT conv_id, turn, list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 3) AS ws FROM conversations))")
def keyword_triage(spark, d):
    out = classify.triage(table(spark, d, "conversations"), "text")
    return out.select("conv_id", "turn", F.array_join("keywords", " ").alias("keywords"))


@query("WITH r AS (SELECT * FROM (VALUES " + ", ".join("({}, '{}', '{}', '{}')".format(i, k, p.replace("'", "''"), s) for i, (k, p, s) in enumerate(classify.security_rules())) + ") t(rule, kind, p, severity)) SELECT doc_id, rule, kind, severity FROM documents, r WHERE regexp_matches(text, p)")
def secret_scan(spark, d):
    return classify.rule_hits(table(spark, d, "documents"), "doc_id", "text")


# Contexts: hits with their texts, unions of hits, words and modules around them

_TOP = _SEARCH + ", ranked AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sums WHERE score > 0 QUALIFY rank <= {k})"
_FIRST = "FROM (SELECT item_id, split_part(text, ' ', 1) AS text FROM benchmark))"


def _hits(spark, d, limit, asked=None):
    docs = table(spark, d, "documents")
    out = stored(search.search(None, _asked(spark, d) if asked is None else asked, limit=limit, digits=6, index=_index(spark, d)), "hits")
    rows = docs.select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", "doc_id").alias("path"), F.lit(None).cast("string").alias("relative_path"), F.lit(1).alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.col("text").alias("content"), F.col("lang").alias("language"), F.lit("text").alias("type"), F.col("source").alias("name"))
    return rows.join(small_side(out), "id")  # few hits go to the texts


def _first_words(spark, d):
    return _asked(spark, d).withColumn("query", F.split("query", " ")[0])


@query(_TOP.format(k=5) + """, b AS (SELECT query_id, string_agg('File: ' || concat_ws('/', source, doc_id) || ' (L1)' || chr(10) || '```' || chr(10) || coalesce(text, '') || chr(10) || '```' || chr(10), chr(10) ORDER BY rank) AS c FROM ranked JOIN documents ON doc_id = id GROUP BY 1)
SELECT item_id AS query_id, sha256(coalesce(c, 'No relevant code found.')) AS h, sha256(coalesce(c, 'No relevant code found.') || chr(10) || chr(10) || coalesce(text, '')) AS p FROM benchmark LEFT JOIN b ON query_id = item_id""")
def search_contexts(spark, d):
    out = search.contexts(_hits(spark, d, 5), _asked(spark, d))
    return out.select("query_id", F.sha2("context", 256).alias("h"), F.sha2("prompt", 256).alias("p"))


@query(_TOP.format(k=5) + " SELECT query_id, rank::INT AS rank, id, concat_ws('/', source, doc_id) AS path, coalesce(lang, 'unknown') AS language, round(score, 3) AS score, sha256(substr(coalesce(text, ''), 1, 300)) AS h FROM ranked JOIN documents ON doc_id = id")
def search_previews(spark, d):
    return search.previews(_hits(spark, d, 5)).withColumn("h", F.sha2("preview", 256)).drop("preview")


@query(_TOP.format(k=3) + """, asks AS (SELECT item_id AS query_id, length(text) % 5 AS topic, row_number() OVER (PARTITION BY length(text) % 5 ORDER BY item_id) AS part FROM benchmark), f AS (SELECT topic, id, min((part, rank)) AS f FROM ranked JOIN asks USING (query_id) GROUP BY ALL)
SELECT topic::INT AS topic, id, row_number() OVER (PARTITION BY topic ORDER BY f, id)::INT AS place FROM f QUALIFY place <= 10""")
def search_unions(spark, d):
    part = F.row_number().over(Window.partitionBy("topic").orderBy("item_id"))
    asks = table(spark, d, "benchmark").select("item_id", (F.length("text") % 5).alias("topic")).withColumn("part", part).withColumnRenamed("item_id", "query_id")
    return search.union_of_hits(_ranked(spark, d, 3).join(asks, "query_id"), 3, 10)


@query(_TOP.format(k=10) + """, hot AS (SELECT source FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, source LIMIT 3), j AS (SELECT query_id, id, score, coalesce(source IN (FROM hot) OR EXISTS (SELECT 1 FROM hot WHERE contains(concat_ws('/', d.source, d.doc_id), hot.source)), false) AS hot FROM ranked JOIN documents d ON doc_id = id)
SELECT query_id, id, hot, row_number() OVER (PARTITION BY query_id ORDER BY hot DESC, score DESC, id)::INT AS place FROM j QUALIFY place <= 5""")
def investigation(spark, d):
    hot = table(spark, d, "documents").where("source is not null").groupBy(F.col("source").alias("id")).count().orderBy(F.desc("count"), "id").limit(3)
    return search.investigation(_hits(spark, d, 10), hot).select("query_id", "id", "hot", "place")


@query(_TOP.format(k=10).replace("FROM benchmark)", _FIRST) + """, w AS (SELECT item_id AS query_id, split_part(text, ' ', 1) AS q FROM benchmark), j AS (SELECT query_id, rank, contains(text, q)::INT AS rel FROM ranked JOIN documents ON doc_id = id JOIN w USING (query_id)),
m AS (SELECT query_id, coalesce(sum(rel) FILTER (WHERE rank <= 5), 0) AS hits, count(*) AS n, sum(rel) AS relevant FROM j GROUP BY 1), e AS (SELECT query_id, CASE WHEN relevant > 0 THEN hits / relevant ELSE 0 END AS r, hits / least(5, n) AS p FROM m)
SELECT query_id, round(r, 6) AS recall, round(p, 6) AS precision, round(CASE WHEN r + p > 0 THEN 2 * r * p / (r + p) ELSE 0 END, 6) AS f1 FROM e""")
def query_benchmark(spark, d):
    from skerry.operators import questions

    out = questions.query_benchmark(table(spark, d, "documents"), _first_words(spark, d), id_col="doc_id", text_col="text", index=_index(spark, d))
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1")])


@query("""WITH s AS (SELECT DISTINCT split_part(text, ' ', 1) AS symbol FROM benchmark), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents),
w AS (SELECT DISTINCT doc_id, line, unnest(regexp_extract_all(t, '(\\w+)', 1)) AS symbol FROM l) SELECT symbol, doc_id AS id, line::INT AS line FROM w JOIN s USING (symbol)""")
def symbol_lines(spark, d):
    docs = table(spark, d, "documents")
    lines = docs.select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    names = _first_words(spark, d).select(F.col("query").alias("symbol")).distinct()
    return search.usages(lines, docs, names, id_col="doc_id", text_col="text")[1]


@query("""WITH m AS (SELECT p_partkey AS k, p_size AS s FROM part WHERE p_partkey % 4 = 2), q AS (SELECT p_partkey AS query_id, 'what is m' || p_partkey || ' for' AS t FROM part WHERE p_partkey % 8 = 2)
SELECT query_id, 'App.M' || k AS module, 'Module App.M' || k || ':' || chr(10) || '  - Imports: App.Repo, Enum, Tool' || s || chr(10) || '  - Functions: App.M' || k || '.bare, App.M' || k || '.get, App.M' || k || '.helper' || k || ', App.M' || k || '.quick' AS text FROM q, m WHERE contains(t, 'm' || k)""")
def module_contexts(spark, d):
    from skerry.operators import extract

    from .base import files

    nodes, edges = extract.code_graph(files(spark, d).where("path like 'lib/%'"))
    k = F.col("p_partkey")
    asked = table(spark, d, "part").where("p_partkey % 8 = 2").select(k.alias("query_id"), F.concat(F.lit("what is m"), k.cast("string"), F.lit(" for")).alias("query"))
    return search.module_contexts(asked.select("query_id", F.lit("").alias("content")), asked, nodes, edges)


@query("""WITH c AS (SELECT * FROM (VALUES ('common', 1), ('verbs', 2), ('names', 3)) t(id, n)), q AS (SELECT item_id AS query_id, length(text) AS l FROM benchmark),
s AS (SELECT query_id, id, 0.5 * ((l + n) % 10) / 10 AS s FROM q, c) SELECT query_id, id, round(s, 6)::DOUBLE AS score FROM s WHERE s > 0""")
def semantic_halves(spark, d):
    """Hybrid routing where no collection has a matching keyword: half of the semantic score."""
    rows = spark.createDataFrame([("common", 1), ("verbs", 2), ("names", 3)], "id string, n int")
    semantic = table(spark, d, "benchmark").crossJoin(F.broadcast(rows)).select(F.col("item_id").alias("query_id"), "id", (((F.length("text") + F.col("n")) % 10) / 10.0).alias("score"))
    keyword = semantic.select("query_id", "id", F.lit(0.0).alias("score"))
    return search.hybrid(keyword, semantic, 3).where("score > 0").select("query_id", "id", F.round("score", 6).alias("score"))


@query(_TOP.format(k=10) + """, j AS (SELECT query_id, rank, contains(d.text, b.text)::INT AS rel FROM ranked JOIN documents d ON doc_id = id JOIN benchmark b ON item_id = query_id),
m AS (SELECT query_id, coalesce(sum(rel) FILTER (WHERE rank <= 5), 0) AS hits, count(*) AS n, sum(rel) AS relevant FROM j GROUP BY 1), e AS (SELECT query_id, CASE WHEN relevant > 0 THEN hits / relevant ELSE 0 END AS r, hits / least(5, n) AS p FROM m)
SELECT query_id, round(r, 6) AS recall, round(p, 6) AS precision, round(CASE WHEN r + p > 0 THEN 2 * r * p / (r + p) ELSE 0 END, 6) AS f1 FROM e""")
def query_benchmark_whole(spark, d):
    """As query_benchmark, with the whole benchmark texts as queries; a hit is right if it holds the text."""
    from skerry.operators import questions

    out = questions.query_benchmark(table(spark, d, "documents"), _asked(spark, d), id_col="doc_id", text_col="text", index=_index(spark, d))
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1")])


_SYMBOLS = "FROM (SELECT DISTINCT w AS item_id, 'usage of ' || w || ' OR reference to ' || w || ' OR calls to ' || w AS text FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE length(w) >= 2)"


@query(_TOP.format(k=10).replace("FROM benchmark", _SYMBOLS) + " SELECT query_id AS symbol, id, score, rank::INT AS rank FROM ranked")
def symbol_hits(spark, d):
    """Documents found for usages of every word of the benchmark."""
    words = table(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("symbol")).where("length(symbol) >= 2").distinct()
    return search.usage_hits(None, words, digits=6, index=_index(spark, d)).withColumnRenamed("query_id", "symbol")


_MODULES_SQL = (
    _TOP.format(k=5)
    .replace("FROM documents", "FROM (SELECT k AS doc_id, content AS text FROM files WHERE k % 4 = 2)")
    .replace("FROM benchmark", "FROM (SELECT p_partkey AS item_id, 'needs tool' || p_size || ' and helper' || (p_partkey + 4) AS text FROM part WHERE p_partkey % 8 = 2)")
    .replace("WITH post", "WITH " + FILES_SQL + ", post", 1)
)


@query(_MODULES_SQL + """ SELECT query_id, 'App.M' || id AS module, 'Module App.M' || id || ':' || chr(10) || '  - Imports: App.Repo, Enum, Tool' || s || chr(10) || '  - Functions: App.M' || id || '.bare, App.M' || id || '.get, App.M' || id || '.helper' || id || ', App.M' || id || '.quick' AS text FROM ranked JOIN p ON k = id""")
def search_module_contexts(spark, d):
    """Modules that the hits of a search over the source files define; no question names one."""
    from skerry.operators import extract

    from .base import files

    sources = files(spark, d).where("path like 'lib/%'")
    nodes, edges = extract.code_graph(sources)
    k = F.col("p_partkey")
    asked = table(spark, d, "part").where("p_partkey % 8 = 2").select(k.alias("query_id"), F.concat(F.lit("needs tool"), F.col("p_size").cast("string"), F.lit(" and helper"), (k + 4).cast("string")).alias("query"))
    keyed = sources.withColumn("id", F.regexp_extract("path", r"m(\d+)\.ex$", 1).cast("long"))
    hits = search.search(keyed, asked, 5, digits=6).hint("merge").join(keyed.select("id", "content").hint("merge"), "id")
    return search.module_contexts(hits.select("query_id", "content"), asked, nodes, edges)


_COLLECTIONS = [("common", "Common words", ["the", "and", "of"], "frequent function words", 0), ("verbs", "Verbs", ["ing", "ed"], "doing and done", 1), ("names", "Names", ["tion", "ly"], "nouns", 2)]


@query("""WITH c AS (SELECT *, list_concat(patterns, [lower(id), lower(name)]) AS ps, string_split(lower(about), ' ') AS ab FROM (VALUES """ + ", ".join(f"('{i}', '{n}', {p}, '{a}', {x})" for i, n, p, a, x in _COLLECTIONS) + """) t(id, name, patterns, about, label)),
w AS (SELECT doc_id AS query_id, unnest(list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '')) AS w FROM documents),
kw AS (SELECT query_id, id, least(1.0, (count(*) FILTER (WHERE len(list_filter(ps, lambda x: contains(w, x) OR contains(x, w))) > 0) + 0.5 * count(*) FILTER (WHERE len(list_filter(ab, lambda x: contains(w, x) OR contains(x, w))) > 0)) * 2 / any_value(len(ps)))::DOUBLE AS score FROM w, c GROUP BY ALL),
e AS (SELECT label, unnest(embedding::DOUBLE[]) AS e, unnest(range(len(embedding))) AS i FROM embeddings),
mid AS (SELECT id, list(a ORDER BY i) AS m FROM (SELECT id, i, avg(e) AS a FROM e JOIN c USING (label) GROUP BY ALL) GROUP BY id),
sem AS (SELECT vec_id AS query_id, id, round(list_cosine_similarity(embedding::DOUBLE[], m), 4) AS score FROM embeddings, mid),
both_ AS (SELECT coalesce(kw.query_id, sem.query_id) AS query_id, coalesce(kw.id, sem.id) AS id, 0.5 * coalesce(kw.score, 0) + 0.5 * coalesce(sem.score, 0) AS score FROM (FROM kw WHERE score > 0) kw FULL JOIN sem ON kw.query_id = sem.query_id AND kw.id = sem.id)
SELECT query_id, id, round(score, 6) AS score FROM both_""")
def hybrid_routes(spark, d):
    """Each document routed to collections: half by its words, half by its vector's cosine to the mean vector of the collection's label."""
    rows = spark.createDataFrame(_COLLECTIONS, "id string, name string, patterns array<string>, description string, label long")
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    means = search.mean_vectors(vectors.join(F.broadcast(rows.select("id", "label")), "label"), "id", "v")
    semantic = search.vector_scores(vectors, means, "vec_id", "v", digits=4)
    keyword = search.route_scores(table(spark, d, "documents"), rows, "doc_id", "text")
    return search.hybrid(keyword, semantic, 3).select("query_id", "id", F.round("score", 6).alias("score"))

"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, jaccard, katz, langid, licences, lines, mixing, negatives, phrases, sharding, toxicity, vectors
from .common import read, text_crc


def op1_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Katz bigram scores of all documents, learned from those outside the held-out fifth."""
    docs = read(spark, sf_dir, "documents")
    out = katz.katz_scores(docs, text_crc("doc_id") % 5 != 1).scores
    return out.select("doc_id", (text_crc("doc_id") % 5 == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by the hash of doc_id, with the shard each would have among 17."""
    return sharding.shard_slots(read(spark, sf_dir, "documents"), 16)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those outside the held-out quarter."""
    docs = read(spark, sf_dir, "documents")
    held = text_crc("doc_id") % 4 == 2
    model = langid.fit(docs, ~held)
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from the labels outside the held-out fifth."""
    docs = read(spark, sf_dir, "documents")
    held = text_crc("doc_id") % 5 == 0
    model = toxicity.fit(docs, read(spark, sf_dir, "labels").where(~held))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all vectors of a label at a cosine of 0.98 or more."""
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"), 0.98)


def op9_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of 4-word shingles have a Jaccard similarity of 0.85 or more."""
    return jaccard.jaccard_groups(read(spark, sf_dir, "documents"), width=4, percent=85)


def source_tree() -> dict:
    """Domains are families of sources: the number in the source's name modulo 4."""
    number = F.regexp_extract(F.col("source"), "([0-9]+)$", 1)
    return {"domain": F.when(number != "", F.concat(F.lit("domain"), (number.cast("long") % 4).cast("string"))), "lang": F.col("lang"), "source": F.col("source")}


#: Target weights of the query: by domain, by language in each domain, by the number in a source's name modulo 5.
DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS = {"domain0": 14, "domain1": 3, "domain2": 2}, {"de": 12, "es": 3, "fr": 2}, {"0": 20, "1": 2, "2": 3, "3": 4, "4": 5}


def target_weights(leaves: DataFrame) -> dict[str, DataFrame]:
    """Weights that some leaves, languages and a whole domain cannot fill; and a language in each domain and a domain that
    no document has. Whatever is not named weighs 1."""

    def weight(name, table: dict) -> Column:
        pairs = [F.lit(x) for pair in table.items() for x in pair]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), name), F.lit(1)).cast("double").alias("weight")

    number = F.regexp_extract("source", "([0-9]+)$", 1)
    rest = (F.when(number != "", number).cast("long") % 5).cast("string")
    domains, langs = leaves.select("domain").distinct(), leaves.select("domain", "lang").distinct()
    absent = leaves.sparkSession.createDataFrame([("domain9", 5.0)], "domain string, weight double")
    return {
        "domain": domains.select("domain", weight(F.col("domain"), DOMAIN_WEIGHTS)).unionByName(absent),
        "lang": langs.select("domain", "lang", weight(F.col("lang"), LANG_WEIGHTS)).unionByName(domains.select("domain", F.lit("zz-absent").alias("lang"), F.lit(4.0).alias("weight"))),
        "source": leaves.select("domain", "lang", "source", weight(F.coalesce(rest, F.lit("")), SOURCE_WEIGHTS)),
    }


def op2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 1.5 times their tokens by target weights; what a node cannot give goes to its siblings, then further up."""
    out = mixing.mix(read(spark, sf_dir, "documents"), source_tree(), weights=target_weights)
    return out.select("doc_id", "_mix.domain", "_mix.lang", "_mix.source", "_mix.tokens", "_mix.epoch", "_mix.order", "_mix.leaf_budget")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate lines of all documents: per document how many lines it has, how many go, and the checksum of the rest."""
    out = lines.without_duplicate_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", text_crc(F.col("text")).alias("text_crc32"))


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents as files source/lang/doc_id."""
    return licences.scan(read(spark, sf_dir, "documents"), F.concat_ws("/", "source", "lang", "doc_id"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents."""
    out = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts encoded by the 50k byte-level vocabulary and decoded again, by their digests."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ids = bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN).select("doc_id", "ids")
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return bpe.decode(ids, ranks).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of two or three words of each language of all documents."""
    return phrases.collocations(read(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector among all vectors, a seventh of them with a changed label."""
    rows = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0, label)


QUERIES = {
    "op1_katz_scores": op1_katz_scores,
    "op2_mixture": op2_mixture,
    "op3_jump_shards": op3_jump_shards,
    "op4_language_id": op4_language_id,
    "op5_line_dedup": op5_line_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_near_vectors": op7_near_vectors,
    "op8_licence_scan": op8_licence_scan,
    "op9_jaccard_groups": op9_jaccard_groups,
    "op10_decontaminate": op10_decontaminate,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_phrases": op12_phrases,
    "op13_hard_negatives": op13_hard_negatives,
}

def _weights(name: str, table: dict) -> str:
    return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE 1 END"


_FILL = """
{name}_n AS (SELECT {path}, {budget} AS budget, sum(cap) AS cap, ({w})::DOUBLE AS w FROM {source} GROUP BY ALL),
{name}_l AS (SELECT *, cap / w AS lv, coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap / w, {path} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
  sum(w) OVER (PARTITION BY {parent} ORDER BY cap / w, {path} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {name}_n),
{name}_p AS (SELECT *, greatest(budget - used, 0) / rest AS pour FROM {name}_l),
{name}_m AS (SELECT *, arg_min(CASE WHEN pour < lv THEN pour END, CASE WHEN pour < lv THEN lv END) OVER (PARTITION BY {parent}) AS p FROM {name}_p),
{name} AS (SELECT {path}, CASE WHEN p IS NULL THEN cap ELSE least(cap, w * p) END AS share FROM {name}_m)"""

_KEY = "(('0x' || substr(md5('7|' || {epoch} || '|' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT >> 3)"

MIXTURE_SQL = (
    """WITH docs AS (SELECT doc_id, coalesce('domain' || nullif(regexp_extract(source, '([0-9]+)$', 1), '')::BIGINT % 4, 'null') AS domain, coalesce(lang, 'null') AS lang,
  coalesce(source, 'null') AS source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))::BIGINT AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, 4.0::DOUBLE * sum(tokens) AS cap FROM docs GROUP BY ALL HAVING sum(tokens) > 0),
root AS (SELECT 1.5::DOUBLE * sum(tokens) AS total FROM docs),"""
    + _FILL.format(name="a", path="domain", budget="(SELECT total FROM root)", source="leaves", parent="1", w=_weights("domain", DOMAIN_WEIGHTS))
    + ","
    + _FILL.format(name="b", path="domain, lang", budget="any_value(share)", source="leaves JOIN a USING (domain)", parent="domain", w=_weights("lang", LANG_WEIGHTS))
    + ","
    + _FILL.format(name="c", path="domain, lang, source", budget="any_value(share)", source="leaves JOIN b USING (domain, lang)", parent="domain, lang", w=_weights("(nullif(regexp_extract(source, '([0-9]+)$', 1), '')::BIGINT % 5)::VARCHAR", SOURCE_WEIGHTS))
    + """,
plan AS (SELECT domain, lang, source, floor(share + 1e-6)::BIGINT AS leaf_budget, leaf_budget // tokens AS whole, leaf_budget % tokens AS rest FROM leaves JOIN c USING (domain, lang, source)),
placed AS (SELECT docs.*, leaf_budget, whole, rest, """
    + _KEY.format(epoch="whole")
    + """ AS key FROM docs JOIN plan USING (domain, lang, source)),
cut AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM placed),
taken AS (SELECT *, whole + (rest > 0 AND used < rest)::INT AS epochs FROM cut),
spread AS (SELECT *, unnest(range(0, epochs)) AS e FROM taken)
SELECT doc_id, domain, lang, source, tokens, e::INT AS epoch, """
    + _KEY.format(epoch="e")
    + """ AS "order", leaf_budget FROM spread"""
)

DECONTAMINATE_SQL = r"""WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM items WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, w[s:least(s + 9, len(w))] AS win FROM starts),
sizes AS (SELECT DISTINCT len(win) AS n FROM wins),
cells AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM low, sizes WHERE len(w) >= n),
met AS (SELECT doc_id, s, n, item_id FROM (SELECT doc_id, s, n, w[s:s + n - 1] AS win FROM cells) JOIN wins USING (win)),
places AS (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM met),
hits AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY ALL),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS all_items FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY ALL)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(all_items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN hits USING (doc_id) LEFT JOIN names USING (doc_id)"""

NEAR_VECTORS_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT vec_id, (SELECT count(*) FROM links WHERE x = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN least ON x = vec_id"""

PHRASES_SQL = r"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, w[i:i + k - 1] AS words FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS sizes(k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, k, words, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY ALL),
halves AS MATERIALIZED (SELECT lang, k, words, f, cut, words[1:cut] AS x, words[cut + 1:k] AS y FROM (SELECT *, unnest(range(1, k)) AS cut FROM f)),
cuts AS (SELECT h.lang, h.words, h.f AS a, cut, p.f AS l, s.f AS r, (1000000::HUGEINT * h.f * h.f // (p.f::HUGEINT * s.f))::BIGINT AS score
  FROM halves h JOIN f p ON p.lang = h.lang AND p.words = h.x JOIN f s ON s.lang = h.lang AND s.words = h.y),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, cut) = 1),
inner_ AS (SELECT lang, part, max(f) AS most FROM (SELECT lang, f, words[1:2] AS part FROM f WHERE k = 3 UNION ALL SELECT lang, f, words[2:3] FROM f WHERE k = 3) GROUP BY ALL),
kept AS (SELECT low.lang, array_to_string(words, ' ') AS phrase, a, l, r, score FROM low LEFT JOIN inner_ ON inner_.lang = low.lang AND inner_.part = low.words WHERE most IS NULL OR 100 * most < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""

HARD_NEGATIVES_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY anchor_id, p.id ORDER BY n.score DESC, n.id)::INT AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n USING (anchor_id) WHERE NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score QUALIFY rank <= 5"""

ORACLES: dict[str, str] = {"op13_hard_negatives": HARD_NEGATIVES_SQL, "op12_phrases": PHRASES_SQL, "op2_mixture": MIXTURE_SQL, "op7_near_vectors": NEAR_VECTORS_SQL, "op10_decontaminate": DECONTAMINATE_SQL}

"""Benchmark decontamination: a prefix-filtered containment join in DataFrame functions only.

A window of an item is contained in a document only if all its words are, so one word is its necessary prefix: the one
that is rarest in the documents ("anchor"). Occurrences of anchors are joined to windows; the offset of the anchor
bounds where the window can lie, and the words there are compared. Windows with a word that no document has are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_small, small_side, stored, unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a maximal run of other bytes than these (digits, a-z and all beyond ASCII remain).
SEPARATORS, WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows that are broadcast at a time; more are handled in blocks of this size, each against all documents.
BLOCK = 200_000


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def words_of(text: Column) -> Column:
    return F.filter(F.split(lowered(text), SEPARATORS), lambda w: w != "")


def windows_of(items: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """(item, w): the windows of each item, each once; an item shorter than the window is one; one without words has none."""
    words = items.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(window - 1), F.lit(1)))
    return words.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s"), F.least(F.size("w"), F.lit(window))).alias("w")).distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs' id and text hash (`row`) for each row, with n_words, n_hit (words inside an occurrence of a window), n_items,
    items (sorted ids) and contaminated (n_hit > 0).

    A null text has no words. A null item id hits, but is not listed. Repeated rows get the same result each. No items,
    or no documents, give no hits or no rows. Only the named columns are read, so others may clash.
    """
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    listed = stored(windows_of(items, window, item_col, item_text), "items")
    vocabulary = stored(listed.select(F.explode("w").alias("word")).distinct(), "vocabulary")
    spoken = base.select(F.explode(words_of(F.col("text"))).alias("word"))
    if is_small(vocabulary):
        counts = spoken.join(F.broadcast(vocabulary), "word", "left_semi").groupBy("word").count()
    else:
        counts = spoken.groupBy("word").count().join(vocabulary, "word", "left_semi")
    counts = stored(counts, "counts")
    w = stored(listed.select("w").distinct().withColumn("win", F.xxhash64("w")), "windows")
    by_word = w.select("win", "w", F.posexplode("w").alias("at", "word")).join(counts, "word", "left")
    rarest = by_word.groupBy("win").agg(F.min_by(F.struct("word", "at"), F.struct(F.coalesce("count", F.lit(0)), "word", "at")).alias("a"), F.min(F.coalesce("count", F.lit(0))).alias("least"), F.first("w").alias("w"))
    anchors = rarest.where("least > 0").select(F.col("a.word").alias("word"), F.col("a.at").alias("at"), "win", "w", F.pmod("win", F.lit(1 << 20)).alias("part"))
    anchors = stored(anchors, "anchors")
    blocks = -(-anchors.count() // BLOCK)
    spans = None
    for b in range(blocks):
        some = anchors.where(F.pmod("part", F.lit(blocks)) == b).select("word", "at", "win", "w")
        at = base.select("row", words_of(F.col("text")).alias("words")).select("row", "words", F.posexplode("words").alias("pos", "word"))
        met = at.join(small_side(some), "word").where((F.col("pos") >= F.col("at")) & (F.col("pos") - F.col("at") + F.size("w") <= F.size("words")))
        met = met.where(F.slice("words", F.col("pos") - F.col("at") + 1, F.size("w")) == F.col("w"))
        met = met.select("row", "win", (F.col("pos") - F.col("at")).alias("start"), (F.col("pos") - F.col("at") + F.size("w")).alias("end"))
        spans = met if spans is None else spans.union(met)
    every = base.select("id", "row", F.regexp_count(lowered(F.col("text")), F.lit(WORD)).cast("long").alias("n_words"))
    every = every.withColumnRenamed("id", id_col)
    if spans is None:
        return every.select(id_col, "row", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.array().cast("array<string>").alias("items"), F.lit(False).alias("contaminated"))
    spans = stored(spans.distinct(), "spans")
    union = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "end"))),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("last")),
        lambda acc, x: F.struct((acc.n + F.greatest(x.end - F.greatest(x.start, acc.last), F.lit(0))).alias("n"), F.greatest(acc.last, x.end).alias("last")),
    )
    hits = spans.groupBy("row").agg(union["n"].cast("long").alias("n_hit"))
    named = spans.select("row", "win").distinct().join(listed.select(F.xxhash64("w").alias("win"), "item"), "win")
    items_of = named.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = stored(hits.join(items_of, "row", "left"), "hits")
    found = small_side(found)
    items_or = F.coalesce("items", F.array().cast("array<string>"))
    return every.join(found, "row", "left").select(id_col, "row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_or).cast("long").alias("n_items"), items_or.alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows that hold a window of an item; all columns are kept."""
    bad = stored(contamination(docs, items, window, id_col, text_col, item_col, item_text).where("contaminated").select("row").distinct(), "contaminated")
    (mark,) = unused(docs.columns, "contaminated")
    key = F.xxhash64(docs[id_col], docs[text_col])
    return docs.join(small_side(bad.withColumnRenamed("row", mark)), key == F.col(mark), "left_anti")

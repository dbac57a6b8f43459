"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, mixing and sharding, in this order.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written and read again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm import common, decontaminate, jaccard, mixing, sharding, toxicity
from skerry.llm.queries import source_tree

#: None: a trained classifier, hashed shards and groups are beyond SQL; tests/llm/test_pipeline.py has a brute-force twin.
ORACLE_SQL = None
SHARDS = 16


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that a classifier of all labelled ones finds toxic."""
    model = toxicity.fit(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, out=("_score", "_toxic")).where("_toxic = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with a Jaccard similarity of 0.8 or more on 5-word shingles, one row of each group stays: that with the least doc_id (null last).

    Ties: the least hash of doc_id and text; of rows equal in both, the least other columns. Texts without a word all stay.
    """
    groups = common.stored(jaccard.jaccard_groups(docs, width=5, percent=80, with_rows=True).where("part is not null"), "groups")
    best = groups.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("b")).select(F.col("b.row").alias("_row"))
    best = common.stored(best, "best")
    rows = groups.groupBy(F.col("row").alias("_row")).count()
    gone = common.stored(rows.join(common.small_side(best), "_row", "left_anti").select("_row"), "gone")
    repeated = common.stored(rows.where("count > 1").join(common.small_side(best), "_row", "left_semi").select("_row"), "repeated")
    kept = docs.withColumn("_row", jaccard.row_hash()).join(common.small_side(gone), "_row", "left_anti")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*others)) if others else F.lit("")
    one = kept.join(common.small_side(repeated), "_row", "left_semi").groupBy("_row").agg(F.min_by(F.struct(*docs.columns), order).alias("d")).select("d.*")
    return kept.join(common.small_side(repeated), "_row", "left_anti").select(*docs.columns).unionByName(one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold ten words in a row of a benchmark item."""
    return decontaminate.clean(docs, common.read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixed to 1.5 times the tokens with flattened weights: rows of favoured leaves are repeated in further epochs."""
    return mixing.mix(docs, source_tree()).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With the shard (0 to 15) of each document."""
    return sharding.assign_shards(docs, SHARDS)


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("decontamination", drop_contaminated), ("mixing", mix_sources), ("sharding", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)

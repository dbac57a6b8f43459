"""Mixing sources to target weights: hierarchical budgets over a tree of domains, languages and sources.

The budget of tokens flows down the tree by weight. A child takes at most what its leaves can give (their tokens times
the allowed epochs); what it cannot take goes to its siblings by weight (water-filling), and only what all of them
cannot take was never given to their parent, so that the parent's siblings have it. A leaf then reads its documents in
seeded order, epoch after epoch, up to its budget: whole epochs, then a prefix of the next one. The cut inside an epoch
is found by three levels of sums over ranges of the order, so a leaf's documents are never gathered in one task.
DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import is_small, stored, unused

TREE = ("domain", "lang", "source")
#: The order key has 45 bits; sums are kept for 2**12 ranges, then 2**12 ranges of the one with the cut, then rows.
BITS, RANGE = 45, 12


def token_count(text: Column) -> Column:
    """Words between white space; a null text has none."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")


def order_key(seed: int, epoch: Column, id_: Column) -> Column:
    """The place of a document in an epoch: 45 bits of an md5, the same in any engine."""
    text = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_.cast("string"), F.lit("null")))
    return F.shiftright(F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long"), 3)


def fill(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Water-fill siblings. nodes: parent columns, budget (of the parent), weight, capacity. Adds share (doubles).

    Siblings in order of capacity per weight are full up to some place; the others share what is left by weight.
    """
    by = Window.partitionBy(*parent).orderBy("_level", *[c for c in TREE if c in nodes.columns])
    upto = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = nodes.withColumn("_level", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf"))))
    rows = rows.withColumns({"_used": F.coalesce(F.sum("capacity").over(upto), F.lit(0.0)), "_rest": F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))})
    rows = rows.withColumn("_pour", F.when(F.col("_rest") > 0, F.greatest(F.col("budget") - F.col("_used"), F.lit(0.0)) / F.col("_rest")))
    first = F.min(F.when(F.col("_pour") < F.col("_level"), F.struct("_level", *[c for c in TREE if c in nodes.columns], "_pour"))).over(Window.partitionBy(*parent))
    rows = rows.withColumn("_pour", first["_pour"])
    share = F.when(F.col("weight") <= 0, 0.0).when(F.col("_pour").isNull(), F.col("capacity")).otherwise(F.least(F.col("capacity"), F.col("weight") * F.col("_pour")))
    return rows.withColumn("share", share).drop("_level", "_used", "_rest", "_pour")


def leaf_budgets(leaves: DataFrame, weights: dict[str, DataFrame], budget: float, max_epochs: int) -> DataFrame:
    """leaves: the tree columns and tokens. weights: for each level, its path columns and weight (absent: 0).

    Returns the leaves with budget, a whole number of tokens of at most tokens * max_epochs. A leaf of which any node on the path
    has no weight over 0 gives nothing and counts in no node's capacity, so that its share goes to others.
    """
    weighed = leaves.withColumn("_ok", F.lit(True))
    for depth, level in enumerate(TREE, 1):
        path = list(TREE[:depth])
        own = weights[level].where(F.col("weight").cast("double") > 0).select(*path).distinct().withColumn("_has", F.lit(True))
        weighed = weighed.join(own, path, "left").withColumn("_ok", F.col("_ok") & F.col("_has").isNotNull()).drop("_has")
    leaves = weighed.withColumn("capacity", F.when(F.col("_ok"), F.col("tokens") * F.lit(max_epochs)).otherwise(0).cast("double")).drop("_ok")
    above = None
    for depth, level in enumerate(TREE, 1):
        path = list(TREE[:depth])
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.join(weights[level], path, "left").withColumn("weight", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)))
        parent = path[:-1] or ["_root"]
        nodes = nodes.withColumns({"_root": F.lit(0), "budget": F.lit(float(budget))}) if above is None else nodes.join(above, parent)
        above = fill(nodes, parent).select(*path, F.col("share").alias("budget"))
    return leaves.join(above, list(TREE)).withColumn("budget", F.floor(F.col("budget") + F.lit(1e-6)).cast("long")).drop("capacity")


def flattened_weights(leaves: DataFrame, power: float) -> dict[str, DataFrame]:
    """Weights of all levels: each node's tokens to a power (1: as they are, 0: all alike)."""
    return {level: leaves.groupBy(*TREE[:d]).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("weight")) for d, level in enumerate(TREE, 1)}


def mix(docs: DataFrame, tree: dict[str, Column], budget_ratio: float = 1.5, power: float = 0.8, max_epochs: int = 4, seed: int = 7, weights: dict[str, DataFrame] | Callable[[DataFrame], dict[str, DataFrame]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, each row once for every epoch that takes it, with columns of the struct `_mix`: tree columns, tokens, epoch,
    order, leaf_budget. budget: budget_ratio times all tokens. weights: those of leaf_budgets, or a function that makes them of the
    leaves (tree columns, tokens); without them each node weighs its tokens to a power.

    tree gives a column for domain, lang and source; nulls are the name "null". A document is taken in an epoch if the
    tokens of those before it fall short of what the leaf has left; documents of equal id share a place and are taken
    together, so repeated rows stay together. Documents without tokens are taken whenever their place comes before the
    cut. A leaf without tokens or without weight gives nothing. An empty table gives an empty result. A column `_mix` is
    replaced; all other columns are kept, whatever their names.
    """
    names = {k: F.coalesce(v.cast("string"), F.lit("null")) for k, v in tree.items()}
    narrow = stored(docs.select(F.col(id_col).alias("_id"), token_count(F.col(text_col)).alias("n"), *[v.alias(k) for k, v in names.items()]), "mix")
    leaves = stored(narrow.groupBy(*TREE).agg(F.sum("n").alias("tokens")), "leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    if not weights:
        weights = flattened_weights(leaves.where("tokens > 0"), power)
    plan = leaf_budgets(leaves, weights(leaves) if callable(weights) else weights, budget_ratio * total, max_epochs)
    plan = plan.withColumns({"whole": F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0), "left": F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0)})
    plan = stored(plan, "plan")
    few = F.broadcast if is_small(plan) else (lambda df: df)
    last = narrow.join(few(plan.select(*TREE, "whole", "left")), list(TREE)).where("left > 0")
    last = last.select(*TREE, "left", order_key(seed, F.col("whole"), F.col("_id")).alias("key"), "n")
    before = Window.partitionBy(*TREE).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    cut = None
    for level in (1, 2):
        shift = BITS - level * RANGE
        sums = last.groupBy(*TREE, "left", F.shiftright("key", shift).alias("at")).agg(F.sum("n").alias("n"))
        sums = sums.withColumn("used", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("used") < F.col("left"))
        cut = stored(sums.groupBy(*TREE).agg(F.max("at").alias("at"), F.max_by("left", "at").alias("_l"), F.max_by("used", "at").alias("_u")).select(*TREE, F.col("at").alias("_at"), (F.col("_l") - F.col("_u")).alias("_left")), "cut")
        last = last.join(few(cut), list(TREE)).where(F.shiftright("key", shift) == F.col("_at")).select(*TREE, F.col("_left").alias("left"), "key", "n")
    keys = last.groupBy(*TREE, "left", F.col("key").alias("at")).agg(F.sum("n").alias("n"))
    keys = keys.withColumn("used", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("used") < F.col("left"))
    ends = keys.groupBy(*TREE).agg(F.max("at").alias("cut"))
    plan = stored(plan.join(ends, list(TREE), "left").select(*[F.col(c).alias(f"_{c}") for c in TREE], "whole", F.coalesce("cut", F.lit(-1)).alias("cut"), "budget"), "plan")
    docs = docs.drop("_mix")
    h, e, *keys_ = unused(docs.columns, "h", "e", *TREE, "whole", "cut", "budget")
    plan = plan.toDF(*keys_)
    domain, lang, source, whole, end, budget = keys_
    here = F.struct(*[names[c].alias(c) for c in TREE], token_count(F.col(text_col)).alias("tokens"))
    rows = docs.withColumn(h, here).join(few(plan), [F.col(f"{h}.{c}") == F.col(k) for c, k in zip(TREE, (domain, lang, source), strict=True)])
    taken = F.filter(F.sequence(F.lit(0), F.col(whole).cast("int")), lambda x: (x < F.col(whole)) | (order_key(seed, x, F.col(id_col)) <= F.col(end)))
    rows = rows.withColumn(e, F.explode(taken))
    made = F.struct(*[F.col(f"{h}.{c}").alias(c) for c in (*TREE, "tokens")], F.col(e).alias("epoch"), order_key(seed, F.col(e), F.col(id_col)).alias("order"), F.col(budget).alias("leaf_budget"))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], made.alias("_mix"))

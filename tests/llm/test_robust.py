"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from skerry.llm import bpe, chargrams, common, decontaminate, jaccard, katz, langid, licences, lines, mixing, sharding, tokens, toxicity

#: Names that operators use inside, as extra columns.
CLASHES = ["id", "row", "n", "key", "text_a", "h1", "_n", "_row", "_key", "_removed", "_h", "_e", "_", "_domain", "_lang", "_source", "_epoch", "whole", "cut", "budget", "tokens", "term", "component", "part", "_id", "_text", "_contaminated", "score_", "path", "dir", "shard_"]


def table(spark, rows, kinds="doc_id long, text string, lang string, source string"):
    df = spark.createDataFrame(rows, kinds)
    return df.withColumns({c: F.lit("clash") for c in CLASHES if c not in df.columns})


def tree():
    return {"domain": F.lit("d"), "lang": F.col("lang"), "source": F.col("source")}


RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
OPERATORS = {
    "bpe": lambda s, d: bpe.encode(d, RANKS, public_tokenizers.PATTERN),
    "katz": lambda s, d: katz.katz_scores(d, F.lit(True)).scores,
    "mix": lambda s, d: mixing.mix(d, tree()),
    "shards": lambda s, d: sharding.assign_shards(d, 4),
    "slots": lambda s, d: sharding.shard_slots(d, 4),
    "language": lambda s, d: langid.predict(d, langid.fit(d, F.lit(True))),
    "lines": lambda s, d: lines.without_duplicate_lines(d),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.fit(d, d.select("doc_id", (F.col("doc_id") % 2).alias("toxic")))),
    "groups": lambda s, d: jaccard.jaccard_groups(d),
    "licences": lambda s, d: licences.scan(d, F.concat_ws("/", "source", "doc_id")),
    "contamination": lambda s, d: decontaminate.contamination(d, s.createDataFrame([("i", "one two three")], "item_id string, text string")),
    "clean": lambda s, d: decontaminate.clean(d, s.createDataFrame([("i", "one two three")], "item_id string, text string")),
}
ROWS = [(1, "one two three\nfour", "en", "s1"), (1, "one two three\nfour", "en", "s1"), (2, None, None, None), (None, "", "en", None), (None, None, None, "s2"), (3, "eins zwei drei vier", "de", "s2"), (4, "ONE two three\nfour", "en", "s1"), (5, "😀 12 !", None, "s1")]
KEEPS = {"bpe", "shards", "language", "lines", "toxicity", "clean", "mix"}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_rows(spark, name):
    docs = table(spark, ROWS)
    out = OPERATORS[name](spark, docs)
    rows = out.collect()
    if name in KEEPS:
        assert set(docs.columns) <= set(out.columns) and all(r["row"] == "clash" for r in rows)
    if name == "clean":
        assert sorted(str(r.doc_id) for r in rows) == ["2", "3", "5", "None", "None"]
    elif name != "mix":
        assert len(rows) == len(ROWS)
    empty = OPERATORS[name](spark, docs.where("false"))
    assert empty.count() == 0 and empty.columns == out.columns


@pytest.mark.parametrize("name", list(OPERATORS))
def test_a_very_long_text(spark, name, monkeypatch):
    words = "lorem ipsum dolor sit amet consetetur sadipscing elitr ".split()
    long = "\n".join(f"{words[i % 8]} {words[i // 8 % 8]} w{i % 5000} {words[i // 64 % 8]}" for i in range(40_000))
    out = OPERATORS[name](spark, table(spark, [(1, long, "en", "s1"), (2, "short one", "de", "s1"), (3, "x" * 1_000_000, "de", "s2")]))
    rows = out.collect()
    assert {r.doc_id for r in rows} == {1, 2, 3}
    if name == "lines":
        assert next(r.n_lines for r in rows if r.doc_id == 1) == 40_000


def test_long_texts_give_what_short_pieces_give(monkeypatch):
    text = "Ab cé  dd " * 50 + "end" + "z" * 70
    want_words, want = tokens.words([text.encode()])[0], [f for _, _, f, _ in chargrams.grams([text], (1, 3))][0]
    monkeypatch.setattr(tokens, "CHUNK", 37)
    monkeypatch.setattr(chargrams, "CHUNK", 37)
    assert (tokens.words([text.encode()])[0] == want_words).all()
    pieces = [f for _, _, f, _ in chargrams.grams([text], (1, 3))]
    assert len(pieces) > 5
    for order in (0, 1):
        assert sorted(h for f in pieces for h in f[order][0].tolist()) == sorted(want[order][0].tolist())
    alone = sorted(list(chargrams.grams(["b c"], (2,)))[0][2][0][0].tolist())
    monkeypatch.setattr(chargrams, "CHUNK", 1000)
    _, _, found, _ = next(iter(chargrams.grams(["x", "b c", "y", "b c"], (2,))))
    for at in (1, 3):
        assert sorted(found[0][0][found[0][1] == at].tolist()) == alone


def test_equal_lines_are_cut_in_linear_time(spark):
    docs = spark.createDataFrame([(1, "same line\n" * 100_000)], "doc_id long, text string")
    assert lines.without_duplicate_lines(docs).first().n_removed == 99_999


def test_shares_without_weight_go_to_others(spark):
    leaves = spark.createDataFrame([("a", "en", "s1", 100), ("a", "en", "s2", 100), ("b", "en", "s3", 100)], "domain string, lang string, source string, tokens long")
    weights = {
        "domain": spark.createDataFrame([("a", 1.0), ("b", 1.0)], "domain string, weight double"),
        "lang": spark.createDataFrame([("a", "en", 1.0), ("b", "en", 1.0)], "domain string, lang string, weight double"),
        "source": spark.createDataFrame([("a", "en", "s2", 1.0), ("b", "en", "s3", 1.0), ("a", "en", "s1", 0.0)], "domain string, lang string, source string, weight double"),
    }
    got = {r.source: r.budget for r in mixing.leaf_budgets(leaves, weights, 200, 1).collect()}
    assert got == {"s1": 0, "s2": 100, "s3": 100}


def test_broadcasts_are_bounded_by_bytes(spark):
    wide = spark.createDataFrame([("x" * 1000,)] * 10, "t string")
    assert common.is_small(wide, 20_000) and not common.is_small(wide, 5_000)
    assert common.unused(["_A", "__b"], "a", "b") == ["___a", "___b"]

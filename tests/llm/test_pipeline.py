import random

import corpus_pipeline


def write(spark, path):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    item = " ".join(f"q{i}" for i in range(14))
    docs, labels = [], []
    for i in range(80):
        text = rnd.choices(words, k=40)
        if i % 4 == 0:
            text[5:8] = ["you", "worthless", "idiot"]
        docs.append((i, " ".join(text), rnd.choice(["en", "fr"]), f"src{i % 5}", 0))
        labels.append((i, 1, int(i % 4 == 0)))
    docs += [(100, docs[1][1], "en", "src0", 0), (101, docs[2][1].upper(), "en", "src1", 0), (102, docs[3][1] + " more", None, None, 0)]
    docs += [(103, "before it " + item + " after it", "en", "src2", 0), (104, None, "en", "src3", 0), (105, "", "en", "src3", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_stages_and_run(spark, tmp_path):
    write(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    toxic, copies, bad = {i for i in range(80) if i % 4 == 0}, {100, 101, 102}, {103}
    kept = {i for i in [*range(80), *range(100, 106)]}
    for (_, stage), gone in zip(corpus_pipeline.STAGES[:3], (toxic, copies, bad), strict=True):
        docs = stage(spark, docs, str(tmp_path))
        kept -= gone
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted(kept)
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in final} <= kept and all(0 <= r["shard"] < corpus_pipeline.SHARDS for r in final)
    assert len(final) > len(kept) * 0.9


def test_copies_with_null_repeated_and_shared_ids(spark, tmp_path):
    text = lambda name: " ".join(f"{name}{i}" for i in range(30))
    rows = [
        (1, text("a"), "en", "y"), (1, text("a"), "en", "x"), (1, text("a"), None, "z"),
        (None, text("b"), "en", "x"), (None, text("b") + " more", "en", "x"), (None, text("b"), "fr", "x"),
        (7, text("c"), "en", "x"), (9, text("c"), "en", "x"), (9, text("d"), "en", "x"),
        (None, text("e"), "en", "x"), (4, text("e") + " more", "en", "x"),
        (5, None, "en", "x"), (5, None, "en", "x"), (None, "", "en", "x"), (6, text("f"), "en", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    kept = sorted(((r.doc_id, (r.text or "")[:2], r.source) for r in got.collect()), key=str)
    assert [k for k in kept if k[1] != "b0"] == sorted([(1, "a0", "x"), (7, "c0", "x"), (9, "d0", "x"), (4, "e0", "x"), (5, "", "x"), (5, "", "x"), (None, "", "x"), (6, "f0", "x")], key=str)
    assert [k for k in kept if k[1] == "b0"] == [(None, "b0", "x")]

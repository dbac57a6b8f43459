import hashlib
import time

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from skerry.llm import bpe, queries

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = [
    None, "", " ", "a", "it's we'll I'D", "  two  spaces \n\n tail  ", "x y z", "naïve façade 你好世界 สวัสดี", "12345 3.14 ½ ٣", "<|endoftext|> tok", "😀👩‍👩‍👧 ok", "a\x00b\x1cc\x85d",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab", "\r\n\t mixed\r\n", "Thstinnt thndhain. Onhalyti", "z" * 5000 + " " + "ab" * 3000 + "-" * 700 + "\n" * 300, "same text", "same text",
]


@pytest.mark.parametrize("word_bytes", [bpe.WORD_BYTES, 0])
def test_ids_equal_the_librarys(spark, word_bytes):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    rows = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN, word_bytes=word_bytes), RANKS, out="back").collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert r.ids == LIBRARY.encode_ordinary(TEXTS[r.doc_id] or ""), TEXTS[r.doc_id]
        assert bytes(r.back).decode() == (TEXTS[r.doc_id] or "")


def test_every_code_point_is_split_as_the_library_does(spark):
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}#{chr(c)}" for c in points[i : i + 16384]) for i in range(0, len(points), 16384)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    java = bpe.java_pattern(spark, public_tokenizers.PATTERN)
    split = dict(docs.select("doc_id", bpe.pieces(F.col("text"), java)).collect())
    for i, text in enumerate(texts):
        raw, at = text.encode(), 0
        bounds = set()
        for piece in split[i]:
            at += len(piece.encode())
            bounds.add(at)
        assert at == len(raw)
        # a vocabulary of bytes and these pieces: each piece is one token only if the library splits there too
        words = {bytes([b]): b for b in range(256)}
        for piece in split[i]:
            words.setdefault(piece.encode(), len(words))
        own = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=words, special_tokens={})
        assert own.encode_ordinary(text) == [words[piece.encode()] for piece in split[i]]


def test_heap_equals_library():
    for word in (b"", b"a", "überstrapazierfähig".encode(), b"lorem" * 200, b"abab" * 99, bytes(range(97, 123)) * 9):
        if word:
            assert bpe.heap_merge(word, RANKS) == LIBRARY._encode_single_piece(word)


def test_unusual_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, ids string")
    assert bpe.encode(empty, RANKS, public_tokenizers.PATTERN).collect() == []
    clash = spark.createDataFrame([(1, "one two", "x", "y", None)], "doc_id long, body string, pieces string, long string, _pieces string")
    (row,) = bpe.encode(clash, RANKS, public_tokenizers.PATTERN, text_col="body").collect()
    assert row.ids == LIBRARY.encode_ordinary("one two") and (row.pieces, row.long, row._pieces) == ("x", "y", None)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = queries.op11_byte_bpe(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        ids = LIBRARY.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_a_merge_looks_up_few_ranks(spark):
    table = bpe.rank_map(spark, RANKS)

    def seconds(size):
        words = spark.createDataFrame([("".join(chr(97 + (i * i * 7 + j * 13 + i * j) % 26) for i in range(size)),) for j in range(600)], "piece string").coalesce(1)
        began = time.time()
        rows = bpe._using(words, {"ranks": table}, "ids", lambda t: bpe.fold(F.col("piece").cast("binary"), t["ranks"])).collect()
        took = time.time() - began
        for r in rows[::50]:
            assert r.ids == LIBRARY._encode_single_piece(r.piece.encode())
        return took

    seconds(20)
    assert seconds(200) < 10


def test_lookups_in_lambdas_are_of_maps(spark):
    """A map's key is found by a loop; array_position, which looked up every piece and pair before, throws an exception for each find."""
    table = bpe.rank_map(spark, RANKS)
    docs = spark.createDataFrame([("of maps of maps",)], "text string")
    words, _ = bpe.word_table(docs, bpe.java_pattern(spark, public_tokenizers.PATTERN), table)
    assert [t.schema["value"].dataType.simpleString() for t in (table, words)] == ["array<map<binary,int>>", "array<map<string,array<int>>>"]
    for ranks in ({b"a": 0, b"b": bpe.NONE}, {}):
        if ranks:
            with pytest.raises(ValueError):
                bpe.rank_map(spark, ranks)
        else:
            assert len(bpe.rank_map(spark, ranks).first()["value"]) == bpe.RANK_SLOTS


def test_states_of_all_sizes(spark):
    table = bpe.rank_map(spark, RANKS)
    sizes = [1, 2, 3, *range(bpe.SEVERAL - 4, bpe.SEVERAL + 3), bpe.LONG, (1 << bpe.PLACE) - 3]
    words = [bytes(97 + (i * i * 7 + j * 13 + i * j) % 26 for i in range(size)) for size in sizes for j in range(3)] + [b"a" * size for size in sizes]
    rows = bpe._using(spark.createDataFrame([(w,) for w in words], "word binary"), {"ranks": table}, "ids", lambda t: bpe.fold(F.col("word"), t["ranks"])).collect()
    assert len(rows) == len(words)
    for r in rows:
        assert r.ids == LIBRARY._encode_single_piece(bytes(r.word))

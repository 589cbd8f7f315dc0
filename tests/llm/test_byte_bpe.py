from array import array

import duckdb
import public_tokenizers
import pytest
import tiktoken
from loomtext.llm import byte_bpe as B
from pyspark.sql import functions as F

TEXTS = ["", None, " ", "  \n\n x", "It's we'LL don't 1234 ½ &&&###  \t\r\n", "é ñ ß 日本語 🙂   a\x1fb\x85c​", "a" * 500, "\x00￾"]


@pytest.fixture(scope="module")
def ranks():
    return B.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("words", [0, 100_000])
def test_as_the_library(spark, library, words):
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    rows += [(10_000 + i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (10_000, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    found = B.decode(B.encode(docs, words=words)).collect()
    expected = sorted((str(i), array("I", library.encode_ordinary(t or "")).tobytes(), (t or "").encode()) for i, t in rows)
    assert sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in found) == expected


def test_fold(spark, ranks, library):
    words = sorted({w.encode() for t in TEXTS[:6] for w in B.splitter(public_tokenizers.PATTERN).findall(t or "")} | {b" international", b" Donaudampfschiff"})
    frame = spark.createDataFrame([(w,) for w in words] + [(b"",)], "word binary")
    found = {bytes(r.word): r.ids for r in frame.select("word", B.fold(F.col("word"), ranks).alias("ids")).collect()}
    assert found == {w: library._encode_single_piece(w) for w in words} | {b"": []}


def test_empty_table(spark):
    assert B.decode(B.encode(spark.createDataFrame([], "doc_id long, text string"))).count() == 0

import hashlib
import re

import duckdb
from loomtext.llm import imatch as I
from pyspark.sql import functions as F


def plain(rows):
    """(doc_id, text, edited, next text) of rows in descending doc_id."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = [t or "" for _, t in order]
    for (i, _), t, after in zip(order, texts, texts[1:] + texts[:1]):
        half = len(t) // 2
        yield i, t, t[: len(t) - half] + after[:half], after


def words(text):
    return {w for w in re.split(r"[\W_]+", text.lower()) if w}


def test_given_table(spark):
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    found = I.edited(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert {(r.doc_id, r.n_chars, r.text, r.edited) for r in found} == {(i, len(t), t, e) for i, t, e, _ in plain(rows)} and len(found) == len(rows)
    prints = {r.text: r.fingerprint for r in found}
    prints |= {r.edited: r.edited_fingerprint for r in found}
    assert all(prints[r.text] == r.fingerprint and prints[r.edited] == r.edited_fingerprint for r in found)
    mean = lambda x: sum(x) / len(x)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    assert mean([r.near_edited for r in found]) > mean([r.near_next for r in found]) + 0.15


def test_band_and_terms(spark):
    docs = spark.createDataFrame([(i, f"all few{i % 10} rare{i} Twice{i // 2}, all") for i in range(100)], "doc_id long, text string")
    assert sorted(I.lexicon(docs, 0.05, 0.2)) == [f"few{i}" for i in range(10)]
    text = "The cat, the_CAT! Ünder naïve x2 2"
    assert set(docs.limit(1).select(I.terms(F.lit(text))).first()[0]) == words(text)


def test_edges(spark):
    rows = [(3, None), (1, ""), (9, "one two three four five"), (5, "😀 é " * 30), (2, "One two\tthree"), (None, "zero one"), (7, "x" * 5000), (11, "one two three four five"), (4, "!!! ???")]
    docs = spark.createDataFrame([(i, t, "a", 0) for i, t in rows], "doc_id long, text string, range string, copy int")
    found = {r.doc_id: r for r in I.edited(docs).collect()}
    assert {(i, r.text, r.edited) for i, r in found.items()} == {(i, t, e) for i, t, e, _ in plain(rows)}
    assert found[9].fingerprint == found[11].fingerprint and found[11].near_next == 1.0 and found[11].n_chars == 23
    assert found[1].fingerprint == found[3].fingerprint == found[4].fingerprint
    one = I.edited(docs.where("doc_id = 9")).collect()
    assert [(r.edited, r.near_next) for r in one] == [("one two thre" + "one two thr", 1.0)]
    copies = docs.where("doc_id = 9").unionByName(docs.where("doc_id in (9, 7)"))
    assert sorted(r.doc_id for r in I.edited(copies).collect()) == [7, 9, 9]
    assert I.edited(docs.limit(0)).count() == 0
    assert I.edited(docs.where("doc_id is null")).count() == 1
    assert hashlib.sha256(b"").hexdigest() == docs.limit(1).select(F.sha2(F.lit(""), 256)).first()[0]

import itertools

import duckdb
import numpy as np
from loomtext.llm import language_id as L


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = L.identify(docs, L.fit(docs)).select("doc_id", L.held_out(L.F.col("doc_id")).alias("h"), "lang_pred", "score").collect()
    truth = dict(duckdb.sql("select doc_id, lang from '/root/testdata/sf0.01/documents.parquet'").fetchall())
    held = [r for r in found if r.h and r.lang_pred != "und"]
    right = np.mean([r.lang_pred == truth[r.doc_id] for r in held])
    assert len(found) == 1000 and right > 0.9, right
    assert all(0 <= r.score <= 1 for r in found)


def test_edges(spark):
    rows = [(i, t, l, "z") for i, (t, l) in enumerate([("the cat and the dog " * 30, "en"), ("der Hund und die Katze " * 30, "de"), ("привет мир и люди " * 20, "ru")] * 12)]
    rows += [(100, None, "en", ""), (101, "123 ||| &&&", "en", ""), (102, "the cat and the dog " * 20 + "der Hund und die Katze " * 30, None, ""), (None, "мир и привет", None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = L.fit(docs)
    found = {r.doc_id: r for r in L.identify(docs, model).collect()}
    assert found[100].lang_pred == found[101].lang_pred == "und" and found[100].score == 0
    assert [s.lang for s in found[102].spans] == ["en", "de"] and found[102].lang_pred == "de" and found[102].spans[0].end == 100
    assert found[None].lang_pred == "ru"
    assert L.identify(docs, L.fit(docs.limit(0))).select("lang_pred").distinct().collect()[0][0] == "und"
    assert L.identify(docs.limit(0), model).count() == 0


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    n = np.array([3, 0, 6, 1, 5])
    scores = rng.normal(size=(n.sum(), 3)).astype(np.float32) * 2
    path, at = L.viterbi(scores, n, 1.5), 0
    for m in n:
        s = scores[at : at + m]
        value = lambda p: sum(s[i, x] for i, x in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        if m:
            assert np.isclose(value(path[at : at + m].tolist()), max(map(value, itertools.product(range(3), repeat=int(m)))), atol=1e-4)
        at += m

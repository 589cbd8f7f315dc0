import re

import duckdb
import numpy as np
from loomtext.llm import language_id, packing

import corpus_pipeline as P
from test_simhash import classes, plain
from test_suffix_dedup import plain as repeats


def likeness(a, b):
    """Jaccard, of the sets of five-word shingles."""
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.encode().lower().split()] for i in range(max(1, len(w) - 4)) if w}
    a, b = shingles(a), shingles(b)
    return len(a & b) / max(1, len(a | b))


def brute_force(docs, langs):
    """(doc_id, text) that reach packing, by the stages' definitions."""
    kept = sorted((i, t) for i, t in docs if langs[i][0] != "und" and langs[i][1] >= 0.5)
    name = classes([plain(t) for _, t in kept])
    for k, (_, t) in enumerate(kept):
        for j in range(k):
            if name[j] != name[k] and likeness(kept[j][1], t) >= P.LIKE:
                name = [name[j] if x == name[k] else x for x in name]
    kept = [x for k, x in enumerate(kept) if name.index(name[k]) == k]
    split, seen = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t.encode())] for _, t in kept], {}
    for (_, t), own in zip(kept, split, strict=True):
        for i in range(len(own) - P.PASSAGE + 1):
            words = tuple(t.encode()[a:b] for a, b in own[i : i + P.PASSAGE])
            seen[words] = seen.get(words, 0) + 1
    out = []
    for (i, t), own, by_byte in zip(kept, split, repeats([t.encode() for _, t in kept], 400), strict=True):
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for a, b in by_byte:
            gone[a:b] = True
        for k in range(len(own) - P.PASSAGE + 1):
            if seen[tuple(raw[a:b] for a, b in own[k : k + P.PASSAGE])] > 1:
                gone[own[k][0] : own[k + P.PASSAGE - 1][1]] = True
        out.append((i, np.frombuffer(raw, np.uint8)[~gone].tobytes().decode(errors="ignore")))
    return out


def test_stages_against_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    langs = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, language_id.fit(docs)).collect()}
    expected = brute_force(rows, langs)
    now = docs
    for k, (name, stage) in enumerate(P.STAGES[:-1]):
        before = {r.doc_id for r in now.collect()}
        now = stage(spark, now, sf)
        assert now.columns == docs.columns and now.dtypes == docs.dtypes
        now.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        assert {r.doc_id for r in now.collect()} <= before
    assert sorted((r.doc_id, r.text) for r in now.collect()) == expected
    assert all(r.n_chars == len(r.text) for r in now.collect())
    encoder = packing.word_bpe(packing.vocabulary_path("word_bpe_49k.json"))
    total = {i: len(encoder.encode([t])[0]) // 4 + 1 for i, t in expected}
    pieces = P.STAGES[-1][1](spark, now, sf).collect()
    assert {i: sum(r.length for r in pieces if r.doc_id == i) for i in total} == total and {r.doc_id for r in pieces} == set(total)


def test_idle_workers_keep_no_words(spark):
    docs = spark.createDataFrame([(i, f"the cat {i} sat on mat {i % 7}") for i in range(400)], "doc_id long, text string").repartition(8)

    def held(batches):
        import pyarrow as pa
        from loomtext.llm import subwords

        for _ in batches:
            pass
        known = list(subwords._ENCODERS.values())
        yield pa.RecordBatch.from_arrays([pa.array([len(known)]), pa.array([sum(len(x.now.at) + len(x.before.at) for x in known)])], names=["encoders", "words"])

    assert packing.pack(docs).agg({"length": "sum"}).first()[0] > 400
    # The same workers, which Spark keeps for later tasks.
    found = spark.range(0, 80, 1, 8).mapInArrow(held, "encoders long, words long").collect()
    assert any(r.encoders for r in found) and not any(r.words for r in found)


def test_edges(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, _d long, row string"
    word = "the cat and the dog went along to see what there was to be seen "
    rows = [(1, word * 40, "en", "a", 5, 0, ""), (2, word * 40, None, "a", None, 0, ""), (None, word * 40, "en", None, 1, 0, ""), (None, "quite another text that stands alone", "en", "b", 1, 0, ""), (3, None, "en", "b", 1, 0, ""), (4, "", "en", "b", 0, 0, ""), (5, "some short text", "en", "b", 15, 0, ""), (5, "some short text", "en", "b", 15, 0, ""), (9, "99 !! ..", "en", "b", 1, 0, "")]
    now = spark.createDataFrame(rows, kind)
    for _, stage in P.STAGES[:2]:
        now = stage(spark, now, "")
    assert sorted(((r.doc_id or 0), r.text[:5]) for r in now.collect()) == [(0, "quite"), (1, "the c"), (5, "some ")]
    now = P.STAGES[2][1](spark, now, "")
    assert {r.doc_id: r.n_chars for r in now.collect()}[5] == 15
    assert P.STAGES[3][1](spark, now, "").count() == 3
    empty = spark.createDataFrame([], kind)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, "")
    assert empty.count() == 0

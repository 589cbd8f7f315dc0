import random
import re
import zlib

import duckdb
import numpy as np
from loomtext.llm import suffix_array as A
from loomtext.llm import suffix_dedup as S


def plain(texts, length):
    """Removed spans by brute force."""
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 2, int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i + 1 : i + length + 1] = 1
        edge = np.flatnonzero(np.diff(gone))
        out.append([(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])])
    return out


def test_suffix_arrays_against_sorting(monkeypatch):
    rng = np.random.default_rng(0)
    for trial in range(150):
        monkeypatch.setattr(A, "SHORT", 0 if trial % 2 else 1 << 18)
        t = rng.integers(0, int(rng.integers(1, 6)), int(rng.integers(0, 70)))
        if trial % 5 == 0:
            t = np.tile(t[:3], 20)
        sa, x = A.suffix_array(t), t.tolist()
        assert sa.tolist() == sorted(range(len(x)), key=lambda i: x[i:])
        shared = A.permuted_prefixes(t, sa) if len(x) > 1 else None
        for a, b in zip(sa[:-1].tolist(), sa[1:].tolist()):
            n = next((k for k in range(len(x)) if x[a : a + k + 1] != x[b : b + k + 1] or max(a, b) + k >= len(x)), 0)
            assert shared[b] == n
    t = rng.integers(0, 200, 6000)
    t[3000:] = t[:3000]
    assert A.suffix_array(t).tolist() == sorted(range(6000), key=lambda i: t.tolist()[i : i + 3010])


def removed(found):
    return sorted(((r.doc_id is None, r.doc_id or 0), r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in found)


def expected(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), t, own in zip(rows, texts, plain(texts, length), strict=True):
        gone = {x for a, b in own for x in range(a, b)}
        out.append(((i is None, i or 0), len(t), own, bytes(c for k, c in enumerate(t) if k not in gone)))
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 300))) for _ in range(40)]
    passage = "".join(rng.choice("abcdefgh ") for _ in range(70))
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t) for i, t in enumerate(base[:10])]
    rows += [(200 + i, base[i + 5][rng.randint(0, 40) :] + "é" + base[i][: rng.randint(0, 200)]) for i in range(25)]
    rows += [(300 + i, base[(3 * i) % 40][: rng.randint(0, 90)] + passage + base[(7 * i) % 40][: rng.randint(0, 90)]) for i in range(30)]
    rows += [(400, None), (401, ""), (402, "a" * 500), (403, "ab" * 200), (404, "ä" * 90), (None, base[3]), (None, None), (7, base[7]), (7, base[7]), (7, "other text" * 3), (405, "\0" * 50 + "x")]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, at int")
    for most in (512, 3):  # 3: frequent anchors are split
        found = S.remove_repeats(docs, length=40, anchor=12, most=most, shard=2000, also=("key",))
        assert removed(found.collect()) == expected(rows, 40)
    assert found.columns == ["doc_id", "key", "n_bytes", "n_removed", "n_spans", "kept", "spans"]
    assert S.remove_repeats(docs.limit(0), length=40, anchor=12).count() == 0
    texts = found.select(S.kept_text(S.F.col("kept"))).collect()
    assert all("�" not in r[0] for r in texts)


def test_whole_texts(spark):
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    rows += [(10_000 + i, " ".join(w for k, w in enumerate(t.split(" ")) if zlib.crc32(f"{i} {k}".encode()) % 150)) for i, t in rows[::9]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert removed(S.remove_repeats(docs).collect()) == expected(rows, 400)


def test_pieces_of_a_very_long_text(monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 900)
    rng = random.Random(2)
    text = "".join(rng.choice("abc") for _ in range(5000)).encode()
    _, _, _, at, more, inner = S.Anchors(40, 12).spans([text, b"", text[:39], text[:40]])
    own = [a + i for a, m in zip(at.tolist(), more.tolist(), strict=True) for i in range(m + 1)]
    assert sorted(own) == sorted([*range(4961), 0]) and (inner >= more).all() and (inner <= 28).all()


def test_spans_leave_in_bounded_batches(spark, monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    docs = spark.createDataFrame([(i, text + str(i)) for i in range(20)], "doc_id long, text string")
    kinds, n = (S.Kind(400, 64),), S.all_spans(docs, (S.Kind(400, 64),)).count()
    spans = S.all_spans(docs, kinds).withColumn("copies", S.F.lit(1).cast("long"))
    monkeypatch.setattr(type(docs), "mapInArrow", lambda rows, f, schema: (rows, f))
    rows, f = S.with_text(docs, spans, kinds)
    got = list(f(iter(rows.toArrow().combine_chunks().to_batches())))
    sizes = [sum(map(len, b.column(10).to_pylist())) for b in got]
    assert sum(b.num_rows for b in got) == n and sum(sizes) > 1_000_000 and max(sizes) <= 1 << 20
    for b in got:
        for x in b.to_pylist():
            assert (text + str(x["d"])).encode()[x["at"] : x["at"] + x["more"] + 400] == x["bytes"]


def test_passages_of_words(spark):
    rng = random.Random(8)
    words = lambda n: [rng.choice("abcdefghij") + str(rng.randrange(900)) for _ in range(n)]
    rows, shared = [], [words(n) for n in (51, 50, 60, 51, 75)]
    for k, own in enumerate(shared):
        for side in (0, 1):
            gap = "\n " if side and k == 3 else " "  # other bytes between the same words
            rows.append((10 * k + side, " ".join(words(rng.randrange(80))) + f" é{k}{side} " + gap.join(own) + " " + " ".join(words(rng.randrange(80)))))
    rows += [(100, "日本語" * 70), (101, "x日本語" + "日本語" * 70), (102, ""), (103, None), (None, " ".join(shared[0])), (104, "a " * 60), (104, "a " * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    split, seen = [[(m.start(), m.end()) for m in re.finditer(rb"[^ \n]+", (t or "").encode())] for _, t in rows], {}
    for k, own in enumerate(split):
        t = (rows[k][1] or "").encode()
        for i in range(len(own) - 50):
            seen.setdefault(tuple(t[a:b] for a, b in own[i : i + 51]), []).append((k, own[i][0], own[i + 50][1]))
    gone = [set() for _ in rows]
    for k, own in enumerate(plain([(t or "").encode() for _, t in rows], 400)):
        gone[k] |= {x for a, b in own for x in range(a, b)}
    for places in seen.values():
        for k, a, b in places if len(places) > 1 else ():
            gone[k] |= set(range(a, b))
    kept = [bytes(c for i, c in enumerate((t or "").encode()) if i not in gone[k]) for k, (_, t) in enumerate(rows)]
    found = S.remove_repeats(docs, words=51).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, bytes(r.kept)) for r in found), key=key) == sorted(((i, b) for (i, _), b in zip(rows, kept, strict=True)), key=key)
    short = {r.doc_id: r.n_removed for r in S.remove_repeats(docs).collect()}
    assert short[0] == 0 and gone[0] and not gone[2] and gone[6]
    counted = {r.doc_id: r for r in S.remove_repeats(docs, words=51, cut_words=False).collect()}
    assert {i: r.n_removed for i, r in counted.items()} == short
    inside = [{x for places in seen.values() if len(places) > 1 for j, a, b in places if j == k for x in range(len(own)) if a <= own[x][0] < b} for k, own in enumerate(split)]
    assert {i: len(x) for (i, _), x in zip(rows, inside, strict=True)} == {i: r.n_passage_words for i, r in counted.items()}

import re
import zlib

import duckdb
import numpy as np
import xxhash
from loomtext.llm import simhash as S


def plain(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps):
    """Brute force: component of each position."""
    name = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and name[i] != name[j]:
                a, b = sorted((name[i], name[j]))
                name = [a if x == b else x for x in name]
    return name


def test_against_brute_force(spark):
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet' order by doc_id").fetchall()
    edited = [(1000 + i, " ".join(w for k, w in enumerate((t or "").split(" ")) if zlib.crc32(f"{i} {k}".encode()) % 90)) for i, t in rows[:80]]
    rows += edited + [(5000, None), (5001, ""), (5002, " \n"), (5003, "ONE two"), (5004, "one\ttwo"), (None, "one two"), (None, "alone here now and then"), (None, "alone here now and then"), (5005, "é\x85 x y z w")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    found = S.near_duplicates(docs).collect()
    fps = [plain(t) for _, t in rows]
    assert {(r.doc_id, r.fingerprint) for r in found} == {(i, f"{f:016x}") for (i, _), f in zip(rows, fps, strict=True)} and len(found) == len(rows)
    name = classes(fps)
    low = {n: min((i for (i, _), m in zip(rows, name, strict=True) if m == n and i is not None), default=None) for n in name}
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in found} == {(i, f"{f:016x}", low[n]) for (i, _), f, n in zip(rows, fps, name, strict=True)}
    assert len({low[n] for n in name}) < len(rows) - 20
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_large_buckets_and_chains(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 4)]
    fps = set(base)
    for b in base:
        x = b
        for _ in range(60):
            x ^= 1 << int(rng.integers(0, 64))
            fps |= {x, b ^ (1 << int(rng.integers(0, 64)))}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)], "node long, fp long")
    found = {r.node: r.component for r in S.components(S.links(nodes)).collect()}
    assert [found.get(i, i) for i in range(len(fps))] == classes(fps)


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in (a, b)))
    return len(a & b) / len(a | b)


def test_one_of_each_by_likeness(spark):
    rng = np.random.default_rng(9)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    rows = []
    for g in range(30):
        own = words(240)
        rows.append((3 * g, own))
        for k, edits in ((1, 4), (2, 14)):  # likeness about 0.84 and 0.55
            now = list(own)
            for at in np.linspace(5, 230, edits).astype(int).tolist():
                now[at] = f"new{g} {k} {at}"
            rows.append((3 * g + k, now))
    rows = [(i, " ".join(w)) for i, w in rows] + [(900, rows[0][1] and " ".join(rows[0][1]).upper()), (901, "one two"), (902, "one two three"), (903, ""), (904, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fps, name = [plain(t) for _, t in rows], list(range(len(rows)))
    missed = 0
    for i in range(len(rows)):
        for j in range(i):
            near = (fps[i] ^ fps[j]).bit_count() <= 4
            like = bool(rows[i][1] and rows[j][1]) and jaccard(rows[i][1], rows[j][1]) >= 0.8
            missed += like and not near
            if (near or like) and name[i] != name[j]:
                a, b = sorted((name[i], name[j]))
                name = [a if x == b else x for x in name]
    assert missed >= 20  # links that 64 bits miss
    expected = sorted({min(i for (i, _), m in zip(rows, name, strict=True) if m == n) for n in name})
    assert sorted(r.doc_id for r in S.one_of_each(docs, like=0.8).collect()) == expected
    assert len(S.one_of_each(docs).collect()) > len(expected) + 15
    assert S.one_of_each(docs.limit(0), like=0.8).count() == 0

import math

import numpy as np
from loomtext.llm import topk_search as T
from pyspark.sql import functions as F


def plain(rows, k, every):
    good = [(n, i, [math.floor(256 * float(c)) for c in v]) for n, (i, v) in enumerate(rows) if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for n, i, q in good:
        if i is None or i % every:
            continue
        scored = sorted((-max(min(sum(a * b for a, b in zip(q, x)), 2**63 - 1), -(2**63)), j is None, j or 0) for m, j, x in good if m != n)[:k]
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(scored)]
    return sorted(out, key=str)


def found(spark, given, k=5, every=50, **options):
    frame = spark.createDataFrame([(i, v, 1) for i, v in given], "vec_id long, embedding array<float>, row int")
    return sorted(map(tuple, T.search(frame, F.col("vec_id") % every == 0, k=k, **options).collect()), key=str)


def test_given_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = T.search(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"), F.col("vec_id") % 50 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and sorted(map(tuple, got.collect()), key=str) == plain(rows, 5, 50)


def test_ties_copies_nulls_and_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.integers(-3, 4, 6) / 7]) for i in range(300)]
    rows += [(1000 + i, rows[10][1]) for i in range(60)] + [(50, rows[3][1]), (100, rows[100][1]), (None, rows[0][1]), (None, rows[7][1])]
    rows += [(2000, None), (2050, [1.0, None]), (2100, [float("nan")]), (2150, [float("inf")]), (2200, [1.0, -1.0]), (2250, [])]
    assert found(spark, rows) == plain(rows, 5, 50)
    assert found(spark, rows, block=3, rows=40, pivots=2) == plain(rows, 5, 50)


def test_few_rows_and_huge_components(spark):
    assert found(spark, []) == [] and found(spark, [(0, None)]) == [] and found(spark, [(0, [1.0])]) == []
    rows = [(0, [2.0**20, 1.5]), (1, [2.0**21, 0.25]), (2, [-(2.0**30), 3.0]), (50, [2.0**120, 2.0])]
    assert found(spark, rows) == plain(rows, 5, 50)


def test_bounds_leave_most_out():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(20, 8)) * 40)[rng.integers(0, 20, 4000)] + rng.integers(-2, 3, (4000, 8))
    marks = T.spread(x[:500], 32)
    far = T.distances(x, marks).astype(np.float32)
    block = T.Block(np.arange(10), x[:10], marks, 5)
    seen = []
    plain_products = T.products
    T.products = lambda a, q: seen.append(len(a)) or plain_products(a, q)
    try:
        best, least = block.start(), np.full(10, -np.inf)
        block.search(best, least, np.arange(4000), np.arange(4000), np.zeros(4000, bool), x, (x * x).sum(1), far)
    finally:
        T.products = plain_products
    assert sum(seen) < 0.5 * 10 * 4000
    for i in range(10):
        scores = x @ x[i]
        scores[i] = -1e18
        assert [-s for s, _, _ in best[i]] == sorted(scores, reverse=True)[:5]

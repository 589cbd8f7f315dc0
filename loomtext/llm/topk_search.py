"""Exact top-k search by inner product, with a table of distances to pivots.

Every vector's distances to the pivots are computed once and written beside it.  For a query q and a candidate x, the largest
difference of their distances to a pivot is at most their own distance, so (|q|^2 + |x|^2 - largest^2) / 2 is at least their
inner product.  Candidates are evaluated in the order of that bound until it falls below the k-th best score found; a query's
scores with the pivots, which are candidates too, are the first.

Queries go out in blocks of `block` vectors, each broadcast and held against all rows: what is broadcast has a fixed size, and
a task keeps k rows for each query of the block.

Components become floor(scale * x), as exact integers.  A vector that is null or has a null or non-finite component takes no
part; a shorter vector counts as continued by zeros.  Queries are rows, so of rows with one id each is a query of its own and a
candidate of the others; null ids are no queries, and as candidates come last among ties.  Scores beyond 64 bits are cut to
the nearest long.  Other columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored

#: Sums of products stay exact in doubles below this.
EXACT = 2.0**53
LAST = np.iinfo(np.int64).max


def integers(column: pa.Array, width: int, scale: float) -> np.ndarray:
    """floor(scale * x) as doubles, each row filled with zeros to the width."""
    n, flat = np.diff(np.asarray(column.offsets)), np.asarray(column.flatten(), dtype=np.float64)
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), n)
    out[row, np.arange(len(flat)) - (np.cumsum(n) - n)[row]] = np.floor(scale * flat)
    return out


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of x with q, as int64."""
    if len(x) == 0 or np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(1, x.shape[1]) < EXACT:
        return (x @ q).astype(np.int64)
    whole = [int(c) for c in q]
    sums = [sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in x.tolist()]
    return np.array([min(max(s, -(2**63)), LAST) for s in sums], np.int64)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def spread(x: np.ndarray, n: int) -> np.ndarray:
    """Rows that lie far from each other, each the farthest from those before."""
    if not len(x):
        return x
    chosen = [int((x * x).sum(1).argmax())]
    near = distances(x, x[chosen])[:, 0]
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


class Block:
    """Queries with their best k so far; columns row, id (null: LAST and none)."""

    def __init__(self, rows: np.ndarray, x: np.ndarray, pivots: np.ndarray, k: int):
        self.rows, self.x, self.k = rows, x, k
        self.square, self.far = (x * x).sum(1), distances(x, pivots).astype(np.float32)

    def start(self) -> list[list[tuple]]:
        return [[] for _ in self.rows]

    def search(self, best: list[list[tuple]], least: np.ndarray, row: np.ndarray, name: np.ndarray, none: np.ndarray, x: np.ndarray, square: np.ndarray, far: np.ndarray) -> None:
        """best: of each query (-score, no id, id), sorted; least: its k-th score, from which on candidates count."""
        slack = 2.0**-17 * (square.max() + self.square.max(initial=0) + float(far.max()) ** 2 + float(self.far.max(initial=0)) ** 2)
        columns = np.ascontiguousarray(far.T)
        for at in range(0, len(self.rows), 64):
            own = slice(at, at + 64)
            bound = np.zeros((len(self.rows[own]), len(x)), np.float32)
            gap = np.empty_like(bound)
            for p in range(columns.shape[0]):
                np.subtract(self.far[own, p, None], columns[p], out=gap)
                np.abs(gap, out=gap)
                np.maximum(bound, gap, out=bound)
            bound *= bound
            upper = (self.square[own, None] + square - bound) / 2 + slack
            upper[np.isnan(upper)] = np.inf  # beyond single precision a bound says nothing
            for i in np.flatnonzero((upper >= least[own, None]).any(1)).tolist():
                self.one(best, least, at + i, upper[i], row, name, none, x)

    def one(self, best, least, i, upper, row, name, none, x) -> None:
        todo = np.flatnonzero(upper >= least[i])
        todo = todo[np.argsort(-upper[todo], kind="stable")]
        for at in range(0, len(todo), 128):
            part = todo[at : at + 128]
            if upper[part[0]] < least[i]:
                return
            score = products(x[part], self.x[i])
            good = (score >= least[i]) & (row[part] != self.rows[i])
            if good.any():
                part, score = part[good], score[good]
                order = np.lexsort((name[part], none[part], -score))[: self.k]
                best[i] = sorted(best[i] + [(-int(score[j]), bool(none[part[j]]), int(name[part[j]])) for j in order])[: self.k]
                if len(best[i]) == self.k:
                    least[i] = max(least[i], -best[i][-1][0])


_BLOCKS: dict = {}


def search(vectors: DataFrame, is_query: Column, name: str = "vec_id", vector: str = "embedding", k: int = 5, scale: float = 256.0, pivots: int = 32, sample: int = 2000, block: int = 8192, rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score.  Pivots come from `sample` vectors, the first by hash."""
    v = F.col(vector).cast("array<double>")
    usable = F.col(vector).isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    own = vectors.where(usable).select(F.col(name).cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    width = own.agg(F.max(F.size("v"))).first()[0] or 0
    chosen = own.select("v").orderBy(F.xxhash64("v")).limit(sample).toArrow()
    marks = spread(integers(chosen["v"].combine_chunks() if chosen.num_rows else pa.array([], pa.list_(pa.float64())), width, scale), pivots)

    def measure(batches):
        for batch in slices(batches, rows):
            x = integers(batch.column("v"), width, scale)
            far = distances(x, marks).astype(np.float32)
            kind = lambda a, t: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.ravel(), t))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("query"), kind(x, pa.float64()), kind(far, pa.float32())], names=["row", "id", "query", "x", "far"])

    # A row's number is fixed once the table is written.
    table = stored(own.withColumn("row", F.monotonically_increasing_id()).mapInArrow(measure, "row long, id long, query boolean, x array<double>, far array<float>"), "pivot-table")
    session, found, after = vectors.sparkSession, [], None
    while True:
        some = table.where("query and id is not null").select("row", "id", "x")
        some = (some if after is None else some.where(F.col("row") > after)).orderBy("row").limit(block).toArrow()
        if not some.num_rows:
            break
        after = some["row"][-1].as_py()
        block_name, names = uuid.uuid4().hex, np.asarray(some["id"])
        x = integers(some["x"].combine_chunks(), width, 1.0)
        # A pivot that is the query itself, or rows equal to it, says nothing, so only the k + 1st best of the pivots counts.
        first = np.full(len(x), -np.inf)
        if len(marks) > k:
            scores = np.sort(np.stack([products(marks, q) for q in x]), 1)
            first = scores[:, -k - 1].astype(np.float64)
            first[np.abs(first) >= EXACT] = -np.inf
        shared = session.sparkContext.broadcast((np.asarray(some["row"]), x, marks, first))
        run = part(shared, block_name, names, k, width, rows)
        found.append(table.select("row", "id", "x", "far").mapInArrow(run, "query long, query_id long, vec_id long, score long"))
    if not found:
        return session.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def part(shared, block_name: str, names: np.ndarray, k: int, width: int, rows: int):
    def run(batches):
        if block_name not in _BLOCKS:
            _BLOCKS.clear()
            own_rows, x, marks, _ = shared.value
            _BLOCKS[block_name] = Block(own_rows, x, marks, k)
        of, least = _BLOCKS[block_name], shared.value[3].copy()
        best = of.start()
        for batch in slices(batches, rows):
            row = np.asarray(batch.column("row"))
            none = np.asarray(batch.column("id").is_null())
            name = np.asarray(batch.column("id").fill_null(LAST))
            x = integers(batch.column("x"), width, 1.0)
            far = np.asarray(batch.column("far").flatten()).reshape(len(x), -1)
            of.search(best, least, row, name, none, x, (x * x).sum(1), far)
        out = [(int(of.rows[i]), int(names[i]), None if none else name, -score) for i, own in enumerate(best) for score, none, name in own]
        for at in range(0, len(out), 50_000):
            columns = list(zip(*out[at : at + 50_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "query_id", "vec_id", "score"])

    return run

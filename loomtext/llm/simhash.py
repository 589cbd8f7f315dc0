"""SimHash near-duplicates, linked by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments (22, 21 and 21 bits, filled up to 23).  A segment's keys are the indices of the
codewords of the perfect (23, 12) Golay code within four bits of it: one, or six.  Segments that differ in at most two bits
share a key.  Of fingerprints with at most four differing bits, two segments differ together in at most two, so pairs of
segment keys find every link; each is verified on the whole fingerprints.  Equal fingerprints are one node from the start.

Links inside a partition are contracted before they leave it, and components come from alternating star contraction with
tables written between the rounds: neither links nor components go to the driver.

`one_of_each` can also link texts by the Jaccard likeness of their sets of five-word shingles, which 64 bits do not show well
enough: texts that share a band of MinHash values meet in a bucket, and every link is verified on the whole sets.

Nulls: a null text has fingerprint zero, as an empty one; a null doc_id keeps its row and has no say in component_id unless a
whole component has none.  Equal rows each keep their row.  Other columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored, tidied

SEED = 42
#: Bands of MinHash values, and values in each: texts of likeness 0.8 share none with probability (1 - 0.8**5)**24 = 0.00007.
BANDS, IN_BAND = 24, 5


def fingerprint(texts: list[bytes], words: int = 4) -> np.ndarray:
    """Unsigned fingerprints of whole texts.  Bits are summed in the eight byte lanes of 64-bit integers, 255 hashes at a time."""
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for k, text in enumerate(texts):
        w = text.lower().split()
        if not w:
            continue
        line = b" ".join(w)
        ends = list(accumulate(map(len, w), lambda a, b: a + b + 1))
        if len(w) <= words:
            hashes.append(digest(line, SEED))
            counts[k] = 1
            continue
        starts = [0, *[e + 1 for e in ends]]
        hashes += [digest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :])]
        counts[k] = len(w) - words + 1
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    h, n = np.array(hashes, np.uint64), counts[full]
    begin = np.cumsum(n) - n
    parts = -(-n // 255)
    own = np.repeat(np.arange(len(n)), parts)
    first = np.cumsum(parts) - parts
    chunk = begin[own] + 255 * (np.arange(len(own)) - first[own])
    ones = np.zeros((len(n), 8, 8), np.int64)  # byte, bit
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & np.uint64(0x0101010101010101), chunk)
        ones[:, :, bit] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, 0)
    out[full] = np.packbits(2 * ones > n[:, None, None], axis=2, bitorder="little").reshape(-1, 8).copy().view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, words: int = 4, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long, and the long columns named in `also`."""

    def run(batches):
        for batch in slices(batches):
            found = fingerprint([x or b"" for x in batch.column(1).to_pylist()], words).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), *batch.columns[2:]], names=["doc_id", "fp", *also])

    known = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"), *also)
    return known.mapInArrow(tidied(run), "doc_id long, fp long" + "".join(f", {x} long" for x in also))


def _golay():
    """Check bits of the 4096 messages, and per syndrome the error patterns of up to four bits."""
    poly = 0b101011100011
    check = np.zeros(4096, np.int64)
    for m in range(4096):
        r = m << 11
        for i in range(22, 10, -1):
            if r >> i & 1:
                r ^= poly << (i - 11)
        check[m] = r
    from itertools import combinations

    errors: list[list[int]] = [[] for _ in range(2048)]
    for n in range(5):
        for bits in combinations(range(23), n):
            e = sum(1 << b for b in bits)
            errors[int(check[e >> 11]) ^ (e & 2047)].append(e)
    table = np.full((2048, 6), -1, np.int64)
    for s, own in enumerate(errors):
        table[s, : len(own)] = own
    return check, table


CHECK, ERRORS = _golay()


def codewords(x: np.ndarray) -> np.ndarray:
    """Indices (n, 6) of the codewords within four bits of each 23-bit word, -1 where there are fewer."""
    e = ERRORS[CHECK[x >> 11] ^ (x & 2047)]
    return np.where(e >= 0, (x[:, None] ^ e) >> 11, -1)


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of unsigned fingerprints: positions and keys (pair of segments, two codeword indices)."""
    s = [(fp >> np.uint64(a)).astype(np.int64) & ((1 << n) - 1) for a, n in ((0, 22), (22, 21), (43, 21))]
    c = [codewords(x) for x in s]
    at, out = [], []
    for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        a, b = c[i][:, :, None], c[j][:, None, :]
        good = (a >= 0) & (b >= 0)
        both = (k << 24) | (a << 12) | b
        rows = np.broadcast_to(np.arange(len(fp))[:, None, None], good.shape)
        at.append(rows[good])
        out.append(both[good])
    return np.concatenate(at), np.concatenate(out)


class Forest:
    """Union-find by smallest name, over names as they come."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= bits


def link(names: np.ndarray, fps: np.ndarray, key: np.ndarray, bits: int, forest: Forest) -> None:
    """Joins linked names of rows sorted by key.  Small buckets: all rows against those a lag behind, for each lag; large ones: linked rows are taken out as they are found."""
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(begin, len(key)))
    small = np.repeat(size <= 32, size) & np.repeat(size > 1, size)
    n, f, k = names[small], fps[small], key[small]
    for lag in range(1, 32):
        if len(k) <= lag:
            break
        same = k[lag:] == k[:-lag]
        if not same.any():
            break
        hit = np.flatnonzero(same & near(f[lag:], f[:-lag], bits))
        for a, b in zip(n[hit].tolist(), n[hit + lag].tolist(), strict=True):
            forest.join(a, b)
    for i in np.flatnonzero(size > 32).tolist():
        left_n, left_f = names[begin[i] : begin[i] + size[i]], fps[begin[i] : begin[i] + size[i]]
        while len(left_n):
            todo, left_n, left_f = [(left_n[0], left_f[0])], left_n[1:], left_f[1:]
            while todo and len(left_n):
                name, fp = todo.pop()
                hit = near(left_f, fp, bits)
                if hit.any():
                    for x in left_n[hit].tolist():
                        forest.join(int(name), x)
                    todo += zip(left_n[hit], left_f[hit], strict=True)
                    left_n, left_f = left_n[~hit], left_f[~hit]


def links(nodes: DataFrame, bits: int = 4) -> DataFrame:
    """Of nodes (node, fp), unequal fps: links (a, b), b < a, that connect what is connected by links of at most `bits` bits."""

    def spread(batches):
        for batch in slices(batches, 20_000):
            name, fp = (np.asarray(batch.column(i)) for i in (0, 1))
            at, key = keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(name[at]), pa.array(fp[at])], names=["key", "node", "fp"])

    def joined(batches):
        forest, tail = Forest(), None
        for batch in batches:
            now = [np.asarray(batch.column(i)) for i in range(3)]
            if tail is not None:
                now = [np.concatenate(x) for x in zip(tail, now, strict=True)]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1], "left"))  # the last key may go on
            tail = [x[cut:] for x in now]
            if cut:
                link(now[1][:cut], now[2][:cut].view(np.uint64), now[0][:cut], bits, forest)
        if tail is not None:
            link(tail[1], tail[2].view(np.uint64), tail[0], bits, forest)
        a = list(forest.up)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array([forest.root(x) for x in a], pa.int64())], names=["a", "b"])

    spreaded = nodes.mapInArrow(tidied(spread), "key int, node long, fp long")
    return spreaded.repartition("key").sortWithinPartitions("key").mapInArrow(tidied(joined), "a long, b long").distinct()


def shingles(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """Each text's sorted set of hashes of so many lower-cased words; a shorter text is one shingle, one without words has none."""
    split = [(t or b"").lower().split() for t in texts]
    digest, known = xxhash.xxh64_intdigest, {w: 0 for own in split for w in own}
    for w in known:
        known[w] = digest(w, SEED)
    out = []
    for own in split:
        h = np.fromiter((known[w] for w in own), np.uint64, len(own))
        k = min(words, len(h))
        found = np.zeros(len(h) - k + 1 if k else 0, np.uint64)
        for i in range(k):
            found = mixed(found ^ h[i : i + len(found)])
        out.append(np.unique(found))
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


MULTIPLIERS = np.random.default_rng(SEED).integers(0, 2**63, BANDS * IN_BAND).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BANDS) keys of sets that are not empty."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    h, begin = np.concatenate(sets), np.cumsum(n) - n
    out = np.empty((len(sets), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(sets), b, np.uint64)
        for m in MULTIPLIERS[b * IN_BAND : (b + 1) * IN_BAND]:
            key = mixed(key ^ np.minimum.reduceat(h * m, begin))
        out[:, b] = key
    return out.view(np.int64)


def link_sets(names: list[int], sets: list[np.ndarray], like: float, forest: Forest) -> None:
    """Joins the names of a bucket's sets that are linked by pairs of so much likeness; linked ones are taken out as they are found."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, begin = np.concatenate(sets), np.cumsum(n) - n
    left = np.arange(len(sets))
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            k = todo.pop()
            own = sets[k]
            close = left[np.minimum(n[left], n[k]) >= like * np.maximum(n[left], n[k]) - 1e-9]
            if not len(close):
                continue
            m = n[close]
            first = np.cumsum(m) - m
            other = flat[np.repeat(begin[close] - first, m) + np.arange(int(m.sum()))]
            same = np.add.reduceat(own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other, first, dtype=np.int64)
            hit = close[same >= like * (m + n[k] - same) - 1e-9]
            for x in hit.tolist():
                forest.join(names[k], names[x])
            todo += hit.tolist()
            left = np.setdiff1d(left, hit, assume_unique=True)


def alike(docs: DataFrame, like: float, words: int = 5) -> DataFrame:
    """Of docs (h, text), h the text's hash: links (a, b) of hashes that connect what is connected by texts of so much likeness."""

    def keyed(batches):
        for batch in slices(batches):
            sets = shingles(batch.column(1).to_pylist(), words)
            full = np.flatnonzero([len(x) > 0 for x in sets])
            if len(full):
                key = bands([sets[i] for i in full.tolist()])
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(np.asarray(batch.column(0))[full], BANDS))], names=["key", "h"])

    def taken(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in shingles(batch.column(1).to_pylist(), words)], pa.binary())], names=["h", "own"])

    def joined(batches):
        forest, before, names, sets = Forest(), None, [], []
        for batch in slices(batches):
            for key, h, own in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if key != before:
                    if len(names) > 1:
                        link_sets(names, sets, like, forest)
                    before, names, sets = key, [], []
                names.append(h)
                sets.append(np.frombuffer(own, np.uint64))
        if len(names) > 1:
            link_sets(names, sets, like, forest)
        a = list(forest.up)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array([forest.root(x) for x in a], pa.int64())], names=["a", "b"])

    texts = docs.select(F.col("h"), F.col("text").cast("string").cast("binary").alias("text"))
    rows = stored(texts.mapInArrow(tidied(keyed), "key long, h long").distinct(), "bands")
    # Of buckets with the same texts one is enough.
    buckets = rows.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("h")).alias("x"), F.bit_xor(F.xxhash64("h", F.lit(1))).alias("y")).where("n > 1")
    chosen = stored(buckets.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"), "buckets")
    members = stored(rows.join(chosen, "key"), "members")
    sets = texts.join(members.select("h").distinct(), "h", "left_semi").dropDuplicates(["h"]).mapInArrow(tidied(taken), "h long, own binary")
    full = members.join(stored(sets, "sets"), "h").select("key", "h", "own")
    return full.repartition("key").sortWithinPartitions("key").mapInArrow(tidied(joined), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Of links (a, b): (node, component), the smallest node of the component, for nodes other than the smallest.

    Alternating star contraction: large stars hang each node's larger neighbours on its smallest one, small stars its smaller ones.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        # Large star: of a link (a, b), b < a: a hangs on the smallest around b.
        large = edges.join(low, F.col("b") == F.col("n")).select("a", F.col("m").alias("b")).distinct()
        # Small star: a node hangs on the smallest of its smaller neighbours, and so do those neighbours.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = stored(small.where("a <> b").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now


def classes(prints: DataFrame, bits: int, more: DataFrame | None = None) -> DataFrame:
    """Of rows with fp and doc_id: fp, low (its smallest doc_id), component (a name).  more: further links (a, b), of values of the rows' column h."""
    # A node is the smallest doc_id of a fingerprint; fingerprints without any take names below all others.
    unnamed = F.lit(-(2**62)) + F.pmod(F.xxhash64("fp"), F.lit(2**61))
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low")).select("fp", "low", F.coalesce("low", unnamed).alias("node")), "nodes")
    edges = links(nodes.select("node", "fp"), bits)
    if more is not None:
        named = stored(prints.select("h", "fp").distinct().join(nodes.select("fp", "node"), "fp").select("h", "node"), "named")
        ends = more.join(named.select(F.col("h").alias("a"), F.col("node").alias("m")), "a").join(named.select(F.col("h").alias("b"), F.col("node").alias("n")), "b")
        edges = edges.unionByName(ends.select(F.col("m").alias("a"), F.col("n").alias("b")))
    found = components(edges)
    return nodes.join(found, "node", "left").select("fp", "low", F.coalesce("component", "node").alias("component"))


def near_duplicates(docs: DataFrame, bits: int = 4, words: int = 4) -> DataFrame:
    """doc_id, fingerprint, component_id."""
    prints = stored(fingerprints(docs, words), "fingerprints")
    known = classes(prints, bits)
    # The smallest doc_id again, as a component may hold nodes without.
    lows = known.groupBy("component").agg(F.min("low").alias("component_id"))
    named = known.join(lows, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, bits: int = 4, words: int = 4, like: float | None = None) -> DataFrame:
    """The rows of docs, all columns, of which one of each group of near-duplicates stays: that of the smallest doc_id.

    With `like`, texts whose sets of five-word shingles have this Jaccard likeness at least are linked too.
    Rows are told apart by doc_id and the hash of the text; of rows alike in both, one stays.  A group without doc_ids keeps one too.
    """
    hashed = docs.select("doc_id", "text", F.xxhash64(F.col("text").cast("string")).alias("h"))
    prints = stored(fingerprints(hashed, words, also=("h",)), "fingerprints")
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    least = prints.groupBy("fp").agg(F.min(name).alias("first"), F.min("doc_id").alias("doc_id"))
    more = alike(hashed, like) if like is not None else None
    known = classes(prints, bits, more).join(least.select("fp", "first"), "fp")
    stay = known.groupBy("component").agg(F.min("first").alias("first")).select(F.coalesce("first.doc_id", F.lit(-(2**63) + 1)).alias("_d"), F.col("first.h").alias("_h"))
    keyed = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63) + 1)).alias("_d"), F.xxhash64(F.col("text").cast("string")).alias("_h"))
    kept = keyed.join(stay, ["_d", "_h"], "left_semi")
    first = F.row_number().over(Window.partitionBy("_d", "_h").orderBy("_d"))
    return kept.withColumn("_n", first).where("_n = 1").select("_row.*")

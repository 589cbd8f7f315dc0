"""Bounded-space online packing of tokenized documents into fixed windows.

Every partition keeps `open_windows` windows.  A document's last piece goes to the open window that it fits best; when none
fits, the fullest is filled up with the head of the piece and emitted, and the rest takes the free place.  The windows that
stay open at the end of the partitions are merged, a few partitions at a time, and what then remains is cut at powers of two,
which need no padding.

Nulls: a null text counts as empty and still has its closing id; a null doc_id is kept.  Equal rows are packed each for itself.
Other columns of the input are ignored.  An empty input gives no rows.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partition_id, slices, stored, tidied
from .subwords import vocabulary_path, word_bpe

FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("part", pa.int64()), ("fill", pa.int64())]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
END = (1).to_bytes(4, "little")


class Packer:
    """Packs the documents of one partition.  A piece is [doc_id, start, ids, doc_tokens]."""

    def __init__(self, part: int, window: int, open_windows: int):
        self.part, self.window, self.most, self.made = part, window, open_windows, 0
        self.open: list[list] = []  # [fill, pieces]
        self.closed: list[list] = []

    def place(self, piece: list) -> None:
        while piece:
            n = len(piece[2]) // 4
            fits = [w for w in self.open if self.window - w[0] >= n]
            if n >= self.window or (not fits and len(self.open) < self.most):
                head, piece = cut(piece, self.window)
                into = [0, []]
                self.open.append(into)
            elif fits:
                into, head, piece = max(fits, key=lambda w: w[0]), piece, None
            else:
                into = max(self.open, key=lambda w: w[0])
                head, piece = cut(piece, self.window - into[0])
            into[0] += len(head[2]) // 4
            into[1].append(head)
            if into[0] == self.window:
                self.closed.append(into[1])
                self.open = [w for w in self.open if w is not into]

    def rows(self, windows: list[list], left: bool, keep_ids: bool) -> list[tuple]:
        out = []
        for pieces in windows:
            at, fill, name = 0, sum(len(p[2]) // 4 for p in pieces), (self.part << 32) + self.made
            self.made += 1
            for doc_id, start, ids, total in pieces:
                n = len(ids) // 4
                out.append((doc_id, start, n, zlib.crc32(ids), total, name, at, ids if left or keep_ids else None, self.part if left else None, fill))
                at += n
        return out


def cut(piece: list, n: int) -> tuple[list, list | None]:
    doc_id, start, ids, total = piece
    if len(ids) // 4 <= n:
        return piece, None
    return [doc_id, start, ids[: 4 * n], total], [doc_id, start + n, ids[4 * n :], total]


def powers(n: int) -> list[int]:
    """n as falling powers of two."""
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


def merged(pieces: list[list], window: int) -> list[list]:
    """Windows of the given pieces in order: full ones, then powers of two."""
    total = sum(len(p[2]) // 4 for p in pieces)
    out, at = [], 0
    for size in [window] * (total // window) + powers(total % window):
        own = []
        while size:
            head, rest = cut(pieces[at], size)
            own.append(head)
            size -= len(head[2]) // 4
            if rest:
                pieces[at] = rest
            else:
                at += 1
        out.append(own)
    return out


def pack(docs: DataFrame, window: int = 2048, open_windows: int = 8, merge_parts: int = 16, keep_ids: bool = False, vocabulary: str | None = None) -> DataFrame:
    """One row per piece, with its ids (little-endian unsigned 32-bit) if keep_ids."""
    path = vocabulary or vocabulary_path("word_bpe_49k.json")

    def run(batches):
        packer, encoder = Packer(partition_id(), window, open_windows), word_bpe(path)
        for batch in slices(batches, 4096):  # words are looked up once for each
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, ids in zip(names, encoder.encode([x or "" for x in texts]), strict=True):
                packer.place([doc_id, 0, ids + END, len(ids) // 4 + 1])
            yield to_batch(packer.rows(packer.closed, False, keep_ids))
            packer.closed = []
        yield to_batch(packer.rows([w[1] for w in sorted(packer.open, key=lambda w: -w[0])], True, keep_ids))
        encoder.forget()  # a worker keeps the vocabulary from task to task, but not the words of its texts

    def merge(key, frame):
        frame = frame.sort_values(["part", "sequence_id", "offset"], kind="stable")
        first = int(frame["part"].min())
        windows = {}
        for r in frame.itertuples(index=False):
            windows.setdefault((-r.fill, r.sequence_id), []).append([None if r.doc_id != r.doc_id or r.doc_id is None else int(r.doc_id), int(r.start), r.ids, int(r.doc_tokens)])
        packer = Packer(first, window, open_windows)
        packer.made = 1 << 31
        rows = packer.rows(merged([p for k in sorted(windows) for p in windows[k]], window), False, True)
        return to_batch(rows).to_pandas()[[f for f, _ in FIELDS[:8]]].astype({"doc_id": "Int64"})

    columns = SCHEMA + ", part long, fill long"
    placed = stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(run), columns), "pack")
    left = placed.where("part is not null")
    return placed.where("part is null").drop("part", "fill").unionByName(
        left.groupBy(F.floor(F.col("part") / merge_parts).alias("of")).applyInPandas(merge, SCHEMA)
    )


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, FIELDS, strict=True)], names=[n for n, _ in FIELDS])

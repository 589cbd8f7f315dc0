"""Removal of byte strings that also start elsewhere, decided by suffix arrays of shards.

Every string of `length` bytes has an anchor: of its substrings of `anchor` bytes the leftmost one of smallest hash.  Neighbouring
strings with one anchor, in the front half or in the back half of where it can be, form a span.  All strings of such a half
contain the anchor and, before or behind it, half as much again as it can move; the hash of these common bytes is the span's
key.  So equal strings lie in spans of one key, and spans whose key occurs once hold nothing repeated.  Spans that are equal as
a whole are repeated as a whole.  Different spans of one key are text for a suffix array: keys are dealt to shards, each shard's
array is induced, and the permuted common prefixes show which strings also start elsewhere.  Before that, spans are cut to those
of their eighths whose common bytes another span of the key has too.  A key with more than `most` different spans is halved
again before it is dealt, and so on down to single strings; halves whose key occurs once drop out.

Counts are aggregated before they are shuffled, and no step needs all spans of a frequent anchor in one task.  Whole spans count
as equal by two 64-bit hashes, of which one is of all their bytes.

With `words`, strings of so many words are found too, whatever their bytes: they go the same way, as a second kind, over letters
that are 32-bit hashes of words, but the few strings of spans that share a key are compared as they are.  They are removed, or
only counted with `cut_words` off.

Nulls: a null text counts as empty.  A row is known by its doc_id (or none) and its text's hash, so repeated rows count as
copies and each gets its own answer.  Texts shorter than `length` are left alone.  Kept bytes may end within a character;
`kept_text` leaves such pieces out.  An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, slices, stored, tidied
from .suffix_array import repeated_starts

CHUNK = 1 << 17
MULTIPLIER = 0x9E3779B97F4A7C15
PLACE = (1 << 24) - 1


class Kind(NamedTuple):
    """Strings of `length` letters of `size` bytes of what `view` makes of a text, and their anchors.  Keys of a second kind are negative."""

    length: int
    anchor: int
    size: int = 1
    view: Callable[[bytes], bytes] = bytes


#: A span: strings that start at at .. at + more of the row (d, h); its anchor is `inner` bytes after the first start.
SPAN = "key long, span long, d long, h long, at long, more int, inner int"


def row_key() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63) + 1)).alias("d"), F.xxhash64(F.col("text").cast("string")).alias("h")]


def halved(low: int, high: int) -> list[tuple[int, int]]:
    """Where an anchor can be, low .. high bytes behind a start, as two such ranges (or one of a single place)."""
    middle = (low + high) // 2
    return [(low, middle), (middle + 1, high)] if low < high else [(low, high)]


class Anchors:
    def __init__(self, length: int, anchor: int, size: int = 1):
        self.length, self.anchor, self.size, self.choices = length, anchor, size, length - anchor + 1
        self.parts = np.array(halved(0, self.choices - 1))
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.full(CHUNK + length, MULTIPLIER, np.uint64))
            self.down = np.cumprod(np.full(CHUNK + length, pow(MULTIPLIER, -1, 2**64), np.uint64))

    def pieces(self, texts: list[bytes]):
        """(text, offset, bytes) with every string of each text in exactly one piece."""
        for k, text in enumerate(texts):
            for at in range(0, len(text) // self.size - self.length + 1, CHUNK // 2):
                yield k, at, text[self.size * at : self.size * (at + CHUNK // 2 + self.length - 1)]

    def spans(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Columns text, key, span, at, more, inner."""
        out, held, size = [], [], 0
        for piece in self.pieces(texts):
            if held and size + len(piece[2]) > CHUNK * self.size:
                out.append(self.chunk(held))
                held, size = [], 0
            held.append(piece)
            size += len(piece[2])
        if held:
            out.append(self.chunk(held))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(6))

    def chunk(self, held: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
        joined = b"".join(x[2] for x in held)
        n, k, w = len(joined) // self.size, self.anchor, self.choices
        own = np.frombuffer(joined, np.uint8 if self.size == 1 else np.uint32).astype(np.uint64) + np.uint64(1)
        own *= self.up[:n]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own)])
        h = mixed((sums[k:] - sums[:-k]) * self.down[: n - k + 1])
        value = (h & ~np.uint64(PLACE)) | np.arange(len(h), dtype=np.uint64)
        full = -(-len(value) // w) * w
        block = np.full(full + w, np.iinfo(np.uint64).max, np.uint64)
        block[: len(value)] = value
        block = block.reshape(-1, w)
        front = np.minimum.accumulate(block, 1).ravel()
        back = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1].ravel()
        starts = len(value) - w + 1
        least = (np.minimum(back[:starts], front[w - 1 : w - 1 + starts]) & np.uint64(PLACE)).astype(np.int64)
        sizes = np.fromiter((len(x[2]) // self.size for x in held), np.int64, len(held))
        begin = np.cumsum(sizes) - sizes
        good = np.ones(n, bool)  # starts whose string lies in one piece
        for e in (begin + sizes).tolist():
            good[e - self.length + 1 : e] = False
        good = np.flatnonzero(good[:starts])
        least = least[good]
        back_half = least - good > self.parts[0][1]
        first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (back_half[1:] != back_half[:-1])]))
        last = np.append(first[1:], len(least)) - 1
        a, b, anchor, low, high = good[first], good[last], least[first], *self.parts[back_half[first].astype(int)].T
        common = anchor - low  # all strings of the span contain what is from here to anchor - high + length
        key = mixed((sums[anchor - high + self.length] - sums[common]) * self.down[common] + low.astype(np.uint64))
        view, digest = memoryview(joined), xxhash.xxh64_intdigest
        span = np.fromiter((digest(view[x:y]) for x, y in zip((self.size * a).tolist(), (self.size * (b + self.length)).tolist(), strict=True)), np.uint64, len(a)).view(np.int64)
        piece = np.searchsorted(begin, a, "right") - 1
        text, offset = (np.fromiter((x[i] for x in held), np.int64, len(held))[piece] for i in (0, 1))
        return text, key.view(np.int64), span, a - begin[piece] + offset, b - a, anchor - a


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def to_batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def all_spans(docs: DataFrame, kinds: tuple[Kind, ...]) -> DataFrame:
    def run(batches):
        finders = [Anchors(x.length, x.anchor, x.size) for x in kinds]
        for batch in slices(batches, 1024):
            d, h = (np.asarray(batch.column(i)) for i in (0, 1))
            texts = [x or b"" for x in batch.column(2).to_pylist()]
            for sign, (kind, find) in enumerate(zip(kinds, finders, strict=True)):
                text, key, span, at, more, inner = find.spans(list(map(kind.view, texts)))
                yield to_batch(SPAN, [signed(key, sign), span, d[text], h[text], at, more, inner])

    return docs.select(*row_key(), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(tidied(run), SPAN)


def signed(key, kind: int):
    return key & (2**63 - 1) | -(2**63) * kind


TEXT_SPAN = SPAN + ", copies long, low int, high int, bytes binary"


def with_text(docs: DataFrame, wanted: DataFrame, kinds: tuple[Kind, ...]) -> DataFrame:
    """The bytes of wanted spans."""
    asked = wanted.groupBy("d", "h").agg(F.collect_list(F.struct("key", "span", "at", "more", "inner", "copies")).alias("asked"))
    rows = docs.select(*row_key(), F.col("text").cast("string").cast("binary").alias("text")).join(asked, ["d", "h"])
    parts = [halved(0, x.length - x.anchor) for x in kinds]

    def found(batches):
        for batch in slices(batches, 64, 1 << 18):
            for d, h, text, own in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                views = {}
                for x in own:
                    k = int(x["key"] < 0)
                    if k not in views:
                        views[k] = kinds[k].view(text)
                    size, end = kinds[k].size, x["at"] + x["more"] + kinds[k].length
                    yield x["key"], x["span"], d, h, x["at"], x["more"], x["inner"], x["copies"], *parts[k][x["inner"] > parts[k][0][1]], views[k][size * x["at"] : size * end]

    return rows.mapInArrow(tidied(lambda batches: span_batches(found(batches))), TEXT_SPAN)


#: Bytes of spans that leave a worker at once: spans overlap, and together have many times the bytes of their texts.
AT_ONCE = 1 << 20


def span_batches(spans):
    """Record batches of spans, of about AT_ONCE bytes each."""
    out, size = [], 0
    for x in spans:
        out.append(x)
        size += len(x[-1]) + 80
        if size >= AT_ONCE:
            yield to_batch(TEXT_SPAN, list(zip(*out, strict=True)))
            out, size = [], 0
    yield to_batch(TEXT_SPAN, list(zip(*out, strict=True)) or [[]] * 11)


INTERVAL = "d long, h long, at long, until long, kind int"


def refined(group: list, length: int, times: int = 3) -> list:
    """Of a key's spans (d, h, at, copies, inner, low, high, bytes): (d, h, at, copies, bytes) of the parts that another one may repeat."""
    seen, every = Counter(), []
    for _, _, _, _, inner, low, high, text in group:
        ranges = [(low, high)]
        for _ in range(times):
            ranges = [y for x in ranges for y in halved(*x)]
        own = [(a, text[inner - a : inner - b + length], max(0, inner - b), min(len(text) - length, inner - a)) for a, b in ranges]
        own = [x for x in own if x[2] <= x[3]]
        seen.update(x[:2] for x in own)
        every.append(own)
    out = []
    for (d, h, at, copies, *_, text), own in zip(group, every, strict=True):
        own = [x for x in own if seen[x[:2]] > 1]
        if own:
            first, last = min(x[2] for x in own), max(x[3] for x in own)
            out.append((d, h, at + first, copies, text[first : last + length]))
    return out


def cut_at_gaps(starts: list[int]) -> list[tuple[int, int]]:
    """Runs of rising starts: (first, last)."""
    out: list[tuple[int, int]] = []
    for x in starts:
        out[-1:] = [(out[-1][0], x)] if out and out[-1][1] == x - 1 else [*out[-1:], (x, x)]
    return out


def of_words(group: list, kind: Kind) -> list:
    """Of a key's spans (d, h, at, copies, inner, low, high, bytes): intervals of strings that stand in two of them."""
    wide, size = kind.length * kind.size, kind.size
    strings = [{row[7][i : i + wide]: i // size for i in range(0, len(row[7]) - wide + 1, size)} for row in group]
    seen = Counter(x for own in strings for x in own)
    return [(d, h, at + a, at + b + kind.length, 1) for (d, h, at, copies, *_), own in zip(group, strings, strict=True) if copies == 1 for a, b in cut_at_gaps([i for x, i in own.items() if seen[x] > 1])]


def by_suffix_arrays(rows: DataFrame, kinds: tuple[Kind, ...], shard: int) -> DataFrame:
    """Intervals of repeated strings.  A task's keys go into suffix arrays of about `shard` bytes; strings of words are compared as they are."""

    def solve(held: list) -> list:
        out, length = [], kinds[0].length
        for (d, h, at, copies, text), starts in zip(held, repeated_starts([x[4] for x in held], length), strict=True):
            if copies == 1 and len(starts):  # those with copies are removed as they are
                cuts = np.flatnonzero(np.diff(starts) > 1)
                out += [(d, h, at + a, at + b + length, 0) for a, b in zip(starts[np.append(0, cuts + 1)].tolist(), starts[np.append(cuts, len(starts) - 1)].tolist(), strict=True)]
        return out

    def groups(batches):
        before, span, group = None, None, []
        for batch in slices(batches, 1024):
            for key, own, *row in zip(*(batch.column(i).to_pylist() for i in range(10)), strict=True):
                if key != before:
                    if group:
                        yield before, group
                    before, span, group = key, None, []
                if own != span:
                    group.append(row)
                    span = own
        if group:
            yield before, group

    def run(batches):
        held, size, found = [], 0, []
        for key, group in groups(batches):
            if key < 0:
                found += of_words(group, kinds[1])
            else:
                held += (new := refined(group, kinds[0].length))
                size += sum(len(x[4]) for x in new)
            if size >= shard:
                found += solve(held)
                held, size = [], 0
            if len(found) > 10_000:
                yield to_batch(INTERVAL, list(zip(*found, strict=True)))
                found = []
        found += solve(held) if held else []
        yield to_batch(INTERVAL, list(zip(*found, strict=True)) or [[]] * 5)

    rows = rows.select("key", "span", "d", "h", "at", "copies", "inner", "low", "high", "bytes")
    return rows.repartition("key").sortWithinPartitions("key", "span").mapInArrow(tidied(run), INTERVAL)


def halves(rows: DataFrame, kinds: tuple[Kind, ...]) -> DataFrame:
    """Each span as its strings with an anchor in the front and in the back half of where it can be."""

    def found(batches):
        digest = lambda x, seed: int(np.uint64(xxhash.xxh64_intdigest(x, seed)).view(np.int64))
        for batch in slices(batches):
            for key, _, d, h, at, more, inner, copies, low, high, text in zip(*(batch.column(i).to_pylist() for i in range(11)), strict=True):
                kind = kinds[key < 0]
                for a, b in halved(low, high):
                    # Starts of strings whose anchor is a .. b letters behind them.
                    first, last = max(0, inner - b), min(more, inner - a)
                    if first <= last:
                        common = text[kind.size * (inner - a) : kind.size * (inner - b + kind.length)]
                        part = text[kind.size * first : kind.size * (last + kind.length)]
                        yield signed(digest(common, a + 1), int(key < 0)), digest(part, 0), d, h, at + first, last - first, inner - first, copies, a, b, part

    return rows.mapInArrow(tidied(lambda batches: span_batches(found(batches))), TEXT_SPAN)


def intervals(rows: DataFrame, kinds: tuple[Kind, ...]) -> DataFrame:
    length = F.when(F.col("key") < 0, kinds[-1].length).otherwise(kinds[0].length)
    return rows.select("d", "h", "at", (F.col("at") + F.col("more") + length).alias("until"), (F.col("key") < 0).cast("int").alias("kind"))


def repeated(docs: DataFrame, kinds: tuple[Kind, ...], most: int, shard: int) -> DataFrame:
    """d, h, at, until, kind: all repeated strings of a kind lie in these intervals of its view, and nothing else."""
    spans = stored(all_spans(docs, kinds), "spans")
    keys = spans.groupBy("key").agg(F.count("*").alias("total"), (F.min("span") != F.max("span")).alias("mixed")).where("total > 1").drop("total")
    # Written first, so that both sides of the join are plain tables and the tasks of a frequent key can be split.
    keys = stored(keys, "keys")
    again = stored(spans.join(keys, "key"), "spans-again")
    discard(spans)
    found = [intervals(again.where("not mixed"), kinds)]
    varied = again.where("mixed").drop("mixed")
    # Each `first` is that of the same row, and what is written is fixed; on plain columns it aggregates by hash.
    one = [F.first(x).alias(x) for x in ("d", "h", "at", "more", "inner")]
    spans_of = stored(varied.groupBy("key", "span").agg(F.count("*").alias("copies"), *one), "kinds")
    # A query of its own: next to other exchanges the tasks of a frequent span are not split.
    found.append(stored(intervals(varied.join(spans_of.where("copies > 1").select("key", "span"), ["key", "span"]), kinds), "copied"))
    rows = stored(with_text(docs, spans_of, kinds), "span-texts")
    while True:
        large = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("key")
        found.append(by_suffix_arrays(rows.join(large, "key", "left_anti"), kinds, shard))
        large = stored(large, "large")
        if large.isEmpty():
            break
        parts = stored(halves(rows.join(large, "key"), kinds), "halves")
        keys = parts.groupBy("key").agg(F.sum("copies").alias("total"), (F.min("span") != F.max("span")).alias("mixed")).where("total > 1").select("key", "mixed")
        same = parts.groupBy("key", "span").agg(F.sum("copies").alias("n"), *[F.first(x).alias(f"{x}_1") for x in ("d", "h", "at")])
        keys, same = stored(keys, "keys"), stored(same, "same")
        parts = stored(parts.join(keys, "key").join(same, ["key", "span"]), "halves-again")
        found.append(intervals(parts.where("n > 1 and copies = 1"), kinds))
        rows = parts.where("mixed and d = d_1 and h = h_1 and at = at_1").select(*[F.col("n").alias("copies") if x == "copies" else F.col(x) for x in [y.split()[0] for y in TEXT_SPAN.split(", ")]])
        rows = stored(rows, "span-texts")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    out = stored(out, "repeated")
    discard(again)
    return out


#: A passage of more than fifty words.
PASSAGE = 51


SPACE = np.zeros(256, bool)
SPACE[list(b" \t\n\r\f\v")] = True
UP = np.cumprod(np.full(CHUNK, MULTIPLIER, np.uint64))
DOWN = np.cumprod(np.full(CHUNK, pow(MULTIPLIER, -1, 2**64), np.uint64))


PART = re.compile(rb"[\s\S]{1,%d}(?=\s|\Z)|\S+" % CHUNK)


def word_ids(text: bytes) -> bytes:
    """The text's words as 32-bit hashes.  Texts are taken in parts of whole words, of which a longer one is hashed for itself."""
    if len(text) <= CHUNK:
        return hashed_words(text)
    return b"".join(hashed_words(x[0]) if len(x[0]) <= CHUNK else xxhash.xxh32_digest(x[0]) for x in PART.finditer(text))


def hashed_words(text: bytes) -> bytes:
    gap = np.ones(len(text) + 2, np.int8)
    gap[1:-1] = SPACE[np.frombuffer(text, np.uint8)]
    edge = np.diff(gap)
    first, last = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((np.frombuffer(text, np.uint8) + np.uint64(1)) * UP[: len(text)], out=sums[1:])
    return (mixed((sums[last] - sums[first]) * DOWN[first]) >> np.uint64(32)).astype(np.uint32).tobytes()


def word_bytes(text: bytes, own: list | None) -> list[dict]:
    """Intervals of word numbers as such of bytes."""
    if not own:
        return []
    at = [m.span() for m in re.finditer(rb"[^ \t\n\r\f\v]+", text)]
    return [{"at": at[x["at"]][0], "until": at[x["until"] - 1][1]} for x in own]


ANSWER = "n_bytes long, n_removed long, n_spans long, n_passage_words long, kept binary, spans array<struct<at: long, until: long>>"
SPANS = pa.list_(pa.struct([("at", pa.int64()), ("until", pa.int64())]))


def merged(own: list | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((x["at"], x["until"]) for x in own or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = 400, anchor: int = 64, most: int = 512, shard: int = 1 << 19, also: tuple[str, ...] = (), words: int | None = None, cut_words: bool = True) -> DataFrame:
    """doc_id, the columns named in `also`, and n_bytes, n_removed, n_spans, n_passage_words (with `words`), kept (bytes), spans (what is removed).

    What is removed are strings of `length` bytes that start elsewhere too and, with `words`, such of so many words unless
    cut_words is off.  n_passage_words is the number of words in the latter.
    """
    kinds = (Kind(length, anchor), *([Kind(words, min(8, words), 4, word_ids)] if words is not None else []))
    of = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.struct("at", "until")))
    found = repeated(docs, kinds, most, shard).distinct().groupBy("d", "h").agg(of(0).alias("own"), of(1).alias("own_words"))
    known = docs.select(*row_key(), F.struct(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(x) for x in also)).alias("row"), F.col("text").cast("string").cast("binary").alias("text"))
    joined = known.join(found, ["d", "h"], "left").select("row", "text", "own", "own_words")

    def run(batches):
        for batch in slices(batches):
            texts, kept = [x or b"" for x in batch.column(1).to_pylist()], []
            by_byte, by_word = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            removed = [merged([*(a or ()), *(word_bytes(t, b) if cut_words else ())]) for t, a, b in zip(texts, by_byte, by_word, strict=True)]
            passages = [None if words is None else sum(b - a for a, b in merged(x)) for x in by_word]
            for text, own in zip(texts, removed, strict=True):
                at = [0, *[b for _, b in own]]
                kept.append(b"".join(text[a:b] for a, b in zip(at, [*[a for a, _ in own], len(text)], strict=True)) if own else text)
            columns = [[len(x) for x in texts], [sum(b - a for a, b in x) for x in removed], [len(x) for x in removed], passages]
            spans = pa.array([[{"at": a, "until": b} for a, b in x] for x in removed], SPANS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns], pa.array(kept, pa.binary()), spans], names=["row", "n_bytes", "n_removed", "n_spans", "n_passage_words", "kept", "spans"])

    row = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(tidied(run), f"row {row}, {ANSWER}").select("row.*", "n_bytes", "n_removed", "n_spans", *(["n_passage_words"] if words is not None else []), "kept", "spans")


def kept_text(kept: Column) -> Column:
    """Kept bytes as text, without pieces of characters."""
    return F.replace(F.make_valid_utf8(kept.cast("string")), F.lit("\ufffd"), F.lit(""))

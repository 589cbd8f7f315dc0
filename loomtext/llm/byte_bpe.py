"""Byte-level BPE encoding and decoding by a table of ranks.

`fold` is the merge loop in Spark's higher-order functions: over a word's array of byte pieces it repeatedly joins the pair of
lowest rank, by a literal rank map, until no pair has a rank.  It runs on the distinct frequent words of the whole corpus; the
resulting dictionary has a bounded size and is broadcast.  Texts are then split and looked up in Arrow batches, where the rare
words are merged by the same ranks: joining the ids of all distinct words back to their places in the texts would shuffle the
corpus twice.  Decoding concatenates the binary pieces of the ids.

Nulls: a null text counts as empty and has no ids.  Any valid Unicode text decodes to its own bytes.  Equal rows get equal
answers.  Other columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import base64
import json
import uuid
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicon
from .common import slices, stored
from .subwords import vocabulary_path

BUCKETS = 1 << 14


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def public_pattern() -> str:
    import importlib

    from .common import TOKENIZER_PACKAGE

    return importlib.import_module(TOKENIZER_PACKAGE).PATTERN


def rank_map(ranks: dict[bytes, int]) -> Column:
    """A literal array of small maps from hexadecimal pieces to ranks, by the pieces' hash: a map is searched from end to end."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        name = piece.hex().upper()
        buckets[xxhash.xxh64_intdigest(name, 42) % BUCKETS][name] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string, int>>")


def fold(word: Column, ranks: dict[bytes, int]) -> Column:
    """The ids of a word, a binary column, as array<int>."""
    table = rank_map(ranks)
    # The signed hash's remainder is that of the unsigned one, as the number of buckets is a power of two.
    rank = lambda h: F.try_element_at(F.get(table, F.pmod(F.xxhash64(h), F.lit(BUCKETS)).cast("int")), h)
    bound = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))  # noqa: E731  evaluates value once

    def step(parts: Column) -> Column:
        pairs = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda right, i: rank(F.concat(F.get(parts, i), right)))

        def merge(found: Column) -> Column:
            at = F.array_position(found, F.array_min(found)).cast("int")
            joined = F.concat(F.get(parts, at - 1), F.get(parts, at))
            rest = F.slice(parts, at + 2, F.greatest(F.size(parts) - at - 1, F.lit(0)))
            return F.when(F.array_min(found).isNull(), parts).otherwise(F.concat(F.slice(parts, F.lit(1), at - 1), F.array(joined), rest))

        return bound(pairs, merge)

    n = F.octet_length(word)
    single = F.transform(F.sequence(F.lit(1), n), lambda i: F.hex(F.substring(word, i, F.lit(1))))
    parts = F.aggregate(F.sequence(F.lit(1), n), single, lambda p, _: step(p))
    return F.when(n > 0, F.transform(parts, rank)).otherwise(F.array().cast("array<int>"))


def splitter(pattern: str):
    """White space as Unicode has it, as the library does."""
    import regex

    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def frequent(docs: DataFrame, ranks: dict[bytes, int], pattern: str, words: int, longest: int = 64) -> dict[str, bytes]:
    """Ids of the corpus's most frequent words, `words` of them at most."""
    state: list = []

    def split(texts):
        if not state:
            state.append(splitter(pattern).findall)
        return [[w.encode() for w in state[0](t or "")] for t in texts]

    counts = stored(lexicon.count(docs.select(F.col("text").cast("string")), split), "words")
    some = lexicon.head(counts.where(F.octet_length("word") <= longest), words)
    return {bytes(r.word).decode(): array("I", r.ids).tobytes() for r in some.select("word", fold(F.col("word"), ranks).alias("ids")).collect()}


_CODERS: dict = {}


class Coder:
    def __init__(self, ranks: dict[bytes, int], pattern: str, known: dict[str, bytes], cached: int):
        import tiktoken

        self.find, self.known, self.own, self.cached = splitter(pattern).findall, known, {}, cached
        # A word is a match of the pattern, so the library merges it as a whole.
        self.merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> bytes:
        known, own, out = self.known, self.own, []
        for word in self.find(text):
            ids = known.get(word) or own.get(word)
            if ids is None:
                ids = own[word] = array("I", self.merge(word)).tobytes()
            out.append(ids)
        if len(own) > self.cached:
            own.clear()
        return b"".join(out)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, words: int = 100_000, cached: int = 150_000) -> DataFrame:
    """doc_id, ids: little-endian unsigned 32-bit integers."""
    ranks, pattern = load_ranks(path or vocabulary_path("byte_bpe_multi_50k.tiktoken")), pattern or public_pattern()
    name = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast((ranks, frequent(docs, ranks, pattern, words)))

    def run(batches):
        if name not in _CODERS:
            _CODERS.clear()
            _CODERS[name] = Coder(shared.value[0], pattern, shared.value[1], cached)
        coder = _CODERS[name]
        for batch in slices(batches):
            ids = [coder.encode(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, decoded: the concatenated pieces."""
    shared = encoded.sparkSession.sparkContext.broadcast({i: p for p, i in load_ranks(path or vocabulary_path("byte_bpe_multi_50k.tiktoken")).items()})

    def run(batches):
        piece = shared.value.__getitem__
        for batch in slices(batches):
            texts = [b"".join(map(piece, np.frombuffer(x or b"", "<u4").tolist())) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")

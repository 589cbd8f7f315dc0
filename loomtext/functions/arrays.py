"""Array functions for token sequences and position ids.

Over-long arrays are cut in the middle or passed through as stated; nulls give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

IGNORED = -100  # fixed value: a label that no loss counts


def spread(n: Column | int) -> Column:
    """0 .. n - 1, empty for n = 0."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n > 0, F.sequence(F.lit(0).cast("int"), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def chunks(tokens: Column, n: int) -> Column:
    """Pieces of n tokens, the last may be shorter."""
    return once(lambda t: F.transform(spread(F.ceil(F.size(t) / n)), lambda i: F.slice(t, i * n + 1, F.lit(n))), tokens)


def head_tail(items: Column, head: int, tail: int) -> Column:
    """The first and last items; all, once each, if there are no more."""
    return F.filter(items, lambda x, i: (i < head) | (i >= F.size(items) - tail))


def middle_cut(tokens: Column, most: Column | int) -> Column:
    """Over-long arrays keep most // 2 at the front and the rest of `most`, rounded up, at the back."""
    most = F.lit(most) if isinstance(most, int) else most
    head = F.floor(most / 2).cast("int")
    tail = (most - head).cast("int")
    return F.when(F.size(tokens) <= most, tokens).otherwise(F.concat(F.slice(tokens, F.lit(1), head), F.slice(tokens, F.size(tokens) - tail + 1, tail)))


def prompt_cut(tokens: Column, longest: int, answer: int, spare: int = 100) -> Column:
    """Prompts keep as many tokens at either end as half of what answer and spare leave."""
    half = int((longest - answer - spare) / 2)
    return F.when(F.size(tokens) <= 2 * half, tokens).otherwise(F.concat(F.slice(tokens, 1, half), F.slice(tokens, F.size(tokens) - half + 1, F.lit(half))))


def pad(tokens: Column, length: Column | int, value: int = 0) -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(tokens, F.array_repeat(F.lit(value), F.greatest(length - F.size(tokens), F.lit(0)).cast("int")))


def pad_with_mask(tokens: Column, length: Column | int, value: int = 0) -> Column:
    """struct(ids, mask)."""
    return F.struct(pad(tokens, length, value).alias("ids"), pad(F.transform(tokens, lambda _: F.lit(1)), length).alias("mask"))


def masked_labels(prompt: Column, answer: Column, value: int = IGNORED) -> Column:
    """Labels of a prompt and its answer: only the answer counts."""
    return F.concat(F.transform(prompt, lambda _: F.lit(value)), answer)


def replaced(items: Column, target: Column, value: Column) -> Column:
    return F.transform(items, lambda x: F.when(x == target, value).otherwise(x))


def positions(n: Column, length: Column, key: Column, seed: int = 0) -> Column:
    """n ids in a row, from a start below length - n that the key draws; 0 if n = length."""
    free = length - n
    start = F.when(free > 0, F.pmod(F.xxhash64(key, F.lit(seed)), F.greatest(free, F.lit(1)))).otherwise(F.lit(0)).cast("int")
    return F.transform(spread(n), lambda i: start + i)


def covering_starts(n: Column, length: Column) -> Column:
    """Starts of the ceil(length / n) windows of n that cover length, as even as integers are; error if n > length."""
    k = F.ceil(length / n).cast("int")
    starts = F.transform(spread(k), lambda i: F.floor(i * (length - n) / F.greatest(k - 1, F.lit(1))).cast("int"))
    return F.when(n > length, F.raise_error("window longer than length").cast("array<int>")).otherwise(starts)


def covering_positions(n: Column, length: Column) -> Column:
    """The ids of each covering window."""
    return F.transform(covering_starts(n, length), lambda s: F.sequence(s, (s + n - 1).cast("int")))


def chunk_layout(n_chunks: Column, longest: Column, system: Column, qa: Column) -> Column:
    """Begin and beacon position of each chunk in the span that system and question leave: array<struct<begin, beacon>>."""
    width = F.floor((longest - system - qa) / F.greatest(n_chunks, F.lit(1))).cast("int")
    return F.transform(spread(n_chunks), lambda i: F.struct((system + i * width).cast("int").alias("begin"), (system + (i + 1) * width - 1).cast("int").alias("beacon")))


def chunk_positions(size: Column, begin: Column, width: Column, sparse: Column) -> Column:
    """Ids of a chunk's tokens: in a row from begin, or spread over the width."""
    return F.transform(spread(size), lambda i: (begin + F.when(sparse, F.floor(i * (width - 1) / F.greatest(size - 1, F.lit(1)))).otherwise(i)).cast("int"))


def is_sparse(key: Column, tenths: int = 1) -> Column:
    """One key in ten by default."""
    return F.pmod(F.xxhash64(key), F.lit(10)) < tenths


def qa_positions(question: Column, last: Column, size: Column, special: int = 1) -> Column:
    """struct(question, answer): ids after `last`; the answer's start after the special tokens and fill what the question leaves of size."""
    n = F.size(question)
    ask = F.transform(spread(n), lambda i: (last + 1 + i).cast("int"))
    room = F.greatest(size - n, F.lit(0))
    return F.struct(ask.alias("question"), F.transform(spread(room), lambda i: (last + 1 + n + special + i).cast("int")).alias("answer"))


def beacons(chunk: int, total: Column, system: Column) -> Column:
    """Every (chunk + 1)-th place from chunk on, behind the system part."""
    return F.when(total > chunk, F.transform(F.sequence(F.lit(chunk), F.greatest(total - 1, F.lit(chunk)).cast("int"), F.lit(chunk + 1)), lambda p: (p + system).cast("int"))).otherwise(F.array().cast("array<int>"))


def assembled(system: Column, references: Column, question: Column, places: Column) -> Column:
    """struct(input_ids, attention_mask, position_ids) of system, references and question in a row."""
    ids = F.concat(system, F.flatten(references), question)
    return F.struct(ids.alias("input_ids"), F.transform(ids, lambda _: F.lit(1)).alias("attention_mask"), places.alias("position_ids"))


def answer_struct(prompt: Column, answer: Column, places: Column) -> Column:
    return F.struct(answer.alias("input_ids"), F.transform(answer, lambda _: F.lit(1)).alias("attention_mask"), masked_labels(prompt, answer).alias("labels"), places.alias("position_ids"))


def combinations(lists: Column) -> Column:
    """The product of an array of arrays, as rows to explode."""
    kind = "array<array<int>>"
    return F.aggregate(lists, F.array(F.array().cast("array<int>")).cast(kind), lambda done, own: F.flatten(F.transform(done, lambda d: F.transform(own, lambda x: F.concat(d, F.array(x))))))


def drawn(items: Column, n: int, key: Column, seed: int = 0) -> Column:
    """n of the items without replacement, by hash, in their order; all if there are no more."""
    numbered = F.transform(items, lambda x, i: F.struct(F.xxhash64(key, i, F.lit(seed)).alias("h"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(F.transform(F.slice(F.array_sort(numbered), 1, n), lambda s: F.struct(s.i, s.x))), lambda s: s.x)


def zipped(*arrays: Column) -> Column:
    return F.arrays_zip(*arrays)


def every_other(items: Column, first: int) -> Column:
    return F.filter(items, lambda x, i: (i >= first) & (F.pmod(i - first, F.lit(2)) == 0))


def gold_at(documents: Column, place: int) -> Column:
    """The first gold document moved to a place among the others; without one, as they are."""
    gold = F.filter(documents, lambda d: d.isgold)
    others = F.filter(documents, lambda d: ~d.isgold)
    return F.when(F.size(gold) > 0, F.concat(F.slice(others, 1, place), F.slice(gold, 1, 1), F.slice(others, F.lit(place + 1), F.greatest(F.size(others), F.lit(0))))).otherwise(documents)


def only_gold(documents: Column) -> Column:
    return F.slice(F.filter(documents, lambda d: d.isgold), 1, 1)


def place_of(items: Column, value: Column) -> Column:
    """From 0; -1 if it is missing."""
    return (F.array_position(items, value) - 1).cast("int")


def total_length(arrays: Column) -> Column:
    return F.aggregate(arrays, F.lit(0), lambda n, a: n + F.size(a))


def first_differences(a: Column, b: Column, c: Column, target: int) -> Column:
    """From the first to the last place where any two differ; the last `target` places if none do."""
    n = F.greatest(F.size(a), F.size(b), F.size(c))
    at = F.filter(spread(n), lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i)) | ~F.get(b, i).eqNullSafe(F.get(c, i)) | ~F.get(a, i).eqNullSafe(F.get(c, i)))
    return F.when(F.size(at) > 0, F.sequence(F.array_min(at), F.array_max(at))).otherwise(F.filter(spread(n), lambda i: i >= n - target))


def valid_pairs(pairs: Column, key: Column) -> Column:
    """Whether key-value pairs (structs k, v) are two at least, hold the key, and no key twice."""
    keys = F.transform(pairs, lambda p: p.k)
    return (F.size(pairs) >= 2) & F.array_contains(keys, key) & (F.size(F.array_distinct(keys)) == F.size(keys))

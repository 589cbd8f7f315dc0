"""I-Match fingerprints of whole texts and of an edited copy, in DataFrame functions only.

Terms are runs of letters and digits, lower-cased.  The lexicon is the terms whose document frequency lies in a band, as a
share of all documents: at least `rarest` and at most `commonest`, so that it holds at most (terms a document / rarest) terms
however large the corpus is.  Each of the fingerprint's parts belongs to a randomised subset of the lexicon (a term's hash
decides; a part's subset holds every 16th, 32nd, ... term of it): a text's distinct terms in the lexicon are sorted, and those of
the subset are hashed.  A part without terms is dashes.  The first part is that of the whole lexicon, or of all terms for a
text that has none in the lexicon.

Two fingerprints' likeness is the share of equal parts among the parts that either has, 1 if they are equal.

The next document, in descending doc_id (after the last: the first), comes from a window within ranges of doc_id, of which
each also gets the first document of the next lower range; the only thing collected is one doc_id for each range.  Rows of one
doc_id are ordered by their texts' hash and texts; rows without doc_id come last.

Nulls: a null text counts as empty.  A single document is its own next.  Equal rows each get their answer.  Other columns are
ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A part's subset holds each 2 ** scale-th term of the lexicon.  Short texts have terms in the first parts, long ones share the last.
SCALES = (4,) * 2 + (5,) * 3 + (6,) * 4 + (7,) * 6 + (8,) * 8 + (9,) * 9
EACH = 6  # parts whose bits lie in one hash
#: Each part's hash, and its bits there.
PLACES = [(i // EACH, ((1 << s) - 1) << 10 * (i % EACH)) for i, s in enumerate(SCALES)]
BUCKETS = 1 << 14
DIGITS = 8


def terms(text: Column) -> Column:
    """Distinct terms."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def lexicon(docs: DataFrame, rarest: float, commonest: float) -> list[str]:
    """The terms of the band, without those that stand in one document only."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counts = docs.select(F.explode(terms(text)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    total = docs.count()
    low, high = max(2, rarest * total), max(2, commonest * total)
    return [r.term for r in counts.where(F.col("n").between(low, high)).select("term").collect()]


def literal(value: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def member_table(words: list[str]) -> Column:
    """A literal array of small arrays of words, by the words' hash."""
    buckets: list[list[str]] = [[] for _ in range(BUCKETS)]
    for w in words:  # F.xxhash64 is the same hash, signed; with a power of two the remainder is too
        buckets[xxhash.xxh64_intdigest(w.encode(), 42) % BUCKETS].append(w)
    return literal(buckets, "array<array<string>>")


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), which evaluates value once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def short(words: Column) -> Column:
    return F.lower(F.lpad(F.right(F.hex(F.xxhash64(F.array_join(words, " "))), F.lit(DIGITS)), DIGITS, "0"))


def fingerprint(text: Column, table: Column) -> Column:
    """The fingerprint of a text column that is not null."""
    in_lexicon = lambda t: F.array_contains(F.get(table, F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int")), t)

    def parts(own: Column) -> Column:
        def part(word: int, mask: int) -> Column:
            chosen = F.filter(own, lambda x: x[f"b{word}"].bitwiseAND(F.lit(mask).cast("long")) == 0)
            return F.when(F.size(chosen) > 0, short(F.transform(chosen, lambda x: x.term))).otherwise("-" * DIGITS)

        return F.concat(*[part(*place) for place in PLACES])

    def of(every: Column) -> Column:
        def known(own: Column) -> Column:
            hashed = F.transform(own, lambda t: F.struct(t.alias("term"), *[F.xxhash64(t, F.lit(i)).alias(f"b{i}") for i in range(PLACES[-1][0] + 1)]))
            whole = F.when(F.size(own) > 0, short(own)).otherwise(short(F.array_sort(every)))
            return F.concat(whole, bound(hashed, parts))

        return bound(F.array_sort(F.filter(every, in_lexicon)), known)

    return bound(terms(text), of)


def likeness(a: Column, b: Column) -> Column:
    """Between 0 and 1, of two fingerprints."""
    places = F.sequence(F.lit(1), F.lit(1 + DIGITS * len(SCALES)), F.lit(DIGITS))
    at = lambda x, i: F.substring(x, i, F.lit(DIGITS))
    either = F.filter(places, lambda i: F.greatest(at(a, i), at(b, i)) != "-" * DIGITS)
    equal = F.filter(either, lambda i: at(a, i) == at(b, i))
    return F.when(a == b, 1.0).otherwise(F.size(equal) / F.greatest(F.size(either), F.lit(1)))


def ranges(docs: DataFrame, n: int) -> list[list[int]]:
    """Bounds of about n ranges of doc_id, in groups of equal size (the last may be shorter)."""
    found = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20_000)).first()[0]
    bounds = sorted(set(found or ()))
    each = max(1, round(len(bounds) ** 0.5))
    return [bounds[i : i + each] for i in range(0, len(bounds), each)] or [[]]


def range_of(groups: list[list[int]]) -> Column:
    """0 for null, else 1 + the number of bounds that doc_id exceeds: of whole groups, then within one."""
    exceeded = lambda bounds: F.size(F.filter(bounds, lambda b: F.col("doc_id") > b))
    whole = exceeded(literal([g[-1] for g in groups if g], "array<long>"))
    within = bound(whole, lambda k: k * len(groups[0]) + F.coalesce(exceeded(F.get(literal(groups, "array<array<long>>"), k)), F.lit(0)))
    return F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(1 + within)


def edited(docs: DataFrame, rarest: float = 0.001, commonest: float = 0.1) -> DataFrame:
    """doc_id, n_chars, text, edited, fingerprint, edited_fingerprint, near_edited, near_next."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    table = member_table(lexicon(own, rarest, commonest))
    groups = ranges(own, 4 * max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    number = range_of(groups)
    tops = sorted((r.b, r.m) for r in own.groupBy(number.alias("b")).agg(F.max("doc_id").alias("m")).collect())
    # The highest document of a range goes to the next higher range too, and that of the highest to the lowest.
    size = 2 + len(groups) * len(groups[0])
    highest, above = [None] * size, [None] * size
    for (b, top), (up, _) in zip(tops, tops[1:] + tops[:1], strict=True):
        highest[b], above[b] = top, up
    first = F.col("doc_id").eqNullSafe(F.get(literal(highest, "array<long>"), F.col("range")))
    place = lambda where, copy: F.struct(where.alias("range"), F.lit(copy).alias("copy"))
    here, there = place(F.col("range"), 0), place(F.get(literal(above, "array<int>"), F.col("range")), 1)
    dealt = own.withColumn("range", number).withColumn("fingerprint", fingerprint(F.col("text"), table))
    dealt = dealt.select("doc_id", "text", "fingerprint", F.xxhash64("text").alias("hash"), F.inline(F.when(first, F.array(here, there)).otherwise(F.array(here))))
    order = Window.partitionBy("range").orderBy("copy", F.desc_nulls_last("doc_id"), "hash", "text")
    near = dealt.withColumn("next", F.lead(F.struct("text", "fingerprint")).over(order)).where("copy = 0")
    half = F.floor(F.char_length("text") / 2).cast("int")
    head = F.substring(F.col("text"), F.lit(1), F.char_length("text") - half)
    out = near.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "text", F.concat(head, F.substring(F.col("next.text"), F.lit(1), half)).alias("edited"), "fingerprint", F.col("next.fingerprint").alias("next_fingerprint"))
    out = out.withColumn("edited_fingerprint", fingerprint(F.col("edited"), table))
    return out.select("doc_id", "n_chars", "text", "edited", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))

"""Word counts of a whole corpus, and its most frequent words as a set of bounded size."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices


def count(texts: DataFrame, split: Callable[[list], list[list[bytes]]], held: int = 400_000) -> DataFrame:
    """word binary, n long, of the one column of `texts`.  A task holds `held` distinct words at most before it passes on what it has."""

    def run(batches):
        own: Counter = Counter()
        for batch in slices(batches):
            for words in split(batch.column(0).to_pylist()):
                own.update(words)
            if len(own) > held:
                yield from rows(own)
                own = Counter()
        yield from rows(own)

    def rows(own):
        names, n = list(own), list(own.values())
        for at in range(0, len(n), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(names[at : at + 100_000], pa.binary()), pa.array(n[at : at + 100_000], pa.int64())], names=["word", "n"])

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head(counts: DataFrame, at_most: int) -> DataFrame:
    """The words of the highest counts, `at_most` of them; words of about equal counts are in or out together."""
    step = F.floor(F.log2("n") * 16)
    room, least = at_most, None
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # a few hundred rows at any size
        if r["count"] > room:
            break
        room, least = room - r["count"], r.step
    return counts.where(step >= F.lit(least)) if least is not None else counts.limit(0)

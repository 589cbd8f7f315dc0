"""Critical chunks of a context: chunks that share most terms with a question and its answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import chunks
from ..functions.text import term_set, words


def question_answer_pairs(turns: DataFrame) -> DataFrame:
    """conv_id, turn, question, answer: each user turn with the assistant turn right after it.  One shuffle, no self join."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    after = turns.select("conv_id", "turn", "role", "text", *[F.lead(c).over(order).alias(f"next_{c}") for c in ("turn", "role", "text")])
    return after.where("role = 'user' and next_role = 'assistant' and next_turn = turn + 1").select("conv_id", "turn", F.col("text").alias("question"), F.col("next_text").alias("answer"))


def pairs_of_array(df: DataFrame, messages: str = "conversations") -> DataFrame:
    """The same of an array of messages whose first is the context: questions at places 2, 4, ..., answers after them."""
    from ..functions.arrays import every_other

    return df.withColumn("pair", F.explode(F.arrays_zip(every_other(F.col(messages), 2).alias("question"), every_other(F.col(messages), 3).alias("answer")))).where("pair.question is not null and pair.answer is not null")


def context_chunks(contexts: DataFrame, size: int = 64, key: str = "doc_id", tokenize: Callable[[Column], Column] = words) -> DataFrame:
    """key, chunk_id, tokens."""
    return contexts.select(key, F.posexplode(chunks(tokenize(F.col("text")), size)).alias("chunk_id", "tokens"))


def overlaps(pairs: DataFrame, pieces: DataFrame, terms: Callable[[Column], Column] = term_set) -> DataFrame:
    """conv_id, turn, chunk_id, chunk, overlap: terms that a chunk shares with question or answer.

    Term sets are built before the join, which is an equi-join on the context: the larger a context, the more rows, never a product.
    """
    asked = pairs.select("conv_id", "turn", F.array_union(terms(F.col("question")), terms(F.col("answer"))).alias("asked"))
    own = pieces.select(F.col("doc_id").alias("conv_id"), "chunk_id", F.array_join("tokens", " ").alias("chunk"), F.array_distinct(F.transform("tokens", F.lower)).alias("terms"))
    return asked.join(own, "conv_id").select("conv_id", "turn", "chunk_id", "chunk", F.size(F.array_intersect("asked", "terms")).alias("overlap"))


def top_chunks(scored: DataFrame, k: int = 6) -> DataFrame:
    """The k chunks of highest overlap for each question with their rank rn; ties to the earlier chunk."""
    order = Window.partitionBy("conv_id", "turn").orderBy(F.desc("overlap"), "chunk_id")
    return scored.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)


def with_least(top: DataFrame, least: int = 3) -> DataFrame:
    """Of questions whose chunks all have so much overlap."""
    each = Window.partitionBy("conv_id", "turn")
    return top.withColumn("_least", F.min("overlap").over(each)).where(F.col("_least") >= least).drop("_least")


def strategy(top: DataFrame, name: str, half: int = 3) -> DataFrame:
    """Chunks of a strategy: full (all), half (the first ones) or wrong (the last ones)."""
    if name == "full":
        return top
    if name == "half":
        return top.where(F.col("rn") <= half)
    last = Window.partitionBy("conv_id", "turn").orderBy(F.desc("rn"))
    return top.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= half).drop("_n")


def classified(scored: DataFrame, delta: int | None = 6, k: int = 6) -> DataFrame:
    """critical: overlap above delta, or, without one, among the k highest."""
    if delta is not None:
        return scored.withColumn("critical", F.col("overlap") > delta)
    order = Window.partitionBy("conv_id", "turn").orderBy(F.desc("overlap"), "chunk_id")
    return scored.withColumn("critical", F.row_number().over(order) <= k)


def shared_context(top: DataFrame, joint: str = " \n ") -> DataFrame:
    """conv_id, turn, context: the chunks in document order."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_id", "chunk")))
    return top.groupBy("conv_id", "turn").agg(F.array_join(F.transform(parts, lambda x: x.chunk), joint).alias("context"))


def head_tail_chunks(pieces: DataFrame, head: int = 8, tail: int = 8, key: str = "doc_id") -> DataFrame:
    """The first and last chunks of each context.  Chunks are numbered, so their count tells the last ones."""
    n = F.max("chunk_id").over(Window.partitionBy(key)) + 1
    return pieces.withColumn("_n", n).where((F.col("chunk_id") < head) | (F.col("chunk_id") >= F.col("_n") - tail)).drop("_n")

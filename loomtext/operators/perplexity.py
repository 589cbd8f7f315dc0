"""Perplexity over key tokens: token tables (doc_id, pos, loss_full, loss_short, s, e) and intervals (doc_id, s, e)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_key(gain: float = 2.0, most: float = 2.0) -> Column:
    """Tokens that the long context makes likelier by so much, and likely."""
    return (F.col("loss_short") - F.col("loss_full") > gain) & (F.col("loss_full") < most)


def window_of(trunc: int, sliding: int) -> Column:
    """The sliding window that a token is scored in; null before the first."""
    return F.when(F.col("pos") >= trunc, F.floor((F.col("pos") - trunc) / sliding))


def shifted(tokens: DataFrame) -> DataFrame:
    """target: the token that each place predicts."""
    return tokens.withColumn("target", F.lead("token").over(Window.partitionBy("doc_id").orderBy("pos")))


def merged_intervals(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, s, e: intervals joined where one starts at the end of the one before.  Overlaps alone do not join."""
    order = Window.partitionBy(key).orderBy("s", "e")
    fresh = spans.withColumn("_new", F.coalesce((F.lag("e").over(order) != F.col("s")).cast("int"), F.lit(1)))
    return fresh.withColumn("_island", F.sum("_new").over(order)).groupBy(key, "_island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_island")


def inside(tokens: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tokens with is_key: whether they lie wholly in an interval of their document.

    Neither a range join nor a list for each document: a running maximum over both, by start, tells how far the intervals reach
    that began before a token.
    """
    marks = tokens.withColumn("_kind", F.lit(1)).unionByName(spans.select(key, "s", "e", F.lit(0).alias("_kind")), allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("s", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(F.col("_kind") == 0, F.col("e"))).over(order)
    return marks.withColumn("_reach", reach).where("_kind = 1").withColumn("is_key", F.coalesce(F.col("_reach") >= F.col("e"), F.lit(False))).drop("_kind", "_reach")


def document_scores(tokens: DataFrame, key: Column | None = None) -> DataFrame:
    """doc_id, ppl, n_token, longppl (null without key tokens), n_key_token."""
    chosen = F.when(is_key() if key is None else key, F.col("loss_full").cast("double"))
    return tokens.groupBy("doc_id").agg(F.exp(F.avg(F.col("loss_full").cast("double"))).alias("ppl"), F.count("loss_full").alias("n_token"), F.exp(F.avg(chosen)).alias("longppl"), F.count(chosen).alias("n_key_token"))


def corpus_scores(scores: DataFrame) -> DataFrame:
    """Means weighted by tokens; documents without key tokens are left out."""
    good = scores.where("longppl is not null")
    ratio = lambda v, n: (F.sum(F.col(v) * F.col(n)) / F.sum(n)).alias(v)
    return good.agg(ratio("longppl", "n_key_token"), ratio("ppl", "n_token"))

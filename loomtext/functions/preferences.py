"""Preference losses, judgements and index partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A judgement's three words and what they say of the three answers.
JUDGEMENTS = {"c,i,y": (True, True, True), "c,i,n": (True, True, False), "i,c,y": (True, False, True), "i,c,n": (True, False, False), "i,i,y": (False, False, True)}


def negative_log_sigmoid(x: Column) -> Column:
    return F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def log_ratio(chosen: Column, rejected: Column) -> Column:
    return chosen - rejected


def rejected_mean(first: Column, second: Column) -> Column:
    return (first + second) / 2


def sigmoid_loss(delta: Column, beta: float, gamma: float, smoothing: float = 0.0) -> Column:
    x = beta * (delta - gamma)
    return negative_log_sigmoid(x) * (1 - smoothing) + negative_log_sigmoid(-x) * smoothing


def hinge_loss(delta: Column, beta: float, gamma: float) -> Column:
    return F.greatest(F.lit(0.0), 1 - beta * (delta - gamma))


def reward(logp: Column, beta: float) -> Column:
    return beta * logp


def log_odds(chosen: Column, rejected: Column) -> Column:
    return (chosen - rejected) - (F.log1p(-F.exp(chosen)) - F.log1p(-F.exp(rejected)))


def odds_loss(chosen: Column, rejected: Column, beta: float) -> Column:
    return -beta * negative_log_sigmoid(log_odds(chosen, rejected))


def combined_loss(sft: Column, preference: Column, weight: float) -> Column:
    return weight * sft + preference


def judgement(text: Column) -> Column:
    """array<boolean> of three; null if the first line has not three words."""
    line = F.regexp_replace(F.substring_index(text, "\n", 1), "^##Judgement: ", "")
    parts = F.transform(F.split(line, ","), lambda x: F.lower(F.trim(x)))
    key, found = F.array_join(parts, ","), F.array(*[F.lit(False)] * 3)
    for words, values in JUDGEMENTS.items():
        found = F.when(key == words, F.array(*[F.lit(v) for v in values])).otherwise(found)
    return F.when(F.size(parts) == 3, found)


def judgement_score(judged: Column) -> Column:
    """-1 without judgement, 1 if the last is true, else 0."""
    return F.when(judged.isNull(), -1).when(F.element_at(judged, 3), 1).otherwise(0)


def near_equal_part(index: Column, n: Column, k: int) -> Column:
    """The part of k in which an index of n falls; the last n % k parts hold one more."""
    width, first = F.floor(n / k), k - F.pmod(n, F.lit(k))
    edge = width * first
    return F.when(index < edge, F.floor(index / F.greatest(width, F.lit(1)))).otherwise(first + F.floor((index - edge) / (width + 1))).cast("long")


def ceil_part(index: Column, n: Column, k: int) -> Column:
    return F.floor(index / F.greatest(F.ceil(n / k), F.lit(1))).cast("long")


def floor_part(index: Column, n: Column, k: int) -> Column:
    """Blocks of n // k, one at least; what is over makes further blocks."""
    return F.floor(index / F.greatest(F.floor(n / k), F.lit(1))).cast("long")

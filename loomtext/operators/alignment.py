"""Answers of three strategies aligned to preference rows, and the losses' means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import preferences as P


def three_way(full: DataFrame, half: DataFrame, wrong: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Rows of the same index and question in all three: on, question, label, context, and the three predictions."""
    on = on or ["row_idx"]
    short = lambda df, name: df.select(*on, F.col("question").alias(f"q_{name}"), F.col("predict").alias(name))
    both = full.join(short(half, "half"), on).join(short(wrong, "wrong"), on)
    return both.where("question = q_half and question = q_wrong").select(*on, "question", "label", *[c for c in ("context_lst",) if c in full.columns], F.col("predict").alias("full"), "half", "wrong")


def preference_rows(aligned: DataFrame) -> DataFrame:
    """The columns that training reads, spelt as it reads them."""
    return aligned.select(F.col("context_lst").alias("all_ref_text"), F.col("question").alias("combined_question"), F.col("full").alias("final_answer"), "label", F.col("half").alias("prefix_a"), F.col("wrong").alias("siffix_a"))


def losses(rows: DataFrame, beta: float, gamma: float, sft_weight: float, smoothing: float = 0.0) -> DataFrame:
    """rows has chosen, rejected_1, rejected_2 (log probabilities) and sft."""
    rejected = P.rejected_mean(F.col("rejected_1"), F.col("rejected_2"))
    out = rows.withColumn("rejected", rejected).withColumn("delta", F.col("chosen") - rejected)
    out = out.withColumn("sigmoid", P.sigmoid_loss(F.col("delta"), beta, gamma, smoothing)).withColumn("hinge", P.hinge_loss(F.col("delta"), beta, gamma))
    out = out.withColumn("reward_chosen", P.reward(F.col("chosen"), beta)).withColumn("reward_rejected", P.reward(F.col("rejected"), beta))
    return out.withColumn("loss", P.combined_loss(F.col("sft"), F.col("sigmoid"), sft_weight))


def preference_metrics(scored: DataFrame) -> DataFrame:
    """One row of means."""
    gain = F.col("reward_chosen") - F.col("reward_rejected")
    means = {"loss": F.col("loss"), "sigmoid": F.col("sigmoid"), "hinge": F.col("hinge"), "chosen": F.col("reward_chosen"), "rejected": F.col("reward_rejected"), "accuracy": (gain > 0).cast("double"), "margin": gain}
    return scored.agg(*[F.avg(c).alias(f"avg_{n}") for n, c in means.items()])

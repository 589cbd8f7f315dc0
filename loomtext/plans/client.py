"""Calls to a model or judge: an injected callable for each partition, whose set-up runs once a task."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.preferences import judgement, judgement_score


def generate(rows: DataFrame, make: Callable[[], Callable[[list[str]], list[str]]], prompt: str = "prompt", output: str = "predict", batch: int = 64, tries: int = 1, pause: float = 0.0, failed: str | None = None) -> DataFrame:
    """rows with the model's output.  make() gives a function from prompts to answers.

    A batch that fails is tried again, then row by row; a row that fails to the end has `failed` (null, or "") as its output.
    Rows keep their keys, so their order does not matter.
    """
    schema = rows.schema.simpleString()[7:-1]

    def attempt(call, prompts):
        for k in range(tries):
            try:
                return call(prompts)
            except Exception:
                if k + 1 < tries and pause:
                    time.sleep(pause)
        return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()
        for frame in frames:
            answers: list = []
            for at in range(0, len(frame), batch):
                prompts = frame[prompt].iloc[at : at + batch].tolist()
                found = attempt(call, prompts)
                answers += found if found is not None else [(attempt(call, [p]) or [failed])[0] for p in prompts]
            yield frame.assign(**{output: pd.Series(answers, index=frame.index, dtype="object")})

    return rows.mapInPandas(run, f"{schema}, {output} string")


def answered(rows: DataFrame, output: str = "predict") -> DataFrame:
    """Without rows whose calls were exhausted."""
    return rows.where(F.col(output).isNotNull())


def judged(rows: DataFrame, make: Callable, prompt: str = "judge_prompt") -> DataFrame:
    """judgement (three booleans or null) and its score."""
    out = generate(rows, make, prompt, "judge_text")
    return out.withColumn("judgement", judgement(F.col("judge_text"))).withColumn("judge_score", judgement_score(F.col("judgement")))

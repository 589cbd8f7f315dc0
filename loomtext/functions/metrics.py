"""Scores of predictions.  All are native but those that need a segmenter, stemmer or sequence matcher, which are pandas functions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .text import CJK_PUNCTUATION, PUNCTUATION, answer_tokens, first_line, normalize_answer, once, preprocess_output, words

# Which metric scores which data set.
METRIC_OF = {
    "narrativeqa_e": "qa_f1", "qasper_e": "qa_f1", "multifieldqa_en_e": "qa_f1", "hotpotqa_e": "qa_f1", "2wikimqa_e": "qa_f1", "musique": "qa_f1", "gov_report_e": "rouge", "multi_news_e": "rouge",
    "trec_e": "classification", "triviaqa_e": "qa_f1", "samsum_e": "rouge", "passage_retrieval_en_e": "retrieval", "passage_count_e": "count", "lcc_e": "code_sim", "repobench-p_e": "code_sim", "qmsum_e": "rouge",
}


def numbered(tokens: Column) -> Column:
    """The tokens, each with how many equal ones come before it, in linear time after a sort; nulls are left out."""

    def of(s: Column) -> Column:
        places = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        return once(lambda at: runs(s, at), places)

    def runs(s: Column, at: Column) -> Column:
        last = lambda p, i: F.coalesce(F.get(at, i + 1), F.size(s)) - p - 1
        return F.flatten(F.transform(at, lambda p, i: F.transform(F.sequence(F.lit(0), last(p, i)), lambda k: F.concat(F.get(s, p), F.lit("\0"), k.cast("string")))))

    return once(of, F.array_sort(F.filter(tokens, lambda x: x.isNotNull())))


def overlap(a: Column, b: Column, few: int = 64) -> Column:
    """Size of the intersection of two multisets.  A few common tokens are counted one by one, more by numbering: linear either way, and the same."""
    times = lambda x, t: F.size(F.filter(x, lambda y: y == t))
    one_by_one = lambda common: F.aggregate(common, F.lit(0), lambda n, t: n + F.least(times(a, t), times(b, t)))
    by_number = F.size(F.array_intersect(numbered(a), numbered(b)))
    return once(lambda common: F.when(F.size(common) <= few, one_by_one(common)).otherwise(by_number), F.array_intersect(a, b))


def f1(prediction: Column, gold: Column) -> Column:
    """Of two token arrays."""
    same = overlap(prediction, gold).cast("double")
    p, r = same / F.greatest(F.size(prediction), F.lit(1)), same / F.greatest(F.size(gold), F.lit(1))
    return F.when(same == 0, 0.0).otherwise(2 * p * r / F.when(p + r == 0, F.lit(1.0)).otherwise(p + r))


def qa_f1(prediction: Column, gold: Column) -> Column:
    return once(f1, answer_tokens(prediction), answer_tokens(gold))


def count_score(prediction: Column, gold: Column) -> Column:
    """The share of the prediction's numbers that are the gold, as text."""
    numbers = F.regexp_extract_all(prediction, F.lit("(?U)(\\d+)"), 1)
    return F.when(prediction.isNull() | gold.isNull(), None).when(F.size(numbers) == 0, 0.0).otherwise(F.size(F.filter(numbers, lambda x: x == gold.cast("string"))) / F.greatest(F.size(numbers), F.lit(1)))


def retrieval_score(prediction: Column, gold: Column, mark: str = "Paragraph ") -> Column:
    """As count_score, with the number that follows the mark in gold; null if there is none."""
    return count_score(prediction, F.nullif(F.regexp_extract(gold, f"(?U){mark}(\\d+)", 1), F.lit("")))


def retrieval_cjk_score(prediction: Column, gold: Column) -> Column:
    return retrieval_score(prediction, gold, "段落")


def classification_score(prediction: Column, gold: Column, classes: Column, strict: bool = False) -> Column:
    """1 / n if gold is among the n classes named in the prediction, without those that are only part of gold.

    strict: what follows a class that is left out is never left out itself, as when a list loses items while it is walked.
    """
    part = lambda c: F.contains(gold, c) & (c != gold)
    named = F.filter(classes, lambda c: F.contains(prediction, c))
    if strict:
        start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("skip"))
        step = lambda s, c: F.when(~s.skip & part(c), F.struct(s.kept.alias("kept"), F.lit(True).alias("skip"))).otherwise(F.struct(F.concat(s.kept, F.array(c)).alias("kept"), F.lit(False).alias("skip")))
        named = F.aggregate(named, start, step, lambda s: s.kept)
    else:
        named = F.filter(named, lambda c: ~part(c))
    return F.when(F.array_contains(named, gold), 1.0 / F.greatest(F.size(named), F.lit(1))).otherwise(0.0)


def best_subspan_em(prediction: Column, golds: Column) -> Column:
    """1 if any normalised gold is in the normalised prediction."""
    return once(lambda p: F.exists(golds, lambda g: F.contains(p, normalize_answer(g))), normalize_answer(prediction)).cast("double")


def best_of(score: Callable[[Column, Column], Column], prediction: Column, golds: Column) -> Column:
    """The highest score over golds, 0 at least."""
    return F.greatest(F.lit(0.0), F.coalesce(F.array_max(F.transform(golds, lambda g: score(prediction, g))), F.lit(0.0)))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two token arrays, a row of the table at a time.  For short texts."""
    zero = F.transform(F.sequence(F.lit(0), F.size(b)), lambda _: F.lit(0))

    def row(last: Column, x: Column) -> Column:
        better = lambda now, y, i: F.when(x == y, F.get(last, i) + 1).otherwise(F.greatest(F.element_at(now, -1), F.get(last, i + 1)))
        numbered = F.transform(b, lambda y, i: F.struct(y.alias("y"), i.alias("i")))
        return F.aggregate(numbered, F.array(F.lit(0)), lambda now, z: F.concat(now, F.array(better(now, z.y, z.i))))

    return F.element_at(F.aggregate(a, zero, row), -1)


def rouge_l(prediction: Column, gold: Column) -> Column:
    """F1 of the longest common subsequence of words, natively."""
    score = lambda n, a, b: F.when(n == 0, 0.0).otherwise(2.0 * n / F.greatest(F.size(a) + F.size(b), F.lit(1)))
    return once(lambda a, b: once(score, lcs_length(a, b), a, b), words(prediction), words(gold))


def _lcs(a: list, b: list) -> int:
    """Bit-parallel: long texts cost words times machine words."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    v, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        u = v & at.get(y, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def rouge_l_long(segment: Callable[[str], list[str]] = str.split):
    """rouge_l as a pandas function, for long texts or another segmenter."""

    @F.pandas_udf("double")
    def score(prediction: pd.Series, gold: pd.Series) -> pd.Series:
        def one(p, g):
            a, b = segment(p or ""), segment(g or "")
            n = _lcs(a, b)
            return 2 * n / (len(a) + len(b)) if n else 0.0

        return pd.Series([one(p, g) for p, g in zip(prediction, gold, strict=True)], dtype="float64")

    return score


def segmented_f1(segment: Callable[[str], list[str]] = list):
    """qa_f1 for text without spaces; by default every character is a token.  Tokens lose punctuation and white space, empty ones go."""

    gone = str.maketrans("", "", PUNCTUATION + CJK_PUNCTUATION)

    def tokens(text):
        clean = ("".join(t.lower().translate(gone).split()) for t in segment(text or ""))
        return Counter(t for t in clean if t)

    def one(a, b):
        same = sum((a & b).values())
        return 2 * same / (sum(a.values()) + sum(b.values())) if same else 0.0

    @F.pandas_udf("double")
    def score(prediction: pd.Series, gold: pd.Series) -> pd.Series:
        return pd.Series([one(tokens(p), tokens(g)) for p, g in zip(prediction, gold, strict=True)], dtype="float64")

    return score


def code_line(prediction: Column) -> Column:
    """The first line without back quote, hash or double slash; empty if there is none."""
    lines = F.split(F.ltrim(prediction, F.lit("\n")), "\n")
    return F.coalesce(F.get(F.filter(lines, lambda x: ~(F.contains(x, F.lit("`")) | F.contains(x, F.lit("#")) | F.contains(x, F.lit("//")))), 0), F.lit(""))


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([round(100 * SequenceMatcher(None, x or "", y or "").ratio()) / 100 for x, y in zip(a, b, strict=True)], dtype="float64")


def code_sim(prediction: Column, gold: Column) -> Column:
    """Matching blocks' share, in hundredths, of the prediction's code line and the gold."""
    return _ratio(code_line(prediction), gold)


def label_match(target: Column, output: Column, question: Column, labels: Column, strict: bool = False) -> Column:
    """Whether the labels in the output, without those in the question, are exactly the target's; a target of several, with commas, needs all its parts."""
    return once(_labels_match, preprocess_output(output, strict), F.lower(question), F.lower(target), labels)


def _labels_match(out: Column, asked: Column, goal: Column, labels: Column) -> Column:
    found = F.array_except(F.filter(labels, lambda x: F.contains(out, F.lower(x))), F.filter(labels, lambda x: F.contains(asked, F.lower(x))))
    lower = F.transform(found, F.lower)
    parts = F.split(goal, ",")
    several = F.contains(goal, F.lit(",")) & (F.char_length(goal) > 3)
    return F.when(several, F.forall(parts, lambda p: F.array_contains(lower, p)) & (F.size(lower) == F.size(parts))).otherwise(F.array_contains(lower, goal) & (F.size(lower) == 1))


def recall_score(response: Column, gold: Column, forbidden: Column, stem: Callable[[Column], Column] = lambda tokens: tokens) -> Column:
    """struct(recall, score): unigram recall in hundredths, and that minus 100 / (k + 1) for each of the k forbidden terms it names."""
    a, b = stem(words(F.lower(response))), stem(words(F.lower(gold)))
    recall = 100.0 * overlap(a, b) / F.greatest(F.size(b), F.lit(1))
    named = F.size(F.filter(forbidden, lambda f: F.contains(F.lower(response), F.lower(f))))
    return F.struct(recall.alias("recall"), (recall - named * 100.0 / (F.size(forbidden) + 1)).alias("score"))


def by_metric(metric: Column, prediction: Column, gold: Column, classes: Column) -> Column:
    """Dispatch by a metric's name; only the chosen branch runs."""
    return (
        F.when(metric == "qa_f1", qa_f1(prediction, gold)).when(metric == "count", count_score(prediction, gold)).when(metric == "retrieval", retrieval_score(prediction, gold))
        .when(metric == "classification", classification_score(first_line(prediction), gold, classes)).when(metric == "rouge", rouge_l_long()(prediction, gold)).when(metric == "code_sim", code_sim(prediction, gold))
    )

"""Score reports: buckets, roll-ups, pivots and resumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The report's groups and their data sets.
REPORT = {
    "Single-Document QA": ["qasper_e", "multifieldqa_en_e"], "Multi-Document QA": ["hotpotqa_e", "2wikimqa_e", "musique"], "Summarization": ["gov_report_e", "multi_news_e"],
    "Few-shot Learning": ["trec_e", "triviaqa_e", "samsum_e"], "Synthetic Tasks": ["passage_count_e", "passage_retrieval_en_e"], "Code Completion": ["lcc_e", "repobench-p_e"],
}
BUCKETS = ("0-4k", "4-8k", "8k+")


def bucket(length: Column) -> Column:
    return F.when(length < 4000, BUCKETS[0]).when(length < 8000, BUCKETS[1]).otherwise(BUCKETS[2])


def bucket_means(scored: DataFrame, digits: int | None = 2) -> DataFrame:
    """dataset_name, bucket, score: means in hundredths, rounded half to even."""
    mean = 100 * F.avg("score")
    return scored.groupBy("dataset_name", bucket(F.col("length")).alias("bucket")).agg((mean if digits is None else F.bround(mean, digits)).alias("score"))


def mean_scores(scored: DataFrame, digits: int = 2) -> DataFrame:
    return scored.groupBy("dataset_name").agg(F.bround(100 * F.avg("score"), digits).alias("score"))


def with_average(buckets: DataFrame) -> DataFrame:
    """A row `Avg.` for each data set: the plain mean of its buckets."""
    return buckets.unionByName(buckets.groupBy("dataset_name").agg(F.avg("score").alias("score")).withColumn("bucket", F.lit("Avg.")))


def wide_report(buckets: DataFrame, strict: bool = False) -> DataFrame:
    """bucket and a column for each data set and each group's average; a missing score is 0.  strict: averages are left at 0."""
    names = [n for own in REPORT.values() for n in own]
    wide = buckets.groupBy("bucket").pivot("dataset_name", names).agg(F.first("score"))
    cell = lambda n: F.coalesce(F.col(f"`{n}`"), F.lit(0.0))
    average = lambda own: F.lit(0.0) if strict else sum((cell(n) for n in own), F.lit(0.0)) / len(own)
    out = [F.col("bucket")]
    for group, own in REPORT.items():
        out += [*[cell(n).alias(n) for n in own], average(own).alias(f"{group} Avg.")]
    return wide.select(*out, average(names).alias("ALL Avg."))


def choice_accuracy(judged: DataFrame, overall: str = "Overall", digits: int = 2) -> DataFrame:
    """dataset_name (and the total over all rows) with accuracy for easy, hard, short, medium and all; any difficulty but easy is hard."""
    right = F.col("judge").cast("int")
    kinds = {"easy": F.col("difficulty") == "easy", "hard": F.col("difficulty") != "easy", "short": F.col("length") == "short", "medium": F.col("length") == "medium", "all": F.lit(True)}
    share = lambda c: F.bround(F.coalesce(F.sum(F.when(c, right)), F.lit(0)) / F.greatest(F.count_if(c), F.lit(1)), digits)
    sums = judged.rollup("dataset_name").agg(*[share(c).alias(n) for n, c in kinds.items()], F.grouping("dataset_name").alias("_total"))
    return sums.withColumn("dataset_name", F.when(F.col("_total") == 1, overall).otherwise(F.col("dataset_name"))).drop("_total")


def accuracy_matrix(scored: DataFrame, lengths: list[str]) -> DataFrame:
    """task and a column for each context length: accuracy in whole hundredths, cut; null where there is nothing."""
    return scored.groupBy("task").pivot("ctx_length", lengths).agg(F.floor(100 * F.avg(F.col("correct").cast("int"))).cast("int"))


def full_grid(means: DataFrame, tasks: DataFrame, lengths: DataFrame) -> DataFrame:
    """Every pair of two small dimensions, with its mean or null."""
    return tasks.crossJoin(F.broadcast(lengths)).join(means, ["task", "ctx_length"], "left")


def unfinished(expected: DataFrame, done: DataFrame, on: str = "dataset_name") -> DataFrame:
    """Names whose number of rows in `done` is not the expected one."""
    return expected.groupBy(on).agg(F.count("*").alias("n")).join(done.groupBy(on).agg(F.count("*").alias("n")), [on, "n"], "left_anti").select(on)


def metric_means(scored: DataFrame, metrics: list[str]) -> DataFrame:
    return scored.agg(*[F.avg(m).alias(m) for m in metrics])

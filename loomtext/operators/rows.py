"""Row filters, unions, samples and orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def complete(df: DataFrame) -> DataFrame:
    """Rows without any null."""
    return df.dropna("any")


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    """The columns of a prefix, without it."""
    return df.select(*[F.col(f"`{c}`").alias(c[len(prefix) :].lstrip("_")) for c in df.columns if c.startswith(prefix)])


def short_enough(df: DataFrame, length: str = "length", context: str = "context", longest: int = 512_000) -> DataFrame:
    """Rows that are not of the long class and whose context has fewer characters."""
    return df.where((F.lower(length) != "long") & (F.char_length(context) < longest))


def required(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """The rows; a row that breaks the condition stops the query.  The check sits in a filter, which no projection can drop."""
    return df.where(F.when(F.coalesce(condition, F.lit(False)), True).otherwise(F.raise_error(message).cast("boolean")))


def first_rows(df: DataFrame, n: int, index: str = "row_idx") -> DataFrame:
    """By the persisted index, so that it is the same rows each time."""
    return df.where(F.col(index) < n)


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def without(df: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    return df.join(done, on, "left_anti")


def hash_choice(key: list[str], n: Column, seed: int = 0) -> Column:
    """A draw in 0 .. n - 1 that depends on the key alone."""
    return F.pmod(F.xxhash64(*key, F.lit(seed)), F.greatest(n, F.lit(1)))


def mixed_length(key: list[str], sizes: list[int], ratio: float, seed: int = 0) -> Column:
    """One of the sizes with probability 1 - ratio, else the largest."""
    uniform = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    return F.when(uniform > ratio, F.get(F.array(*map(F.lit, sizes)), hash_choice(key, F.lit(len(sizes)), seed + 1).cast("int"))).otherwise(max(sizes))


def dealt(df: DataFrame, parts: int) -> DataFrame:
    """Work items over partitions at random; for load only."""
    return df.repartition(parts)


def length_class(df: DataFrame, tokens: Column, most: int = 128_000) -> DataFrame:
    """One row: number of rows, those below `most` tokens, and median and highest size."""
    n = F.size(tokens)
    return df.agg(F.count("*").alias("n"), F.count_if(n < most).alias("below"), F.percentile_approx(n, 0.5, 10_000).alias("median"), F.max(n).alias("highest"))


def ranged(rows: DataFrame, by: str, name: str = "_range") -> DataFrame:
    """Adds the number of a row's range between quantiles of a numeric column, nulls last: one for each 100,000 rows, as many as shuffle partitions at most."""
    spark = rows.sparkSession
    ranges = min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // 100_000 + 1)
    bounds = sorted(set(rows.approxQuantile(by, [k / ranges for k in range(1, ranges)], 0.25 / ranges))) if ranges > 1 else []
    return rows.withColumn(name, F.when(F.col(by).isNull(), len(bounds) + 1).otherwise(sum(((F.col(by) > x).cast("int") for x in bounds), F.lit(0))))


def row_index(rows: DataFrame, by: str, name: str = "i") -> DataFrame:
    """Adds each row's place, from 0, in the order of a numeric column, nulls last.  Values may leave gaps and repeat.

    Ranges between quantiles are counted and numbered each for itself, after the rows of the ranges before: no global sort.
    """
    own = ranged(rows, by)
    before, offsets = 0, [F.lit(0), F.lit(0)]
    for r in own.groupBy("_range").count().orderBy("_range").collect():  # a row for each range
        offsets += [F.lit(r["_range"]), F.lit(before)]
        before += r["count"]
    place = F.row_number().over(Window.partitionBy("_range").orderBy(by)) - 1
    offset = F.element_at(F.create_map(*offsets[2:] or offsets), F.col("_range"))
    return own.withColumn(name, place.cast("long") + offset).drop("_range")

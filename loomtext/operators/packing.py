"""Fixed windows of concatenated token arrays, with boundaries and weights for groups of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rows import ranged


def collated(df: DataFrame, inputs: list[str], labels: list[str], longest: int) -> DataFrame:
    """Arrays cut in the middle and padded: 0 for inputs and masks, the ignored label for labels."""
    from ..functions.arrays import IGNORED, middle_cut, pad

    return df.withColumns({c: pad(middle_cut(F.col(c), longest), longest, IGNORED if c in labels else 0) for c in [*inputs, *labels]})


def boundaries(items: DataFrame, key: str, order: str, size: str) -> DataFrame:
    """Running ends of each item in its key's sequence; items without a place in the order come last, equal places end together.

    Few keys do not make few tasks: each key's items are summed up in ranges of the order, and ranges begin where those before end.
    """
    own = ranged(items, order)
    within = F.sum(size).over(Window.partitionBy(key, "_range").orderBy(F.col(order).asc_nulls_last()))
    sums = own.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_at")).agg(F.sum(size).alias("_sum"))
    before = Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_key", "_at", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    placed = own.withColumn("end", within).join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_at")))
    return placed.withColumn("end", F.col("end") + F.col("_start")).drop("_range", "_key", "_at", "_start")


def whole_groups(rows: DataFrame, group: int, index: str = "row_idx") -> DataFrame:
    """Rows up to the last full group."""
    n = rows.agg(F.count("*").alias("_n"))
    return rows.crossJoin(F.broadcast(n)).where(F.col(index) < F.col("_n") - F.col("_n") % group).drop("_n")


def group_weights(rows: DataFrame, group: int, weight: str = "weight", index: str = "row_idx") -> DataFrame:
    """weight_sum: over the rows of a group of consecutive indices."""
    return rows.withColumn("weight_sum", F.sum(weight).over(Window.partitionBy(F.floor(F.col(index) / group))))


def warmed(rows: DataFrame, first: int = 32, longest: int = 32_768, factor: float = 2.0, index: str = "row_idx") -> DataFrame:
    """The first rows' arrays cut to `longest`, their weights raised."""
    early = F.col(index) < first
    return rows.withColumns({"inputs": F.when(early, F.slice("inputs", 1, longest)).otherwise(F.col("inputs")), "weight": F.when(early, F.col("weight") * factor).otherwise(F.col("weight"))})


def curriculum(rows: DataFrame, layout_key: str = "row_idx") -> DataFrame:
    """sparse: whether a row's position ids are spread out."""
    from ..functions.arrays import is_sparse

    return rows.withColumn("sparse", is_sparse(F.col(layout_key)))

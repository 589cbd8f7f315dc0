"""Writers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import format_spans


def json_lines(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.mode("overwrite").option("compression", compression).json(path)


def parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(by or [])).parquet(path)


def report_csv(report: DataFrame, path: str, index: str | None = None) -> None:
    """One file; for reports, which have a few rows.  index: that column comes first."""
    columns = [index, *[c for c in report.columns if c != index]] if index else report.columns
    report.select(*[F.col(f"`{c}`") for c in columns]).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def grouped_csv(df: DataFrame, path: str, by: list[str], config: dict | None = None) -> None:
    """A folder of CSV files for each group; the configuration lies beside them as a table of one row."""
    df.write.mode("overwrite").partitionBy(*by).option("header", True).csv(f"{path}/rows")
    if config is not None:
        df.sparkSession.createDataFrame([(json.dumps(config, sort_keys=True),)], "config string").coalesce(1).write.mode("overwrite").json(f"{path}/config")


def enriched(df: DataFrame, metrics: dict[str, Column], path: str) -> None:
    """Rows as they are, with metric_ columns."""
    json_lines(df.withColumns({f"metric_{n}": c for n, c in metrics.items()}), path)


def span_text(df: DataFrame, path: str, spans: str = "spans") -> None:
    df.select(format_spans(F.col(spans)).alias("value")).write.mode("overwrite").text(path)

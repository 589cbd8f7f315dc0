"""Stateless scoring of a stream of predictions, and windowed means with late data.

The same functions serve tables and streams, so results agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as M


def read(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """JSON-lines files as they arrive; so many files a batch bound what is in flight."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def scored(predictions: DataFrame) -> DataFrame:
    """score: the best token F1 over the golds."""
    return predictions.withColumn("score", M.best_of(M.qa_f1, F.col("pred_str"), F.col("answers")))


def windowed_means(rows: DataFrame, time: str = "ts", width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Mean score of each data set and time window; rows later than `late` are left out."""
    own = rows.withWatermark(time, late).groupBy(F.window(time, width), "dataset_name")
    return own.agg(F.avg("score").alias("score"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), "dataset_name", "score", "n")


def write(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Runs until all that is there has been read."""
    return df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)

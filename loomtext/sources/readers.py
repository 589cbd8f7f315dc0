"""Readers.  Paths may be files, folders or globs of any store that Spark reads; compressed text is read as it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import file_stem, parse_spans


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON array of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def keyed_json(spark: SparkSession, path: str, value: str) -> DataFrame:
    """bucket_id and value of files that are one map from names to structs; value: the whole map's type."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", value)).alias("bucket_id", "value"))


def keyed_rows(keyed: DataFrame, arrays: list[str]) -> DataFrame:
    """A row for each place of parallel arrays: bucket_id, place, system_prompt as messages or text in JSON, and the arrays' items."""
    kinds = keyed.schema["value"].dataType
    # A missing array counts as empty, so its items are null.
    zipped = F.arrays_zip(*[F.coalesce(F.col(f"value.{a}"), F.array().cast(kinds[a].dataType)).alias(a) for a in arrays])
    return keyed.select("bucket_id", F.to_json("value.system_prompt").alias("system_prompt") if "system_prompt" in keyed.schema["value"].dataType.names else F.lit(None).alias("system_prompt"), F.posexplode(zipped).alias("place", "item")).select("bucket_id", "place", "system_prompt", "item.*")


def nested_json(spark: SparkSession, path: str, record: str) -> DataFrame:
    """task, split and records of files {task: {split: {datas: [record]}}}."""
    text = spark.read.text(path, wholetext=True)
    tasks = text.select(F.explode(F.from_json("value", f"map<string, map<string, struct<datas: array<{record}>>>>")).alias("task", "splits"))
    splits = tasks.select("task", F.explode("splits").alias("split", "body"))
    return splits.select("task", "split", F.posexplode("body.datas").alias("row_idx", "r")).select("task", "split", "row_idx", "r.*")


def partitioned(spark: SparkSession, path: str, config: str | None = None, split: str | None = None) -> DataFrame:
    """Parquet laid out by config and split; both prune folders."""
    df = spark.read.parquet(path)
    for column, value in (("config", config), ("split", split)):
        df = df.where(F.col(column) == value) if value is not None else df
    return df


def folder(spark: SparkSession, path: str, schema: str, glob: str = "*.jsonl") -> DataFrame:
    """All JSON-lines files of a folder, with file_name and dataset_name, its stem."""
    df = spark.read.schema(schema).option("pathGlobFilter", glob).json(path)
    return df.withColumn("file_name", F.col("_metadata.file_name")).withColumn("dataset_name", file_stem(F.col("file_name")))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, value of stripped whole text files."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value"))
    return text.select("file", F.posexplode(F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), "\n")).alias("line_no", "value"))


def span_text(spark: SparkSession, path: str) -> DataFrame:
    """file, spans: of each file's first line."""
    first = spark.read.text(path, wholetext=True)
    return first.select(F.col("_metadata.file_name").alias("file"), parse_spans(F.substring_index("value", "\n", 1)).alias("spans"))


def csv_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def head(df: DataFrame, n: int, index: str = "row_idx") -> DataFrame:
    from ..operators.rows import first_rows

    return first_rows(df, n, index)


def prompt_template(spark: SparkSession, path: str) -> str:
    """One small template file, to be used as a constant."""
    return spark.read.text(path, wholetext=True).first()[0].rstrip("\n")


def as_messages(system_prompt: Column) -> Column:
    """JSON of a text or of a list of messages, always as messages."""
    kind = "array<struct<role: string, content: string>>"
    text = F.coalesce(F.get_json_object(F.concat(F.lit('{"x":'), system_prompt, F.lit("}")), "$.x"), system_prompt)
    return F.when(F.startswith(F.ltrim(system_prompt), F.lit("[")), F.from_json(system_prompt, kind)).otherwise(F.array(F.struct(F.lit("system").alias("role"), text.alias("content"))))


class NumpySource(DataSource):
    """`npy`: rows of a two-dimensional array file as (row_idx, values); option rows: rows in a partition.

    The path must be readable by the executors' Python, as on a shared mount.  Partitions map the file and read their rows only.
    """

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "row_idx long, values array<double>"

    def reader(self, schema) -> NumpyReader:
        return NumpyReader(self.options["path"], int(self.options.get("rows", 10_000)))


class NumpyReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def partitions(self) -> list[InputPartition]:
        import numpy as np

        n = len(np.load(self.path, mmap_mode="r"))
        return [InputPartition((a, min(n, a + self.rows))) for a in range(0, n, self.rows)] or [InputPartition((0, 0))]

    def read(self, partition):
        import numpy as np

        a, b = partition.value
        data = np.load(self.path, mmap_mode="r")
        for i in range(a, b):
            yield i, data[i].astype(float).tolist()


def npy(spark: SparkSession, path: str, rows: int = 10_000) -> DataFrame:
    spark.dataSource.register(NumpySource)
    return spark.read.format("npy").option("path", path).option("rows", str(rows)).load()

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

TOKENIZER_PACKAGE = "public_tokenizers"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Only in local mode may it be unset; a temporary one is set then."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='loomtext-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back.

    It cuts the lineage: what follows reads one fixed set of rows, also after a lost executor.  The shuffle files behind what is
    written go at once; the files written go when the session ends or by `discard`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a stored table that nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def partition_id() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def tidied(run):
    """The function of batches `run`, after whose task the worker gives back the memory it no longer uses.

    Spark keeps idle workers beside the next stage's, and neither Arrow nor the C library returns freed pages by itself.
    """

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library's
            if trim:
                trim(0)

    return whole


def roomy() -> None:
    """From now on freed arrays stay with the process, up to 64 MB; else the C library may return those of each step and fetch them page by page anew.

    These are the highest limits that the GNU library sets by itself, once 32 MB have been freed at once.
    """
    option = getattr(ctypes.CDLL(None), "mallopt", None)
    if option:
        option(-3, 1 << 25)  # M_MMAP_THRESHOLD
        option(-1, 1 << 26)  # M_TRIM_THRESHOLD


def offsets(column: pa.Array) -> np.ndarray:
    """Of an array of strings or bytes: where each begins in its buffer, and the end."""
    buffer = column.buffers()[1]
    return np.frombuffer(buffer, np.int32, len(column) + 1, 4 * column.offset).astype(np.int64) if buffer else np.zeros(len(column) + 1, np.int64)


def ascii_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of texts between ASCII white space, flat, and each text's number of them."""
    found = pc.ascii_split_whitespace(texts)
    flat, ends = found.flatten(), np.asarray(found.offsets)
    full = np.asarray(pc.binary_length(flat)) > 0  # white space at either end leaves empty ones
    return flat if full.all() else flat.filter(pa.array(full)), np.diff(np.append(0, np.cumsum(full))[ends - ends[0]])


def slices(batches, rows: int = 256, size: int = 4 << 20):
    """Record batches of a bounded number of rows, and of about `size` bytes of strings at most unless one row has more."""
    for batch in batches:
        ends = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                begin = offsets(column)
                ends += begin[1:] - begin[0]
        at = 0
        while at < batch.num_rows:
            reach = (ends[at - 1] if at else 0) + size
            end = max(at + 1, min(at + rows, int(np.searchsorted(ends, reach, "right"))))
            yield batch.slice(at, end - at)
            at = end

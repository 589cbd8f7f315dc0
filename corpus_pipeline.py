"""The corpus pipeline over `documents`: language, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.  Null or empty texts have no language and go in the first stage; extra columns
are dropped there.  Equal rows count as copies of each other.  Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import language_id, packing, simhash, suffix_dedup
from loomtext.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document stays if so much of its letters is in one language.
MAJORITY = 0.5
#: Documents are near-duplicates from this Jaccard likeness of their five-word shingles on.
LIKE = 0.8
#: Passages that repeat go from so many words on.
PASSAGE = 51


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, most of them in one language.  It learns from `docs` itself."""
    found = language_id.identify(docs, language_id.fit(docs), also=COLUMNS[1:])
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= MAJORITY)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash or the likeness of five-word shingles links."""
    return simhash.one_of_each(docs.select(*COLUMNS), like=LIKE)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of 400 bytes or of 51 words that stand elsewhere too; every document stays, and n_chars follows."""
    found = suffix_dedup.remove_repeats(docs, also=("lang", "source", "text", "n_chars"), words=PASSAGE)
    changed = F.col("n_removed") > 0
    text = F.when(changed, suffix_dedup.kept_text(F.col("kept"))).otherwise(F.col("text"))
    n_chars = F.when(changed, F.char_length(text).cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 ids."""
    return packing.pack(docs).drop("ids")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packed", packed)]
#: The stages are models, fuzzy links and subword ids, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

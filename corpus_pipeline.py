"""A corpus pipeline of five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.common import SPACE, ensure_checkpoint_dir, small, stored, table
from gridlark.llm.near_copies import near_copies
from gridlark.llm.packing import pack_documents
from gridlark.llm.quality import quality
from gridlark.llm.secret_scan import redacted, secret_scan
from gridlark.llm.suffixes import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality(docs, table(spark, sf_dir, "labels")).where("kept").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word Jaccard similarity of 0.8 or more), the document of the smallest id.

    Documents without an id stay, and so do all rows of that smallest id with one text.
    """
    gone = near_copies(docs).where("doc_id != component_id").select(F.col("doc_id").alias("_id"), "text_hash")
    same = (F.col("doc_id") == F.col("_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("text_hash"))
    return docs.join(small(stored(gone.distinct())), same, "left_anti").select(*COLUMNS)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated passages; those of which no word is left go.

    A passage's border can cut a character; its bytes are left out.  n_chars is counted anew.
    """
    found = remove_repeats(docs, keep=["lang", "source"], as_text=True).withColumnRenamed("remaining", "text")
    return found.where(F.col("text").rlike(f"[^{SPACE}]")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a mark in place of each secret.  n_chars is counted anew."""
    return redacted(secret_scan(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every document's place in the sequences."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("suffix_array_dedup", suffix_dedup_stage),
    ("secret_scan", secrets_stage),
    ("best_fit_packing", packing_stage),
]

#: Hashing by XXH64 and by buckets has no DuckDB form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents; stages write to the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

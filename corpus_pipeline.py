"""From raw documents to packed token ids: filter, deduplicate, decontaminate, mask, pack.

Each stage gets what the one before kept, read back from Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlab.llm.decontaminate import clean
from matchlab.llm.near_dups import without_near_duplicates
from matchlab.llm.packing import pack
from matchlab.llm.quality import passing
from matchlab.llm.queries import VOCABULARY
from matchlab.llm.secrets import without_secrets
from matchlab.session import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counting rules and their language's perplexity band."""
    return passing(docs, scratch_path(spark, "spelling"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that copy no benchmark item."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), scratch_path(spark, "seeds"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return without_secrets(docs, scratch_path(spark, "ledger"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids (little-endian, base64) in sequences of 1024."""
    pieces = pack(docs, VOCABULARY)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).withColumn("ids", F.base64("ids"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scans", secret_scan),
    ("packing", packing),
]

#: The perplexity model and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

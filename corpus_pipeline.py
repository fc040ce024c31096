"""The corpus pipeline: quality filter, line dedup, near-dedup, mixing of sources, packing.

Counted as part of ``tidemark.llm``. Each stage works on all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, unused
from tidemark.llm.copies import near_copies
from tidemark.llm.lines import dedup_lines
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.packing import default_tokenizer, pack
from tidemark.llm.quality import quality_model

#: Least quality score of a document that stays.
LEAST_QUALITY = 0.7


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Rows are judged by their texts alone: null and empty ones like a text without
    tokens, equal ones alike, rows with null or equal ids like any other. Columns of any
    names are kept. An empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return docs.where(quality_model(docs, labels) >= LEAST_QUALITY)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat, or nearly repeat, an earlier line; nulls, repeats and empty tables as in ``dedup_lines``."""
    return dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at similarity 0.8 or more: the one with the smallest id, nulls last, and least hashed text.

    Documents meet by anchors of their SimHash fingerprints, and by MinHash bands where
    fingerprints differ too much for that, and are then compared exactly.
    Null and empty texts are one group. Of repeated rows one stays; rows that share an
    id but not a text are documents of their own. Whole texts are compared, however
    long. Columns of any names are kept; an empty table stays empty.
    """
    key, mark, copy = unused(docs.columns, "id", "print", "copy")
    stay = near_copies(docs).where("stays").select(F.col("doc_id").alias(key), F.col("print").alias(mark)).distinct()
    print_ = F.xxhash64("text")
    kept = docs.join(stay, F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (print_ == F.col(mark)), "left_semi")
    one = W.partitionBy("doc_id", print_).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    return kept.withColumn(copy, F.row_number().over(one)).where(F.col(copy) == 1).drop(copy)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weight, a row for each document and epoch that it is drawn in."""
    return mixed_documents(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    return pack(docs, default_tokenizer())


STAGES = [
    ("quality", quality_filter),
    ("lines", line_dedup),
    ("simhash", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]
#: The classifier, fuzzy lines and tokens have no SQL form; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs

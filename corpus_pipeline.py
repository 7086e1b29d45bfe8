"""A training-data pipeline over ``documents``: five stages, each one operator, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import common, mixing, pieces, quality, simhash, suffixes


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more (five-word shingles), the first."""
    return simhash.deduplicated(docs, size=5, least=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that an earlier place has."""
    return suffixes.trimmed(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, in training order."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the piece ids of each document's text; smaller tables and batches, as earlier stages' workers are still there."""
    common.small_batches(spark, 4 << 20)
    return pieces.encoded(docs.select("doc_id", "text"), pieces.default_model(), key="ids", hot=1 << 17).select("doc_id", "ids")


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode),
]

#: SQL has no XXH64, Cholesky factors or piece tables here; tests/llm holds near copies, cut passages, copies
#: in the mix and piece ids to plain Python on small tables, and the classifier to its held-out rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs

"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

Quality rules drop documents; line dedup drops repeated lines and the documents that these leave empty; near-dedup
keeps the least doc_id of every group; mixing repeats or leaves out documents to reach its sources' targets; encoding
returns what it made of each document that is left. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm import bpe, lines, mixing, repetition, simhash
from logspark.llm.common import checkpoint, shared_dir
from logspark.llm.queries import VOCABULARY

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Lines with fewer characters stay in documents as they are: headings, marks and ends of paragraphs that many documents share.
LEAST_LINE = 16
#: Ids up to which a list of documents is broadcast (16 bytes each).
BROADCAST_IDS = 1_000_000


def _sized(df: DataFrame) -> DataFrame:
    df = checkpoint(df)
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return repetition.verdict(repetition.measure(docs)).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that resemble an earlier one."""
    out = lines.drop_lines(docs.select(*COLUMNS), lines.repeated_lines(docs, min_chars=LEAST_LINE))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each group of documents that share 0.8 or more of their five-word shingles."""
    groups = simhash.resembling(docs, n=5, least=0.8)
    gone = groups.where(F.col("doc_id") > F.col("component_id")).select("doc_id")
    return docs.join(_sized(gone), "doc_id", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Rows that share a doc_id share its copies evenly."""
    copies = mixing.mix(docs).groupBy("doc_id").agg(F.round(F.sum("copies") / F.count("*")).cast("int").alias("_copies")).where("_copies <> 1")
    rows = docs.join(_sized(copies), "doc_id", "left").withColumn("_copies", F.coalesce("_copies", F.lit(1))).where("_copies > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    return bpe.round_trip_digests(docs, bpe.read_vocabulary(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("mixing to target weights", mix), ("byte-level BPE", encode)]

#: MinHash, SimHash, random mixing and merges can't be written in SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs

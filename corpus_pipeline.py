"""The corpus pipeline: stages over documents, each written as Parquet and read again for the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, common, decontam, neardup, pii, quality, queries


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.

    Null and empty texts stay or go together; repeated rows likewise; texts are judged whole; no documents give none.
    """
    return quality.keep_good(docs, quality.train(docs))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the least doc_id (null last; of equal ones any).

    Null and empty texts are one group, repeated rows leave one; no documents give none.
    """
    return neardup.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Null and empty texts stay, repeated rows stay or go together; no documents give none.
    """
    return decontam.remove(docs, common.table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows.

    Null texts stay null (and so n_chars), empty ones empty, repeated rows are treated alike; no documents give none.
    """
    out = pii.redact(docs, pii.train(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, their number, and a digest of the bytes that they decode to.

    Null and empty texts have no ids; a row for each document, repeated or not; no documents give none.
    """
    ranks, pattern = queries.rank_file(), queries.split_pattern()
    row = docs.select(F.struct("doc_id", "lang", "source").alias("row"), "text")
    tokens = bpe.encode_decode(row, ranks, pattern, id_col="row")
    return tokens.select("id.*", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", neardup_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", pii_stage),
    ("byte_bpe", bpe_stage),
]

#: Training, sampling and merging stages are beyond SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir."""
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs

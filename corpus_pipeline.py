"""A corpus pipeline over the table documents: five stages, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.decontaminate import drop_contaminated
from panelspark.llm.pieces import encode_pieces
from panelspark.llm.quality import quality_rules
from panelspark.llm.secrets import redact_secrets
from panelspark.llm.simhash import drop_near_duplicates
from panelspark.llm.workspace import Workspace

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    return drop_near_duplicates(docs, shingle=5, similarity=0.8).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets masked; n_chars is that of the masked text."""
    out = redact_secrets(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as sampled pieces: doc_id, lang, source, n_pieces, lossless, ids."""
    slim = docs.select("doc_id", "text", "lang", "source")
    return encode_pieces(slim, keep_text=False).select("doc_id", "lang", "source", "n_pieces", "lossless", "ids")


STAGES = [("quality rules", quality), ("near duplicates", near_dedup), ("decontamination", decontaminate), ("secret scans", secrets), ("pieces", pieces)]

#: SQL cannot express the sketches, the search or the sampling; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ws = Workspace(spark)
    for name, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

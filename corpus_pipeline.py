"""Cleaning a corpus: quality rules, exact and near duplicates, secrets, and packing for training."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm import exact_dedup, packing, quality, secret_scan, simhash
from candela.llm.frames import saved
from candela.llm.queries import IDS_FILE

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; references are counted over the documents of this stage."""
    return quality.judged(docs, quality.reference(docs)).where("quality.kept").select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one of smallest doc_id."""
    return exact_dedup.distinct_documents(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of five-word shingles of 0.8 or more, those of the smallest doc_id; one without
    a doc_id has no place in the order and stays."""
    dropped = simhash.similar_documents(docs).where("doc_id > component_id").select("doc_id", "text_hash").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", simhash.text_hash().alias("text_hash"))
    return rows.join(dropped, ["doc_id", "text_hash"], "left_anti").select("row.*")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    return secret_scan.masked(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences and offsets."""
    return packing.pack(docs, IDS_FILE)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_stage),
    ("exact duplicates", exact_stage),
    ("near duplicates", near_stage),
    ("secret scans", secret_stage),
    ("packing", packing_stage),
]

#: SQL has no form for fingerprints, references and packing; the tests hold the stages against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""One registered query for each operator of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm import (
    byte_bpe,
    exact_dedup,
    fill_middle,
    html_text,
    masked_lm,
    packing,
    periodic_runs,
    quality,
    ring_shards,
    secret_scan,
    shingle_join,
    simhash,
    url_filter,
)
from candela.llm.oracles import ORACLES  # noqa: F401

#: Where the tokenizer files are; a parameter of the operators.
IDS_FILE = public_tokenizers.path("byte_bpe_50k.json")
RANKS_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
# fixed values: rules of the URL query and its number of shards
URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
]
SHARDS = 40


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(spark, f"{sf_dir}/documents.parquet").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_spans(_table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.pseudo_likelihood(_table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality_rules(_table(spark, sf_dir, "documents"))
    return scored.withColumns({c: F.round(c, 9) for c in ("char_distance", "word_distance")})


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), IDS_FILE)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_decode(_table(spark, sf_dir, "documents"), RANKS_FILE)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op10_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_shards.shard_keys(_table(spark, sf_dir, "documents"), ring_shards.Ring(SHARDS))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.similar_documents(_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.periodic_runs(_table(spark, sf_dir, "documents"), change=periodic_runs.repeated_tail))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.fill_in_middle(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_secret_scans, op3_lm_scoring, op4_simhash_near_dedup, op5_quality_rules, op6_best_fit_packing,
        op7_html_extraction, op8_byte_bpe, op9_url_filters, op10_ring_shards, op11_jaccard_join, op12_periodic_runs, op13_fill_middle,
    )
}

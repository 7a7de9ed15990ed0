"""Registered queries of this subpackage: thin calls over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemart.llm import (
    bpe,
    byte_bpe,
    hard_negatives,
    langid,
    minhash,
    packing,
    quality,
    ranked_search,
    secret_scan,
    subspace,
    token_orc,
    toxicity,
    urlrank,
)
from tidemart.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(documents(spark, sf_dir))


@query
def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(documents(spark, sf_dir))


@query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(documents(spark, sf_dir))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.fit(docs))


@query
def op5_url_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrank.verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query
def op6_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.round_trip(documents(spark, sf_dir))


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(documents(spark, sf_dir))


@query
def op8_subspace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subspace.groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = hard_negatives.relabelled(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return hard_negatives.mine(vectors, hard_negatives.every_hundredth())


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(documents(spark, sf_dir))

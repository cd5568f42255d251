"""The registered queries of this subpackage: each operator over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tiepoints.llm import bpe, collocation, decontam, neardup, outliers, pii, ranked, repeats, secrets, sharding, spans, toxicity, warc
from tiepoints.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(documents(spark, sf_dir))


@query
def op8_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE["op6_decontaminate"] = decontam.SQL


@query
def op5_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(documents(spark, sf_dir))


@query
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data_digest(documents(spark, sf_dir))


@query
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


ORACLE["op9_near_duplicates"] = neardup.SQL


@query
def op10_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir))


@query
def op2_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.remove_repeated_runs(documents(spark, sf_dir))


@query
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE["op11_warc"] = warc.SQL


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(documents(spark, sf_dir))


ORACLE["op12_collocations"] = collocation.SQL


@query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE["op13_ranked_search"] = ranked.SQL

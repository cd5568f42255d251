"""Readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiepoints import schemas
from tiepoints.operators.records import parse_keys


def _table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def read_chip_pairs(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, schemas.CHIP_PAIR)


def read_sparse_specs(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _table(spark, path, schemas.SPARSE_SPEC, fmt)


def read_dense_specs(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _table(spark, path, schemas.DENSE_SPEC, fmt)


def read_conf_tables(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The three name-to-conf tables as one, ``conf`` as JSON text."""
    return _table(spark, path, schemas.CONF_TABLE, fmt)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, schemas.MANIFEST)


def read_run_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _table(spark, path, schemas.RUN_LOG, fmt)


def read_reference(spark: SparkSession, path: str, pol: str | None = None) -> DataFrame:
    """Reference images, a table partitioned by ``ref_pol``."""
    table = _table(spark, path, schemas.REFERENCE_IMAGE)
    return table.where(F.col("ref_pol") == pol) if pol else table


def read_gcps(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Ground control points from CSV; none without a path."""
    if not path:
        return spark.createDataFrame([], schemas.GCP)
    return spark.read.schema(schemas.GCP).option("header", True).csv(path)


def read_windows(spark: SparkSession, path: str, rejected: bool) -> DataFrame:
    """The bad or the good windows of ``writers.write_windows``; the other half is not read."""
    return spark.read.parquet(path).where(F.col("rejected") == rejected).drop("rejected")


def read_match_files(spark: SparkSession, path: str, schema: T.StructType = schemas.MATCH_ROW) -> DataFrame:
    """Per-window CSV files; the key parsed from each file name becomes column ``key``."""
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return parse_keys(rows.select(F.col("_metadata.file_name").alias("file_name"), "*"))


def read_match_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of all detectors below ``path``, which is partitioned (see ``write_match_records``)."""
    schema = T.StructType(
        [
            *schemas.MATCH_RECORD.fields,
            T.StructField("window_size", T.IntegerType()),
            T.StructField("detector", T.StringType()),
            T.StructField("source_pol", T.StringType()),
        ]
    )
    return spark.read.schema(schema).parquet(path)

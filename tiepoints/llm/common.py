"""What several operators share: the text column, span lists, and joins with hot keys."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPANS = "array<struct<kind:string,start:int,end:int>>"


#: Rows that a worker turns into Python objects at a time; a batch may hold ten thousand long texts.
SLICE = 256


def give_back() -> None:
    """Hand freed memory back to the system at the end of a task.

    Workers are reused, and each would otherwise keep the most it ever held, whatever stage comes next.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` only; whatever else the table carries cannot clash with an operator."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined in the order given."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def n_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "utf-8"), 256)


def back_to_rows(big: DataFrame, per_key: DataFrame, key: str, n: str, rows: int, spare: Column) -> DataFrame:
    """Inner join of rows with one row per key, where a key may hold a large share of the rows.

    ``per_key[n]`` is the number of rows of ``big`` with that key and ``rows`` the number of all
    of them. A key with more than a thousandth of the rows is hot: there are fewer than a
    thousand such keys, so they are broadcast, and their rows do not move. All others are shuffled
    by key. A row that found a hot key is dealt out by ``spare``, any column that spreads rows.
    """
    least = max(rows // 1000, 1000)
    values = [c for c in per_key.columns if c not in (key, n)]
    hot = per_key.where(F.col(n) > least).select(
        F.col(key).alias("_hot"), F.struct(*values).alias("_hot_values")
    )
    cold = per_key.where(F.col(n) <= least).select(F.col(key).alias("_cold"), F.struct(*values).alias("_cold_values"))
    met = big.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    met = met.withColumn("_to", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(spare))
    found = met.join(cold, (F.col("_to") == F.col("_cold")) & F.col("_hot").isNull(), "left")
    found = found.withColumn("_values", F.coalesce("_hot_values", "_cold_values")).where("_values is not null")
    return found.select(*big.columns, *[F.col("_values")[v].alias(v) for v in values])

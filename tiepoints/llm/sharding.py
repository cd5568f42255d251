"""Sharding along a Hilbert curve over several metadata dimensions.

Every dimension is cut at quantiles of the whole table into ``2 ** BITS`` steps; the steps of a row
are its cell, and cells are ordered along the Hilbert curve. Strings are cut by their values: a value's step is
the quantile of its middle row when all rows are in the order of the values. The ordered rows are cut into
runs whose row counts differ by at most one (law ``rows``), so every shard is a compact range in all
dimensions and its files can be skipped by their minima and maxima.

No row is sorted across the cluster. A cell, however many rows it has, is divided into ``SLICES``
by a hash of the row; counts of cells and slices give every slice its first position, and rows are
numbered inside their slice only. There are at most ``2 ** (BITS * dimensions)`` cells, a
constant that bounds what is broadcast and what one task orders.

Nulls are a step of their own, below all values. Equal rows are interchangeable; rows of one cell and
slice are ordered by doc_id, then by the checksum. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiepoints.llm.common import filled
from tiepoints.operators.joins import join_settled
from tiepoints.session import settle

BITS = 4
SLICES = 1024


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer cells, one row per cell and one column per dimension."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations, from the coarsest step to the finest
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            index = (index << 1) | ((x[i] >> bit) & 1)
    return index


def value_steps(rows: DataFrame, column: str, steps: int) -> DataFrame:
    """Distinct values of ``column`` with their ``_step`` from 1 to ``steps``; written.

    Rows are counted per value first, so a value of many rows is one row here. Values are dealt into ranges by
    order; the sums of the ranges, one row per partition, give each range its beginning, and values are
    summed up inside their range only.
    """
    counts = settle(rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n")), "values")
    ranged = settle(counts.repartitionByRange(column).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("_range").agg(F.sum("_n").alias("_sum"))
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # over partitions
    starts = sums.select(
        "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"),
        F.sum("_sum").over(W.partitionBy(F.lit(0))).alias("_all"),
    )
    inside = W.partitionBy("_range").orderBy(column).rowsBetween(W.unboundedPreceding, -1)
    ranged = ranged.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    twice = 2 * (F.col("_start") + F.col("_before")) + F.col("_n")  # twice the middle
    step = F.expr("_twice * _steps div (2 * _all)")
    placed = ranged.join(F.broadcast(starts), "_range").withColumns({"_twice": twice, "_steps": F.lit(steps)})
    return settle(placed.select(column, (1 + F.least(step, F.lit(steps - 1))).cast("int").alias("_step")), "value-steps")


def with_steps(rows: DataFrame, dimensions: dict[str, Column], bits: int = BITS) -> DataFrame:
    """Add one step per dimension, ``_s_<name>``: 0 for null; of a string that of ``value_steps``, of a number
    one more than the number of quantile bounds below it.

    Bounds come from a mergeable sketch over all rows, ``2 ** bits - 2`` numbers per dimension.
    """
    steps = (1 << bits) - 1
    shares = [i / steps for i in range(1, steps)]
    rows = rows.select("*", *[c.alias(f"_v_{name}") for name, c in dimensions.items()])
    words = [name for name in dimensions if isinstance(rows.schema[f"_v_{name}"].dataType, T.StringType)]
    numbers = [name for name in dimensions if name not in words]
    sketches = [F.percentile_approx(F.col(f"_v_{name}").cast("double"), shares, 1000).alias(name) for name in numbers]
    bounds = rows.agg(*sketches).first() if numbers else {}
    for name in numbers:
        value, step = F.col(f"_v_{name}").cast("double"), F.lit(1)
        for cut in sorted(set(bounds[name] or [])):
            step = step + (value > cut).cast("int")
        rows = rows.withColumn(f"_s_{name}", F.coalesce(step, F.lit(0)))
    for name in words:
        known = value_steps(rows, f"_v_{name}", steps).withColumnRenamed("_step", f"_s_{name}")
        rows = join_settled(rows, known, [f"_v_{name}"], "left").withColumn(f"_s_{name}", F.coalesce(f"_s_{name}", F.lit(0)))
    return rows.drop(*[f"_v_{name}" for name in dimensions])


def assign_shards(
    rows: DataFrame, dimensions: dict[str, Column], order: list[str], shards: int, bits: int = BITS
) -> DataFrame:
    """Add ``shard`` and ``slot``: the run of the Hilbert order a row falls into, and its place there."""
    steps = [f"_s_{name}" for name in dimensions]
    placed = with_steps(rows, dimensions, bits).withColumn(
        "_slice", F.pmod(F.xxhash64(*order), F.lit(SLICES)).cast("int")
    )
    placed = settle(placed, "shards")
    counted = settle(placed.groupBy(*steps, "_slice").agg(F.count("*").alias("_n")), "slices")

    @F.pandas_udf("long")
    def curve(*parts: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([p.to_numpy() for p in parts], axis=1), bits))

    cells = counted.groupBy(*steps).agg(F.sum("_n").alias("_n")).withColumn("_curve", curve(*steps))
    before = W.orderBy("_curve").rowsBetween(W.unboundedPreceding, -1)  # over cells: bounded by the grid
    cells = cells.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = W.partitionBy(*steps).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    slices = counted.withColumn("_offset", F.coalesce(F.sum("_n").over(inside), F.lit(0))).drop("_n")
    total = counted.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]

    # The numbering and the join share one partitioning by slice.
    at = W.partitionBy(*steps, "_slice").orderBy(*order)
    numbered = placed.withColumn("_row", F.row_number().over(at) - 1).join(slices, [*steps, "_slice"])
    numbered = numbered.join(F.broadcast(cells), steps)
    place = F.col("_start") + F.col("_offset") + F.col("_row")
    small, larger = divmod(total, shards)  # the first `larger` shards have one row more
    edge = larger * (small + 1)
    late = F.lit(larger) + F.floor((place - edge) / max(small, 1))
    shard = F.when(place < edge, F.floor(place / (small + 1))).otherwise(late).cast("int")
    first = F.col("shard") * small + F.least(F.col("shard"), F.lit(larger))
    return (
        numbered.withColumn("shard", shard)
        .withColumn("slot", (place - first).cast("long"))
        .drop(*steps, "_slice", "_row", "_offset", "_start", "_curve")
    )


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Documents by language, source and size: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The size is the number of UTF-8 bytes plus 8; a null text has none and the checksum of none.
    """
    text = filled(F.col("text").cast("string")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
    )
    dimensions = {name: F.col(name) for name in ("lang", "source", "size")}
    placed = assign_shards(rows, dimensions, ["doc_id", "text_crc32", "size"], shards)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )

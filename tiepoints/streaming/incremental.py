"""Processing only what has not been processed yet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tiepoints.operators.correspond import Pixel, drop_nodata, in_bounds
from tiepoints.operators.records import located_points

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def clean_and_locate(points: DataFrame, size: int, valid1: Pixel, valid2: Pixel) -> DataFrame:
    """The stateless part of a run: bounds, nodata, map coordinates, displacement."""
    return located_points(drop_nodata(in_bounds(points, size, size, size, size), valid1, valid2))


def incremental_run(
    spark: SparkSession, source: str, schema: T.StructType, transform, out: str, checkpoint: str,
    files: str = "*.parquet", max_files: int = 1000, keys: Sequence[str] = (), within: tuple[str, str] | None = None,
) -> DataFrame:
    """Run ``transform`` over the files of ``source`` that earlier runs did not see.

    What was seen is kept in ``checkpoint``; results are appended to ``out``, exactly once per
    file. Returns everything in ``out``.

    With ``keys`` a result whose keys were met before is dropped, also if an earlier run met it in another
    file. The keys met are streaming state, partitioned by key and kept with the checkpoint on disk
    (RocksDB). It grows with the distinct keys; ``within = (time column, delay)`` forgets those older than
    the watermark, if repeats are known to come no later.
    """
    stream = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", files)
        .option("maxFilesPerTrigger", max_files)
        .parquet(source)
    )
    result = transform(stream)
    fresh = result
    if keys:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
        fresh = result.withWatermark(*within).dropDuplicatesWithinWatermark(list(keys)) if within else result.dropDuplicates(list(keys))
    (
        fresh.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(out)
        .awaitTermination()
    )
    return spark.read.schema(result.schema).parquet(out)

"""Writers. Directories are partitioned, so that runs side by side and reruns do not collide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiepoints import schemas
from tiepoints.sources.match_files import FORMAT, MatchFiles

RECORD_PARTITIONS = ("window_size", "detector", "source_pol")


def write_match_records(records: DataFrame, path: str, mode: str = "append") -> None:
    """One directory per window size, detector and polarisation, as Parquet."""
    records.write.mode(mode).partitionBy(*RECORD_PARTITIONS).parquet(path)


def write_match_files(records: DataFrame, path: str) -> None:
    """One CSV file per file id, named after it, in the same directories (see ``match_files``).

    Records that share a file id are one file. They are brought together by a shuffle on the id, so each file
    is written by one task, and they are streamed into it, however many there are.
    """
    records.sparkSession.dataSource.register(MatchFiles)
    key = [*RECORD_PARTITIONS, "file_id"]
    together = records.select(*key, *schemas.RECORD_LISTS).repartition(*key).sortWithinPartitions(*key, *schemas.RECORD_LISTS)
    together.write.format(FORMAT).mode("append").save(path)


def write_windows(windows: DataFrame, path: str) -> None:
    """Good and bad windows side by side, in one pass: ``rejected=false`` and ``rejected=true``.

    A bad window keeps its key, its ``reject_reason`` and the ``error`` behind it, so none is lost unseen.
    """
    rejected = F.col("reject_reason").isNotNull()
    windows.withColumn("rejected", rejected).write.partitionBy("rejected").parquet(path)


def write_run_summary(summary: DataFrame, path: str) -> None:
    """Summary of finished window sizes; replaces those it contains and no others."""
    (
        summary.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("window_size")
        .parquet(path)
    )


def manifest_of(summary: DataFrame) -> DataFrame:
    """A window size is done when its summary exists."""
    return summary.select("window_size").distinct().withColumn("done", F.lit(True))

"""Session settings and the shared work folder."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # The largest k for which a ranked limit is also applied before the shuffle; keypoint
    # budgets are above the default of 1000.
    "spark.sql.optimizer.windowGroupLimitThreshold": "16384",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings this package is designed for."""
    for key, value in TUNING.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; on a cluster use the one you are given."""
    return tune(
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tiepoints")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session may run without it; it then gets a fresh temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tiepoints-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


#: Paths handed out inside every open ``scratch``, the innermost last.
_scratches: list[list[str]] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the work folder that no other run uses."""
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _scratches:
        _scratches[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what operators wrote to the work folder inside, so that long jobs do not fill it.

    Results must be written or collected inside, since they read those tables. Tables of an enclosing
    ``scratch`` stay. A folder that cannot be deleted is left behind; it is not worth failing a finished job.
    """
    paths: list[str] = []
    _scratches.append(paths)
    try:
        yield
    finally:
        _scratches.remove(paths)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in paths:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            with suppress(Exception):
                folder.getFileSystem(conf).delete(folder, True)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, as ``--py-files`` would; once per application.

    The archive is only handed to Spark, which distributes it.
    """
    context, package = spark.sparkContext, Path(__file__).resolve().parent
    if context.applicationId in _shipped or not package.is_dir():
        return
    base = Path(tempfile.mkdtemp(prefix="tiepoints-")) / package.name
    context.addPyFile(shutil.make_archive(str(base), "zip", package.parent, package.name))
    _shipped.add(context.applicationId)


def spread(df: DataFrame) -> DataFrame:
    """Give the scan of a small file at least one task per core.

    A small file is one task however much work follows. A scan that has splits enough is
    returned as it is, so this moves at most a split's worth of bytes per core. Rows are placed
    by hash of the first column, which unlike round robin needs no sort to be repeatable.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, df.columns[0])


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once per row.

    They are the output of a generator, which the optimizer does not copy into later filters
    and projections as it does with the definition of an ordinary column.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(
        *[c for c in df.columns if c not in columns], F.inline(F.array(row))
    )


def settle(df: DataFrame, label: str = "settled") -> DataFrame:
    """Write ``df`` to the work folder and read it back.

    Cuts the lineage on storage that outlives executors, and makes the row count a metadata
    read. Meant for per-group tables (modes, models, counts), never for the points.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

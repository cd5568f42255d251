"""Parameter sweeps: the grid, what is still to do, and how runs ended."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiepoints.operators.joins import join_per_key

# Default settings of a sweep. Thresholds and confidences are text, because they
# go into file ids unchanged.
WINDOW_SIZES = "1024"
RANSAC_METHODS = ("4",)
RANSAC_THRESHOLDS = ("1", "2", "3")
RANSAC_CONFIDENCES = ("0.91", "0.95", "0.99")
MAX_KEYPOINTS = 2048
OOM_EXIT_CODES = (-9, 137)

REPORT_PAGE = 1000


def int_list(setting: Column, default: str = WINDOW_SIZES) -> Column:
    """A comma list of integers as an array; unset means the default. NULL where not a number."""
    return F.transform(
        F.split(F.coalesce(setting, F.lit(default)), ","), lambda s: F.trim(s).try_cast("int")
    )


def derived_parameters(
    runs: DataFrame, num_features: Column | int = MAX_KEYPOINTS, output_prefix: str = "window"
) -> DataFrame:
    """Parameters that follow from ``window_size``; the keypoint budget and folder prefix are given."""
    win = F.col("window_size")
    return runs.withColumns(
        {
            "window_size_small": F.greatest(F.lit(250), F.floor(win / 2).cast("int")),
            "loftr_max_window": win,
            "debug_mode": win > 2000,
            "min_surviving_chips": F.when(win >= 2000, 1).otherwise(2),
            "output_dir": F.concat(F.lit(output_prefix), win.cast("string")),
            "num_features": F.lit(num_features),
        }
    )


def sweep_grid(
    configs: DataFrame,
    window_sizes: str | None = None,
    methods: Sequence[str] = RANSAC_METHODS,
    thresholds: Sequence[str] = RANSAC_THRESHOLDS,
    confidences: Sequence[str] = RANSAC_CONFIDENCES,
) -> DataFrame:
    """Every configuration with every window size and fit. The lists are constants of the plan."""
    out = configs.withColumn("window_size", F.explode(int_list(F.lit(window_sizes).cast("string"))))
    for name, values in (
        ("ransac_method", methods),
        ("ransac_threshold", thresholds),
        ("ransac_confidence", confidences),
    ):
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return derived_parameters(out)


def pending(runs: DataFrame, done: DataFrame, keys: Sequence[str] = ("window_size",)) -> DataFrame:
    """Runs without an entry in the manifest. Only the manifest says that a run is complete."""
    return join_per_key(runs, done.where("done").select(*keys).distinct(), keys, "left_anti")


def to_fetch(pairs: DataFrame, cached: DataFrame, force: bool = False) -> DataFrame:
    """Pairs that are not cached yet; all of them when forced."""
    if force:
        return pairs
    return join_per_key(pairs, cached.select("pair_id").distinct(), ["pair_id"], "left_anti")


def without_failed(runs: DataFrame, failed: DataFrame) -> DataFrame:
    """Drop the runs of matchers that once failed to load."""
    return join_per_key(runs, failed.select("tag").distinct(), ["tag"], "left_anti")


def outcome(exit_code: Column) -> Column:
    return (
        F.when(exit_code == 0, "ok")
        .when(exit_code.isin(*OOM_EXIT_CODES), "OOM-killed")
        .otherwise(F.concat(F.lit("exit="), exit_code.cast("string")))
    )


def with_elapsed(log: DataFrame) -> DataFrame:
    """Elapsed minutes of every run, to one decimal."""
    return log.withColumn("elapsed_min", F.round((F.col("end_us") - F.col("start_us")) / 60e6, 1))


def run_summary(log: DataFrame) -> DataFrame:
    """Runs and minutes per outcome."""
    return (
        with_elapsed(log)
        .groupBy(outcome(F.col("exit_code")).alias("outcome"))
        .agg(F.count("*").alias("runs"), F.round(F.sum("elapsed_min"), 1).alias("minutes"))
    )


def run_status(log: DataFrame) -> DataFrame:
    """Counts of good and failed runs, and the overall status: 1 if any failed."""
    failed = F.col("exit_code") != 0
    return log.agg(
        F.count_if(~failed).alias("ok"),
        F.count_if(failed).alias("failed"),
        F.coalesce(F.max(failed.cast("int")), F.lit(0)).alias("status"),
    )


def run_report(log: DataFrame, page: int = REPORT_PAGE) -> DataFrame:
    """Names of the runs per outcome in catalog order, joined by ``", "``.

    A line covers ``page`` catalog positions, so that no row grows with the log; the lines of
    an outcome in ``page`` order are the whole list.
    """
    return log.groupBy(
        outcome(F.col("exit_code")).alias("outcome"),
        F.floor(F.col("ordinal") / page).alias("page"),
    ).agg(
        F.count("*").alias("runs"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("ordinal", "tag"))), lambda r: r["tag"]
            ),
            ", ",
        ).alias("tags"),
    )

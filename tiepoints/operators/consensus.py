"""Displacement consensus of the chips of a pair. The definition is this package's own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiepoints.operators.joins import join_settled
from tiepoints.session import settle

# Default consensus parameters.
TOLERANCE_M = 5.0
MODE_BIN_M = 0.5
MIN_INLIERS_PER_CHIP = 3
WIDE_WINDOW = 2000


def min_surviving_chips(window_size: int) -> int:
    return 1 if window_size >= WIDE_WINDOW else 2


def _mode(histogram: DataFrame, keys: list[str], prefix: str, bin_m: float) -> DataFrame:
    """Centre of the fullest displacement bin; ties to the lower bin."""
    best = F.max(F.struct("n", (-F.col("bx")).alias("nx"), (-F.col("by")).alias("ny")))
    return histogram.groupBy(*keys).agg(best.alias("_best")).select(
        *keys,
        ((0.5 - F.col("_best")["nx"]) * bin_m).alias(f"{prefix}_across"),
        ((0.5 - F.col("_best")["ny"]) * bin_m).alias(f"{prefix}_along"),
    )


def surviving_chips(
    points: DataFrame,
    pair: list[str],
    chip: str = "chip",
    *,
    tolerance: float = TOLERANCE_M,
    bin_m: float = MODE_BIN_M,
    min_inliers: int = MIN_INLIERS_PER_CHIP,
    fitted: DataFrame | None = None,
    means: DataFrame | None = None,
) -> DataFrame:
    """Chips whose mean displacement agrees with their pair: ``pair, chip, n, across, along``.

    ``points`` has ``across`` and ``along``. Inliers of a chip are the rows of ``fitted`` when
    given (see ``ransac.inliers``), else its points within ``tolerance`` of its own mode. With
    ``means`` their number ``n`` and means are known already, for one fit per chip or for several with
    columns of their own, which stay. Points are only ever counted into bins or averaged, both with
    map-side combine; what is joined back is one row per chip.
    """
    keys = [*pair, chip]
    bins = [F.floor(F.col("across") / bin_m).alias("bx"), F.floor(F.col("along") / bin_m).alias("by")]

    def near(value: str, mode: str):
        return F.abs(F.col(value) - F.col(mode)) <= tolerance

    if means is not None:
        # Modes of chips are of no use here: one row per pair is met.
        counted = points.groupBy(*pair, *bins).agg(F.count("*").alias("n"))
        modes = settle(_mode(counted, pair, "pair", bin_m), "modes")
        known = join_settled(means.where(F.col(chip).isNotNull() & (F.col("n") >= min_inliers)), modes, pair)
        return known.where(near("across", "pair_across") & near("along", "pair_along")).select(means.columns)
    binned = points.groupBy(*keys, *bins).agg(F.count("*").alias("n"))
    pair_bins = binned.groupBy(*pair, "bx", "by").agg(F.sum("n").alias("n"))
    modes = settle(
        _mode(binned, keys, "chip", bin_m).join(_mode(pair_bins, pair, "pair", bin_m), pair), "modes"
    )

    kept = join_settled(points if fitted is None else fitted, modes, keys)
    if fitted is None:
        kept = kept.where(near("across", "chip_across") & near("along", "chip_along"))
    return (
        kept.groupBy(*keys)
        .agg(
            F.count("*").alias("n"),
            F.avg("across").alias("across"),
            F.avg("along").alias("along"),
            F.first("pair_across").alias("pair_across"),
            F.first("pair_along").alias("pair_along"),
        )
        .where(F.col("n") >= min_inliers)
        .where(near("across", "pair_across") & near("along", "pair_along"))
        .drop("pair_across", "pair_along")
    )


def least_chips(window_size: Column) -> Column:
    """``min_surviving_chips`` of a column."""
    return F.when(window_size >= WIDE_WINDOW, 1).otherwise(2)


def chip_consensus(
    points: DataFrame, pair: list[str], chip: str = "chip", *, min_chips: int | None = None, fit: Sequence[str] = (), **options
) -> DataFrame:
    """Pairs with at least ``min_chips`` agreeing chips, and their mean displacement.

    ``fit`` names the columns that tell several fits of ``means`` apart. Without ``min_chips`` the rule of the window size holds if ``window_size`` is one of the keys, else 2.
    """
    if min_chips is None:
        least = least_chips(F.col("window_size")) if "window_size" in pair else F.lit(2)
    else:
        least = F.lit(min_chips)
    return (
        surviving_chips(points, pair, chip, **options)
        .groupBy(*pair, *fit)
        .agg(
            F.count("*").alias("chips"),
            F.sum("n").alias("n"),
            F.avg("across").alias("across"),
            F.avg("along").alias("along"),
        )
        .where(F.col("chips") >= least)
    )

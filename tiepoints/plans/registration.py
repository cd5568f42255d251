"""End-to-end runs put together from the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiepoints.functions.file_ids import detector_name
from tiepoints.operators import chips, consensus, correspond, matchers, ransac, records, sweep
from tiepoints.operators.correspond import Pixel
from tiepoints.session import fresh_path, settle


def displacement_consensus(
    points: DataFrame,
    size: int,
    valid1: Pixel,
    valid2: Pixel,
    displace,
    window: Sequence[str],
    pair: list[str],
    *,
    min_chips: int | None = None,
) -> DataFrame:
    """From raw correspondences to the agreed displacement of every pair.

    Bounds, nodata, minimum matches per window, displacement, chip consensus.
    """
    bounded = correspond.in_bounds(points, size, size, size, size)
    clear = correspond.drop_nodata(bounded, valid1, valid2)
    enough = correspond.min_matches(clear, window)
    return consensus.chip_consensus(displace(enough), pair, min_chips=min_chips)


def match_pairs(
    pairs: DataFrame,
    specs: Sequence[matchers.MatcherSpec],
    keep: Sequence[str],
    min_valid_fraction: float,
) -> DataFrame:
    """From chip pairs to cleaned windows, for every matcher of a catalog.

    Gates and preparation run before the pixels go to Python; sizes and masks travel along, so
    that the cleaning needs no join. The plan has no shuffle. Every window keeps a row, with the
    first gate that rejected it in ``reject_reason``.
    """
    prepared = chips.prepare_pairs(pairs, min_valid_fraction)
    carried = [*keep, "reject_reason", "w1", "h1", "w2", "h2", "mask1", "mask2"]
    found = matchers.run_catalog(prepared, specs, carried)
    failed = F.when(F.col("error").isNotNull(), F.lit("matcher_error"))
    return correspond.clean_windows(
        found.withColumn("reject_reason", F.coalesce("reject_reason", failed)),
        correspond.mask_pixel(F.col("mask1"), F.col("w1")),
        correspond.mask_pixel(F.col("mask2"), F.col("w2")),
    ).select(*keep, "tag", "reject_reason", "kp", "error")


RUN = ["window_size", "detector", "source_pol", "s1_ref_tag"]
FIT = ["ransac_method", "ransac_threshold", "ransac_confidence"]
_WINDOW = [
    "window_size", "source_pol", "s1_ref_tag", "pair_id", "wx", "wy", "s1_wx", "s1_wy", "geo", "w1", "h1", "w2", "h2",
    "mask1", "mask2", "reject_reason",
]


@dataclass(frozen=True)
class Registration:
    """What a run leaves, all of it written but for ``report`` and ``best``."""

    windows: DataFrame
    fits: DataFrame
    survivors: DataFrame
    best: DataFrame
    report: DataFrame


def _finished(found: DataFrame) -> DataFrame:
    """Cleaned windows of a pass without their masks."""
    failed = F.when(F.col("error").isNotNull(), F.lit("matcher_error"))
    cleaned = correspond.clean_windows(
        found.withColumn("reject_reason", F.coalesce("reject_reason", failed)),
        correspond.mask_pixel(F.col("mask1"), F.col("w1")),
        correspond.mask_pixel(F.col("mask2"), F.col("w2")),
    )
    chip = F.shiftleft(F.col("wx").cast("long"), 32) + F.col("wy")
    return cleaned.select(
        "window_size", detector_name(F.col("tag")).alias("detector"), "source_pol", "s1_ref_tag", "pair_id", chip.alias("chip"),
        "wx", "wy", "s1_wx", "s1_wy", "geo", "tag", "reject_reason", "kp", "error",
    )


def run(
    pairs: DataFrame,
    cat: DataFrame,
    load: Callable[..., matchers.Matcher],
    *,
    manifest: DataFrame | None = None,
    min_valid_fraction: float,
    methods: Sequence[str] = sweep.RANSAC_METHODS,
    thresholds: Sequence[str] = sweep.RANSAC_THRESHOLDS,
    confidences: Sequence[str] = sweep.RANSAC_CONFIDENCES,
    min_area: float = 200.0,
    per_pass: int = 4,
) -> Registration:
    """A whole run: a catalog table over a table of chip pairs, to the report of every configuration.

    Window sizes that ``manifest`` has as done are left out. The pairs are gated, inpainted and quantised in one
    scan and written; each pass of the catalog reads that. Windows become points in the map, all fits of the
    sweep share one scoring pass over the points, which also sums what the consensus of chips and the errors
    need, so the points are read for their hypotheses, their scores, and their histogram only.

    ``report`` has a row per window size, detector, polarisation and fit: windows, how many were accepted,
    whether the model loaded, pairs that agree (by the rule of their window size), their chips and inliers, mean
    displacement of the pairs, error of the inliers. A detector without any fit has one row without fit.
    """
    spark = pairs.sparkSession
    wanted = pairs if manifest is None else sweep.pending(pairs, manifest)
    prepared = settle(chips.prepare_pairs(wanted, min_valid_fraction).select(*_WINDOW, "u1", "u2"), "prepared")
    specs = matchers.catalog_specs(cat, load)
    windows = matchers.run_catalog_table(prepared, specs, _WINDOW, fresh_path(spark, "windows"), _finished, per_pass)

    keys = [*RUN, "pair_id", "chip"]
    kept = correspond.explode_points(windows.where(F.col("reject_reason").isNull()), [*keys, "wx", "wy", "s1_wx", "s1_wy", "geo"])
    points = records.located_points(kept).select(*keys, "x1", "y1", "x2", "y2", "across", "along")
    carried = {
        "squares": ransac.Carry("squares"), "across": ransac.Carry("sum", "across"), "along": ransac.Carry("sum", "along"),
        **ransac.inlier_extent("x1"), **ransac.inlier_extent("y1"),
    }
    found = ransac.fit_affine(
        points, keys, methods, [float(t) for t in thresholds], [float(c) for c in confidences], carry=carried, whole=ransac.GROUP_POINTS
    )
    area = (F.col("x1_max") - F.col("x1_min")) * (F.col("y1_max") - F.col("y1_min"))
    fits = settle(found.where(area >= min_area).drop("x1_min", "x1_max", "y1_min", "y1_max"), "fits")
    means = fits.select(
        *keys, *FIT, F.col("inliers").alias("n"), (F.col("across") / F.col("inliers")).alias("across"),
        (F.col("along") / F.col("inliers")).alias("along"), "squares",
    )
    survivors = settle(consensus.surviving_chips(points, [*RUN, "pair_id"], means=means), "survivors")
    return Registration(windows, fits, survivors, _best(fits), _report(windows, survivors))


def _best(fits: DataFrame) -> DataFrame:
    """The configuration with most inliers per chip, then least error, then name."""
    named = fits.select(
        "window_size", "pair_id", "chip", "inliers", F.sqrt(F.col("squares") / F.col("inliers")).alias("rmse"),
        F.concat_ws("_", "detector", "source_pol", "s1_ref_tag", *[F.col(c).cast("string") for c in FIT]).alias("name"),
    )
    return ransac.best_fit_per_chip(named, ["window_size", "pair_id", "chip"])


def _report(windows: DataFrame, survivors: DataFrame) -> DataFrame:
    tried = windows.groupBy(*RUN).agg(
        F.count("*").alias("windows"),
        F.count_if(F.col("reject_reason").isNull()).alias("accepted"),
        F.when(F.max(F.coalesce(F.col("error").startswith("load failed"), F.lit(False))), "load failed").otherwise("ok").alias("outcome"),
    )
    pairs = survivors.groupBy(*RUN, "pair_id", *FIT).agg(
        F.count("*").alias("chips"), F.sum("n").alias("n"), F.avg("across").alias("across"),
        F.avg("along").alias("along"), F.sum("squares").alias("squares"),
    ).where(F.col("chips") >= consensus.least_chips(F.col("window_size")))
    agreed = pairs.groupBy(*RUN, *FIT).agg(
        F.count("*").alias("pairs"), F.sum("chips").alias("chips"), F.sum("n").alias("inliers"),
        F.avg("across").alias("across"), F.avg("along").alias("along"), F.sqrt(F.sum("squares") / F.sum("n")).alias("rmse"),
    )
    return tried.join(agreed, RUN, "left")

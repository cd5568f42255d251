"""Cleaning correspondences: choice of point set, bounds, nodata, minimum count.

Two forms. ``clean_windows`` takes one row per window with point arrays, as matchers emit them,
and is map-only. The other functions take one row per point.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiepoints.functions.rasters import let, mask_at
from tiepoints.operators.joins import join_per_key
from tiepoints.session import once

MIN_MATCHES = 4

Pixel = Callable[[Column, Column], Column]


def select_keypoints(pred: DataFrame) -> DataFrame:
    """Pick the filtered point pair ``mm*`` if both exist and the first has points, else ``raw*``.

    Adds ``kp ARRAY<STRUCT<kp_idx,x1,y1,x2,y2>>`` (float32) and ``reject_reason``: ``no_points``
    for an empty choice, ``ragged`` for sides of unequal length. One to three filtered points
    do not fall back to the raw ones.
    """
    filtered = F.col("mm0").isNotNull() & F.col("mm1").isNotNull() & (F.size("mm0") > 0)
    chosen = once(
        pred,
        _p0=F.when(filtered, F.col("mm0")).otherwise(F.col("raw0")),
        _p1=F.when(filtered, F.col("mm1")).otherwise(F.col("raw1")),
    )
    p0, p1 = F.col("_p0"), F.col("_p1")
    reason = F.when(p0.isNull() | (F.size(p0) == 0), "no_points").when(
        p1.isNull() | (F.size(p0) != F.size(p1)), "ragged"
    )

    def coordinate(p: Column, axis: int, name: str) -> Column:
        return F.get(p, F.lit(axis)).cast("float").alias(name)

    points = F.transform(
        p0,
        lambda p, i: F.struct(
            i.alias("kp_idx"), coordinate(p, 0, "x1"), coordinate(p, 1, "y1"),
            coordinate(F.get(p1, i), 0, "x2"), coordinate(F.get(p1, i), 1, "y2"),
        ),
    )
    return once(chosen, reject_reason=reason, kp=F.when(reason.isNull(), points)).drop("_p0", "_p1")


def _inside(x: Column, y: Column, w: Column, h: Column) -> Column:
    # NaN compares greater than everything here, so the upper bound drops it.
    return (x >= 0) & (x < w) & (y >= 0) & (y < h)


def in_bounds(points: DataFrame, w1, h1, w2, h2) -> DataFrame:
    """Points inside their own image on both sides, half-open; NaN is dropped."""
    size = [F.lit(v) if isinstance(v, int) else v for v in (w1, h1, w2, h2)]
    return points.where(
        _inside(F.col("x1"), F.col("y1"), size[0], size[1])
        & _inside(F.col("x2"), F.col("y2"), size[2], size[3])
    )


def mask_pixel(mask: Column, width: Column) -> Pixel:
    """Validity of the pixel under a point, from a mask of one byte per pixel on the same row."""

    def valid(x: Column, y: Column) -> Column:
        # try_cast: a NaN point that an earlier predicate drops must not raise here.
        return mask_at(mask, width, F.floor(x).try_cast("int"), F.floor(y).try_cast("int"))

    return valid


def drop_nodata(points: DataFrame, valid1: Pixel, valid2: Pixel) -> DataFrame:
    """Points whose pixel is valid in both images."""
    return points.where(
        valid1(F.col("x1"), F.col("y1")) & valid2(F.col("x2"), F.col("y2"))
    )


def drop_nodata_by_table(
    points: DataFrame, nodata_pixels: DataFrame, chip_id: str, x: str, y: str
) -> DataFrame:
    """Points that touch no row of a nodata pixel table ``(chip_id, iy, ix)``.

    For masks kept as tables; only nodata pixels travel, as an anti join on the pixel.
    """
    pixel = points.withColumn("_ix", F.floor(x).try_cast("int")).withColumn(
        "_iy", F.floor(y).try_cast("int")
    )
    bad = nodata_pixels.select(
        F.col("chip_id").alias(chip_id), F.col("iy").alias("_iy"), F.col("ix").alias("_ix")
    ).distinct()
    return join_per_key(pixel, bad, [chip_id, "_iy", "_ix"], "left_anti").drop("_ix", "_iy")


def min_matches(points: DataFrame, keys: Sequence[str], least: int = MIN_MATCHES) -> DataFrame:
    """Points of windows that still have at least ``least`` of them.

    Windows are counted with partial aggregation and the short ones removed by an anti join.
    A short window has fewer than ``least`` rows, so no key of the joined side can be hot.
    """
    short = points.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") < least).drop("n")
    return join_per_key(points, short, keys, "left_anti")


def clean_windows(pred: DataFrame, valid1: Pixel, valid2: Pixel, least: int = MIN_MATCHES) -> DataFrame:
    """The whole cleaning of one row per window, in gate order, without a shuffle.

    Needs ``w1, h1, w2, h2`` and the prediction arrays; rows that already carry a
    ``reject_reason`` keep it. ``kp`` holds the surviving points and is NULL on a rejected row.
    """
    earlier = F.col("reject_reason") if "reject_reason" in pred.columns else F.lit(None).cast("string")
    chosen = select_keypoints(pred.withColumn("_earlier", earlier))

    def inside(p: Column) -> Column:
        return _inside(p["x1"], p["y1"], F.col("w1"), F.col("h1")) & _inside(
            p["x2"], p["y2"], F.col("w2"), F.col("h2")
        )

    def clear(p: Column) -> Column:
        return valid1(p["x1"], p["y1"]) & valid2(p["x2"], p["y2"])

    staged = once(
        chosen,
        _kept=let(
            F.filter("kp", inside),
            lambda bounded: F.struct(
                F.size(bounded).alias("n_bounded"), F.filter(bounded, clear).alias("kp")
            ),
        ),
    )
    kept = F.col("_kept")
    reason = F.coalesce(
        "_earlier",
        "reject_reason",
        F.when(kept["n_bounded"] == 0, "out_of_bounds").when(F.size(kept["kp"]) < least, "too_few"),
    )
    return once(
        staged, reject_reason=reason, kp=F.when(reason.isNull(), kept["kp"])
    ).drop("_kept", "_earlier")


def explode_points(windows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per surviving point of cleaned windows."""
    return windows.select(*keep, F.inline("kp"))


def reject_counts(windows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How many windows each reason rejected; accepted ones count as ``accepted``."""
    return (
        windows.groupBy(*keys, F.coalesce("reject_reason", F.lit("accepted")).alias("reject_reason"))
        .agg(F.count("*").alias("n"))
    )

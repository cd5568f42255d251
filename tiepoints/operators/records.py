"""Match records: one struct of lists per window, and the way back to one row per point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiepoints import schemas
from tiepoints.functions import file_ids, geometry
from tiepoints.session import once


def located_points(points: DataFrame) -> DataFrame:
    """Map coordinates, displacement and full-image pixels of window-local points.

    Needs ``x1..y2`` and the window's ``wx, wy, s1_wx, s1_wy, geo``.
    """
    geo, wx, wy = F.col("geo"), F.col("wx"), F.col("wy")
    swx, swy = F.col("s1_wx"), F.col("s1_wy")
    x1, y1, x2, y2 = (F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2"))
    X1, Y1 = geometry.map_point(x1, y1, geo, 1, wx, wy)
    X2, Y2 = geometry.map_point(x2, y2, geo, 2, swx, swy)
    mapped = points.withColumns({"map_x1": X1, "map_y1": Y1, "map_x2": X2, "map_y2": Y2})
    moved = geometry.displacement(*(F.col(c) for c in ("map_x1", "map_y1", "map_x2", "map_y2")))
    full1 = geometry.full_image_point(x1, y1, wx, wy)
    full2 = geometry.full_image_point(x2, y2, swx, swy)
    return mapped.withColumns(
        {**moved, "full_x1": full1[0], "full_y1": full1[1], "full_x2": full2[0], "full_y2": full2[1]}
    )


def _located(kp: Column, window: dict[str, Column]) -> Column:
    """``kp`` with every record field computed per point."""
    geo, wx, wy, swx, swy = (window[c] for c in ("geo", "wx", "wy", "s1_wx", "s1_wy"))

    def locate(p: Column) -> Column:
        x1, y1, x2, y2 = (p[c].cast("double") for c in ("x1", "y1", "x2", "y2"))
        mapped = (*geometry.map_point(x1, y1, geo, 1, wx, wy), *geometry.map_point(x2, y2, geo, 2, swx, swy))
        full = (*geometry.full_image_point(x1, y1, wx, wy), *geometry.full_image_point(x2, y2, swx, swy))
        values = (*full, *mapped, *geometry.displacement(*mapped).values())
        return F.struct(*[v.alias(name) for name, v in zip(schemas.RECORD_LISTS, values)])

    return F.transform(kp, locate)


def build_records(windows: DataFrame, *, keep: Sequence[str] = ()) -> DataFrame:
    """One record per row of cleaned windows (``kp`` array, see ``clean_windows``). Map-only.

    Needs ``tag, source_pol, s1_ref_tag, pair_id, wx, wy, s1_wx, s1_wy, geo`` and, for the file
    id, the strings ``ransac_method, ransac_threshold, ransac_confidence``. Lists follow
    ``kp_idx``.
    """
    window = {c: F.col(c) for c in ("geo", "wx", "wy", "s1_wx", "s1_wy")}
    position = geometry.global_position(window["geo"], window["wx"], window["wy"])
    file_id = file_ids.build_file_id(
        F.col("tag"), F.col("source_pol"), F.col("s1_ref_tag"), F.col("pair_id"),
        position["global_scan"], position["global_pix"],
        F.col("ransac_method"), F.col("ransac_threshold"), F.col("ransac_confidence"),
    )
    located = once(
        windows.where(F.col("kp").isNotNull()), _points=_located(F.array_sort("kp"), window)
    )
    return located.select(
        *keep,
        file_id.alias("file_id"),
        "pair_id",
        position["global_scan"].alias("global_scan"),
        position["global_pix"].alias("global_pix"),
        window["wx"].alias("local_init_x"),
        window["wy"].alias("local_init_y"),
        F.lit(file_ids.MATCHER_TOKEN).alias("matcher"),
        F.lit("").alias("match_param"),
        *[F.col("_points")[name].alias(name) for name in schemas.RECORD_LISTS],
    )


def gather_windows(
    points: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] = ("x1", "y1", "x2", "y2"),
    extra: Sequence[str] = (),
) -> DataFrame:
    """Collect point rows into ``kp`` arrays, one row per window.

    A window is bounded by the keypoint budget of whatever produced it (see
    ``matching.top_keypoints``), so it is one row whatever the partitioning, and later gates judge it
    as a whole. Points are numbered by ``order``; ``extra`` columns stay with them.
    """
    fields = dict.fromkeys(["x1", "y1", "x2", "y2", *extra])
    payload = F.struct(*dict.fromkeys([*order, *fields]))
    return (
        points.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(payload)).alias("_sorted"))
        .withColumn(
            "kp",
            F.transform(
                "_sorted",
                lambda p, i: F.struct(i.alias("kp_idx"), *[p[c].alias(c) for c in fields]),
            ),
        )
        .drop("_sorted")
    )


def explode_records(records: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per point, lists of a record as columns; the inverse of ``build_records``."""
    return records.select(*keep, F.inline(F.arrays_zip(*schemas.RECORD_LISTS)))


def parse_keys(files: DataFrame, name: str = "file_name") -> DataFrame:
    """Add ``key``, decoded from each file basename; NULL for names of another format."""
    split = once(files, _parts=file_ids.tokens(F.col(name)))
    valued = once(split, _values=file_ids.numbers(F.col("_parts")))
    return once(valued, key=file_ids.key(F.col("_parts"), F.col("_values"))).drop("_parts", "_values")

"""Ground control points.

Control points lie in grid cells as wide as the search radius. A cell with more than ``MOST`` of them is split
into four, again and again, until every leaf has at most that many, so no list grows with a crowd. A match
sees the points of the cells around it, and of split cells the bounding boxes of their leaves; it reads
only those leaves that can hold a point as near as what it surely has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiepoints.operators.joins import join_settled
from tiepoints.session import settle

MOST = 1024
#: Halvings of a cell's width; points that are still together are dealt out by id.
LEVELS = 30

_LEAF = ["_level", "_lx", "_ly", "_slot"]


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("bigint")


def _at_level(points: DataFrame, radius: float, level: int) -> DataFrame:
    width = radius / 2.0**level
    return points.withColumns(
        {"_level": F.lit(level), "_lx": _cell(F.col("X"), width), "_ly": _cell(F.col("Y"), width), "_slot": F.lit(0)}
    )


def leaves_of(gcps: DataFrame, radius: float, most: int = MOST) -> tuple[DataFrame, DataFrame | None]:
    """Control points of cells that are not split, and of the leaves of split ones (None without any).

    Points at one position are merged to the lowest id first. One pass per level that still has crowds.
    """
    unique = settle(gcps.groupBy("X", "Y").agg(F.min("gcp_id").alias("gcp_id")), "gcps")
    inside = ["_lx", "_ly"]
    whole, split, rest = None, [], _at_level(unique, radius, 0)
    for level in range(LEVELS + 1):
        crowded = rest.groupBy(*inside).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
        if crowded.isEmpty():
            if whole is None:
                return rest, None
            split.append(rest)
            break
        crowded = settle(crowded, "crowded")
        calm = join_settled(rest, crowded.drop("_n"), inside, "left_anti")
        if whole is None:
            whole = calm
        else:
            split.append(calm)
        packed = join_settled(rest, crowded, inside)
        if level == LEVELS:
            slots = F.ceil(F.col("_n") * 2 / most)
            split.append(packed.withColumn("_slot", F.pmod(F.xxhash64("gcp_id"), slots).cast("int")).drop("_n"))
        else:
            rest = settle(_at_level(packed.select("gcp_id", "X", "Y"), radius, level + 1), "crowd")
    return whole, reduce(DataFrame.unionByName, split)


def _around(rows: DataFrame, cx: Column, cy: Column) -> DataFrame:
    """Every row for its grid cell and the 8 around."""
    offsets = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    for name, value in (("_cx", cx), ("_cy", cy)):
        rows = rows.withColumn(name, value).withColumn(name, F.explode(F.transform(offsets, lambda d: F.col(name) + d)))  # noqa: B023
    return rows


def _squared(dx: Column, dy: Column) -> Column:
    return dx * dx + dy * dy


def _closest(listed: Column, radius: float) -> Column:
    """The nearest listed point within the radius as ``struct(d2, gcp_id)``, else NULL."""
    ranked = F.transform(
        listed,
        lambda g: F.struct(_squared(F.col("_x") - g["X"], F.col("_y") - g["Y"]).alias("d2"), g["gcp_id"].alias("gcp_id")),
    )
    return F.array_min(F.filter(ranked, lambda c: c["d2"] <= radius * radius))


def _promising(boxes: Column, best: Column, radius: float) -> Column:
    """Leaves that can hold a point at least as near as every match surely has one."""
    x, y = F.col("_x"), F.col("_y")

    def nearest(b: Column) -> Column:
        beside = lambda v, lo, hi: F.greatest(lo - v, v - hi, F.lit(0.0))
        return _squared(beside(x, b["x0"], b["x1"]), beside(y, b["y0"], b["y1"]))

    def farthest(b: Column) -> Column:
        across = lambda v, lo, hi: F.greatest(F.abs(v - lo), F.abs(v - hi))
        return _squared(across(x, b["x0"], b["x1"]), across(y, b["y0"], b["y1"]))

    bound = F.least(F.array_min(F.transform(boxes, farthest)), best, F.lit(radius * radius))
    return F.transform(F.array(bound), lambda most: F.filter(boxes, lambda b: nearest(b) <= most))[0]


def nearest_gcp(
    matches: DataFrame, gcps: DataFrame, radius: float, x: str = "map_x1", y: str = "map_y1", most: int = MOST
) -> DataFrame:
    """For every match its nearest control point within ``radius``, if any; ties to the lower id.

    Adds ``gcp_id`` and ``gcp_distance``. A match without a position has none. Tables of cells and leaves are
    joined by their measured size (see ``join_settled``): small ones are broadcast, and where no cell is
    crowded the matches do not move.
    """
    whole, split = leaves_of(gcps, radius, most)
    cell, point = ["_cx", "_cy"], F.struct("gcp_id", "X", "Y")
    cells = _around(whole, F.col("_lx"), F.col("_ly")).groupBy(*cell).agg(F.collect_list(point).alias("_gcps"))
    if split is not None:
        lists = split.groupBy(*_LEAF).agg(
            F.collect_list(point).alias("_listed"), F.min("X").alias("x0"), F.max("X").alias("x1"), F.min("Y").alias("y0"), F.max("Y").alias("y1")
        )
        lists = settle(lists, "leaves")
        up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), "_level")).cast("bigint")
        boxes = _around(lists.drop("_listed"), up("_lx"), up("_ly")).groupBy(*cell)
        boxes = boxes.agg(F.collect_list(F.struct(*_LEAF, "x0", "x1", "y0", "y1")).alias("_boxes"))
        cells = cells.join(boxes, cell, "full")
    cells = settle(cells, "cells")
    placed = matches.withColumns({"_x": F.col(x), "_y": F.col(y), "_cx": _cell(F.col(x), radius), "_cy": _cell(F.col(y), radius)})
    met = join_settled(placed, cells, cell, "left").withColumn("_best", _closest(F.col("_gcps"), radius)).drop("_gcps")
    if split is not None:
        beside_crowd = met.where("_boxes is not null").select("_x", "_y", "_boxes", "_best").dropDuplicates(["_x", "_y"])
        asked = beside_crowd.select("_x", "_y", F.inline(_promising(F.col("_boxes"), F.col("_best.d2"), radius)))
        found = join_settled(asked.select("_x", "_y", *_LEAF), lists.select(*_LEAF, "_listed"), _LEAF)
        found = found.groupBy("_x", "_y").agg(F.min(_closest(F.col("_listed"), radius)).alias("_inside"))
        met = join_settled(met, settle(found, "nearest"), ["_x", "_y"], "left").withColumn("_best", F.least("_best", "_inside"))
    return met.select(
        *matches.columns,
        F.col("_best")["gcp_id"].alias("gcp_id"),
        F.sqrt(F.col("_best")["d2"]).alias("gcp_distance"),
    )

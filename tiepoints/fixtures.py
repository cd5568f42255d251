"""Operator inputs derived from the given tables (recipes of FIXTURES.md)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiepoints.functions.rasters import let
from tiepoints.operators.matchers import Matcher, phase_correlation
from tiepoints.operators.records import gather_windows
from tiepoints.session import spread

IMAGE = 1024
CHIP = 8
MISSING_TYPE = "ECONOMY"
MISSING_MATCHER = "Brand#2"
MISSING_DENSE = "Brand#17"
HEAVY = ("ring", "widget")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def correspondences_of(lineitem: DataFrame) -> DataFrame:
    """One correspondence per line item, with planted shifts, outliers and bad chips."""
    supp, line, qty = F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_quantity")
    inlier = F.col("l_discount") <= 0.065
    x1 = ((F.col("l_partkey") * 7) % 1100 - 20).cast("double")
    y1 = (F.floor("l_extendedprice").cast("bigint") % 1100 - 20).cast("double")
    bad = F.when(supp % 10 == 9, 15 * line).when(line == 7, 12).otherwise(0)
    noise_x = F.when(inlier, (F.round(F.col("l_tax") * 100).cast("int") - 4) * 0.125).otherwise(
        qty * 4 - 100
    )
    noise_y = F.when(inlier, (qty.cast("int") % 5 - 2) * 0.125).otherwise(100 - qty * 2)
    pol = F.col("l_partkey") % 2 == 0
    return lineitem.select(
        (supp % 20).cast("int").alias("pair_id"),
        line.alias("chip"),
        F.col("l_orderkey").alias("win"),
        F.concat(F.lit("imw-d"), (F.col("l_partkey") % 3).cast("string")).alias("detector"),
        F.when(pol, "HH").otherwise("HV").alias("source_pol"),
        F.when(pol, "VV").otherwise("VH").alias("s1_ref_tag"),
        (~inlier).alias("outlier"),
        (qty / 64).alias("score"),
        x1.alias("x1"),
        y1.alias("y1"),
        (x1 + supp % 5 + bad + noise_x).alias("x2"),
        (y1 - supp % 3 + noise_y).alias("y2"),
    )


def correspondences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correspondences_of(table(spark, sf_dir, "lineitem"))


def valid1(x: Column, y: Column) -> Column:
    return F.floor(x) % 64 >= 4


def valid2(x: Column, y: Column) -> Column:
    return F.floor(y) % 64 >= 4


def with_displacement(points: DataFrame) -> DataFrame:
    """Displacement in image pixels taken as metres."""
    return points.withColumns(
        {
            "across": F.col("x1") - F.col("x2"),
            "along": F.col("y1") - F.col("y2"),
            "distance": F.hypot(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")),
        }
    )


def with_geometry(rows: DataFrame) -> DataFrame:
    """Window origins and the geometry struct, from ``pair_id`` and ``chip``."""
    pair, chip = F.col("pair_id"), F.col("chip")
    x0, y0 = (1000 * pair).cast("double"), (-500 * pair).cast("double")
    return rows.withColumns(
        {
            "wx": (1024 * chip).cast("int"),
            "wy": (512 * chip).cast("int"),
            "s1_wx": (1024 * chip + 2).cast("int"),
            "s1_wy": (512 * chip - 3).cast("int"),
            "geo": F.struct(
                x0.alias("x01"), y0.alias("y01"), F.lit(10.0).alias("xres1"), F.lit(-10.0).alias("yres1"),
                (x0 + 5.0).alias("x02"), (y0 - 5.0).alias("y02"),
                F.lit(10.0).alias("xres2"), F.lit(-10.0).alias("yres2"),
                F.lit(100).alias("crop_col_offset"), F.lit(200).alias("crop_row_offset"),
            ),
        }
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One matcher prediction per order: all points raw, inliers filtered, none for every 7th.

    An order has few items, as a matcher returns a bounded number of points for a window.
    """
    points = correspondences(spark, sf_dir)
    windows = gather_windows(points, ["win"], extra=["outlier"])

    def side(kp: Column, x: str, y: str) -> Column:
        return F.transform(kp, lambda p: F.array(p[x].cast("float"), p[y].cast("float")))

    good = F.filter("kp", lambda p: ~p["outlier"])
    filtered = F.col("win") % 7 != 0
    return with_geometry(
        windows.select(
            "win",
            (F.col("win") % 20).cast("int").alias("pair_id"),
            (F.col("win") % 7 + 1).cast("int").alias("chip"),
            F.concat(F.lit("m"), (F.col("win") % 5).cast("string")).alias("tag"),
            F.when(F.col("win") % 2 == 0, "HH").otherwise("HV").alias("source_pol"),
            F.when(F.col("win") % 2 == 0, "VV").otherwise("VH").alias("s1_ref_tag"),
            *[F.lit(IMAGE).alias(c) for c in ("w1", "h1", "w2", "h2")],
            side(F.col("kp"), "x1", "y1").alias("raw0"),
            side(F.col("kp"), "x2", "y2").alias("raw1"),
            F.when(filtered, side(good, "x1", "y1")).alias("mm0"),
            F.when(filtered, side(good, "x2", "y2")).alias("mm1"),
            F.lit("4").alias("ransac_method"),
            F.lit("1").alias("ransac_threshold"),
            F.lit("0.95").alias("ransac_confidence"),
        )
    )


def match_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match file names, some of another format or unreadable."""
    supp, part, line = F.col("l_suppkey"), F.col("l_partkey"), F.col("l_linenumber")
    even = part % 2 == 0
    s = lambda c: c.cast("string")
    name = F.concat(
        F.when(supp % 13 == 0, "disk").otherwise(F.concat(F.lit("imw-m"), s(supp % 5))),
        F.when(even, "_HH_toS1VV").otherwise("_HV_toS1VH"),
        F.lit("_pair"), F.when(F.col("l_quantity") == 50, "X").otherwise(s(supp % 20)),
        F.lit("_scan"), s(line * 1024), F.lit("_pix"), s(part), F.lit("_lgm"),
        F.when(line == 7, "_hom").otherwise("_aff"), F.lit("_4_"), s(part % 3 + 1),
        F.when(F.col("l_quantity") == 49, "").otherwise(
            F.when(part % 3 == 0, "_0.91").when(part % 3 == 1, "_0.95").otherwise("_0.99")
        ),
        F.lit("_"),
        F.when(line == 6, "").otherwise(".csv"),
    )
    return table(spark, sf_dir, "lineitem").select(name.alias("file_name"))


def reference_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference image per pair and reference polarisation."""
    pairs = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 20).cast("int").alias("pair_id"))
    return pairs.distinct().select(
        "pair_id", F.explode(F.array(F.lit("VV"), F.lit("VH"))).alias("ref_pol")
    ).withColumn("ref_path", F.concat(F.lit("ref/"), "ref_pol", F.lit("/"), F.col("pair_id").cast("string")))


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration specs with repeated and malformed tags."""
    dense = F.col("p_size") % 2 == 0
    name = F.when(F.col("p_partkey") % 50 == 0, F.col("p_name")).otherwise(
        F.replace("p_name", F.lit(" "), F.lit("-"))
    )
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("int").alias("ordinal"),
        F.concat(name, F.lit("-"), (F.col("p_partkey") % 97).cast("string")).alias("tag"),
        F.when(~dense, F.col("p_type")).alias("extractor"),
        F.col("p_brand").alias("matcher"),
        dense.alias("dense"),
    )


def confs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conf tables that lack one extractor, one matcher and one dense matcher."""
    part = table(spark, sf_dir, "part")

    def named(kind: str, column: str, missing: str) -> DataFrame:
        name = F.col(column)
        conf = F.when(name.endswith("7"), F.lit('{"model":{}}')).otherwise(
            F.concat(F.lit('{"model":{"name":"'), F.lower(name), F.lit('"}}'))
        )
        return part.where(name != missing).select(F.lit(kind).alias("kind"), name.alias("name"), conf.alias("conf")).distinct()

    return (
        named("extract", "p_type", MISSING_TYPE)
        .unionByName(named("match", "p_brand", MISSING_MATCHER))
        .unionByName(named("dense", "p_brand", MISSING_DENSE))
    )


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    start = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    return table(spark, sf_dir, "orders").select(
        key.alias("ordinal"),
        F.concat(F.lit("t"), key.cast("string")).alias("tag"),
        (key % 2 == 0).alias("dense"),
        F.get(F.array(*[F.lit(c) for c in (0, 0, 1, 137, -9, 2)]), (key % 6).cast("int")).alias("exit_code"),
        start.alias("start_us"),
        (start + F.round(F.col("o_totalprice") * 1000000).cast("bigint")).alias("end_us"),
    )


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("bigint").alias("block"),
        (F.col("vec_id") % 2).cast("int").alias("side"),
        F.col("vec_id").alias("id"),
        F.col("embedding").alias("d"),
    )


def chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 chips with NULL as nodata; every 41st is flat, every 37th holds a NaN."""
    pixel = lambda v, i: (
        F.when(F.col("vec_id") % 41 == 0, F.lit(0.5))
        .when((F.col("vec_id") % 37 == 0) & (i == 5), F.lit(float("nan")))
        .when(F.abs(v) >= 0.02, v)
    ).cast("float")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chip_id"),
        F.lit(CHIP).alias("w"),
        F.lit(CHIP).alias("h"),
        F.lit(None).cast("float").alias("nodata"),
        F.transform("embedding", pixel).alias("px"),
    )


def _rolled(px: Column, by: Column) -> Column:
    def roll(px: Column) -> Column:
        return F.transform(
            px,
            lambda _, i: F.get(
                px, (F.floor(i / CHIP) * CHIP + F.pmod(i - by, F.lit(CHIP))).cast("int")
            ),
        )

    return let(px, roll)


def chip_pairs(spark: SparkSession, sf_dir: str, nodata: bool = True) -> DataFrame:
    """Chips with a copy rolled by ``chip_id % 8`` columns, whose nodata is a number."""
    shift = F.col("chip_id") % CHIP
    if nodata:
        base = chips(spark, sf_dir)
    else:
        base = table(spark, sf_dir, "embeddings").select(
            F.col("vec_id").alias("chip_id"), F.col("embedding").alias("px"),
            F.lit(None).cast("float").alias("nodata"),
        )
    return base.select(
        "chip_id",
        F.col("px").alias("px1"),
        F.transform(_rolled(F.col("px"), shift), lambda v: F.coalesce(v, F.lit(-9999.0).cast("float"))).alias("px2"),
        F.col("nodata").alias("nodata1"),
        F.lit(-9999.0).cast("float").alias("nodata2"),
        *[F.lit(CHIP).alias(c) for c in ("w1", "h1", "w2", "h2")],
    )


def registration_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chip pairs of several window sizes and polarisations, with known shifts.

    All chips of a pair are moved by the same columns, but for every 11th; every 50th is a pair of its own.
    """
    vec = F.col("vec_id")
    pair = F.when(vec % 50 == 0, 1000 + vec).otherwise(vec % 40).cast("int")
    base = table(spark, sf_dir, "embeddings").select(
        pair.alias("pair_id"), vec.cast("int").alias("chip"), F.col("embedding").alias("px1"), "vec_id"
    )
    shift = F.pmod(F.col("pair_id") % CHIP + F.when(vec % 11 == 0, 2).otherwise(0), F.lit(CHIP))
    pol = F.col("pair_id") % 2 == 0
    rows = base.select(
        "pair_id", "chip", "px1", _rolled(F.col("px1"), shift).alias("px2"),
        F.when(F.col("pair_id") % 20 == 19, 512).when(F.col("pair_id") % 3 == 0, 2048).otherwise(1024).alias("window_size"),
        F.when(pol, "HH").otherwise("HV").alias("source_pol"), F.when(pol, "VV").otherwise("VH").alias("s1_ref_tag"),
        *[F.lit(None).cast("float").alias(c) for c in ("nodata1", "nodata2")],
        *[F.lit(CHIP).alias(c) for c in ("w1", "h1", "w2", "h2")],
    )
    return with_geometry(rows)


def flawed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chip pairs of which most have a flaw, told by ``vec_id % 10``: 0 to 3 in shape, 4 to 7 in image 2 only."""
    case, px = F.col("vec_id") % 10, F.col("embedding")
    second = (
        F.when(case == 1, F.array().cast("array<float>"))
        .when(case == 2, F.slice("embedding", 1, CHIP * CHIP - 1))
        .when(case == 4, F.transform(px, lambda v: F.lit(0.25).cast("float")))
        .when(case == 5, F.transform(px, lambda v, i: F.when(i == 9, F.lit(float("nan")).cast("float")).otherwise(v)))
        .when(case == 6, F.transform(px, lambda v, i: F.when(i >= 20, v)))
        .when(case == 7, F.transform(px, lambda v: F.lit(None).cast("float")))
        .otherwise(px)
    )
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chip_id"), F.when(case != 0, px).alias("px1"), second.alias("px2"),
        *[F.lit(None).cast("float").alias(c) for c in ("nodata1", "nodata2")],
        *[F.lit(CHIP).alias(c) for c in ("w1", "h1", "w2")], F.when(case == 3, -CHIP).otherwise(CHIP).alias("h2"),
    )


def flawed_matcher(kind: str) -> Matcher:
    """Matchers that go wrong in the ways that matchers do."""
    grid = np.array([(x, y, 1.0) for y in range(0, CHIP, 2) for x in range(0, CHIP, 2)])

    def match(image1, image2):
        if kind == "raising":
            raise ValueError("cannot match")
        if kind == "flat":
            return {"mm0": np.arange(5), "mm1": np.arange(5)}
        if kind == "wide":  # more columns than two are cut off
            return {"mm0": grid, "mm1": grid}
        if kind == "uneven":
            return {"raw0": grid[:, :2], "raw1": grid[1:, :2]}
        if kind == "outside":
            return {"raw0": grid[:, :2] + CHIP, "raw1": grid[:, :2]}
        if kind == "few":
            return {"raw0": grid[:3, :2], "raw1": grid[:3, :2]}
        return {"mm0": [], "raw0": None}

    if kind == "missing":
        raise OSError("no weights")
    return match


FLAWED = ("wide", "flat", "uneven", "outside", "few", "empty", "raising", "missing")


def done_window_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest in which the window sizes of some regions are done."""
    region = table(spark, sf_dir, "region").where(F.col("r_regionkey") < 2)
    return region.select((512 + 3584 * F.col("r_regionkey")).cast("int").alias("window_size"), F.lit(True).alias("done"))


def wanted_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma lists of the tags that a run is to use, one list per nation."""
    nation = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("int").alias("ordinal"))
    return specs(spark, sf_dir).join(F.broadcast(nation), "ordinal").select(F.col("tag").alias("tags"))


def load_matcher(conf: dict) -> Matcher:
    """Phase correlation in steps that the model's name tells; a conf without a name cannot be loaded."""
    name = conf["matcher"]["model"].get("name")
    if name is None:
        raise ValueError("model without name")
    return phase_correlation(1 + int(name[-1]) % 2)


def gcps(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("gcp_id"),
        ((key * 97) % 1000 * 10.0 + 5.0).alias("X"),
        ((key * 389) % 1000 * 10.0).alias("Y"),
    )


def gcp_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("match_id"),
        (F.floor("o_totalprice") % 1000 * 10.0).alias("map_x1"),
        ((F.col("o_orderkey") * 7) % 997 * 10.0).alias("map_y1"),
    )

"""The registered queries; each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiepoints import fixtures as fx
from tiepoints import schemas
from tiepoints.functions import file_ids, geometry, rasters
from tiepoints.operators import (
    catalog,
    chips,
    consensus,
    correspond,
    geo,
    matchers,
    matching,
    ransac,
    records,
    stats,
    sweep,
)
from tiepoints.plans import registration
from tiepoints.session import fresh_path
from tiepoints.sources import readers, writers
from tiepoints.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PAIR, CHIP = ["pair_id"], ["pair_id", "chip"]
MIN_VALID = 0.8


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def r6(value: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison, without negative zero."""
    return F.round(value, digits) + F.lit(0.0)


# --- registry -------------------------------------------------------------------------------


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.resolve(catalog.first_valid(fx.specs(spark, sf)), fx.confs(spark, sf))


def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.catalog(_resolved(spark, sf))


@query
def registry_resolve(spark: SparkSession, sf: str) -> DataFrame:
    return _catalog(spark, sf).select(
        "ordinal",
        "tag",
        "dense",
        F.try_variant_get("conf.feature", "$.model.name", "string").alias("feature_name"),
        F.try_variant_get("conf.matcher", "$.model.name", "string").alias("matcher_name"),
    )


@query
def registry_skips(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.skips(_resolved(spark, sf))


@query
def tag_violations(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.tag_violations(fx.specs(spark, sf))


@query
def registry_counts(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.counts(_catalog(spark, sf))


@query
def registry_listing(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.listing(_catalog(spark, sf))


@query
def heavy_dense(spark: SparkSession, sf: str) -> DataFrame:
    flagged = catalog.with_run_forward(_catalog(spark, sf), needles=fx.HEAVY)
    return flagged.select("ordinal", "tag", "dense", catalog.is_heavy(fx.HEAVY).alias("heavy"), "run_forward")


@query
def allow_list(spark: SparkSession, sf: str) -> DataFrame:
    # The second entry of every list has a leading space, which is not trimmed away.
    lists = fx.table(spark, sf, "part").select(
        F.concat(
            F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), (F.col("p_size") % 97).cast("string"),
            F.lit(", "), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-1"),
        ).alias("tags")
    )
    return catalog.allow_table(_catalog(spark, sf), lists).select("ordinal", "tag", "dense")


@query
def tag_lookup(spark: SparkSession, sf: str) -> DataFrame:
    wanted = fx.table(spark, sf, "part").select(
        F.col("p_partkey").alias("request_id"),
        F.concat(
            F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), (F.col("p_partkey") % 101).cast("string")
        ).alias("tag"),
    )
    return catalog.lookup_tags(wanted, _catalog(spark, sf)).select(
        "request_id", "tag", "catalog_ordinal", "status"
    )


@query
def registry_from_files(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "registry")
    specs = catalog.first_valid(fx.specs(spark, sf))
    specs.where(~F.col("dense")).drop("dense").write.json(f"{path}/sparse")
    specs.where("dense").drop("dense", "extractor").write.json(f"{path}/dense")
    fx.confs(spark, sf).write.parquet(f"{path}/confs")
    read = catalog.all_specs(
        readers.read_sparse_specs(spark, f"{path}/sparse", "json"),
        readers.read_dense_specs(spark, f"{path}/dense", "json"),
    )
    resolved = catalog.resolve(read, readers.read_conf_tables(spark, f"{path}/confs"))
    return catalog.catalog(resolved).select("ordinal", "tag", "dense")


# --- sweep ----------------------------------------------------------------------------------


@query
def window_size_settings(spark: SparkSession, sf: str) -> DataFrame:
    setting = F.when(
        F.col("o_orderkey") % 3 != 0,
        F.concat_ws(",", (F.col("o_custkey") % 4096).cast("string"), F.lit("512"), F.col("o_orderpriority")),
    )
    listed = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.explode(sweep.int_list(setting)).alias("window_size")
    )
    return sweep.derived_parameters(listed).select("run_id", "window_size", "window_size_small", "output_dir")


@query
def sweep_grid(spark: SparkSession, sf: str) -> DataFrame:
    return sweep.sweep_grid(_catalog(spark, sf).select("ordinal", "tag"), "400,1024,2000,2048")


@query
def pending_runs(spark: SparkSession, sf: str) -> DataFrame:
    size = (256 * F.col("l_linenumber")).cast("int")
    items = fx.table(spark, sf, "lineitem")
    path = fresh_path(spark, "run-summary")
    done = items.where(F.col("l_linenumber") % 2 == 0).groupBy(size.alias("window_size")).agg(
        F.count("*").alias("windows")
    )
    writers.write_run_summary(done, path)
    written = spark.read.schema("windows BIGINT, window_size INT").parquet(path)
    runs = items.select(size.alias("window_size"), F.col("l_suppkey").alias("scene"))
    left = sweep.pending(runs, writers.manifest_of(written))
    return left.groupBy("window_size", "scene").agg(F.count("*").alias("runs"))


@query
def cached_pairs(spark: SparkSession, sf: str) -> DataFrame:
    wanted = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("pair_id")
    )
    cached = fx.table(spark, sf, "customer").where(F.col("c_acctbal") > 0).select(
        F.col("c_custkey").alias("pair_id")
    )
    return sweep.to_fetch(wanted, cached)


def _windows_and_failed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    windows = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("window_id"),
        F.concat(F.lit("m"), (F.col("o_custkey") % 50).cast("string")).alias("tag"),
    )
    failed = fx.table(spark, sf, "supplier").where(F.col("s_acctbal") < 0).select(
        F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("tag")
    )
    return windows, failed


@query
def failed_latch(spark: SparkSession, sf: str) -> DataFrame:
    return sweep.without_failed(*_windows_and_failed(spark, sf))


@query
def latch_flags(spark: SparkSession, sf: str) -> DataFrame:
    flagged = chips.flag_failed(*_windows_and_failed(spark, sf))
    return flagged.groupBy("tag", "load_failed").agg(F.count("*").alias("windows"))


@query
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return sweep.run_summary(fx.run_log(spark, sf))


@query
def run_elapsed(spark: SparkSession, sf: str) -> DataFrame:
    return sweep.with_elapsed(fx.run_log(spark, sf)).select("tag", "elapsed_min")


@query
def run_status(spark: SparkSession, sf: str) -> DataFrame:
    return sweep.run_status(fx.run_log(spark, sf))


@query
def run_report(spark: SparkSession, sf: str) -> DataFrame:
    return sweep.run_report(fx.run_log(spark, sf))


# --- chips ----------------------------------------------------------------------------------


def _pixels(rows: DataFrame, column: str) -> DataFrame:
    return chips.explode_pixels(rows, column, "chip_id")


@query
def chip_normalize(spark: SparkSession, sf: str) -> DataFrame:
    pixels = _pixels(chips.normalize_chips(fx.chips(spark, sf)), "img")
    return pixels.select("chip_id", "iy", "ix", r6("v").alias("v"))


@query
def chip_pair_source(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "chip-pairs")
    pairs = fx.with_geometry(
        fx.chip_pairs(spark, sf).withColumns(
            {"pair_id": F.col("chip_id").cast("int"), "chip": (F.col("chip_id") % 7).cast("int"),
             "window_size": F.lit(fx.CHIP), "source_pol": F.lit("HH"), "s1_ref_tag": F.lit("VV")}
        )
    )
    pairs.select(*[f.name for f in schemas.CHIP_PAIR.fields]).write.parquet(path)
    gated = chips.gate_pairs(readers.read_chip_pairs(spark, path), MIN_VALID)
    return gated.select("pair_id", "wx", "wy", "reject_reason", F.col("geo.x02").alias("x02"))


@query
def chip_gate(spark: SparkSession, sf: str) -> DataFrame:
    gated = chips.gate_pairs(fx.chip_pairs(spark, sf), MIN_VALID)
    return gated.select("chip_id", "reject_reason", "valid1", "valid2")


@query
def chip_reject_counts(spark: SparkSession, sf: str) -> DataFrame:
    return correspond.reject_counts(chips.gate_pairs(fx.chip_pairs(spark, sf), MIN_VALID))


@query
def chip_inpaint(spark: SparkSession, sf: str) -> DataFrame:
    filled = chips.normalize_chips(fx.chips(spark, sf), fill="row")
    return _pixels(filled, "filled").select("chip_id", "iy", "ix", r6("v").alias("v"))


@query
def chip_inpaint_nearest(spark: SparkSession, sf: str) -> DataFrame:
    filled = chips.normalize_chips(fx.chips(spark, sf), fill="nearest")
    return _pixels(filled, "filled").select("chip_id", "iy", "ix", r6("v").alias("v"))


@query
def chip_quantize(spark: SparkSession, sf: str) -> DataFrame:
    ready = chips.prepare_pairs(fx.chip_pairs(spark, sf), MIN_VALID).where(F.col("reject_reason").isNull())
    listed = ready.withColumn("u1", rasters.byte_values(F.col("u1")))
    return chips.explode_pixels(listed, "u1", "chip_id", "w1").select(
        "chip_id", "iy", "ix", F.col("v").alias("u8")
    )


@query
def chip_resample(spark: SparkSession, sf: str) -> DataFrame:
    small = chips.resample_chips(fx.chips(spark, sf), 3)
    return _pixels(small, "px").select("chip_id", "iy", "ix", r6("v").alias("v"))


# --- correspondences ------------------------------------------------------------------------


def _bounded(spark: SparkSession, sf: str) -> DataFrame:
    size = fx.IMAGE
    return correspond.in_bounds(fx.correspondences(spark, sf), size, size, size, size)


def _clear(spark: SparkSession, sf: str) -> DataFrame:
    return correspond.drop_nodata(_bounded(spark, sf), fx.valid1, fx.valid2)


def _displaced(spark: SparkSession, sf: str) -> DataFrame:
    return fx.with_displacement(_clear(spark, sf))


@query
def select_keypoints(spark: SparkSession, sf: str) -> DataFrame:
    chosen = correspond.select_keypoints(fx.predictions(spark, sf))
    return correspond.explode_points(chosen, ["win"])


@query
def window_clean(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = correspond.clean_windows(fx.predictions(spark, sf), fx.valid1, fx.valid2)
    return cleaned.select("win", "reject_reason", F.size("kp").cast("bigint").alias("n"))


@query
def window_reject_counts(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = correspond.clean_windows(fx.predictions(spark, sf), fx.valid1, fx.valid2)
    return correspond.reject_counts(cleaned, ["tag"])


@query
def in_bounds(spark: SparkSession, sf: str) -> DataFrame:
    narrow = fx.correspondences(spark, sf).withColumns(
        {c: F.col(c).cast("float").cast("double") for c in ("x1", "y1", "x2", "y2")}
    )
    size = fx.IMAGE
    kept = correspond.in_bounds(narrow, size, size, size, size)
    return kept.select("pair_id", "chip", "x1", "y1", "x2", "y2")


@query
def nodata_touch(spark: SparkSession, sf: str) -> DataFrame:
    return _clear(spark, sf).select("pair_id", "chip", "x1", "y1", "x2", "y2")


@query
def mask_lookup(spark: SparkSession, sf: str) -> DataFrame:
    pixels = chips.explode_pixels(fx.chips(spark, sf), "px", "chip_id")
    nodata = pixels.where(F.col("v").isNull())
    points = fx.table(spark, sf, "lineitem").select(
        (F.col("l_partkey") % 500).alias("on_chip"),
        (F.col("l_suppkey") % 8 + 0.5).alias("x"),
        (F.col("l_orderkey") % 8 + 0.25).alias("y"),
    )
    kept = correspond.drop_nodata_by_table(points, nodata, "on_chip", "x", "y")
    return kept.groupBy("on_chip", "x", "y").agg(F.count("*").alias("n"))


@query
def min_matches(spark: SparkSession, sf: str) -> DataFrame:
    kept = correspond.min_matches(_clear(spark, sf), ["win"])
    return kept.select("win", "pair_id", "chip", "x1", "y1", "x2", "y2")


# --- geometry and records -------------------------------------------------------------------


def _located(spark: SparkSession, sf: str) -> DataFrame:
    return records.located_points(fx.with_geometry(_clear(spark, sf)))


@query
def pixel_to_map(spark: SparkSession, sf: str) -> DataFrame:
    return _located(spark, sf).select("pair_id", "chip", "map_x1", "map_y1", "map_x2", "map_y2")


@query
def displacement(spark: SparkSession, sf: str) -> DataFrame:
    return _located(spark, sf).select("pair_id", "chip", r6("distance").alias("distance"), "along", "across")


@query
def local_coords(spark: SparkSession, sf: str) -> DataFrame:
    return _located(spark, sf).select("pair_id", "chip", "full_x1", "full_y1", "full_x2", "full_y2")


@query
def global_position(spark: SparkSession, sf: str) -> DataFrame:
    placed = fx.with_geometry(_clear(spark, sf))
    position = geometry.global_position(F.col("geo"), F.col("wx"), F.col("wy"))
    return placed.select("pair_id", "chip", *[c.alias(n) for n, c in position.items()])


def _records(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = correspond.clean_windows(fx.predictions(spark, sf), fx.valid1, fx.valid2)
    return records.build_records(
        cleaned.withColumns(
            {"window_size": F.lit(fx.IMAGE), "detector": file_ids.detector_name(F.col("tag"))}
        ),
        keep=["win", "window_size", "detector", "source_pol"],
    )


def _listed(column: str) -> Column:
    """A list of multiples of 1/8 as text."""
    return F.array_join(F.transform(column, lambda v: (v * 8).cast("bigint").cast("string")), ",")


@query
def match_record(spark: SparkSession, sf: str) -> DataFrame:
    return _records(spark, sf).select(
        "win", "file_id", "pair_id", "global_scan", "global_pix", "local_init_x", "local_init_y",
        "matcher", "match_param",
        _listed("x1").alias("x1"), _listed("y2").alias("y2"), _listed("map_x1").alias("map_x1"),
        _listed("map_y2").alias("map_y2"), _listed("along").alias("along"), _listed("across").alias("across"),
        r6(F.aggregate("distance", F.lit(0.0), lambda a, v: a + v), 4).alias("total_distance"),
    )


@query
def record_explode(spark: SparkSession, sf: str) -> DataFrame:
    rows = records.explode_records(_records(spark, sf), ["win", "file_id"])
    return rows.withColumn("distance", r6("distance"))


@query
def file_id_build(spark: SparkSession, sf: str) -> DataFrame:
    placed = fx.with_geometry(fx.correspondences(spark, sf))
    position = geometry.global_position(F.col("geo"), F.col("wx"), F.col("wy"))
    key = F.col("win")
    built = file_ids.build_file_id(
        F.col("detector"), F.col("source_pol"), F.col("s1_ref_tag"), F.col("pair_id"),
        position["global_scan"], position["global_pix"], F.lit("4"),
        (key % 3 + 1).cast("string"), F.when(key % 2 == 0, "0.91").otherwise("0.99"),
    )
    return placed.select("win", F.concat(built, F.lit(file_ids.EXTENSION)).alias("file_name"))


@query
def file_id_parse(spark: SparkSession, sf: str) -> DataFrame:
    return records.parse_keys(fx.match_files(spark, sf)).select("file_name", "key.*")


@query
def pol_reference_join(spark: SparkSession, sf: str) -> DataFrame:
    parsed = records.parse_keys(fx.match_files(spark, sf))
    runs = parsed.where(F.col("key").isNotNull()).select(
        F.col("key.pair_id").cast("int").alias("pair_id"), "key.source_pol", "key.s1_ref_tag"
    )
    joined = stats.join_reference(runs, fx.reference_images(spark, sf))
    return joined.groupBy("pair_id", "source_pol", "ref_pol", "ref_path").agg(F.count("*").alias("runs"))


@query
def reference_table(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "reference")
    fx.reference_images(spark, sf).write.partitionBy("ref_pol").parquet(path)
    return readers.read_reference(spark, path, "VH")


@query
def gcp_file(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "gcps")
    fx.gcps(spark, sf).write.option("header", True).csv(path)
    return readers.read_gcps(spark, path).unionByName(readers.read_gcps(spark, ""))


@query
def nearest_gcp(spark: SparkSession, sf: str) -> DataFrame:
    found = geo.nearest_gcp(fx.gcp_matches(spark, sf), fx.gcps(spark, sf), 600.0)
    return found.select("match_id", "gcp_id", r6("gcp_distance").alias("gcp_distance"))


# --- matching -------------------------------------------------------------------------------


@query
def mutual_nn(spark: SparkSession, sf: str) -> DataFrame:
    return matching.mutual_nn(fx.descriptors(spark, sf)).withColumn("similarity", r6("similarity"))


@query
def smnn_ratio(spark: SparkSession, sf: str) -> DataFrame:
    found = matching.smnn_ratio(fx.descriptors(spark, sf))
    return found.withColumns({c: r6(c) for c in ("distance", "ratio0", "ratio1")})


@query
def dual_softmax(spark: SparkSession, sf: str) -> DataFrame:
    found = matching.dual_softmax(fx.descriptors(spark, sf), temperature=0.1, threshold=0.05)
    return found.withColumn("probability", r6("probability"))


@query
def local_consistency(spark: SparkSession, sf: str) -> DataFrame:
    kept = matching.local_consistency(_bounded(spark, sf), PAIR, cell=64.0, radius=1.0, least=3)
    return kept.select("pair_id", "x1", "y1", "x2", "y2")


@query
def seeded_affine(spark: SparkSession, sf: str) -> DataFrame:
    kept = matching.seeded_affine(_bounded(spark, sf), PAIR, cell=64.0, spread=2.0, radius=0.6, least=12)
    return kept.select("pair_id", "x1", "y1", "x2", "y2")


@query
def top_keypoints(spark: SparkSession, sf: str) -> DataFrame:
    top = matching.top_keypoints(
        fx.correspondences(spark, sf), CHIP, ties=["x1", "y1", "x2", "y2"], budget=100, threshold=0.125
    )
    return top.select("pair_id", "chip", "rank", "score", "x1", "y1", "x2", "y2")


# --- fit and report -------------------------------------------------------------------------

FIT = ["ransac_method", "ransac_threshold", "ransac_confidence"]
CHIP_DETECTOR = [*CHIP, "detector"]


def _fit_columns(fits: DataFrame, keys: list[str]) -> DataFrame:
    return fits.select(
        *keys, *FIT, "h", "n", "inliers", *[r6(f"model.{c}", 4).alias(f"m_{c}") for c in "abcdef"]
    )


@query
def ransac_affine(spark: SparkSession, sf: str) -> DataFrame:
    return _fit_columns(ransac.fit_affine(_bounded(spark, sf), CHIP_DETECTOR), CHIP_DETECTOR)


@query
def ransac_median(spark: SparkSession, sf: str) -> DataFrame:
    fits = ransac.fit_affine(_bounded(spark, sf), CHIP, thresholds=[2.0], confidences=[0.95], score="median")
    return _fit_columns(fits, CHIP)


@query
def ransac_refit(spark: SparkSession, sf: str) -> DataFrame:
    fits = ransac.refit_affine(_bounded(spark, sf), CHIP, thresholds=[2.0], confidences=[0.95])
    return fits.select(*CHIP, *FIT, "h", "n", "inliers", *[r6(f"refined.{c}", 4).alias(f"r_{c}") for c in "abcdef"])


def _single_fit(points: DataFrame, keys: list[str], **sums: Column) -> DataFrame:
    """One fit per group with sums over its inliers, by the scoring pass."""
    carry = {name: ransac.inlier_sum(value) for name, value in sums.items()}
    fits = ransac.fit_affine(points, keys, thresholds=[3.0], confidences=[0.99], carry=carry)
    return fits.where(F.col("inliers") > 0)


@query
def chip_consensus(spark: SparkSession, sf: str) -> DataFrame:
    agreed = registration.displacement_consensus(
        fx.correspondences(spark, sf), fx.IMAGE, fx.valid1, fx.valid2, fx.with_displacement, ["win"], PAIR
    )
    return agreed.withColumns({"across": r6("across"), "along": r6("along")})


@query
def chip_consensus_fitted(spark: SparkSession, sf: str) -> DataFrame:
    points = _displaced(spark, sf)
    fits = _single_fit(points, CHIP, across=F.col("across"), along=F.col("along"))
    mean = lambda c: (F.col(c) / F.col("inliers")).alias(c)
    means = fits.select(*CHIP, F.col("inliers").alias("n"), mean("across"), mean("along"))
    agreed = consensus.chip_consensus(points, PAIR, means=means)
    return agreed.withColumns({"across": r6("across"), "along": r6("along")})


@query
def min_area(spark: SparkSession, sf: str) -> DataFrame:
    return ransac.large_enough(_bounded(spark, sf), ["win"], 20000.0)


@query
def best_config(spark: SparkSession, sf: str) -> DataFrame:
    fits = _single_fit(_bounded(spark, sf), CHIP_DETECTOR, squares=F.col("r") * F.col("r"))
    scored = fits.select(*CHIP_DETECTOR, "inliers", r6(F.sqrt(F.col("squares") / F.col("inliers"))).alias("rmse"))
    return ransac.best_fit_per_chip(scored.withColumnRenamed("detector", "name"), CHIP)


@query
def match_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = stats.match_statistics(_displaced(spark, sf), ["detector", "source_pol", "pair_id"])
    rounded = [c for c, kind in out.dtypes if kind == "double"]
    return out.withColumns({c: r6(c) for c in rounded})


@query
def pol_summary(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["window_size", "detector", "source_pol", "s1_ref_tag"]
    points = _displaced(spark, sf).withColumn("window_size", F.lit(fx.IMAGE))
    survivors = consensus.surviving_chips(points, [*keys, "pair_id"])
    out = stats.polarisation_summary(survivors, keys)
    return out.withColumns({"across": r6("across"), "along": r6("along")})


# --- matchers, files, increments ------------------------------------------------------------


@query
def matcher_udf(spark: SparkSession, sf: str) -> DataFrame:
    prepared = chips.prepare_pairs(fx.chip_pairs(spark, sf, nodata=False), MIN_VALID)
    specs = [
        matchers.MatcherSpec("phase-fine", matchers.phase_correlation, {"step": 1}),
        matchers.MatcherSpec("phase-coarse", matchers.phase_correlation, {"step": 2}),
    ]
    found = matchers.run_catalog(prepared, specs, ["chip_id"])
    moved = F.get(F.get("raw1", F.lit(0)), F.lit(0)) - F.get(F.get("raw0", F.lit(0)), F.lit(0))
    return found.select(
        "chip_id", "tag", F.size("mm0").cast("bigint").alias("n_inside"),
        F.size("raw0").cast("bigint").alias("n_raw"), moved.cast("int").alias("dx"), "error",
    )


@query
def registration_run(spark: SparkSession, sf: str) -> DataFrame:
    spec = matchers.MatcherSpec("phase", matchers.phase_correlation, {"step": 1})
    windows = registration.match_pairs(fx.chip_pairs(spark, sf, nodata=False), [spec], ["chip_id"], MIN_VALID)
    points = fx.with_displacement(correspond.explode_points(windows, ["chip_id", "tag"]))
    return points.groupBy("chip_id", "tag").agg(
        F.count("*").alias("n"), F.avg("across").alias("across"), F.avg("along").alias("along")
    )


@query
def bad_windows(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "windows")
    specs = [matchers.MatcherSpec(kind, fx.flawed_matcher, {"kind": kind}) for kind in fx.FLAWED]
    writers.write_windows(registration.match_pairs(fx.flawed_pairs(spark, sf), specs, ["chip_id"], MIN_VALID), path)
    bad, good = readers.read_windows(spark, path, True), readers.read_windows(spark, path, False)
    return bad.select("chip_id", "tag", "reject_reason", "error", F.lit(0).cast("bigint").alias("points")).union(
        good.select("chip_id", "tag", "reject_reason", "error", F.size("kp").cast("bigint"))
    )


def _registration(spark: SparkSession, sf: str) -> registration.Registration:
    cat = catalog.allow_table(_catalog(spark, sf), fx.wanted_tags(spark, sf))
    return registration.run(
        fx.registration_pairs(spark, sf), cat, fx.load_matcher, manifest=fx.done_window_sizes(spark, sf),
        min_valid_fraction=MIN_VALID, min_area=13.0,
    )


@query
def registration_report(spark: SparkSession, sf: str) -> DataFrame:
    out = _registration(spark, sf).report
    return out.withColumns({c: r6(c) for c in ("across", "along", "rmse")})


@query
def record_files_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "records")
    writers.write_match_records(_records(spark, sf), path)
    stored = readers.read_match_records(spark, path)
    named = stored.withColumn("file_name", F.concat("file_id", F.lit(file_ids.EXTENSION)))
    return (
        records.parse_keys(named)
        .groupBy("window_size", "detector", "source_pol")
        .agg(
            F.count("*").alias("records"),
            F.sum(F.size("x1")).alias("points"),
            F.sum("key.scan").alias("scans"),
            F.count_if(F.col("key.detector") == F.col("detector")).alias("same_detector"),
        )
    )


@query
def match_files_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "match-files")
    writers.write_match_files(_records(spark, sf), path)
    found = readers.read_match_files(spark, path).groupBy("window_size", "detector", "source_pol", "file_name", "key")
    sums = {c: F.sum(F.col(c) * 8).cast("bigint") for c in ("x1", "y1", "x2", "y2", "map_x1", "map_y2", "along", "across")}
    out = found.agg(F.count("*").alias("points"), r6(F.sum("distance"), 4).alias("distance"), *[v.alias(c) for c, v in sums.items()])
    return out.select(
        "window_size", "detector", "source_pol", "file_name", "key.pair_id", "key.scan", "key.pix", "key.s1_ref_tag",
        "key.ransac_threshold", "key.ransac_confidence", "points", "distance", *sums,
    )


@query
def incremental_run(spark: SparkSession, sf: str) -> DataFrame:
    items = fx.table(spark, sf, "lineitem")

    def transform(stream: DataFrame) -> DataFrame:
        points = fx.with_geometry(fx.correspondences_of(stream))
        return incremental.clean_and_locate(points, fx.IMAGE, fx.valid1, fx.valid2).select(
            "pair_id", "chip", "map_x1", "map_y1", "map_x2", "map_y2", "along", "across"
        )

    path = fresh_path(spark, "incremental")
    return incremental.incremental_run(
        spark, sf, items.schema, transform, f"{path}/out", f"{path}/checkpoint", "lineitem.parquet"
    )


@query
def incremental_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Two increments that share a third of their rows, the second after the first is done."""
    items = fx.table(spark, sf, "lineitem")
    path = fresh_path(spark, "overlap")

    def transform(stream: DataFrame) -> DataFrame:
        points = fx.with_geometry(fx.correspondences_of(stream))
        return incremental.clean_and_locate(points, fx.IMAGE, fx.valid1, fx.valid2).select(
            "win", "pair_id", "chip", "x1", "y1", "x2", "y2", "along", "across"
        )

    out = None
    for left_out in (0, 1):
        items.where(F.col("l_suppkey") % 3 != left_out).write.mode("append").parquet(f"{path}/in")
        out = incremental.incremental_run(
            spark, f"{path}/in", items.schema, transform, f"{path}/out", f"{path}/checkpoint",
            keys=["win", "pair_id", "chip", "x1", "y1", "x2", "y2"],
        )
    return out

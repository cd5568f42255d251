"""A whole run: catalog table x chip pairs, in passes, to the report."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiepoints import fixtures as fx
from tiepoints.operators import matchers, ransac
from tiepoints.plans import registration

SIZE = 16


def blob(seed):
    y, x = np.mgrid[0:SIZE, 0:SIZE]
    rng = np.random.default_rng(seed)
    return sum(rng.uniform(20, 90) * np.exp(-((x - rng.uniform(0, SIZE)) ** 2 + (y - rng.uniform(0, SIZE)) ** 2) / 8) for _ in range(6))


@pytest.fixture(scope="module")
def pairs(spark):
    """Pair 1: chips 1 to 4 agree, 5 does not. Pair 2: one chip, wide window. Pair 3: one chip, narrow window. Pair 4 is done."""
    rows = []
    for pair, chip, shift, window in [(1, 1, 3, 1024), (1, 2, 3, 1024), (1, 3, 3, 1024), (1, 4, 3, 1024), (1, 5, 6, 1024), (2, 1, 2, 2048), (3, 1, 2, 1024), (4, 1, 1, 512)]:
        image = blob(100 * pair + chip)
        rows.append((pair, chip, window, image.ravel().tolist(), np.roll(image, shift, axis=1).ravel().tolist()))
    rows.append((1, 9, 1024, None, None))
    df = spark.createDataFrame(rows, "pair_id int, chip int, window_size int, px1 array<float>, px2 array<float>")
    df = df.withColumns({c: F.lit(SIZE) for c in ("w1", "h1", "w2", "h2")} | {c: F.lit(None).cast("float") for c in ("nodata1", "nodata2")})
    return fx.with_geometry(df.withColumns({"source_pol": F.lit("HH"), "s1_ref_tag": F.lit("VV")}))


@pytest.fixture(scope="module")
def cat(spark):
    confs = [(2, "fine", True, {"step": 1}), (1, "coarse", False, {"step": 4}), (3, "broken", True, {}), (4, "also-broken", True, {"step": 0})]
    rows = [(o, t, d, json.dumps({"model": m})) for o, t, d, m in confs]
    made = spark.createDataFrame(rows, "ordinal int, tag string, dense boolean, m string")
    conf = F.struct(F.lit(None).cast("string").alias("feature"), F.parse_json("m").alias("matcher"), "dense")
    return made.select("ordinal", "tag", "dense", conf.alias("conf"))


def load(conf):
    return matchers.phase_correlation(conf["matcher"]["model"]["step"])


def run(pairs, cat, **options):
    manifest = pairs.sparkSession.createDataFrame([(512, True), (2048, False)], "window_size int, done boolean")
    return registration.run(pairs, cat, load, manifest=manifest, min_valid_fraction=0.5, thresholds=["2"], confidences=["0.95"], **options)


@pytest.mark.parametrize("per_pass", [1, 3])
def test_report(pairs, cat, per_pass):
    out = run(pairs, cat, min_area=1.0, per_pass=per_pass)
    found = {(r["window_size"], r["detector"]): r for r in out.report.collect()}
    assert {k: (r["windows"], r["accepted"], r["outcome"]) for k, r in found.items()} == {
        (1024, "imw-fine"): (7, 6, "ok"), (2048, "imw-fine"): (1, 1, "ok"), (1024, "imw-coarse"): (7, 6, "ok"), (2048, "imw-coarse"): (1, 1, "ok"),
        (1024, "imw-broken"): (7, 0, "load failed"), (2048, "imw-broken"): (1, 0, "load failed"),
        (1024, "imw-also-broken"): (7, 0, "ok"), (2048, "imw-also-broken"): (1, 0, "ok"),
    }
    # One pixel is 10 m; the second image's windows begin 30 m, and its map 5 m, elsewhere.
    fine, wide = found[(1024, "imw-fine")], found[(2048, "imw-fine")]
    assert (fine["pairs"], fine["chips"], fine["inliers"], fine["across"], fine["along"]) == (1, 4, 4 * 13 * 16, 25.0 - 30, 25.0)
    assert (wide["pairs"], wide["chips"], wide["across"]) == (1, 1, 5.0)  # pair 3 is alone in a narrow window
    assert fine["rmse"] < 1e-9 and found[(1024, "imw-broken")]["pairs"] is None
    errors = {(r["detector"], r["error"]) for r in out.windows.where("error is not null and pair_id = 2").collect()}
    assert {d for d, _ in errors} == {"imw-broken", "imw-also-broken"} and any("load failed: KeyError" in e for _, e in errors)


def test_small_areas_have_no_fit(pairs, cat):
    assert run(pairs, cat, min_area=1e6).fits.count() == 0


def test_best_configuration_per_chip(pairs, cat):
    best = run(pairs, cat, min_area=1.0).best.collect()
    assert {r["name"] for r in best} == {"imw-fine_HH_VV_4_2.0_0.95"} and len(best) == 7


def test_pairs_are_scanned_once_whatever_the_catalog(spark, pairs, cat):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    total = pairs.count()
    out = run(pairs.mapInArrow(count, pairs.schema), cat, min_area=1.0, per_pass=1)
    out.report.collect(), out.best.collect()
    assert seen.value == total


def test_an_empty_catalog_and_no_pairs(spark, pairs, cat):
    assert run(pairs, cat.limit(0)).report.count() == 0
    assert run(pairs.limit(0), cat).report.count() == 0


def test_carried_sums_equal_a_second_pass(spark):
    points = spark.createDataFrame(
        [(g, float(i * 7 % 50), float(i * 13 % 40), i * 7 % 50 + 3.0 + (40.0 if i % 5 == 0 else 0.1 * (i % 3)), i * 13 % 40 - 2.0) for g in (1, 2) for i in range(60)],
        "g int, x1 double, y1 double, x2 double, y2 double",
    )
    carry = {"squares": ransac.inlier_sum(F.col("r") * F.col("r")), **ransac.inlier_extent("x1")}
    fits = ransac.fit_affine(points, ["g"], thresholds=[2.0], confidences=[0.95], carry=carry)
    again = ransac.residuals(points, fits, ["g"]).where(F.col("residual") <= 2.0).groupBy("g")
    again = again.agg(F.count("*").alias("n"), F.sum(F.col("residual") * F.col("residual")).alias("s"), F.min("x1").alias("lo"), F.max("x1").alias("hi"))
    expected = {r["g"]: (r["n"], round(r["s"], 9), r["lo"], r["hi"]) for r in again.collect()}
    assert {r["g"]: (r["inliers"], round(r["squares"], 9), r["x1_min"], r["x1_max"]) for r in fits.collect()} == expected

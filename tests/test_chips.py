import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tiepoints.functions import pixels
from tiepoints.operators import chips, matchers
from tiepoints.plans import registration

NAN = float("nan")
SF = "/root/testdata/sf0.001"
PAIR = "id int, px1 array<float>, px2 array<float>, nodata1 float, nodata2 float, w1 int, h1 int, w2 int, h2 int"


def pairs(spark, *rows):
    return spark.createDataFrame([(i, a, b, n, n, 2, 2, 2, 2) for i, (a, b, n) in enumerate(rows)], PAIR)


def chip(px):
    """Values and which are NULL, as a kernel gets them."""
    return np.array([0.0 if v is None else v for v in px], np.float32), np.array([v is None for v in px], bool)


def test_mask_and_normalise():
    px = chip([1.0, None, -9.0, 3.0])
    mask = pixels.valid_mask(*px, -9.0)
    assert mask.tolist() == [True, False, False, True]
    assert pixels.valid_mask(*chip([1.0, NAN]), NAN).tolist() == [True, False]
    px = chip([1.0, None, -9.0, 3.0, 2.0])
    assert pixels.normalize(px[0], pixels.valid_mask(*px, -9.0)).tolist() == [0.0, 0.0, 0.0, 1.0, 0.5]
    for flat in ([2.0, 2.0, None], [None, None], [NAN, NAN], []):
        px = chip(flat)
        assert pixels.normalize(px[0], ~px[1]).tolist() == [0.0] * len(flat)
    px = chip([1.0, NAN, None])
    assert [math.isnan(v) for v in pixels.normalize(px[0], ~px[1])] == [True, True, False]


def test_inpaint():
    px = np.array([9.0, 1.0, 9.0, 2.0, 9.0, 9.0, 9.0, 9.0, 9.0, 9.0, 9.0, 3.0])
    mask = np.array([False, True, False, True, False, False, False, False, False, False, False, True])
    assert pixels.fill(px, mask, 4).tolist() == [1.0, 1.0, 1.0, 2.0, 0.0, 0.0, 0.0, 0.0, 3.0, 3.0, 3.0, 3.0]
    # Of two valid pixels as near, the first in row-major order.
    assert pixels.fill(px, mask, 4, "nearest").tolist() == [1.0, 1.0, 1.0, 2.0, 1.0, 1.0, 1.0, 2.0, 1.0, 1.0, 3.0, 3.0]
    assert pixels.fill(px, np.zeros(12, bool), 4, "nearest").tolist() == [0.0] * 12


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 2**32 - 1), st.floats(0, 1))
def test_nearest_valid_equals_brute_force(height, width, seed, share):
    mask = np.random.default_rng(seed).random((height, width)) < share
    valid = [(y, x) for y in range(height) for x in range(width) if mask[y, x]]
    expected = [
        min(((y - b) ** 2 + (x - a) ** 2, b * width + a) for b, a in valid)[1] if valid else -1
        for y in range(height) for x in range(width)
    ]
    assert pixels.nearest_valid(mask).ravel().tolist() == expected


def test_quantise_truncates_and_clips():
    values = np.array([0.0, 0.5, 1.0, -0.1, 1.5, 254.9 / 255])
    assert pixels.quantize_u8(values).tolist() == [0, 127, 255, 0, 255, 254]


def test_block_mean(spark):
    schema = "id int, px array<float>, w int, h int, nodata float"
    rows = [(1, [1.0, 2.0, 3.0, 4.0, 5.0, None, 7.0, 8.0], 4, 2, None), (2, [1.0, 2.0, None, 4.0, 5.0, None], 3, 2, None), (3, None, 4, 2, None), (4, [1.0], 2, 2, None)]
    found = {r["id"]: (r["px"], r["w"], r["h"]) for r in chips.resample_chips(spark.createDataFrame(rows, schema), 2).collect()}
    assert found == {1: ([8 / 3, 5.5], 2, 1), 2: ([3.0, None], 2, 1), 3: (None, 2, 1), 4: (None, 1, 1)}


def test_normalised_chips_keep_their_other_columns(spark):
    rows = [(1, [1.0, None, 3.0, -9.0], 2, 2, -9.0), (2, None, 2, 2, None), (3, [], 2, 2, None)]
    df = spark.createDataFrame(rows, "id int, px array<float>, w int, h int, nodata float")
    found = {r["id"]: r for r in chips.normalize_chips(df, fill="nearest").collect()}
    assert (bytes(found[1]["mask"]), found[1]["img"], found[1]["filled"]) == (b"\x01\x00\x01\x00", [0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 1.0, 1.0])
    assert found[2]["img"] is found[2]["mask"] is None and found[3]["img"] == [] and found[1]["nodata"] == -9.0


def test_large_chips(spark, tmp_path):
    """Four pairs of 1024 x 1024 pixels, tiled from the given vectors."""
    vectors = np.array([r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("embedding").limit(300).collect()])
    image = np.resize(vectors.ravel(), 1024 * 1024).astype(np.float32)
    image[np.abs(image) < 0.01] = -9999.0
    n = 1 << 20
    lists = pa.ListArray.from_arrays(np.arange(5) * n, pa.array(np.tile(image, 4), pa.float32()))
    same = {f"{c}{i}": pa.array([v] * 4, t) for i in (1, 2) for c, v, t in (("w", 1024, pa.int32()), ("h", 1024, pa.int32()), ("nodata", -9999.0, pa.float32()))}
    pq.write_table(pa.table({"id": pa.array(range(4), pa.int32()), "px1": lists, "px2": lists, **same}), tmp_path / "pairs.parquet", row_group_size=1)
    stored = spark.read.parquet(str(tmp_path / "pairs.parquet")).repartition(4, "id")
    found = chips.prepare_pairs(stored, 0.5).select("reject_reason", F.octet_length("u1").alias("n"), F.sha2("u2", 256).alias("s")).collect()
    mask = image != np.float32(-9999.0)
    whole = pixels.quantize_u8(pixels.fill(pixels.normalize(image, mask), mask, 1024))
    assert {tuple(r) for r in found} == {(None, n, hashlib.sha256(whole.tobytes()).hexdigest())}


def test_gate_order(spark):
    good, flat, holed = [1.0, 2.0, 3.0, 4.0], [5.0] * 4, [1.0, None, None, 2.0]
    gated = chips.gate_pairs(
        pairs(
            spark, (good, good, None), (flat, [1.0, NAN, 2.0, 3.0], None), (good, [1.0, NAN, 2.0, 3.0], None),
            (holed, good, None), (good, holed, None), ([1.0, 2.0, 3.0, 0.0], good, 0.0),
        ),
        0.75,
    )
    found = [r["reject_reason"] for r in gated.orderBy("id").collect()]
    assert found == [None, "all_zero", "nan", "low_valid", "low_valid", None]


def test_failed_matcher_comes_first(spark):
    flagged = pairs(spark, ([5.0] * 4, [5.0] * 4, None)).withColumn("load_failed", F.lit(True))
    assert chips.gate_pairs(flagged, 0.5).first()["reject_reason"] == "load_failed"


def known_pair(size=128, across=8, down=0):
    """Soft blobs on a tilted plane, and the same moved round by (across, down)."""
    y, x = np.mgrid[0:size, 0:size] / size
    blobs = [(0.21, 0.34, 0.05, 90), (0.72, 0.18, 0.08, 60), (0.55, 0.77, 0.03, 110), (0.12, 0.86, 0.06, 75)]
    image = 30 * x + 20 * y + sum(h * np.exp(-((x - a) ** 2 + (y - b) ** 2) / (2 * s * s)) for a, b, s, h in blobs)
    image = np.clip(image, 0, 255).astype(np.uint8)
    return image, np.roll(image, (down, across), axis=(0, 1))


def image_pair(spark, size=128, across=8, down=0):
    one_, two = (i.ravel().astype(float).tolist() for i in known_pair(size, across, down))
    return spark.createDataFrame([(1, one_, two, None, None, size, size, size, size)], PAIR)


def test_known_shift_is_recovered(spark):
    spec = matchers.MatcherSpec("phase", matchers.phase_correlation, {"step": 16})
    window = registration.match_pairs(image_pair(spark, across=8, down=-16), [spec], ["id"], 0.9).first()
    assert window["reject_reason"] is None and window["tag"] == "phase"
    assert {(p["x2"] - p["x1"], p["y2"] - p["y1"]) for p in window["kp"]} == {(8.0, -16.0)}
    assert len(window["kp"]) == 56


def test_rejected_pairs_keep_their_reason(spark):
    flat = [5.0] * 256
    one_, two = (i.ravel().astype(float).tolist() for i in known_pair(16, 2))
    rows = spark.createDataFrame(
        [(1, flat, two, None, None, 16, 16, 16, 16), (2, one_, two, None, None, 16, 16, 16, 16)], PAIR
    )
    spec = matchers.MatcherSpec("phase", matchers.phase_correlation, {"step": 4})
    found = registration.match_pairs(rows, [spec], ["id"], 0.9).orderBy("id").collect()
    assert [(r["reject_reason"], r["kp"] is None) for r in found] == [("all_zero", True), (None, False)]


def broken():
    raise OSError("no weights")


def raising():
    def match(image1, image2):
        raise ValueError("bad window")

    return match


def test_matcher_failures_become_reasons(spark):
    specs = [matchers.MatcherSpec("a", broken), matchers.MatcherSpec("b", raising)]
    rows = registration.match_pairs(image_pair(spark, 16, 2), specs, ["id"], 0.9).collect()
    assert {(r["tag"], r["reject_reason"], r["error"]) for r in rows} == {
        ("a", "matcher_error", "load failed: OSError: no weights"),
        ("b", "matcher_error", "ValueError: bad window"),
    }


def test_images_reach_the_matcher_as_rgb(spark):
    def load():
        def match(image1, image2):
            assert image1.shape == (16, 16, 3) and image1.dtype == np.uint8
            assert (image1[..., 0] == image1[..., 2]).all()
            return {"raw0": [[float(image1.max()), 0.0]], "raw1": [[float(image2.min()), 0.0]]}

        return match

    prepared = chips.prepare_pairs(image_pair(spark, 16, 2), 0.9)
    row = matchers.run_matcher(prepared, matchers.MatcherSpec("x", load), ["id"]).first()
    assert (row["raw0"], row["raw1"], row["mm0"], row["error"]) == ([[255.0, 0.0]], [[0.0, 0.0]], None, None)


def test_valid_fractions_and_packed_masks(spark):
    row = chips.gate_pairs(pairs(spark, ([1.0, 2.0, None, 4.0], [1.0, 2.0, 3.0, 0.0], 0.0)), 0.5).first()
    assert (row["valid1"], row["valid2"], bytes(row["mask1"]), bytes(row["mask2"])) == (0.75, 0.75, b"\1\1\0\1", b"\1\1\1\0")


def test_specs_of_one_tag_are_loaded_for_their_own_run(spark):
    counts = []
    for step in (64, 32):
        spec = matchers.MatcherSpec("phase", matchers.phase_correlation, {"step": step})
        prepared = chips.prepare_pairs(image_pair(spark), 0.9)
        counts.append(len(matchers.run_matcher(prepared, spec, ["id"]).first()["raw0"]))
    assert counts == [4, 16]


def wide():
    return lambda one_, two: {"mm0": np.array([[1, 2, 9], [3, 4, 9]]), "mm1": np.array([[5, 6, 9], [7, 8, 9]])}


def ragged():
    return lambda one_, two: {"mm0": np.arange(5), "mm1": np.arange(5)}


def test_predictions_of_other_shapes(spark):
    prepared = chips.prepare_pairs(image_pair(spark), 0.9)
    row = matchers.run_matcher(prepared, matchers.MatcherSpec("wide", wide), ["id"]).first()
    assert row["mm0"] == [[1.0, 2.0], [3.0, 4.0]] and row["error"] is None
    row = matchers.run_matcher(prepared, matchers.MatcherSpec("ragged", ragged), ["id"]).first()
    assert row["mm0"] is None and "shape" in row["error"]


def test_malformed_chips_are_rejected_by_row(spark):
    good = [1.0, 2.0, 3.0, 4.0]
    gated = chips.gate_pairs(pairs(spark, (None, good, None), (good, [], None), (good, good[:3], None), (good, good, None)), 0.5)
    found = [r["reject_reason"] for r in gated.orderBy("id").collect()]
    assert found == ["bad_shape", "bad_shape", "bad_shape", None]


@pytest.mark.parametrize("per_pass", [1, 2, 4])
def test_a_catalog_in_passes(spark, per_pass):
    prepared = chips.prepare_pairs(image_pair(spark), 0.9)
    specs = [matchers.MatcherSpec(f"step{s}", matchers.phase_correlation, {"step": s}) for s in (64, 32, 128)]
    found = matchers.run_catalog(prepared, specs, ["id"], per_pass).collect()
    assert {r["tag"]: len(r["raw0"]) for r in found} == {"step64": 4, "step32": 16, "step128": 1}


def test_points_leave_in_bounded_batches():
    """What a worker holds depends on points, not on the windows of a Spark batch."""
    n, ids = 600, list(range(600))
    batch = pa.RecordBatch.from_pydict({
        "id": ids, **{c: [1] * n for c in ("w1", "h1", "w2", "h2")},
        "u1": [None if i % 7 == 0 else b"a" for i in ids], "u2": [b"b"] * n,
    })
    calls = []

    def match(image1, image2):
        calls.append(1)
        if len(calls) % 5 == 0:
            raise ValueError("every fifth")
        return {"mm0": np.zeros((len(calls), 2)), "raw0": [], "raw1": np.ones((3000, 3))}

    made = list(matchers._matched(iter([batch]), [matchers.MatcherSpec("x", lambda: match)], ["id"], "run"))
    want, met = {}, 0
    for i in ids:
        met += i % 7 != 0
        raises = i % 7 and met % 5 == 0
        want[i] = (None, None, None, "ValueError: every fifth" if raises else None) if i % 7 == 0 or raises else (met, 0, 3000, None)
    length = lambda points: None if points is None else len(points)
    rows = [r for part in made for r in part.to_pylist()]
    assert [r["id"] for r in rows] == ids
    assert {r["id"]: (*[length(r[c]) for c in ("mm0", "raw0", "raw1")], r["error"]) for r in rows} == want
    held = [sum(length(r["mm0"]) or 0 for r in part.to_pylist()) + 3000 * sum(r["raw1"] is not None for r in part.to_pylist()) for part in made]
    assert len(made) > 1 and max(held) <= matchers.BATCH_POINTS + 4000


def test_a_worker_keeps_the_matchers_of_one_pass_only():
    spec = matchers.MatcherSpec("x", lambda: "model")
    for run in ("first", "second"):
        assert matchers._matcher(spec, run, 0) == matchers._matcher(spec, run, 1) == "model"
    assert set(matchers._loaded) == {("second", 0), ("second", 1)}

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tiepoints.operators import consensus, ransac

POINTS = "g int, x1 double, y1 double, x2 double, y2 double"


def test_hypothesis_counts():
    assert [ransac.hypothesis_count(c) for c in (0.91, 0.95, 0.99)] == [19, 23, 35]


def affine_points(n, outliers, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    x, y = rng.uniform(0, 1000, n), rng.uniform(0, 1000, n)
    u, v = 1.01 * x - 0.02 * y + 5, 0.03 * x + 0.98 * y - 7
    u[:outliers] += rng.uniform(50, 200, outliers)
    rows = [(1, *map(float, r)) for r in zip(x, y, u, v)]
    return rows + [(1, 3.0, 3.0, 900.0, 900.0)] * copies


@pytest.mark.parametrize("score", ["inliers", "median"])
@pytest.mark.parametrize("copies", [0, 60])
def test_known_model_is_recovered(spark, score, copies):
    df = spark.createDataFrame(affine_points(300, 60, copies=copies), POINTS).repartition(4)
    fits = ransac.fit_affine(df, ["g"], score=score).collect()
    assert len(fits) == 9
    for f in fits:
        assert f["n"] == 300 + copies and f["inliers"] == 240
        assert [round(f["model"][c], 6) for c in "abcdef"] == [1.01, -0.02, 5.0, 0.03, 0.98, -7.0]
    best = ransac.fit_affine(df, ["g"], thresholds=[1.0], confidences=[0.99], score=score)
    kept = ransac.inliers(df, best, ["g"])
    assert kept.columns == df.columns and kept.count() == 240


@pytest.mark.parametrize("n", [3, 7, 400])
def test_every_slot_takes_the_first_point_from_its_target_on(spark, n):
    count = 23
    rows = affine_points(n, n // 5, seed=n)
    df = spark.createDataFrame(rows, POINTS).repartition(3)
    hashes = {tuple(r)[1:]: r[0] for r in df.select(ransac.point_hash(*map(F.col, ("x1", "y1", "x2", "y2"))), "x1", "y1", "x2", "y2").collect()}
    target = lambda h, slot: (h * (7919, 104729, 1299709)[slot] % count + slot * count) * (ransac.RING // (3 * count))
    assert len({target(h, s) for h in range(count) for s in range(3)}) == 3 * count
    want = {}
    for h in range(count):
        slots = [min(hashes, key=lambda p: (hashes[p] - target(h, s)) % ransac.RING) for s in range(3)]
        if len(set(slots)) == 3:
            a = np.array([[x, y, 1.0] for x, y, _, _ in slots])
            want[h] = np.linalg.solve(a, [[u, v] for _, _, u, v in slots]).T.ravel()
    got = {m["h"]: [m["model"][c] for c in "abcdef"] for r in ransac.affine_hypotheses(df, ["g"], count).collect() for m in r["models"]}
    assert want and set(got) == set(want)
    for h, model in want.items():
        assert np.allclose(got[h], model, rtol=1e-6, atol=1e-6)


def test_degenerate_groups_have_no_fit(spark):
    rows = [(1, 0.0, 0.0, 1.0, 1.0)] * 50 + [(2, float(i), float(i), 0.0, 0.0) for i in range(50)]
    rows += [(3, 0.0, 0.0, 0.0, 0.0), (3, 1.0, 0.0, 1.0, 0.0)]
    assert ransac.fit_affine(spark.createDataFrame(rows, POINTS), ["g"]).count() == 0


def test_unknown_score(spark):
    with pytest.raises(ValueError):
        ransac.fit_affine(spark.createDataFrame([], POINTS), ["g"], score="other")


def test_min_area(spark):
    rows = [(1, 0.0, 0.0, 0.0, 0.0), (1, 20.0, 10.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0, 0.0), (2, 19.0, 10.0, 0.0, 0.0)]
    assert [tuple(r) for r in ransac.large_enough(spark.createDataFrame(rows, POINTS), ["g"]).collect()] == [(1, 2, 200.0)]


def test_best_fit_ties(spark):
    rows = [(1, 10, 0.5, "b"), (1, 10, 0.5, "a"), (1, 9, 0.1, "c"), (2, 5, 0.2, "x"), (2, 5, 0.1, "y")]
    df = spark.createDataFrame(rows, "chip int, inliers bigint, rmse double, name string")
    best = ransac.best_fit_per_chip(df, ["chip"]).orderBy("chip").collect()
    assert [(r["name"], r["inliers"], r["rmse"]) for r in best] == [("a", 10, 0.5), ("y", 5, 0.1)]


def chips_of(spark, rows):
    return spark.createDataFrame(rows, "pair_id int, chip int, across double, along double")


def test_consensus_drops_deviating_chips_and_scattered_pairs(spark):
    rows = [(1, c, 2.0 + 0.01 * i, -1.0) for c in (1, 2, 3) for i in range(10)]
    rows += [(1, 4, 30.0, -1.0)] * 9 + [(1, 5, 2.0, -1.0)] * 2 + [(1, 1, 80.0, 80.0)] * 4
    rows += [(2, c, 20.0 * c, 0.0) for c in (1, 2, 3) for _ in range(5)]
    agreed = consensus.chip_consensus(chips_of(spark, rows), ["pair_id"]).collect()
    assert [(r["pair_id"], r["chips"], r["n"]) for r in agreed] == [(1, 3, 30)]
    assert agreed[0]["across"] == pytest.approx(2.045) and agreed[0]["along"] == -1.0
    single = consensus.chip_consensus(chips_of(spark, rows), ["pair_id"], min_chips=1).collect()
    assert {r["pair_id"]: r["chips"] for r in single} == {1: 3, 2: 1}


def test_mode_ties_go_to_the_lower_bin(spark):
    rows = [(1, 1, v, 0.0) for v in (-20.0, -20.0, -20.0, 20.0, 20.0, 20.0)]
    chip = consensus.surviving_chips(chips_of(spark, rows), ["pair_id"]).first()
    assert (chip["n"], chip["across"]) == (3, -20.0)


def test_window_size_decides_how_many_chips_must_agree(spark):
    rows = [(1, 1, 2.0, 0.0)] * 4
    for window, pairs in ((1024, 0), (2048, 1)):
        points = chips_of(spark, rows).withColumn("window_size", F.lit(window))
        assert consensus.chip_consensus(points, ["pair_id", "window_size"]).count() == pairs


@pytest.mark.parametrize(("window", "least"), [(1999, 2), (2000, 1), (2048, 1)])
def test_least_chips(window, least):
    assert consensus.min_surviving_chips(window) == least


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.randoms(use_true_random=False))
def test_consensus_ignores_row_order(spark, random):
    rows = [(1, c, 2.0 + c * 0.125 + (i % 3) * 0.25, 1.0) for c in range(4) for i in range(12)]
    shuffled = random.sample(rows, len(rows))
    a, b = (consensus.chip_consensus(chips_of(spark, r), ["pair_id"]) for r in (rows, shuffled))
    assert a.collect() == b.collect()


def test_median_scores_count_steps_of_leaders_only(spark):
    """Winners by the median step equal brute force; of the others only the bin of the median is known."""
    rng, rows, models, counts = np.random.default_rng(3), {}, {}, [3, 7]
    for g in range(6):
        xy = rng.integers(0, 800, (60 + g, 2)) / 8
        rows[g] = np.column_stack([xy, xy + rng.integers(-16, 17, xy.shape) / 8 + (rng.random((len(xy), 1)) < 0.3) * 90])
        models[g] = [(h, (1.0, 0.0, float(c), 0.0, 1.0, float(d))) for h, (c, d) in enumerate(rng.integers(-24, 25, (7, 2)) / 8 + (g == 5) * 3000)]
    df = spark.createDataFrame([(g, *map(float, r)) for g in rows for r in rows[g]], POINTS)
    kind = "g int, models array<struct<h:int,model:struct<a:double,b:double,c:double,d:double,e:double,f:double>>>"
    made = ransac._median_scores(df, spark.createDataFrame(list(models.items()), kind), ["g"], [F.count_if(F.col("r") <= 2).alias("_in0")], counts)
    got = {(r["g"], r["h"]): (r["n"], r["_in0"], r["_median"]) for r in made.collect()}
    assert len(got) == 42
    exact = 0
    for g in rows:
        want = []
        for _, (_, _, c, _, _, f) in models[g]:
            p = rows[g]
            r = np.sqrt((p[:, 0] + c - p[:, 2]) ** 2 + (p[:, 1] + f - p[:, 3]) ** 2)
            j = np.floor(np.log2(np.maximum(r, 64) / 64))
            step = np.where(r < 64, np.floor(r * 64), 4096 + 64 * j + np.floor(r / 2.0**j - 64)).astype(int)
            want.append((len(r), int((r <= 2).sum()), int(np.sort(step)[(len(r) + 1) // 2 - 1])))
        for count in counts:
            best = min(range(count), key=lambda h: (want[h][2], h))
            assert best == min(range(count), key=lambda h: (got[g, h][2], h)) and got[g, best] == want[best]
        for h in range(7):
            assert got[g, h][:2] == want[h][:2] and got[g, h][2] in (want[h][2], want[h][2] // 64 * 64)
            exact += got[g, h][2] == want[h][2]
    assert exact < 42

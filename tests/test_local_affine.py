"""Least squares by sums, refitted models, and the seeded local affine check against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiepoints.functions import geometry
from tiepoints.operators import joins, matching, ransac

POINTS = "k int, x1 double, y1 double, x2 double, y2 double, score double"


def test_affine_from_sums_equals_least_squares(spark):
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 900, 50) / 8, rng.integers(0, 900, 50) / 8
    u, v = np.round((1.1 * x - 0.2 * y + 5 + rng.normal(size=50)) * 8) / 8, np.round((0.3 * x + 0.9 * y - 2 + rng.normal(size=50)) * 8) / 8
    rows = [(1, *map(float, p)) for p in zip(x, y, u, v)]
    rows += [(2, float(i), 2.0 * i, float(i), 1.0) for i in range(9)]  # on one line
    rows += [(3, 0.0, 0.0, 1.0, 1.0), (3, 1.0, 0.0, 2.0, 1.0)]  # too few
    df = spark.createDataFrame(rows, "k int, x double, y double, u double, v double")
    sums = geometry.moments(*(F.col(c) for c in "xyuv"))
    made = df.groupBy("k").agg(F.count("*").alias("n"), *[F.sum(c).alias(name) for name, c in sums.items()])
    found = {r["k"]: r["m"] for r in made.select("k", geometry.affine_from_sums(F.col("n")).alias("m")).collect()}
    a = np.column_stack([x, y, np.ones(50)])
    expected = [*np.linalg.lstsq(a, u, rcond=None)[0], *np.linalg.lstsq(a, v, rcond=None)[0]]
    assert list(found[1]) == pytest.approx(expected, abs=1e-9) and found[2] is None and found[3] is None


def test_refit_uses_all_inliers(spark):
    rng = np.random.default_rng(7)
    x, y = rng.integers(0, 8000, 200) / 8, rng.integers(0, 8000, 200) / 8
    noise = rng.integers(-4, 5, (200, 2)) / 8
    u, v = x + 12 + noise[:, 0], y - 7 + noise[:, 1]
    u[::5] += 300
    df = spark.createDataFrame([(1, *map(float, p), 0.0) for p in zip(x, y, u, v)], POINTS)
    fit = ransac.refit_affine(df, ["k"], thresholds=[3.0], confidences=[0.99]).first()
    m = fit["model"]
    r = np.hypot(m["a"] * x + m["b"] * y + m["c"] - u, m["d"] * x + m["e"] * y + m["f"] - v)
    near = r <= 3
    a = np.column_stack([x[near], y[near], np.ones(near.sum())])
    expected = [*np.linalg.lstsq(a, u[near], rcond=None)[0], *np.linalg.lstsq(a, v[near], rcond=None)[0]]
    assert fit["inliers"] == near.sum() >= 150 and list(fit["refined"]) == pytest.approx(expected, abs=1e-7)
    line = spark.createDataFrame([(1, float(i), float(i % 2 and i), float(i), 0.0, 0.0) for i in (0, 1, 2)] * 3, POINTS)
    again = ransac.refit_affine(line, ["k"], thresholds=[1e-9], confidences=[0.99]).first()
    assert list(again["refined"]) == pytest.approx(list(again["model"]))


def brute(rows, cell, spread, radius, least):
    rows = np.array(rows)
    place = [(r[0], r[1] // cell, r[2] // cell) for r in rows]
    seeds = {}
    for i, (r, at) in enumerate(zip(rows, place)):
        rank = (-r[5], *r[1:5])
        if at not in seeds or rank < seeds[at][0]:
            seeds[at] = (rank, i)
    kept = np.zeros(len(rows), bool)
    for (k, cx, cy), (_, s) in seeds.items():
        near = np.array([q == k and abs(a - cx) <= 1 and abs(b - cy) <= 1 for q, a, b in place])
        local = rows[near][:, 1:5] - rows[s][1:5]
        xy, moved = local[:, :2], local[:, 2:] - local[:, :2]
        chosen = (np.abs(moved) <= spread).all(axis=1)
        a = np.column_stack([xy[chosen], np.ones(chosen.sum())])
        if chosen.sum() < 3 or np.linalg.matrix_rank(a) < 3:
            continue
        model = np.linalg.lstsq(a, moved[chosen], rcond=None)[0]
        good = ((np.column_stack([xy, np.ones(len(xy))]) @ model - moved) ** 2).sum(axis=1) <= radius**2
        if good.sum() >= least:
            kept[np.flatnonzero(near)[good]] = True
    return sorted(map(tuple, rows[kept].tolist()))


def test_seeded_affine_against_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = []
    for k in (1, 2):
        for _ in range(300):
            x, y = rng.integers(-300, 1300, 2) / 8
            turn = 0.01 * k
            u, v = x + turn * y + 6 + rng.integers(-2, 3) / 8, y - turn * x - 3 + rng.integers(-2, 3) / 8
            if rng.random() < 0.35:
                u, v = u + rng.integers(-160, 160) / 8, v + rng.integers(-160, 160) / 8
            rows.append((k, float(x), float(y), round(float(u) * 8) / 8, round(float(v) * 8) / 8, float(rng.integers(0, 6))))
    rows += [rows[0]] * 40 + [(3, 1.0, 1.0, 5.0, 5.0, 1.0)] * 20
    df = spark.createDataFrame(rows, POINTS).repartition(4)
    found = matching.seeded_affine(df, ["k"], cell=32.0, spread=2.5, radius=0.51, least=6)
    expected = brute(rows, 32, 2.5, 0.51, 6)
    assert sorted(map(tuple, found.collect())) == expected and 200 < len(expected) < 640
    assert found.columns == df.columns
    assert matching.seeded_affine(df.limit(0), ["k"], cell=32.0, spread=2.5, radius=0.5, least=6).count() == 0


def test_seeds_are_met_in_plain_columns(spark):
    df = spark.range(40).selectExpr("1 k", "id * 3.0D x1", "id % 7 * 5.0D y1", "id * 3.0D x2", "id % 7 * 5.0D y2", "1.0D score")
    found = matching.seeded_affine(df, ["k"], cell=32.0, spread=2.5, radius=0.51, least=3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and found.count() == 40


@pytest.mark.parametrize("limits", [{}, {"limit_bytes": 0}, {"limit_bytes": 0, "hot_rows": 10}])
def test_semi_join_with_a_condition(spark, tmp_path, limits):
    big = spark.range(100).selectExpr("id % 4 k", "id x")
    spark.sql("select * from values (0L, 50L), (0L, 80L), (1L, 91L), (3L, 200L) t(k, least)").write.parquet(str(tmp_path / "small"))
    small = spark.read.parquet(str(tmp_path / "small"))
    found = joins.join_settled(big, small, ["k"], "left_semi", where=F.col("x") >= F.col("least"), **limits)
    assert found.columns == ["k", "x"]
    assert sorted(r["x"] for r in found.collect()) == sorted([*range(52, 100, 4), 93, 97])

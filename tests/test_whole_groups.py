"""Groups fitted whole in numpy have the fits that aggregations give, however their rows lie."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiepoints.operators import consensus, ransac

POINTS = "g string, w int, x1 {0}, y1 {0}, x2 {0}, y2 {0}, v double"
CARRY = {"squares": ransac.Carry("squares"), "v": ransac.Carry("sum", "v"), **ransac.inlier_extent("x1")}


def rows(sizes, seed=5):
    rng, out = np.random.default_rng(seed), []
    for i, n in enumerate(sizes):
        x, y = rng.integers(0, 4000, (2, n)) / 8
        u, v = x + 3 + rng.integers(-12, 13, n) / 8, y - 2 + rng.integers(-12, 13, n) / 8
        u[::4] += 90
        out += [(f"g{i % 3}", i, *map(float, p), None if i % 5 == 0 or j % 7 == 0 else float(j)) for j, p in enumerate(zip(x, y, u, v))]
    return out


def fits(df, **options):
    found = ransac.fit_affine(df, ["g", "w"], thresholds=[1.0, 2.0], confidences=[0.91, 0.99], carry=CARRY, **options)
    made = {}
    for r in found.collect():
        row = r.asDict(recursive=True)
        model = tuple(row.pop("model").values())
        key = tuple(row.pop(c) for c in ("g", "w", "ransac_method", "ransac_threshold", "ransac_confidence"))
        row["squares"] = row["squares"] and round(row["squares"], 9)
        assert key not in made
        made[key] = (row, model)
    return found.schema, made


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize(("whole", "parts"), [(1 << 16, 1), (1 << 16, 7), (64, 3)])
def test_equal_to_aggregations(spark, kind, whole, parts):
    """Contiguous rows, rows in several places, and groups too large to be fitted whole."""
    data = rows([3, 4, 5, 9, 16, 17, 40, 64, 65, 90, 200, 1, 2, 33]) + [("line", 1, float(i), float(i), 0.0, 0.0, 1.0) for i in range(30)]
    data += [("twice", 2, *p[2:]) for p in rows([30], seed=8)] * 2 + [(None, 3, *p[2:]) for p in rows([20])]
    df = spark.createDataFrame(data, POINTS.format(kind))
    df = df.coalesce(1) if parts == 1 else df.repartition(parts)
    schema, found = fits(df, whole=whole)
    expected_schema, expected = fits(df)
    assert found == expected and len(found) > 40
    assert [(f.name, f.dataType) for f in schema] == [(f.name, f.dataType) for f in expected_schema]


def test_three_distinct_points_are_a_model(spark):
    """Whatever arcs their hashes fall in, but for points of one arc."""
    rng = np.random.default_rng(1)
    data = [("g", i, *map(float, p), 1.0) for i in range(60) for p in rng.integers(0, 400, (3, 4)) / 8]
    df = spark.createDataFrame(data, POINTS.format("double"))
    found, expected = fits(df, whole=100)[1], fits(df)[1]
    assert found == expected and len({w for _, w, *_ in found}) >= 57


def test_a_window_is_not_shuffled_and_batches_do_not_cut_it(spark, monkeypatch):
    df = spark.createDataFrame(rows([70, 50, 30, 90]), POINTS.format("double")).coalesce(1)
    monkeypatch.setattr(ransac, "HELD_RESIDUALS", 1 << 11)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        found = ransac.fit_affine(df, ["g", "w"], carry=CARRY, whole=1000)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert fits(df, whole=1000)[1] == fits(df)[1]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_only_what_numpy_knows_is_carried(spark):
    df = spark.createDataFrame(rows([9]), POINTS.format("double"))
    with pytest.raises(ValueError, match="known kinds"):
        ransac.fit_affine(df, ["g"], carry={"s": ransac.inlier_sum(F.col("r"))}, whole=100)
    assert ransac.fit_affine(df.limit(0), ["g"], carry=CARRY, whole=100).count() == 0


def test_known_means_meet_the_modes_of_pairs_only(spark):
    points = spark.createDataFrame([(1, c, a, 0.0) for c, a in ((1, 2.0), (2, 2.0), (3, 40.0), (None, 40.0)) for _ in range(4)], "p int, chip int, across double, along double")
    means = spark.createDataFrame([(1, c, n, a, 0.0) for c, n, a in ((1, 4, 2.0), (2, 2, 2.0), (3, 4, 40.0), (None, 4, 40.0))], "p int, chip int, n long, across double, along double")
    found = consensus.surviving_chips(points, ["p"], means=means)
    assert [tuple(r) for r in found.collect()] == [(1, 1, 4, 2.0, 0.0)]

"""The paths taken beyond the size limits give the same rows as those below them."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiepoints import session
from tiepoints.operators import geo, joins, matching, stats
from tiepoints.session import settle, work_dir


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds most rows, many of them copies."""
    rows = [(1, 1.0)] * 3000 + [(1, float(i)) for i in range(1500)] + [(k, 0.5) for k in range(2, 200)]
    return spark.createDataFrame(rows, "k int, v double").repartition(6).cache()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot_rows", [500, 10**9])
def test_joins_agree(spark, hot, how, hot_rows):
    small = settle(spark.createDataFrame([(1, "a"), (5, "b"), (999, "c")], "k int, name string"))
    expected = joins.join_settled(hot, small, ["k"], how)
    salted = joins.join_settled(hot, small, ["k"], how, limit_bytes=0, hot_rows=hot_rows)
    assert salted.columns == expected.columns
    assert salted.exceptAll(expected).count() == expected.exceptAll(salted).count() == 0


def test_hot_key_is_split_and_nothing_is_broadcast(spark, hot):
    small = settle(spark.createDataFrame([(1, "a"), (5, "b")], "k int, name string"))
    salted = joins.join_settled(hot, small, ["k"], limit_bytes=0, hot_rows=500)
    spread = salted.where("k = 1").select(F.spark_partition_id().alias("p")).distinct()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert spread.count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_top_per_key(hot):
    top = joins.top_per_key(hot, ["k"], [F.desc("v")], 10, "rank").where("k = 1").orderBy("rank").collect()
    assert [(r["rank"], r["v"]) for r in top] == [(i + 1, 1499.0 - i) for i in range(10)]


def test_work_dir_is_the_configured_one(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert work_dir(spark) == configured if configured else work_dir(spark) == work_dir(spark)


def test_scratch_deletes_what_was_settled_inside_and_nothing_else(spark):
    folder = Path(work_dir(spark).removeprefix("file:").replace("///", "/"))
    before = settle(spark.range(5), "kept-before")
    outer = set(folder.iterdir())
    with session.scratch(spark):
        one = settle(spark.range(7), "inside")
        with session.scratch(spark):
            inner = settle(one.where("id > 2"), "inner")
            assert inner.count() == 4 and len(set(folder.iterdir()) - outer) == 2
        assert one.count() == 7 and len(set(folder.iterdir()) - outer) == 1
    with pytest.raises(ValueError, match="stop"), session.scratch(spark):
        settle(spark.range(3), "failed")
        raise ValueError("stop")
    assert set(folder.iterdir()) == outer and before.count() == 5 and not session._scratches


def test_percentiles_from_brackets_are_exact(spark, hot, monkeypatch):
    monkeypatch.setattr(stats, "WHOLE_GROUP", 0)
    monkeypatch.setattr(stats, "SKETCH_ACCURACY", 200)
    wanted = {"p50": ("v", 0.5), "p90": ("v", 0.9), "p100": ("v", 1.0), "p0": ("v", 0.0)}
    found = {r["k"]: r for r in stats.group_statistics(hot, ["k"], {"mean": F.avg("v")}, wanted).collect()}
    values = np.array([r["v"] for r in hot.where("k = 1").collect()])
    assert len(found) == 199
    for name, (_, p) in wanted.items():
        assert found[1][name] == pytest.approx(np.percentile(values, 100 * p), abs=1e-9)
        assert found[7][name] == 0.5
    assert found[1]["n"] == 4500 and found[1]["mean"] == pytest.approx(values.mean())


def test_percentile_of_spread_values(spark, monkeypatch):
    monkeypatch.setattr(stats, "WHOLE_GROUP", 100)
    monkeypatch.setattr(stats, "SKETCH_ACCURACY", 500)
    values = np.random.default_rng(3).normal(size=20_000)
    df = spark.createDataFrame([(1, float(v)) for v in values], "k int, v double").repartition(5)
    row = stats.group_statistics(df, ["k"], {}, {"p": ("v", 0.37)}).first()
    assert row["p"] == pytest.approx(np.percentile(values, 37), abs=1e-12)


def descriptors(spark, n, copies=0):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(n, 16))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[:copies] = vectors[0]
    rows = [(1, i % 2, i, v.tolist()) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "block bigint, side int, id bigint, d array<float>"), rows


@pytest.mark.parametrize("copies", [0, 40])
def test_tiles_do_not_change_matches(spark, copies):
    desc, rows = descriptors(spark, 120, copies)
    for match in (matching.mutual_nn, matching.smnn_ratio, lambda d, tile: matching.dual_softmax(d, 0.1, 0.01, tile)):
        whole, tiled = (
            sorted((r["id0"], r["id1"], round(r[3], 6)) for r in match(desc, tile=t).collect()) for t in (4096, 13)
        )
        assert whole == tiled and whole


def clustered(spark, centres, each, copies=0):
    """Tight clusters on both sides of a block, and a small block beside it."""
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(centres, 16))
    vectors = np.concatenate([m + 0.02 * rng.normal(size=(each, 16)) for m in middle])
    vectors = vectors[rng.permutation(len(vectors))] * rng.uniform(0.9, 1.1, (len(vectors), 1))
    vectors[:copies] = vectors[0]
    rows = [(1, i % 2, i, v.tolist()) for i, v in enumerate(vectors)] + [(2, i % 2, 10**6 + i, rng.normal(size=16).tolist()) for i in range(30)]
    return spark.createDataFrame(rows, "block bigint, side int, id bigint, d array<float>").repartition(4), rows


@pytest.mark.parametrize("copies", [0, 300])
def test_pivots_find_the_same_matches_with_less_work(spark, copies):
    desc, rows = clustered(spark, 40, 40, copies)
    for match in (matching.mutual_nn, matching.smnn_ratio):
        whole, pruned = (sorted((r["block"], r["id0"], r["id1"], round(r[3], 6)) for r in match(desc, tile=t).collect()) for t in (10**5, 40))
        assert whole == pruned and len(whole) > 20
    for needed in (matching._may_be_largest_product, matching._may_be_two_nearest):
        placed, pairs = matching.needed_tiles(desc.where("block = 1"), needed, 40)
        size = {(r["side"], r["_cluster"]): r["count"] for r in placed.groupBy("side", "_cluster").count().collect()}
        work = sum(size[0, r["c0"]] * size[1, r["c1"]] for r in pairs.collect())
        half = len(rows) // 2
        assert work < (0.35 if needed is matching._may_be_two_nearest else 0.5) * half**2, work / half**2


@pytest.mark.parametrize("dims", [2, 16])
def test_pivots_without_structure_lose_nothing(spark, dims):
    rng = np.random.default_rng(8)
    rows = [(1, int(i % 3 == 0), i, (rng.normal(size=dims) * (0.0 if i % 50 == 0 else 1.0)).tolist()) for i in range(400)]
    desc = spark.createDataFrame(rows, "block bigint, side int, id bigint, d array<float>")
    for match in (matching.mutual_nn, matching.smnn_ratio):
        whole, pruned = (sorted((r["id0"], r["id1"], round(r[3], 6)) for r in match(desc, tile=t).collect()) for t in (10**5, 15))
        assert whole == pruned and whole


def test_mutual_nn_against_brute_force(spark):
    desc, rows = descriptors(spark, 80)
    a = np.array([r[3] for r in rows if r[1] == 0], dtype=np.float32).astype(float)
    b = np.array([r[3] for r in rows if r[1] == 1], dtype=np.float32).astype(float)
    s = a @ b.T
    expected = {(2 * i, 2 * j + 1) for i, j in enumerate(s.argmax(1)) if s[:, j].argmax() == i}
    assert {(r["id0"], r["id1"]) for r in matching.mutual_nn(desc, tile=9).collect()} == expected


def test_local_consistency_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 200, 400), rng.integers(0, 200, 400)
    u, v = rng.normal(scale=1.5, size=400).round(2), rng.normal(scale=1.5, size=400).round(2)
    rows = [(1, float(a), float(b), float(a + c), float(b + d)) for a, b, c, d in zip(x, y, u, v)]
    rows += [rows[0]] * 50 + [(2, 1.0, 1.0, 9.0, 9.0)] * 3
    df = spark.createDataFrame(rows, "pair int, x1 double, y1 double, x2 double, y2 double").repartition(4)
    kept = matching.local_consistency(df, ["pair"], cell=40.0, radius=0.5, least=3).collect()

    def alike(p, q):
        near = all(abs(p[i] // 40 - q[i] // 40) <= 1 for i in (1, 2))
        moves = [abs((p[i + 2] - p[i]) - (q[i + 2] - q[i])) <= 0.5 for i in (1, 2)]
        return p[0] == q[0] and near and all(moves)

    expected = [p for p in rows if sum(alike(p, q) for q in rows) > 3]
    assert sorted(map(tuple, kept)) == sorted(expected)
    assert 50 < len(expected) < len(rows)


@pytest.mark.parametrize("most, levels", [(1024, 30), (8, 30), (2, 3)])
def test_nearest_gcp_against_brute_force(spark, most, levels, monkeypatch):
    monkeypatch.setattr(geo, "LEVELS", levels)
    rng = np.random.default_rng(2)
    points, marks = rng.uniform(0, 300, (80, 2)), rng.uniform(0, 100, (150, 2))
    marks[10] = marks[9]
    matches = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "m int, map_x1 double, map_y1 double")
    gcps = spark.createDataFrame([(i, *map(float, g)) for i, g in enumerate(marks)], "gcp_id bigint, X double, Y double")
    found = {r["m"]: (r["gcp_id"], r["gcp_distance"]) for r in geo.nearest_gcp(matches, gcps, 50.0, most=most).collect()}
    d = np.hypot(*(points[:, None, :] - marks[None, :, :]).transpose(2, 0, 1))
    assert len(found) == 80
    for i in range(80):
        if d[i].min() <= 50:
            assert found[i][0] == d[i].argmin() and found[i][1] == pytest.approx(d[i].min())
        else:
            assert found[i] == (None, None)


def test_crowds_of_control_points_are_split(spark):
    """A third of all points in one cell, most of them in one corner of it: bounded lists, few of them read."""
    rng = np.random.default_rng(9)
    marks = np.concatenate([rng.uniform(0, 900, (1000, 2)), 100 + rng.uniform(0, 40, (300, 2)), 100 + rng.uniform(0, 1, (500, 2))])
    marks = np.concatenate([marks, marks[-1:].repeat(50, axis=0)])
    gcps = spark.createDataFrame([(i, *map(float, g)) for i, g in enumerate(marks)], "gcp_id bigint, X double, Y double")
    whole, split = geo.leaves_of(gcps, 60.0, most=40)
    leaf = ["_level", "_lx", "_ly", "_slot"]
    sizes = [r["count"] for part in (whole, split) for r in part.groupBy(*leaf).count().collect()]
    assert max(sizes) <= 40 and sum(sizes) == 1800 and split.agg(F.max("_level")).first()[0] >= 4
    at = np.concatenate([rng.uniform(90, 150, (60, 2)), rng.uniform(0, 900, (60, 2)), marks[:5]])
    matches = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)] + [(999, None, 1.0)], "m int, map_x1 double, map_y1 double")
    found = {r["m"]: (r["gcp_id"], r["gcp_distance"]) for r in geo.nearest_gcp(matches, gcps, 60.0, most=40).collect()}
    d = np.hypot(*(at[:, None, :] - marks[None, :, :]).transpose(2, 0, 1))
    for i in range(len(at)):
        near = d[i].min() <= 60
        assert found[i][0] == (d[i].argmin() if near else None), i
    assert found[999] == (None, None) and len(found) == 126
    assert geo.nearest_gcp(matches, gcps.limit(0), 60.0).where("gcp_id is not null").count() == 0


@pytest.mark.parametrize("whole", [20_000, 0])
def test_percentiles_count_values_not_rows(spark, whole, monkeypatch):
    monkeypatch.setattr(stats, "WHOLE_GROUP", whole)
    rows = [(1, float(i)) for i in range(10)] + [(1, None)] * 3 + [(2, None)] + [(3, float("nan")), (3, 1.0), (3, 2.0)]
    points = spark.createDataFrame(rows, "k int, v double")
    found = stats.group_statistics(points, ["k"], {"m": F.avg("v")}, {"p50": ("v", 0.5), "p100": ("v", 1.0)})
    got = {r["k"]: (r["n"], r["m"], r["p50"]) for r in found.collect()}
    assert got[1] == (13, 4.5, 4.5) and got[2] == (1, None, None)
    assert got[3][2] == 2.0


def test_a_hot_key_of_one_partition_gets_several_salts(spark):
    big = spark.range(6000).select(F.lit(1).alias("k"), "id").coalesce(1)
    small = settle(spark.createDataFrame([(1, "a")], "k int, v string"))
    joined = joins.join_settled(big, small, ["k"], limit_bytes=0, hot_rows=500)
    assert joined.count() == 6000
    assert big.select(F.pmod(joins._row_hash(big), F.lit(12))).distinct().count() > 1

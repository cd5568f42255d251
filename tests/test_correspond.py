from pyspark.sql import functions as F

from tiepoints.operators import correspond, records

PRED = "id int, w1 int, h1 int, w2 int, h2 int, " + ", ".join(
    f"{n} array<array<float>>" for n in ("mm0", "mm1", "raw0", "raw1")
)
NAN = float("nan")


def grid(n, dx=0.0):
    return [[float(i), 1.0 + dx] for i in range(n)]


def windows(spark, *rows):
    return spark.createDataFrame([(i, 8, 8, 8, 8, *r) for i, r in enumerate(rows)], PRED)


def anywhere(x, y):
    return F.lit(True)


def reasons(spark, *rows, valid1=anywhere, valid2=anywhere):
    out = correspond.clean_windows(windows(spark, *rows), valid1, valid2).orderBy("id").collect()
    return [(r["reject_reason"], len(r["kp"]) if r["kp"] is not None else None) for r in out]


def test_choice_of_point_set(spark):
    assert reasons(
        spark,
        (grid(5), grid(5), grid(7), grid(7)),  # filtered points win
        (grid(2), grid(2), grid(7), grid(7)),  # a few filtered points do not fall back
        ([], [], grid(7), grid(7)),  # an empty filtered set does
        (grid(5), None, grid(7), grid(7)),
        (None, None, None, None),
        (None, None, [], []),
    ) == [(None, 5), ("too_few", None), (None, 7), (None, 7), ("no_points", None), ("no_points", None)]


def test_ragged_windows_are_dropped(spark):
    assert reasons(
        spark, (grid(5), grid(4), None, None), (None, None, grid(5), None)
    ) == [("ragged", None), ("ragged", None)]


def test_bounds_are_half_open_and_drop_nan(spark):
    side = [[0.0, 0.0], [7.99, 7.0], [8.0, 1.0], [-0.01, 1.0], [NAN, 1.0], [1.0, NAN], [2.0, 2.0], [3.0, 3.0]]
    ok = [[1.0, 1.0]] * 8
    assert reasons(spark, (side, ok, None, None), (ok, side, None, None)) == [(None, 4), (None, 4)]
    assert reasons(spark, ([[9.0, 9.0]] * 5, [[1.0, 1.0]] * 5, None, None)) == [("out_of_bounds", None)]


def test_mask_on_the_row(spark):
    rows = windows(spark, (grid(8), grid(8), None, None)).withColumn(
        "mask", F.lit(bytes(i % 8 >= 3 for i in range(64)))
    )
    valid = correspond.mask_pixel(F.col("mask"), F.col("w1"))
    kept = correspond.clean_windows(rows, valid, anywhere).first()["kp"]
    assert [(p["kp_idx"], p["x1"]) for p in kept] == [(i, float(i)) for i in range(3, 8)]


def test_earlier_reason_is_kept(spark):
    rows = windows(spark, (None,) * 4).withColumn("reject_reason", F.lit("matcher_error"))
    assert correspond.clean_windows(rows, anywhere, anywhere).first()["reject_reason"] == "matcher_error"


def test_point_rows_with_nan_do_not_raise(spark):
    points = spark.createDataFrame([(NAN, 1.0, 1.0, 1.0), (1.0, 1.0, 2.0, 2.0)], "x1 double, y1 double, x2 double, y2 double")
    mask = F.lit(b"\1" * 64)
    valid = correspond.mask_pixel(mask, F.lit(8))
    kept = correspond.drop_nodata(correspond.in_bounds(points, 8, 8, 8, 8), valid, valid)
    assert kept.count() == 1


def test_min_matches_counts_per_window(spark):
    rows = [(k, float(i), 0.0, 0.0, 0.0) for k, n in ((1, 3), (2, 4), (3, 9)) for i in range(n)]
    points = spark.createDataFrame(rows, "win int, x1 double, y1 double, x2 double, y2 double")
    kept = correspond.min_matches(points, ["win"]).groupBy("win").count().collect()
    assert sorted(map(tuple, kept)) == [(2, 4), (3, 9)]


def record_windows(spark, n):
    return windows(spark, (grid(n), grid(n, 2.0), None, None)).selectExpr(
        "*", "'a-b' AS tag", "'HH' AS source_pol", "'VV' AS s1_ref_tag", "3 AS pair_id",
        "100 AS wx", "20 AS wy", "7 AS s1_wx", "5 AS s1_wy", "'4' AS ransac_method",
        "'1' AS ransac_threshold", "'0.91' AS ransac_confidence",
        """named_struct('x01', 10D, 'y01', 20D, 'xres1', 2D, 'yres1', -2D, 'x02', 11D, 'y02', 22D,
           'xres2', 4D, 'yres2', -4D, 'crop_col_offset', 1000, 'crop_row_offset', 5000) AS geo""",
    )


def test_record_axes_are_crossed(spark):
    cleaned = correspond.clean_windows(record_windows(spark, 4), anywhere, anywhere)
    r = records.build_records(cleaned).first()
    assert r["file_id"] == "imw-a-b_HH_toS1VV_pair3_scan1100_pix5020_lgm_aff_4_1_0.91_"
    assert (r["global_scan"], r["global_pix"], r["local_init_x"], r["local_init_y"]) == (1100, 5020, 100, 20)
    assert (r["matcher"], r["match_param"]) == ("lgm", "")
    assert (r["x1"][1], r["y1"][1], r["x2"][1], r["y2"][1]) == (21.0, 101.0, 6.0, 10.0)
    assert (r["map_x1"][1], r["map_y1"][1]) == (10 + 21 * 2, 20 - 101 * 2)
    assert (r["map_x2"][1], r["map_y2"][1]) == (11 + 6 * 4, 22 - 10 * 4)
    assert r["across"][1] == r["map_x1"][1] - r["map_x2"][1]
    assert r["along"][1] == r["map_y1"][1] - r["map_y2"][1]
    assert abs(r["distance"][1] - (r["across"][1] ** 2 + r["along"][1] ** 2) ** 0.5) < 1e-9


def test_explode_inverts_build(spark):
    cleaned = correspond.clean_windows(record_windows(spark, 6), anywhere, anywhere)
    built = records.build_records(cleaned)
    rows = records.explode_records(built, ["file_id"]).orderBy("x1").collect()
    record = built.first()
    for name in ("x1", "y2", "map_x1", "map_y2", "distance", "along", "across"):
        assert [r[name] for r in rows] == record[name]


def test_a_large_window_is_gathered_whole_from_any_partitioning(spark):
    rows = [(1, 5.0, 5.0, 5.0, 5.0)] * 300 + [(1, float(i), 0.0, 0.0, 0.0) for i in range(9000)]
    points = spark.createDataFrame(rows, "win int, x1 double, y1 double, x2 double, y2 double")
    two, seven = (records.gather_windows(points.repartition(n), ["win"]).collect() for n in (2, 7))
    assert two == seven and len(two) == 1
    assert [p["kp_idx"] for p in two[0]["kp"]] == list(range(9300))
    assert [p["x1"] for p in two[0]["kp"]] == sorted(p["x1"] for p in two[0]["kp"])

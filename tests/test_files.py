import json

import pytest
from pyspark.sql import functions as F

from tiepoints import fixtures as fx
from tiepoints import schemas
from tiepoints.operators import stats
from tiepoints.plans.queries import _records
from tiepoints.sources import match_files, readers, writers
from tiepoints.streaming import incremental

SF = "/root/testdata/sf0.001"
NAME = "imw-a_HH_toS1VV_pair1_scan2_pix3_lgm_aff_4_1_0.91_.csv"


def test_legacy_csv_files(spark, tmp_path):
    line = "1.0,2.0,3.0,4.0,5.0,6.0,7.0,8.0,9.0,10.0,11.0\n"
    header = ",".join(schemas.RECORD_LISTS) + "\n"
    (tmp_path / NAME).write_text(header + line * 3)
    (tmp_path / "disk_other.csv").write_text(header + line)
    rows = readers.read_match_files(spark, str(tmp_path)).collect()
    assert sorted((r["file_name"], r["key"] and r["key"]["pair_id"]) for r in rows) == [("disk_other.csv", None)] + [(NAME, 1)] * 3
    assert rows[0]["across"] == 11.0


def test_records_survive_writing(spark, tmp_path):
    records = _records(spark, SF).drop("win", "part")
    for path in ("one", "two"):
        writers.write_match_records(records.where(F.col("detector") == {"one": "imw-m1", "two": "imw-m2"}[path]), str(tmp_path / "all"))
    stored = readers.read_match_records(spark, str(tmp_path / "all"))
    expected = records.where(F.col("detector").isin("imw-m1", "imw-m2")).select(stored.columns)
    assert stored.exceptAll(expected).count() == expected.exceptAll(stored).count() == 0


RECORD = "window_size int, detector string, source_pol string, file_id string, " + ", ".join(f"{c} array<double>" for c in schemas.RECORD_LISTS)


def record(file_id, *values, detector="imw-a", size=1024, pol="HH"):
    return (size, detector, pol, file_id, *[[v + i for v in values] for i in range(len(schemas.RECORD_LISTS))])


def test_match_files_are_named_after_their_ids_and_read_back(spark, tmp_path):
    records, path = _records(spark, SF), str(tmp_path / "files")
    writers.write_match_files(records, path)
    listed = sorted(str(f.relative_to(path)) for f in (tmp_path / "files").rglob("*") if f.is_file() and f.suffix == ".csv")
    expected = records.select(F.format_string("window_size=%s/detector=%s/source_pol=%s/%s.csv", "window_size", "detector", "source_pol", "file_id"))
    assert listed == sorted({r[0] for r in expected.collect()})
    stored = readers.read_match_files(spark, path)
    lists = records.select(F.concat("file_id", F.lit(".csv")).alias("file_name"), F.inline(F.arrays_zip(*schemas.RECORD_LISTS)))
    found = stored.select(lists.columns)
    assert found.exceptAll(lists).count() == lists.exceptAll(found).count() == 0
    assert stored.where("key is null or key.detector != detector").count() == 0
    told = json.loads((tmp_path / "files" / "_SUCCESS").read_text())
    assert told == {"files": len(listed), "rows": lists.count()}
    assert not [f for f in (tmp_path / "files").rglob(".*") if not f.name.endswith(".crc")]


def test_records_of_one_id_share_a_file_and_odd_values_survive(spark, tmp_path):
    odd = [float("nan"), float("inf"), -float("inf"), 1e-300, 0.1 + 0.2]
    rows = [record("a b%c", 1.0), record("a b%c", 2.0), record("a b%c", 1.0, detector="imw-b"), record("x", *odd), record("none"), record("x", 5.0, pol=None)]
    df = spark.createDataFrame(rows, RECORD).withColumn("y2", F.when(F.col("file_id") == "x", F.transform("y2", lambda v: F.lit(None).cast("double"))).otherwise(F.col("y2")))
    path = f"file://{tmp_path}/files"
    writers.write_match_files(df, path)
    files = {str(f.relative_to(tmp_path / "files")) for f in (tmp_path / "files").rglob("*.csv")}
    here, null = "window_size=1024/detector=imw-a/source_pol=HH", "window_size=1024/detector=imw-a/source_pol=__HIVE_DEFAULT_PARTITION__"
    assert files == {f"{here}/a b%25c.csv", f"{here.replace('-a', '-b')}/a b%25c.csv", f"{here}/x.csv", f"{here}/none.csv", f"{null}/x.csv"}
    stored = readers.read_match_files(spark, path).where("source_pol = 'HH' and detector = 'imw-a'").collect()
    x = [r["x1"] for r in stored if r["distance"] is not None and r["y2"] is None]
    assert sorted(map(repr, x)) == sorted(map(repr, odd))
    assert sorted(r["x1"] for r in stored if r["y2"] is not None) == [1.0, 2.0]


def test_a_task_that_runs_twice_leaves_the_same_files(tmp_path):
    rows = [dict(zip(["window_size", "detector", "source_pol", "file_id", *schemas.RECORD_LISTS], record(i, 1.0, 2.0))) for i in ("a", "a", "b")]
    writer = match_files.MatchFileWriter(str(tmp_path), overwrite=False)
    first, second = writer.write(iter(rows)), writer.write(iter(rows))
    assert first == second and first.rows == 6 and len(first.files) == 2
    writer.commit([first, None])
    assert json.loads((tmp_path / "_SUCCESS").read_text()) == {"files": 2, "rows": 6}
    assert len((tmp_path / first.files[0]).read_text().splitlines()) == 5
    writer.abort([first, None])
    writer.abort([first])
    assert not list(tmp_path.rglob("*.csv"))


def test_match_files_refuse_what_they_cannot_keep(spark, tmp_path):
    df = spark.createDataFrame([record(None, 1.0)], RECORD)
    with pytest.raises(Exception, match="without file id"):
        writers.write_match_files(df, str(tmp_path / "a"))
    spark.dataSource.register(match_files.MatchFiles)
    good = spark.createDataFrame([record("a", 1.0)], RECORD)
    with pytest.raises(Exception, match="appended"):
        good.write.format(match_files.FORMAT).mode("overwrite").save(str(tmp_path / "b"))
    with pytest.raises(Exception, match="lack"):
        good.drop("along").write.format(match_files.FORMAT).mode("append").save(str(tmp_path / "b"))
    writers.write_match_files(good.limit(0), str(tmp_path / "empty"))
    assert json.loads((tmp_path / "empty" / "_SUCCESS").read_text()) == {"files": 0, "rows": 0}


def test_summary_is_replaced_per_window_size(spark, tmp_path):
    path = str(tmp_path / "summary")
    for rows in ([(1, 512), (2, 1024)], [(9, 1024)]):
        writers.write_run_summary(spark.createDataFrame(rows, "n bigint, window_size int"), path)
    stored = spark.read.parquet(path)
    assert sorted((r["window_size"], r["n"]) for r in stored.collect()) == [(512, 1), (1024, 9)]
    assert {tuple(r) for r in writers.manifest_of(stored).collect()} == {(512, True), (1024, True)}


def test_sources_have_their_schemas(spark, tmp_path):
    assert readers.read_gcps(spark).count() == 0
    (tmp_path / "g.csv").write_text("gcp_id,X,Y\n1,2.5,3.5\n")
    assert tuple(readers.read_gcps(spark, str(tmp_path / "g.csv")).first()) == (1, 2.5, 3.5)
    for reader, schema in (
        (readers.read_chip_pairs, schemas.CHIP_PAIR), (readers.read_sparse_specs, schemas.SPARSE_SPEC),
        (readers.read_dense_specs, schemas.DENSE_SPEC), (readers.read_conf_tables, schemas.CONF_TABLE),
        (readers.read_manifest, schemas.MANIFEST), (readers.read_run_log, schemas.RUN_LOG),
    ):
        path = str(tmp_path / reader.__name__)
        spark.createDataFrame([], schema).write.parquet(path)
        assert reader(spark, path).schema == schema
    reference = str(tmp_path / "reference")
    fx.reference_images(spark, SF).write.partitionBy("ref_pol").parquet(reference)
    assert readers.read_reference(spark, reference, "VH").select("ref_pol").distinct().first()[0] == "VH"


def test_reference_polarisation(spark):
    pols = spark.createDataFrame([("HH",), ("VV",), ("HV",), ("VH",), ("XX",)], "p string")
    assert [r[0] for r in pols.select(stats.reference_pol(F.col("p"))).collect()] == ["VV", "VV", "VH", "VH", None]


def test_incremental_run_reads_every_file_once(spark, tmp_path):
    source, out, check = (str(tmp_path / d) for d in ("in", "out", "check"))
    items = spark.read.parquet(f"{SF}/lineitem.parquet")

    def transform(stream):
        points = fx.with_geometry(fx.correspondences_of(stream))
        return incremental.clean_and_locate(points, fx.IMAGE, fx.valid1, fx.valid2).select("pair_id", "map_x1")

    def run():
        return incremental.incremental_run(spark, source, items.schema, transform, out, check).count()

    low = items.where("l_suppkey < 5").coalesce(1)
    low.write.parquet(source)
    first = run()
    assert first == transform(low).count() > 0
    assert run() == first
    items.where("l_suppkey >= 5").coalesce(2).write.mode("append").parquet(source)
    assert run() == transform(items).count()



def test_records_met_in_an_earlier_increment_are_dropped(spark, tmp_path):
    source, out, check = (str(tmp_path / d) for d in ("in", "out", "check"))

    def add(*rows):
        made = spark.createDataFrame([(k, v) for k, v in rows], "k int, v string").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
        made.coalesce(1).write.mode("append").parquet(source)
        found = incremental.incremental_run(spark, source, made.schema, lambda s: s, out, check, keys=["k"]).collect()
        return sorted((r["k"] is None, r["k"] or 0, r["v"]) for r in found)

    assert add((1, "a"), (2, "b"), (None, "n")) == [(False, 1, "a"), (False, 2, "b"), (True, 0, "n")]
    assert add((2, "later"), (3, "c"), (None, "m")) == [(False, 1, "a"), (False, 2, "b"), (False, 3, "c"), (True, 0, "n")]
    assert add((1, "a")) == [(False, 1, "a"), (False, 2, "b"), (False, 3, "c"), (True, 0, "n")]


def test_state_may_be_bounded_by_a_watermark(spark, tmp_path):
    source, out, check = (str(tmp_path / d) for d in ("in", "out", "check"))
    rows = spark.createDataFrame([(1, "2024-01-01"), (1, "2024-01-01"), (2, "2024-01-02")], "k int, d string").select("k", F.col("d").cast("timestamp").alias("at"))
    rows.coalesce(1).write.parquet(source)
    found = incremental.incremental_run(spark, source, rows.schema, lambda s: s, out, check, keys=["k"], within=("at", "30 days"))
    assert sorted(r["k"] for r in found.collect()) == [1, 2]


def test_bad_windows_are_read_apart(spark, tmp_path):
    rows = [(1, "a", None, None, [1]), (2, "a", "nan", None, None), (3, "b", "matcher_error", "ValueError: x", None)]
    windows = spark.createDataFrame(rows, "id int, tag string, reject_reason string, error string, kp array<int>")
    writers.write_windows(windows, str(tmp_path / "w"))
    bad = readers.read_windows(spark, str(tmp_path / "w"), True)
    assert {tuple(r) for r in bad.select("id", "reject_reason", "error").collect()} == {(2, "nan", None), (3, "matcher_error", "ValueError: x")}
    assert [r["id"] for r in readers.read_windows(spark, str(tmp_path / "w"), False).collect()] == [1]
    assert "PartitionFilters: [isnotnull(rejected" in bad._jdf.queryExecution().toString()

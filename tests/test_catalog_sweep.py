import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tiepoints import schemas
from tiepoints.operators import catalog, sweep


@pytest.fixture(scope="module")
def specs(spark):
    sparse = spark.createDataFrame(
        [(1, "a-nn", "e1", "m1"), (2, "b-nn", "gone", "m1"), (3, "c-nn", "e1", "gone"), (4, "d-nn", "gone", "gone"),
         (5, "a-nn", "e1", "m2"), (6, "bad_tag", "e1", "m1"), (7, "bad tag", "e1", "m1"), (8, "bad(tag)", "e1", "m1")],
        schemas.SPARSE_SPEC,
    )
    dense = spark.createDataFrame(
        [(1, "x-roma", "d1"), (2, "y-lg", "d2"), (3, "b-nn", "d1"), (4, "z", "gone")], schemas.DENSE_SPEC
    )
    return catalog.all_specs(sparse, dense)


@pytest.fixture(scope="module")
def confs(spark):
    named = '{"model":{"name":"%s"}}'
    return spark.createDataFrame(
        [("extract", "e1", named % "E"), ("match", "m1", named % "M"), ("match", "m2", '{"model":{}}'),
         ("dense", "d1", named % "D"), ("dense", "d2", "{}")],
        schemas.CONF_TABLE,
    )


def test_violations_are_found_before_the_lookup(specs):
    found = {(r["tag"], r["n"], r["violation"]) for r in catalog.tag_violations(specs).collect()}
    assert found == {
        ("a-nn", 2, "duplicate"), ("b-nn", 2, "duplicate"), ("bad_tag", 1, "bad_character"),
        ("bad tag", 1, "bad_character"), ("bad(tag)", 1, "bad_character"),
    }


def test_strict_mode_fails(specs):
    with pytest.raises(PySparkException, match="tag"):
        catalog.require_valid_tags(specs).collect()
    fine = specs.where(F.col("tag").isin("c-nn", "x-roma", "z"))
    assert catalog.require_valid_tags(fine).exceptAll(fine).count() == 0


def test_resolve(specs, confs):
    resolved = catalog.resolve(catalog.first_valid(specs), confs)
    rows = catalog.listing(catalog.catalog(resolved)).orderBy("kind", "ordinal").collect()
    assert [tuple(r) for r in rows] == [
        (1, "x-roma", "dense", "imw-x-roma", "D"), (2, "y-lg", "dense", "imw-y-lg", None),
        (1, "a-nn", "sparse", "imw-a-nn", "M"),
    ]
    skipped = {tuple(r) for r in catalog.skips(resolved).collect()}
    assert skipped == {
        (2, "b-nn", False, "extractor", "gone"), (3, "c-nn", False, "matcher", "gone"),
        (4, "d-nn", False, "extractor", "gone"), (4, "z", True, "dense matcher", "gone"),
    }
    conf = catalog.catalog(resolved).where("tag = 'x-roma'").first()["conf"]
    assert conf["feature"] is None and conf["dense"] is True
    counted = catalog.counts(catalog.catalog(resolved)).first()
    assert tuple(counted) == (3, 2, 1)


@pytest.mark.parametrize(
    ("tags", "left"),
    [(None, {"a", "b", "c"}), ("", {"a", "b", "c"}), ("a,b", {"a", "b"}), ("a, b", {"a"}), ("nope", set())],
)
def test_allow_list(spark, tags, left):
    cat = spark.createDataFrame([("a",), ("b",), ("c",)], "tag string")
    assert {r["tag"] for r in catalog.allow_list(cat, tags).collect()} == left
    for rows in ([(tags,)], [(tags,), (None,), ("",)]):
        table = spark.createDataFrame(rows, "tags string")
        assert {r["tag"] for r in catalog.allow_table(cat, table).collect()} == left


def test_forward_flags(spark):
    cat = spark.createDataFrame([("roma", True), ("x-dkm", True), ("roma-s", False), ("y", True)], "tag string, dense boolean")
    flags = {r["tag"]: r["run_forward"] for r in catalog.with_run_forward(cat).collect()}
    assert flags == {"roma": False, "x-dkm": False, "roma-s": True, "y": True}
    assert not any(r["run_forward"] for r in catalog.with_run_forward(cat, skip_forward=True).collect())


def test_lookup_status(spark, specs, confs):
    cat = catalog.catalog(catalog.resolve(catalog.first_valid(specs), confs))
    wanted = spark.createDataFrame([("a-nn",), ("nope",)], "tag string")
    found = {r["tag"]: (r["status"], r["catalog_ordinal"]) for r in catalog.lookup_tags(wanted, cat).collect()}
    assert found == {"a-nn": (0, 1), "nope": (2, None)}


def test_grid_and_derived_parameters(spark):
    configs = spark.createDataFrame([("a",), ("b",)], "tag string")
    assert sweep.sweep_grid(configs).count() == 18
    grid = sweep.sweep_grid(configs, "400,2000,2001").where("tag = 'a' AND ransac_threshold = '1' AND ransac_confidence = '0.91'")
    rows = {r["window_size"]: r for r in grid.collect()}
    assert {w: (r["window_size_small"], r["debug_mode"], r["min_surviving_chips"], r["output_dir"]) for w, r in rows.items()} == {
        400: (250, False, 2, "window400"), 2000: (1000, False, 1, "window2000"), 2001: (1000, True, 1, "window2001"),
    }


def test_int_list(spark):
    df = spark.createDataFrame([("1, 2,x",), (None,)], "s string")
    assert [r[0] for r in df.select(sweep.int_list(F.col("s"))).collect()] == [[1, 2, None], [1024]]


def test_pending_and_fetch(spark):
    runs = spark.createDataFrame([(512,), (1024,), (2048,)], "window_size int")
    done = spark.createDataFrame([(512, True), (1024, False)], schemas.MANIFEST)
    assert sorted(r[0] for r in sweep.pending(runs, done).collect()) == [1024, 2048]
    pairs = spark.createDataFrame([(1,), (2,)], "pair_id int")
    cached = spark.createDataFrame([(1,), (1,)], "pair_id int")
    assert [r[0] for r in sweep.to_fetch(pairs, cached).collect()] == [2]
    assert sweep.to_fetch(pairs, cached, force=True).count() == 2


def test_outcomes(spark):
    codes = [0, 137, -9, 1, 0, 2]
    rows = [(i, f"t{i}", False, c, 0, 90_000_000) for i, c in enumerate(codes)]
    log = spark.createDataFrame(rows, schemas.RUN_LOG)
    found = {r["outcome"]: (r["runs"], r["minutes"]) for r in sweep.run_summary(log).collect()}
    assert found == {"ok": (2, 3.0), "OOM-killed": (2, 3.0), "exit=1": (1, 1.5), "exit=2": (1, 1.5)}
    assert tuple(sweep.run_status(log).first()) == (2, 4, 1)
    assert sweep.run_status(log.where("exit_code = 0")).first()["status"] == 0
    assert sweep.run_status(log.limit(0)).first()["status"] == 0
    ok = sweep.run_report(log, page=4).where("outcome = 'ok'").orderBy("page").collect()
    assert [r["tags"] for r in ok] == ["t0", "t4"]

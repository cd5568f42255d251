import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tiepoints.functions import file_ids
from tiepoints.operators.records import parse_keys

GOOD = "imw-sp-lg_HH_toS1VV_pair007_scan12_pix34_lgm_aff_4_1_0.91_.csv"


def parse(spark, names):
    rows = parse_keys(spark.createDataFrame([(n,) for n in names], "file_name string")).collect()
    return {r["file_name"]: r["key"] for r in rows}


def test_fields(spark):
    key = parse(spark, [GOOD])[GOOD]
    assert key.asDict() == {
        "disk_mode": None, "det_wt": None, "desc_wt": "sp-lg", "detector": "imw-sp-lg",
        "source_pol": "HH", "s1_ref_tag": "VV", "pair_id": 7, "scan": 12, "pix": 34,
        "match_method": "lgm", "match_parameter": None, "ransac_method": "4",
        "ransac_threshold": 1.0, "ransac_confidence": 0.91,
    }


def test_name_without_extension_loses_the_fraction(spark):
    name = GOOD.removesuffix(".csv")
    assert parse(spark, [name])[name]["ransac_confidence"] == 0.0


def test_lenient_tokens(spark):
    name = "imw-roma_HV_VH_1_-3_ 4 _lgm_aff_4_1e0_nan_.csv"
    key = parse(spark, [name])[name]
    assert (key["pair_id"], key["scan"], key["pix"], key["ransac_threshold"]) == (1, -3, 4, 1.0)
    assert math.isnan(key["ransac_confidence"])


@pytest.mark.parametrize(
    "name",
    [
        GOOD.replace("pair007", "pairX"),
        GOOD.replace("_aff_", "_hom_"),
        "imw-roma_HV.csv",
        "disk_x.csv",
        "d/" + GOOD,
        GOOD.replace("_1_0.91", "_1d_0.91"),
        GOOD.replace("_1_0.91", "_1_0.91f"),
        GOOD.replace("scan12", "scan1.0"),
        "",
    ],
)
def test_unreadable(spark, name):
    assert parse(spark, [name])[name] is None


def test_infinity(spark):
    name = GOOD.replace("_1_0.91", "_-inf_Infinity")
    key = parse(spark, [name])[name]
    assert key["ransac_threshold"] == -math.inf and key["ransac_confidence"] == math.inf


@pytest.mark.parametrize(
    ("name", "stem"),
    [
        ("a.csv", "a"), ("a.b.csv", "a.b"), ("a..csv", "a."), (".csv", ".csv"), ("..csv", "..csv"),
        ("d.x/a", "d.x/a"), ("d.x/.csv", "d.x/.csv"), ("a.", "a"), ("a", "a"),
    ],
)
def test_strip_extension(spark, name, stem):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(file_ids.strip_extension(F.col("n"))).first()[0] == stem


token = st.text(alphabet="abcdefghijklmnopqrstuvwxyz0123456789-", min_size=1, max_size=8)
keys = st.tuples(
    token, st.sampled_from(["HH", "HV", "VV"]), st.sampled_from(["VV", "VH"]), st.integers(0, 10**6),
    st.integers(-(10**9), 10**9), st.integers(-(10**9), 10**9),
    st.sampled_from(["1", "2", "3"]), st.sampled_from(["0.91", "0.95", "0.99"]),
)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(keys, min_size=20, max_size=40))
def test_parse_inverts_build(spark, rows):
    columns = ["tag", "pol", "ref", "pair", "scan", "pix", "t", "c"]
    df = spark.createDataFrame(rows, columns)
    name = file_ids.build_file_id(
        *[F.col(c) for c in columns[:6]], F.lit("4"), F.col("t"), F.col("c")
    )
    named = df.withColumn("file_name", F.concat(name, F.lit(".csv")))
    for r in parse_keys(named).collect():
        k = r["key"]
        assert (k["desc_wt"], k["source_pol"], k["s1_ref_tag"], k["pair_id"], k["scan"], k["pix"]) == (
            r["tag"], r["pol"], r["ref"], r["pair"], r["scan"], r["pix"]
        )
        assert (k["ransac_threshold"], k["ransac_confidence"]) == (float(r["t"]), float(r["c"]))

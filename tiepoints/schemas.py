"""Explicit schemas of the tables the package reads and writes; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

INT, LONG, FLOAT, DOUBLE = T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType()
STRING, BOOLEAN = T.StringType(), T.BooleanType()
FLOATS, DOUBLES = T.ArrayType(FLOAT), T.ArrayType(DOUBLE)
POINTS = T.ArrayType(FLOATS)

# Field names are those of the exchanged tables and of the match-file key.


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


GEO = _struct(
    x01=DOUBLE, y01=DOUBLE, xres1=DOUBLE, yres1=DOUBLE,
    x02=DOUBLE, y02=DOUBLE, xres2=DOUBLE, yres2=DOUBLE,
    crop_col_offset=INT, crop_row_offset=INT,
)

# ``wx`` is a row and ``wy`` a column of the full image.
CHIP_PAIR = _struct(
    pair_id=INT, window_size=INT, source_pol=STRING, s1_ref_tag=STRING,
    wx=INT, wy=INT, s1_wx=INT, s1_wy=INT, w1=INT, h1=INT, w2=INT, h2=INT,
    nodata1=FLOAT, nodata2=FLOAT, px1=FLOATS, px2=FLOATS, geo=GEO,
)
CHIP_PIXEL = _struct(chip_id=LONG, iy=INT, ix=INT, v=DOUBLE)
PREDICTION = _struct(
    pair_id=INT, wx=INT, wy=INT, tag=STRING, mm0=POINTS, mm1=POINTS, raw0=POINTS, raw1=POINTS, error=STRING
)
CORRESPONDENCE = _struct(
    pair_id=INT, chip=INT, detector=STRING, kp_idx=INT, x1=FLOAT, y1=FLOAT, x2=FLOAT, y2=FLOAT
)
# Map coordinates carry a prefix: column names that differ only in case are one name to Spark.
RECORD_LISTS = (
    "x1", "y1", "x2", "y2", "map_x1", "map_y1", "map_x2", "map_y2", "distance", "along", "across",
)
MATCH_RECORD = _struct(
    file_id=STRING, pair_id=INT, global_scan=INT, global_pix=INT, local_init_x=INT, local_init_y=INT,
    matcher=STRING, match_param=STRING, **dict.fromkeys(RECORD_LISTS, DOUBLES),
)
MATCH_ROW = _struct(**dict.fromkeys(RECORD_LISTS, DOUBLE))
FILE_KEY = _struct(
    disk_mode=STRING, det_wt=STRING, desc_wt=STRING, detector=STRING, source_pol=STRING, s1_ref_tag=STRING,
    pair_id=LONG, scan=LONG, pix=LONG, match_method=STRING, match_parameter=STRING, ransac_method=STRING,
    ransac_threshold=DOUBLE, ransac_confidence=DOUBLE,
)
SPARSE_SPEC = _struct(ordinal=INT, tag=STRING, extractor=STRING, matcher=STRING)
DENSE_SPEC = _struct(ordinal=INT, tag=STRING, matcher=STRING)
CONF_TABLE = _struct(kind=STRING, name=STRING, conf=STRING)
MANIFEST = _struct(window_size=INT, done=BOOLEAN)
RUN_LOG = _struct(ordinal=LONG, tag=STRING, dense=BOOLEAN, exit_code=INT, start_us=LONG, end_us=LONG)
DESCRIPTOR = _struct(block=LONG, side=INT, id=LONG, d=FLOATS)
GCP = _struct(gcp_id=LONG, X=DOUBLE, Y=DOUBLE)
REFERENCE_IMAGE = _struct(pair_id=INT, ref_pol=STRING, ref_path=STRING)

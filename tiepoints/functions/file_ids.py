"""The underscore-delimited key of a match file: building and decoding it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tiepoints import schemas

# The tokens of the file-name format.
DETECTOR_PREFIX = "imw-"
REFERENCE_PREFIX = "toS1"
PAIR_PREFIX = "pair"
SCAN_PREFIX = "scan"
PIX_PREFIX = "pix"
MATCHER_TOKEN = "lgm"
MODEL_TOKEN = "aff"
EXTENSION = ".csv"

_LAST_EXTENSION = r"\.[^./]*\z"
_ONLY_DOTS_BEFORE = r"(^|/)\.+[^./]*\z"
_DECIMAL = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_NAN = r"^\s*[+-]?nan\s*$"
_INFINITY = r"^\s*[+-]?inf(inity)?\s*$"


def detector_name(tag: Column) -> Column:
    """Detector name and file-name prefix of a catalog tag."""
    return F.concat(F.lit(DETECTOR_PREFIX), tag)


def build_file_id(
    tag: Column,
    pol: Column,
    ref_tag: Column,
    pair_id: Column,
    scan: Column,
    pix: Column,
    method: Column,
    threshold: Column,
    confidence: Column,
) -> Column:
    """The file id, ending in ``_`` before the extension.

    Method, threshold and confidence are strings, so that ``1`` stays ``1``.
    """
    return F.concat_ws(
        "_",
        detector_name(tag),
        pol,
        F.concat(F.lit(REFERENCE_PREFIX), ref_tag),
        F.concat(F.lit(PAIR_PREFIX), pair_id.cast("string")),
        F.concat(F.lit(SCAN_PREFIX), scan.cast("string")),
        F.concat(F.lit(PIX_PREFIX), pix.cast("string")),
        F.lit(MATCHER_TOKEN),
        F.lit(MODEL_TOKEN),
        method,
        threshold,
        confidence,
        F.lit(""),
    )


def strip_extension(name: Column) -> Column:
    """Drop the last extension, unless only dots precede it in the last path component."""
    return F.when(name.rlike(_ONLY_DOTS_BEFORE), name).otherwise(
        F.regexp_replace(name, _LAST_EXTENSION, "")
    )


def _to_double(token: Column) -> Column:
    lowered = F.lower(token)
    return (
        F.when(token.rlike(_DECIMAL), F.trim(token).try_cast("double"))
        .when(lowered.rlike(_NAN), F.lit(float("nan")))
        .when(lowered.rlike(_INFINITY) & F.trim(token).startswith("-"), F.lit(float("-inf")))
        .when(lowered.rlike(_INFINITY), F.lit(float("inf")))
    )


def tokens(name: Column) -> Column:
    """The parts of a file basename without its extension."""
    return F.split(strip_extension(name), "_")


def numbers(parts: Column) -> Column:
    """The five numeric fields; NULL where a token is missing or unreadable.

    Prefixes are removed wherever they occur and are not required.
    """

    def whole(i: int, prefix: str) -> Column:
        return F.replace(F.get(parts, F.lit(i)), F.lit(prefix), F.lit("")).try_cast("bigint")

    return F.struct(
        whole(3, PAIR_PREFIX).alias("pair_id"),
        whole(4, SCAN_PREFIX).alias("scan"),
        whole(5, PIX_PREFIX).alias("pix"),
        _to_double(F.get(parts, F.lit(9))).alias("ransac_threshold"),
        _to_double(F.get(parts, F.lit(10))).alias("ransac_confidence"),
    )


def key(parts: Column, values: Column) -> Column:
    """The 14-field key from ``tokens`` and ``numbers``; NULL when the name is not of this format.

    Tokens past the eleventh are ignored.
    """

    def token(i: int) -> Column:
        return F.get(parts, F.lit(i))

    absent = F.lit(None).cast("string")
    numeric = ("pair_id", "scan", "pix", "ransac_threshold", "ransac_confidence")
    fields = {
        "disk_mode": absent,
        "det_wt": absent,
        "desc_wt": F.substring(token(0), len(DETECTOR_PREFIX) + 1, 1 << 30),
        "detector": token(0),
        "source_pol": token(1),
        "s1_ref_tag": F.replace(token(2), F.lit(REFERENCE_PREFIX), F.lit("")),
        "match_method": token(6),
        "match_parameter": absent,
        "ransac_method": token(8),
        **{c: values[c] for c in numeric},
    }
    readable = token(0).startswith(DETECTOR_PREFIX) & (token(7) == MODEL_TOKEN)
    for c in numeric:
        readable = readable & values[c].isNotNull()
    return F.when(
        readable, F.struct(*[fields[f.name].alias(f.name) for f in schemas.FILE_KEY.fields])
    )

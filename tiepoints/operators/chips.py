"""Preparing image windows: normalising, gating, inpainting, quantising, resampling.

Pixels are worked on as numpy arrays over Arrow buffers, in one map-only stage; what leaves it are packed
bytes (masks and 8-bit images), and pixel arrays only where they are asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiepoints.functions import pixels
from tiepoints.operators.joins import join_per_key

# Fixed value: default decimation of the reference image.
S1_DECIMATION = 10
#: Pixels of output after which a stage hands over a batch.
BATCH_PIXELS = 4 << 20

DOUBLES = T.ArrayType(T.DoubleType())
_ARROW = {"boolean": pa.bool_(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}


class _Lists:
    """Rows of an Arrow column of number lists as numpy views."""

    def __init__(self, column: pa.Array):
        self.column, values = column, column.values
        self.offsets = column.offsets.to_numpy()
        self.values = values.to_numpy(zero_copy_only=False)
        self.null = values.is_null().to_numpy(zero_copy_only=False) if values.null_count else None

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray] | None:
        if not self.column[i].is_valid:
            return None
        at = slice(self.offsets[i], self.offsets[i + 1])
        values = self.values[at]
        return values, np.zeros(len(values), bool) if self.null is None else self.null[at]


def _as_arrow(rows: list, kind: T.DataType | str) -> pa.Array:
    if not isinstance(kind, T.ArrayType):
        return pa.array(rows, _ARROW[kind])
    lengths = [0 if r is None else len(r[0]) for r in rows]
    values = np.concatenate([np.zeros(0), *[r[0] for r in rows if r is not None]])
    null = np.concatenate([np.zeros(0, bool), *[r[1] for r in rows if r is not None]])
    offsets = pa.array(np.cumsum([0, *lengths]), pa.int32(), mask=np.array([*[r is None for r in rows], False]))
    return pa.ListArray.from_arrays(offsets, pa.array(values, mask=null))


def _pixel_stage(
    rows: DataFrame, lists: Sequence[str], scalars: Sequence[str], added: dict[str, T.DataType | str], body: Callable[..., tuple]
) -> DataFrame:
    """Add columns computed from the pixels of a row; the pixel columns ``lists`` do not come back.

    ``body`` gets a row's pixels (values and which are NULL; None for a NULL array), then its ``scalars``.
    """
    kept = [c for c in rows.columns if c not in lists and c not in added]
    cast = rows.select(*kept, *[F.col(c).cast("array<float>") for c in lists], *[F.col(c).alias(f"_{i}") for i, c in enumerate(scalars)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pixel_columns = [_Lists(batch.column(c)) for c in lists]
            plain = [batch.column(f"_{i}").to_pylist() for i in range(len(scalars))]
            start, held, out = 0, 0, []
            for i in range(batch.num_rows):
                row = [p[i] for p in pixel_columns]
                held += sum(len(p[0]) for p in row if p is not None)
                out.append(body(*row, *[p[i] for p in plain]))
                if held >= BATCH_PIXELS or i + 1 == batch.num_rows:
                    part = batch.slice(start, len(out))
                    columns = [part.column(c) for c in kept]
                    columns += [_as_arrow(list(made), kind) for made, kind in zip(zip(*out), added.values())]
                    yield pa.RecordBatch.from_arrays(columns, [*kept, *added])
                    start, held, out = i + 1, 0, []

    kinds = [T.StructField(name, kind if isinstance(kind, T.DataType) else T._parse_datatype_string(kind)) for name, kind in added.items()]
    return cast.mapInArrow(run, T.StructType([*[rows.schema[c] for c in kept], *kinds]))


def normalize_chips(chips: DataFrame, fill: str | None = None) -> DataFrame:
    """Replace ``px`` by ``mask`` (a byte per pixel) and the normalised ``img``.

    With ``fill`` (see ``prepare_pairs``) also ``filled``, the image without nodata. A NULL chip gives NULL.
    """

    def body(px, nodata, width) -> tuple:
        if px is None:
            return (None, None, None)
        values, null = px
        mask = pixels.valid_mask(values, null, nodata)
        img = pixels.normalize(values, mask)
        solid = np.zeros(len(img), bool)
        filled = (pixels.fill(img, mask, width, fill), solid) if fill else None
        return mask.tobytes(), (img, solid), filled

    out = _pixel_stage(chips, ["px"], ["nodata", "w"], {"mask": "binary", "img": DOUBLES, "filled": DOUBLES}, body)
    return out if fill else out.drop("filled")


def _gate(px, nodata, width, height) -> tuple[bool, bool, bool, float | None, np.ndarray | None, np.ndarray | None]:
    """Whether a chip is sound, zero, NaN; its valid fraction, mask and normalised image."""
    if px is None or not width or not height or width < 0 or height < 0 or len(px[0]) != width * height:
        return False, False, False, None, None, None
    mask = pixels.valid_mask(*px, nodata)
    img = pixels.normalize(px[0], mask)
    nan = bool(np.isnan(img).any())
    return True, not nan and float(img.max()) == 0.0, nan, float(mask.mean()), mask, img


def gate_pairs(pairs: DataFrame, min_valid_fraction: float, fill: str | None = None) -> DataFrame:
    """Name the first gate that rejects a pair in ``reject_reason``; NULL for accepted pairs.

    Order: failed matcher (a ``load_failed`` column, if there is one), pixels that are NULL, empty or
    not as many as the size says, all zero, NaN, valid fraction strictly below the minimum. ``valid1`` and
    ``valid2`` are the valid fractions, ``mask1`` and ``mask2`` a byte per pixel, both NULL for malformed chips.
    """

    def body(px1, px2, nodata1, nodata2, w1, h1, w2, h2, latched) -> tuple:
        sides = [_gate(px1, nodata1, w1, h1), _gate(px2, nodata2, w2, h2)]
        sound, zero, nan, valid, masks, images = zip(*sides)
        reason = None
        if latched:
            reason = "load_failed"
        elif not all(sound):
            reason = "bad_shape"
        elif any(zero):
            reason = "all_zero"
        elif any(nan):
            reason = "nan"
        elif min(valid) < min_valid_fraction:
            reason = "low_valid"
        packed = [None if m is None else m.tobytes() for m in masks]
        ready = [None, None]
        if fill and reason is None:
            ready = [pixels.quantize_u8(pixels.fill(i, m, w, fill)).tobytes() for i, m, w in zip(images, masks, (w1, w2))]
        return (*valid, *packed, *ready, reason)

    if fill is not None and fill not in pixels.FILLS:
        raise ValueError(f"unknown fill {fill!r}")
    latch = "load_failed" in pairs.columns
    rows = pairs if latch else pairs.withColumn("load_failed", F.lit(False))
    scalars = ["nodata1", "nodata2", "w1", "h1", "w2", "h2", "load_failed"]
    added = {"valid1": "double", "valid2": "double", **dict.fromkeys(("mask1", "mask2", "u1", "u2"), "binary"), "reject_reason": "string"}
    out = _pixel_stage(rows, ["px1", "px2"], scalars, added, body)
    return out.drop(*([] if latch else ["load_failed"]), *([] if fill else ["u1", "u2"]))


def prepare_pairs(pairs: DataFrame, min_valid_fraction: float, fill: str = "row") -> DataFrame:
    """Gate pairs, and inpaint and quantise the accepted ones to ``u1`` and ``u2``, a byte per pixel.

    All of it is one stage. Nodata is filled from its ``row`` (left, else right) or from the ``nearest``
    valid pixel in both dimensions.
    """
    return gate_pairs(pairs, min_valid_fraction, fill)


def flag_failed(pairs: DataFrame, failed: DataFrame) -> DataFrame:
    """Mark the windows of matchers whose model once failed to load (``failed(tag)``)."""
    known = failed.select("tag").distinct().withColumn("load_failed", F.lit(True))
    return join_per_key(pairs, known, ["tag"], "left").withColumn(
        "load_failed", F.coalesce("load_failed", F.lit(False))
    )


def resample_chips(chips: DataFrame, k: int = S1_DECIMATION) -> DataFrame:
    """Replace the pixels of every chip by the means of its k x k blocks, and its ``w`` and ``h``.

    NULL pixels do not count; a block of them is NULL. A chip that does not fit its size gives NULL.
    """

    def body(px, width, height) -> tuple:
        if px is None or not width or not height or len(px[0]) != width * height:
            return (None,)
        return (pixels.block_mean(*px, width, height, k),)

    out = _pixel_stage(chips, ["px"], ["w", "h"], {"_means": DOUBLES}, body).withColumnRenamed("_means", "px")
    return out.withColumns({"w": F.ceil(F.col("w") / k).cast("int"), "h": F.ceil(F.col("h") / k).cast("int")})


def explode_pixels(chips: DataFrame, value: str, key: str, width: str = "w") -> DataFrame:
    """One row per pixel: ``key, iy, ix, v``."""
    return chips.select(key, width, F.posexplode(value).alias("_pos", "v")).select(
        key,
        F.floor(F.col("_pos") / F.col(width)).cast("int").alias("iy"),
        (F.col("_pos") % F.col(width)).cast("int").alias("ix"),
        "v",
    )

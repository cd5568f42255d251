"""Pluggable image matchers over prepared chip pairs.

A matcher is any callable ``(image1, image2) -> prediction`` on H x W x 3 uint8 images; the
prediction is a mapping with any of ``mm0, mm1`` (filtered) and ``raw0, raw1`` (raw) as N x 2
arrays. Models live outside this package; a small phase-correlation matcher is included.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import batched
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiepoints.session import settle

Matcher = Callable[[np.ndarray, np.ndarray], Mapping[str, Any]]
POINT_SETS = ("mm0", "mm1", "raw0", "raw1")
#: Points of output, a window counting as one more, after which a pass hands over a batch.
BATCH_POINTS = 1 << 18


@dataclass(frozen=True)
class MatcherSpec:
    """One catalog row: a tag and how to load its matcher, which happens once per worker and pass."""

    tag: str
    load: Callable[..., Matcher]
    options: Mapping[str, Any] = field(default_factory=dict)


# By run and number: workers are reused, and another run may have other options or weights under the same tag.
_loaded: dict[tuple[str, int], Matcher | Exception] = {}


def _matcher(spec: MatcherSpec, run: str, number: int) -> Matcher | Exception:
    """The worker's matcher of this run; a failed load is remembered and not tried again.

    Matchers of other runs are let go, so that a worker never holds more than one pass of a catalog.
    """
    for other in [key for key in _loaded if key[0] != run]:
        del _loaded[other]
    if (run, number) not in _loaded:
        try:
            _loaded[run, number] = spec.load(**spec.options)
        except Exception as error:  # any failure of a foreign model drops its windows only
            _loaded[run, number] = error
    return _loaded[run, number]


def _rgb(pixels: pa.Scalar, height: pa.Scalar, width: pa.Scalar) -> np.ndarray:
    gray = np.frombuffer(pixels.as_buffer(), np.uint8)
    return np.repeat(gray.reshape(height.as_py(), width.as_py())[:, :, None], 3, axis=2)


def _points(found: Any) -> np.ndarray:
    """The first two columns of an N x 2 (or wider) array; an empty prediction has no points."""
    points = np.asarray(found, dtype=np.float32)
    if points.size == 0:
        return np.zeros((0, 2), np.float32)
    if points.ndim != 2 or points.shape[1] < 2:
        raise ValueError(f"points of shape {points.shape}")
    return points[:, :2].copy()  # not a view, which would keep what the matcher made


def _as_lists(rows: Sequence[np.ndarray | None]) -> pa.Array:
    """Point sets as an Arrow column, without a Python object per point."""
    ends = np.cumsum([0, *[0 if r is None else len(r) for r in rows]])
    values = np.concatenate([np.zeros((0, 2), np.float32), *[r for r in rows if r is not None]])
    pairs = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, 2), pa.int32()), pa.array(values.ravel()))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.array([*[r is None for r in rows], False])), pairs)


def _predict(spec: MatcherSpec, run: str, number: int, chip1: tuple, chip2: tuple) -> dict[str, Any]:
    model = _matcher(spec, run, number)
    if isinstance(model, Exception):
        return {"error": f"load failed: {type(model).__name__}: {model}"}
    try:
        prediction = model(_rgb(*chip1), _rgb(*chip2))
        return {name: _points(prediction[name]) for name in POINT_SETS if prediction.get(name) is not None}
    except Exception as error:
        return {"error": f"{type(error).__name__}: {error}"}


def _matched(
    stream: Iterator[pa.RecordBatch], specs: Sequence[MatcherSpec], keep: Sequence[str], run: str
) -> Iterator[pa.RecordBatch]:
    """Point sets of every window by every matcher, in batches of about ``BATCH_POINTS`` points."""
    for batch in stream:
        u1, h1, w1, u2, h2, w2 = (batch.column(c) for c in ("u1", "h1", "w1", "u2", "h2", "w2"))
        for number, spec in enumerate(specs):
            start, held, found = 0, 0, []
            for i in range(batch.num_rows):
                chips = (u1[i], h1[i], w1[i]), (u2[i], h2[i], w2[i])
                found.append(_predict(spec, run, number, *chips) if u1[i].is_valid and u2[i].is_valid else {})
                held += 1 + sum(len(found[-1][n]) for n in POINT_SETS if n in found[-1])
                if held >= BATCH_POINTS or i + 1 == batch.num_rows:
                    part = batch.slice(start, len(found))
                    columns = [part.column(c) for c in keep]
                    columns.append(pa.array([spec.tag] * len(found), pa.string()))
                    columns += [_as_lists([f.get(n) for f in found]) for n in POINT_SETS]
                    columns.append(pa.array([f.get("error") for f in found], pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, [*keep, "tag", *POINT_SETS, "error"])
                    start, held, found = i + 1, 0, []


def run_matcher(prepared: DataFrame, spec: MatcherSpec, keep: Sequence[str]) -> DataFrame:
    """Run one matcher over every accepted pair: ``keep, tag``, the point sets, ``error``.

    With ``reject_reason`` among the ``keep`` columns, rejected pairs pass through without points.
    Map-only: pixels stay where they were read, and the ``keep`` columns (window key, geometry,
    masks) pass through Python as Arrow buffers, so nothing has to be joined back. A window
    whose matcher raises, or whose pixels do not fit its size, keeps a row with the reason in ``error``.
    Points stay numpy arrays and leave in batches of about ``BATCH_POINTS``, whatever Spark's batches hold.
    """
    return _one_pass(prepared, [spec], keep)


def _one_pass(prepared: DataFrame, specs: Sequence[MatcherSpec], keep: Sequence[str]) -> DataFrame:
    inputs = ["w1", "h1", "u1", "w2", "h2", "u2"]
    rows = prepared if "reject_reason" in keep else prepared.where(F.col("reject_reason").isNull())
    narrow = rows.select(*keep, *[c for c in inputs if c not in keep])
    run = uuid.uuid4().hex

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _matched(stream, specs, keep, run)

    points = T.ArrayType(T.ArrayType(T.FloatType()))
    schema = T.StructType(
        [
            *[narrow.schema[c] for c in keep],
            T.StructField("tag", T.StringType()),
            *[T.StructField(name, points) for name in POINT_SETS],
            T.StructField("error", T.StringType()),
        ]
    )
    return narrow.mapInArrow(batches, schema)


def run_catalog(
    prepared: DataFrame, specs: Sequence[MatcherSpec], keep: Sequence[str], per_pass: int = 4
) -> DataFrame:
    """Every matcher of a catalog over every pair, ``per_pass`` matchers in one map-only pass.

    A pass reads and prepares a pair once and holds its matchers in memory together. If there are
    several passes, the prepared pairs are written once and read by each.
    """
    if len(specs) > per_pass:
        prepared = settle(prepared, "prepared")
    passes = [_one_pass(prepared, specs[i : i + per_pass], keep) for i in range(0, len(specs), per_pass)]
    return reduce(DataFrame.unionByName, passes)


def catalog_specs(cat: DataFrame, load: Callable[..., Matcher]) -> Iterator[MatcherSpec]:
    """The rows of a catalog table (``catalog.catalog``) as matchers, in catalog order.

    ``load(conf)`` makes the matcher of a row from its conf; it runs on the workers only. Rows are read one
    by one, so the driver holds no more of a catalog than its caller keeps.
    """
    rows = cat.select("dense", "ordinal", "tag", F.to_json("conf").alias("conf")).orderBy("dense", "ordinal")
    for row in rows.toLocalIterator():
        yield MatcherSpec(row["tag"], load, {"conf": json.loads(row["conf"])})


def run_catalog_table(
    prepared: DataFrame, specs: Iterable[MatcherSpec], keep: Sequence[str], path: str, finish: Callable[[DataFrame], DataFrame], per_pass: int = 4
) -> DataFrame:
    """Every matcher over every pair of a written table, in passes whose results are kept below ``path``.

    Each pass is a job of its own, so the plan does not grow with the catalog, and what a pass has written is
    there whatever happens to a later one. ``finish`` turns its windows into what is kept.
    """
    number = None
    for number, chunk in enumerate(batched(specs, per_pass)):
        finished = finish(_one_pass(prepared, chunk, keep))
        finished.write.parquet(f"{path}/pass={number}")
    if number is None:
        return finish(_one_pass(prepared, [], keep))
    return prepared.sparkSession.read.schema(finished.schema).parquet(path).select(finished.columns)


def phase_correlation(step: int = 64) -> Matcher:
    """Matcher for a translation: the peak of the phase correlation, as a grid of point pairs."""
    grids: dict[tuple[int, int], np.ndarray] = {}

    def match(image1: np.ndarray, image2: np.ndarray) -> dict[str, np.ndarray]:
        one, two = (i[:, :, 0].astype(np.float64) for i in (image1, image2))
        cross = np.fft.fft2(two) * np.conj(np.fft.fft2(one))
        surface = np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)).real
        dy, dx = np.unravel_index(np.argmax(np.round(surface, 9)), surface.shape)
        height, width = one.shape
        dy, dx = (int(d) - n if d > n // 2 else int(d) for d, n in ((dy, height), (dx, width)))
        if one.shape not in grids:
            ys, xs = np.mgrid[0:height:step, 0:width:step]
            grids.clear()  # the last size only
            grids[one.shape] = np.column_stack([xs.ravel(), ys.ravel()])
        start = grids[one.shape].copy()
        end = start + (dx, dy)
        inside = ((end >= 0) & (end < (width, height))).all(axis=1)
        return {"mm0": start[inside], "mm1": end[inside], "raw0": start, "raw1": end}

    return match

"""Robust affine fits per group of correspondences.

The hypotheses are this package's own, deterministic choice. Points have a hash on a ring, and each of the
three slots of every hypothesis has a target on it; of all points of the group the slot takes the first one
from its target on, whose way (hash - target) mod ring is shortest. So any point can fill any slot, and
equally likely. As targets cut the ring into equal arcs, the first point of every arc is all that is needed:
one aggregation with map-side combine, whatever the size of the group and however many copies of a point it
holds. Scoring is linear in points. Many groups of bounded size are fitted whole, by the same rules in numpy.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiepoints.functions.geometry import affine_from_sums, affine_residual, moments
from tiepoints.functions.rasters import let
from tiepoints.operators.joins import join_settled
from tiepoints.session import once, settle

# The default fitting grid. The method code is an opaque label.
METHODS = ("4",)
THRESHOLDS = (1.0, 2.0, 3.0)
CONFIDENCES = (0.91, 0.95, 0.99)

RING = 1 << 62
RESIDUAL_STEPS = 64
FINE_PIXELS = 64  # steps of equal width up to here, then as many per doubling
DOUBLINGS = 20

#: Points up to which a group may be fitted whole, and residuals that are held at a time for that.
GROUP_POINTS = 1 << 16
HELD_RESIDUALS = 1 << 16

_PRIME = 2147483647
_FACTORS = ((73856093, 19349663, 83492791, 39916801), (32452843, 49979687, 15485863, 67867967))
_MIXERS = (48271, 16807)
_STRIDES = (7919, 104729, 1299709)  # primes, so that they visit all arcs of a third of the ring
_COORDS = ("x1", "y1", "x2", "y2")


def hypothesis_count(confidence: float) -> int:
    """Three-point samples needed to hit an all-inlier one, at inlier rate one half."""
    return math.ceil(math.log(1 - confidence) / math.log(1 - 0.5**3))


def point_hash(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A 62-bit hash of a correspondence at 1/1024 pixel; plain bigint arithmetic."""
    prime = F.lit(_PRIME).cast("bigint")
    steps = [F.pmod(F.floor(v * 1024.0).cast("bigint"), prime) for v in (x1, y1, x2, y2)]
    halves = []
    for factors, mixer in zip(_FACTORS, _MIXERS):
        mixed = F.pmod(reduce(add, [s * f % prime for s, f in zip(steps, factors)]), prime)
        halves.append((mixed * mixed + mixed * mixer) % prime)
    return halves[0] * F.lit(1 << 31).cast("bigint") + halves[1]


def _solve(p: Column, q: Column, r: Column) -> Column:
    """Affine model through three correspondences, NULL if they are collinear."""

    def edges(e: Column) -> Column:
        det = e["ux"] * e["vy"] - e["vx"] * e["uy"]

        def row(target: str) -> tuple[Column, Column, Column]:
            u, v = q[target] - p[target], r[target] - p[target]
            first = (u * e["vy"] - v * e["uy"]) / F.nullif(det, F.lit(0.0))
            second = (v * e["ux"] - u * e["vx"]) / F.nullif(det, F.lit(0.0))
            return first, second, p[target] - first * p["x1"] - second * p["y1"]

        a, b, c = row("x2")
        d, e_, f = row("y2")
        return F.when(
            det != 0.0,
            F.struct(
                a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"), e_.alias("e"), f.alias("f")
            ),
        )

    return let(
        F.struct(
            (q["x1"] - p["x1"]).alias("ux"), (q["y1"] - p["y1"]).alias("uy"),
            (r["x1"] - p["x1"]).alias("vx"), (r["y1"] - p["y1"]).alias("vy"),
        ),
        edges,
    )


def arc_of(h: Column, slot: int, count: int) -> Column:
    """Arc whose beginning is the target of a hypothesis' slot: every slot has an arc of its own."""
    return (h * _STRIDES[slot] % count + slot * count).cast("int")


def affine_hypotheses(points: DataFrame, keys: Sequence[str], count: int) -> DataFrame:
    """Candidate models per group: ``keys, models ARRAY<STRUCT<h, model>>``.

    A hypothesis whose slots hold one point twice, or three points on a line, has no model. If none has one, as may
    be with three distinct points, the arcs' first points are taken by threes in their order on the ring instead.
    """
    arcs = 3 * count
    hashed = points.select(*keys, *_COORDS, point_hash(*(F.col(c) for c in _COORDS)).alias("_h"))
    arc = F.least(F.expr(f"_h div {RING // arcs}L"), F.lit(arcs - 1).cast("bigint")).cast("int")
    # One fixed-width buffer per column, so that this is a hash aggregation.
    firsts = hashed.groupBy(*keys, arc.alias("_arc")).agg(*[F.min_by(c, "_h").alias(c) for c in _COORDS])
    sample = (
        firsts.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_arc", *_COORDS))).alias("_sample"))
        .where(F.size("_sample") >= 3)
    )
    # Position in the sample for every arc: an empty arc goes to the next one that holds a point, the last ones
    # to the beginning of the ring.
    before = lambda i: F.when(i > 0, F.get("_sample", i - 1)["_arc"]).otherwise(-1)
    reached = F.flatten(F.transform("_sample", lambda s, i: F.array_repeat(i, s["_arc"] - before(i))))
    sample = once(sample, _reached=reached)

    def pick(h: Column, slot: int) -> Column:
        return F.get("_sample", F.coalesce(F.get("_reached", arc_of(h, slot, count)), F.lit(0)))

    def solved(last: Column, point: Callable[[Column, int], Column]) -> Column:
        made = F.transform(
            F.sequence(F.lit(0).cast("bigint"), last.cast("bigint")),
            lambda h: F.struct(h.cast("int").alias("h"), _solve(*(point(h, slot) for slot in range(3))).alias("model")),
        )
        return F.filter(made, lambda m: m["model"].isNotNull())

    sample = once(sample, models=solved(F.lit(count - 1), pick))
    in_turn = solved(F.least(F.size("_sample") - 3, F.lit(count - 1)), lambda h, slot: F.get("_sample", (h + slot).cast("int")))
    models = F.when(F.size("models") > 0, F.col("models")).otherwise(in_turn)
    return sample.select(*keys, models.alias("models"))


def fit_affine(
    points: DataFrame,
    keys: Sequence[str],
    methods: Sequence[str] = METHODS,
    thresholds: Sequence[float] = THRESHOLDS,
    confidences: Sequence[float] = CONFIDENCES,
    score: str = "inliers",
    carry: Mapping[str, Callable[[Column], Column]] | None = None,
    whole: int = 0,
) -> DataFrame:
    """Best affine model of every group for every method, threshold and confidence.

    All fits of the grid share one pass: the highest confidence says how many hypotheses there are, a lower one
    only limits which of them count, and
    inliers are summed for all thresholds together. ``score='inliers'`` takes the model with
    most inliers, ``'median'`` the one with the lowest median residual (in the steps of
    ``residual_step``); ties go to the lower hypothesis. Output: ``keys, ransac_method,
    ransac_threshold, ransac_confidence, h, n, inliers, model``, and a column for each ``carry``.

    ``carry`` maps a name to an aggregate over the inliers, given as a function of the condition that a point
    is one (the residual is column ``r``). They are summed up in the scoring pass, so that means and errors
    of the winning models need no second pass over the points.

    Groups of up to ``whole`` points are fitted each in one task (see ``_fit_whole``); their coordinates must not be NULL, and
    what they ``carry`` must be of kind ``Carry``. It pays where there are many groups and rows of a group lie together.
    """
    if score not in ("inliers", "median"):
        raise ValueError(f"unknown score {score!r}")
    if whole and (score != "inliers" or not all(isinstance(of, Carry) for of in (carry or {}).values())):
        raise ValueError("whole groups go with score='inliers' and known kinds of carry")
    keys = list(keys)
    if whole:
        return _fit_apart(points, keys, methods, thresholds, confidences, dict(carry or {}), whole)
    counts = {c: hypothesis_count(c) for c in confidences}
    most = max(counts.values())
    models = settle(affine_hypotheses(points, keys, most), "models")
    carry = dict(carry or {})
    sums = [F.count_if(F.col("r") <= t).alias(f"_in{i}") for i, t in enumerate(thresholds)]
    sums += [of(F.col("r") <= t).alias(f"_{name}{i}") for name, of in carry.items() for i, t in enumerate(thresholds)]
    if score == "inliers":
        scored = _residuals(points, models, keys).groupBy(*keys, "h").agg(F.count("*").alias("n"), *sums).withColumn(
            "_median", F.lit(0)
        )
    elif carry:
        raise ValueError("carry goes with score='inliers'")
    else:
        scored = _median_scores(points, models, keys, sums, sorted(set(counts.values())))
    grid = F.array(
        *[
            F.struct(
                F.lit(m).alias("ransac_method"), F.lit(float(t)).alias("ransac_threshold"),
                F.lit(float(c)).alias("ransac_confidence"), F.lit(counts[c]).alias("_count"),
                F.col(f"_in{i}").alias("inliers"), *[F.col(f"_{name}{i}").alias(name) for name in carry],
            )
            for m in methods for i, t in enumerate(thresholds) for c in confidences
        ]
    )
    fit_keys = ["ransac_method", "ransac_threshold", "ransac_confidence"]
    winners = (
        scored.select(*keys, "h", "n", "_median", F.inline(grid))
        .where(F.col("h") < F.col("_count"))
        .groupBy(*keys, *fit_keys)
        .agg(
            F.max(
                F.struct(
                    (-F.col("_median")).alias("score"),
                    (F.col("inliers") if score == "inliers" else F.lit(0).cast("bigint")).alias("hits"),
                    (-F.col("h")).alias("order"), "h", "n", "inliers", *carry,
                )
            ).alias("_best")
        )
        .select(*keys, *fit_keys, *[F.col("_best")[c].alias(c) for c in ("h", "n", "inliers", *carry)])
    )
    chosen = F.filter("models", lambda m: m["h"] == F.col("h"))[0]["model"]
    return winners.join(models, keys).withColumn("model", chosen).drop("models")


def inlier_sum(value: Column) -> Callable[[Column], Column]:
    """For ``carry``: the sum of ``value`` over the inliers."""
    return lambda near: F.sum(F.when(near, value))


@dataclass(frozen=True)
class Carry:
    """For ``carry``: ``sum``, ``min`` or ``max`` of a column over the inliers, or the sum of their squared residuals (``squares``)."""

    how: str
    column: str = "r"

    def __call__(self, near: Column) -> Column:
        value = F.col(self.column)
        if self.how == "squares":
            return F.sum(F.when(near, value * value))
        return {"sum": F.sum, "min": F.min, "max": F.max}[self.how](F.when(near, value))


def inlier_extent(column: str) -> dict[str, Carry]:
    """For ``carry``: least and greatest value of a column over the inliers, ``<column>_min`` and ``<column>_max``."""
    return {f"{column}_min": Carry("min", column), f"{column}_max": Carry("max", column)}


# --- groups fitted whole ----------------------------------------------------------------------


def _fit_apart(
    points: DataFrame, keys: list[str], methods: Sequence[str], thresholds: Sequence[float], confidences: Sequence[float],
    carry: dict[str, Carry], whole: int,
) -> DataFrame:
    """``fit_affine`` with groups of up to ``whole`` points fitted whole and all others by aggregations.

    Rows of a group that lie together become one row of lists, which is written. A group that is one such row, as
    that of a window is, stays where it is; only what is left of groups in several places is shuffled.
    """
    known = points.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    columns = list(dict.fromkeys([*_COORDS, *[c.column for c in carry.values() if c.how != "squares"]]))
    pieces = settle(_pieces(known, keys, columns, whole), "pieces")
    fit = lambda groups: _fit_whole(groups, keys, columns, methods, thresholds, confidences, carry)
    several = pieces.groupBy(*keys).agg(F.sum("_n").alias("_n"), F.count("*").alias("_pieces"))
    several = settle(several.where((F.col("_n") > whole) | (F.col("_pieces") > 1)).drop("_pieces"), "several")
    if not several.limit(1).count():
        return fit(pieces)
    alone = join_settled(pieces, several.drop("_n"), keys, "left_anti")
    small, large = several.where(F.col("_n") <= whole).drop("_n"), several.where(F.col("_n") > whole).drop("_n")
    met = join_settled(pieces, small, keys, "left_semi").groupBy(*keys).agg(
        F.sum("_n").alias("_n"), F.collect_list(F.struct(*[f"_{c}" for c in columns])).alias("_all")
    )
    met = met.select(*keys, "_n", *[F.flatten(F.col("_all")[f"_{c}"]).alias(f"_{c}") for c in columns])
    found = fit(alone).unionByName(fit(met))
    if not large.limit(1).count():
        return found
    rest = join_settled(known, large, keys, "left_semi")
    return found.unionByName(fit_affine(rest, keys, methods, thresholds, confidences, carry=carry))


def _pieces(points: DataFrame, keys: list[str], columns: list[str], whole: int) -> DataFrame:
    """Rows of one group that follow each other as one row: ``keys, _n`` and a list ``_<column>`` for every column."""
    rows = points.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    lists = [f"_{c}" for c in columns]

    def piece(batch: pa.RecordBatch, starts: np.ndarray, end: int) -> pa.RecordBatch:
        offsets = pa.array(np.append(starts, end), pa.int32())
        held = [pa.ListArray.from_arrays(offsets, batch.column(c)) for c in lists]
        made = [*[batch.column(k).take(pa.array(starts)) for k in keys], pa.array(np.diff(offsets)), *held]
        return pa.RecordBatch.from_arrays(made, [*keys, "_n", *lists])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the last rows so far, to which the next batch may add
        for batch in batches:
            if rest is not None:
                batch = pa.concat_batches([rest, batch])
            if not batch.num_rows:
                continue
            new = np.ones(batch.num_rows, bool)
            new[1:] = False
            for k in keys:
                column = batch.column(k)
                new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            last = int(starts[-1])
            if batch.num_rows - last >= whole:  # long enough to leave at once
                yield piece(batch, starts, batch.num_rows)
                rest = None
                continue
            if last:
                yield piece(batch, starts[:-1], last)
            rest = batch.slice(last)
        if rest is not None:
            yield piece(rest, np.zeros(1, np.int64), rest.num_rows)

    kinds = [T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in lists]
    return rows.mapInArrow(run, T.StructType([*[rows.schema[k] for k in keys], T.StructField("_n", T.IntegerType()), *kinds]))


def _hash(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
    """``point_hash``."""
    steps = [np.floor(v.astype(np.float64) * 1024.0).astype(np.int64) % _PRIME for v in (x1, y1, x2, y2)]
    halves = []
    for factors, mixer in zip(_FACTORS, _MIXERS):
        mixed = reduce(add, [s * f % _PRIME for s, f in zip(steps, factors)]) % _PRIME
        halves.append((mixed * mixed + mixed * mixer) % _PRIME)
    return halves[0] * (1 << 31) + halves[1]


def _models(points: dict[str, np.ndarray], start: np.ndarray, size: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (6, groups, hypotheses) of ``affine_hypotheses``, and which of them there are."""
    arcs, groups = 3 * count, len(size)
    h = _hash(*(points[c] for c in _COORDS))
    arc = np.minimum(h // (RING // arcs), arcs - 1)
    group = np.repeat(np.arange(groups), size)
    order = np.lexsort((h, group))
    # How many points are before every arc of every group: where the first one from its beginning on is.
    before = np.zeros(groups * arcs, np.int64)
    np.cumsum(np.bincount(group * arcs + arc, minlength=groups * arcs)[:-1], out=before[1:])
    slots = np.array([[n * stride % count + slot * count for n in range(count)] for slot, stride in enumerate(_STRIDES)])
    reached = before.reshape(groups, arcs)[:, slots.ravel()].reshape(groups, 3, count)
    reached = order[np.where(reached >= (start + size)[:, None, None], start[:, None, None], reached)]
    models, there = _solved(*({c: points[c][reached[:, slot]] for c in _COORDS} for slot in range(3)))
    for g in np.flatnonzero(~there.any(axis=1) & (size > 2)):
        own = order[start[g] : start[g] + size[g]]
        own = own[np.unique(arc[own], return_index=True)[1]]
        most = min(len(own) - 2, count)
        if most > 0:
            models[:, g, :most], there[g, :most] = _solved(*({c: points[c][own[slot : slot + most]] for c in _COORDS} for slot in range(3)))
    return models, there


def _solved(p: dict[str, np.ndarray], q: dict[str, np.ndarray], r: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``_solve``: six coefficients, and whether there is a model."""
    ux, uy, vx, vy = q["x1"] - p["x1"], q["y1"] - p["y1"], r["x1"] - p["x1"], r["y1"] - p["y1"]
    det = ux * vy - vx * uy
    there = det != 0
    det = np.where(there, det, 1).astype(np.float64)
    rows = []
    for target in ("x2", "y2"):
        u, v = q[target] - p[target], r[target] - p[target]
        first, second = (u * vy - v * uy).astype(np.float64) / det, (v * ux - u * vx).astype(np.float64) / det
        rows += [first, second, p[target].astype(np.float64) - first * p["x1"].astype(np.float64) - second * p["y1"].astype(np.float64)]
    return np.array(rows), there


def _scored(
    points: dict[str, np.ndarray], start: np.ndarray, size: np.ndarray, thresholds: Sequence[float], counts: Sequence[int], carry: dict[str, Carry]
) -> dict[str, np.ndarray]:
    """Winners (groups, thresholds x counts) of groups of about one size: ``there, h, inliers``, ``model`` and what is carried."""
    models, there = _models(points, start, size, max(counts))
    inside = np.arange(size.max()) < size[:, None]
    at = np.where(inside, start[:, None] + np.arange(size.max()), start[:, None])
    xy = {c: np.where(inside, points[c][at].astype(np.float64), np.nan)[:, None] for c in _COORDS}  # what is no point is near to no model
    a, b, c, d, e, f = models[..., None]
    r = None
    for u, v, w, target in ((a, b, c, "x2"), (d, e, f, "y2")):  # in place, which is most of the work
        off = u * xy["x1"]
        off += v * xy["y1"]
        off += w
        off -= xy[target]
        off *= off
        r = off if r is None else np.add(r, off, out=r)
    np.sqrt(r, out=r)
    inliers = np.array([np.where(there, np.count_nonzero(r <= t, axis=2), -1) for t in thresholds])
    best = np.array([inliers[i, :, :n].argmax(axis=1) for i in range(len(thresholds)) for n in counts]).T  # the first of equals
    level = np.repeat(np.arange(len(thresholds)), len(counts))
    group = np.arange(len(size))[:, None]
    out = {"h": best, "inliers": inliers[level, group, best], "model": models[:, group, best]}
    out["there"] = np.tile([there[:, :n].any(axis=1) for n in counts], (len(thresholds), 1)).T
    r = r[group, best]
    near = r <= np.array([thresholds[i] for i in level])[:, None]
    for name, of in carry.items():
        if of.how == "squares":
            out[name] = (np.where(near, r * r, 0.0).sum(axis=2), near.any(axis=2))
            continue
        value = points[of.column][at][:, None]
        counted = near & ~points[f"{of.column} null"][at][:, None] if f"{of.column} null" in points else near
        if of.how == "sum":
            made = np.where(counted, value.astype(np.float64), 0.0).sum(axis=2)
        else:
            empty, pick = (np.inf, np.fmin) if of.how == "min" else (-np.inf, np.fmax)
            made = pick.reduce(np.where(counted, value, value.dtype.type(empty)), axis=2)
        out[name] = (made, counted.any(axis=2))
    return out


def _fit_whole(
    groups: DataFrame, keys: list[str], columns: list[str], methods: Sequence[str], thresholds: Sequence[float],
    confidences: Sequence[float], carry: dict[str, Carry],
) -> DataFrame:
    """Fits of groups that are one row each, by the rules of ``fit_affine``.

    Groups are worked on together with others of about their size, so many that about ``HELD_RESIDUALS`` are held.
    """
    counts = [hypothesis_count(c) for c in confidences]
    thresholds, confidences = [float(t) for t in thresholds], [float(c) for c in confidences]
    kinds = {c: groups.schema[f"_{c}"].dataType.elementType for c in columns}
    result = T.StructType(
        [
            *[groups.schema[k] for k in keys],
            T.StructField("ransac_method", T.StringType()), T.StructField("ransac_threshold", T.DoubleType()),
            T.StructField("ransac_confidence", T.DoubleType()), T.StructField("h", T.IntegerType()),
            T.StructField("n", T.LongType()), T.StructField("inliers", T.LongType()),
            *[T.StructField(name, kinds[of.column] if of.how in ("min", "max") else T.DoubleType()) for name, of in carry.items()],
            T.StructField("model", T.StructType([T.StructField(c, T.DoubleType()) for c in "abcdef"])),
        ]
    )

    def batch_fits(batch: pa.RecordBatch, points: dict[str, np.ndarray], start: np.ndarray, size: np.ndarray, which: np.ndarray) -> pa.RecordBatch:
        # The points of these groups only, one group after the other.
        sizes = size[which]
        own = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(start[which] - own[:-1], sizes) + np.arange(own[-1])
        found = _scored({c: v[at] for c, v in points.items()}, own[:-1], sizes, thresholds, counts, carry)
        group, fit = np.nonzero(found["there"])
        level, trust = np.divmod(fit, len(counts))
        many = len(methods)
        rep = lambda v: np.repeat(v, many)
        keyed = [batch.column(k).take(pa.array(rep(which[group]))) for k in keys]
        made = [
            pa.array(list(methods) * len(group), pa.string()), pa.array(rep(np.array(thresholds)[level])), pa.array(rep(np.array(confidences)[trust])),
            pa.array(rep(found["h"][group, fit]), pa.int32()), pa.array(rep(sizes[group]), pa.int64()),
            pa.array(rep(found["inliers"][group, fit]), pa.int64()),
        ]
        for name in carry:
            values, any_ = (rep(v[group, fit]) for v in found[name])
            made.append(pa.array(values, mask=~any_))
        model = [pa.array(rep(v)) for v in found["model"][:, group, fit]]
        made.append(pa.StructArray.from_arrays(model, list("abcdef")))
        return pa.RecordBatch.from_arrays([*keyed, *made], result.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = {}
            for c in columns:
                values = batch.column(f"_{c}").flatten()
                points[c] = values.to_numpy(zero_copy_only=False)
                if c not in _COORDS and values.null_count:
                    points[f"{c} null"] = values.is_null().to_numpy(zero_copy_only=False)
            size = batch.column("_n").to_numpy(zero_copy_only=False).astype(np.int64)
            start = np.cumsum(size) - size
            order = np.argsort(size, kind="stable")
            order = order[size[order] >= 3]  # fewer points have no model
            # With an eighth more at most, since shorter ones are filled up.
            held = size[order] * max(counts)
            at = 0
            while at < len(order):
                most = max(1, HELD_RESIDUALS // int(held[at]))
                to = min(at + most, int(np.searchsorted(held, held[at] + held[at] // 8, "right")), len(order))
                yield batch_fits(batch, points, start, size, order[at:to])
                at = to

    return groups.select(*keys, "_n", *[f"_{c}" for c in columns]).mapInArrow(run, result)


def refit_affine(points: DataFrame, keys: Sequence[str], **grid: Sequence) -> DataFrame:
    """``fit_affine``, with ``refined``: the least-squares map of all inliers of the best model.

    A sample of three points decides which points are inliers; their sums, taken in the scoring pass, give
    the map itself. ``refined`` is the sampled model where the inliers are on one line.
    """
    sums = moments(*(F.col(c) for c in _COORDS))
    fits = fit_affine(points, keys, carry={name: inlier_sum(value) for name, value in sums.items()}, **grid)
    refined = F.coalesce(affine_from_sums(F.col("inliers")), F.col("model"))
    return fits.withColumn("refined", refined).drop(*sums)


def residual_step(r: Column) -> Column:
    """Number of the residual's step: 1/64 pixel up to 64 pixels, then 64 steps per doubling."""
    doublings = reduce(add, [(r >= FINE_PIXELS * 2.0**j).cast("int") for j in range(1, DOUBLINGS + 1)])
    fine = F.floor(r * RESIDUAL_STEPS)
    scaled = F.floor(r / F.pow(F.lit(2.0), doublings) - FINE_PIXELS)
    coarse = FINE_PIXELS * RESIDUAL_STEPS + RESIDUAL_STEPS * doublings + scaled
    return F.when(r < FINE_PIXELS, fine).otherwise(coarse).cast("int")


def _residuals(points: DataFrame, models: DataFrame, keys: Sequence[str], *more: str) -> DataFrame:
    """Every point with every model of its group: ``h``, the residual ``r``, and ``more`` fields of the model's entry."""
    met = join_settled(points, models, keys).select(*points.columns, F.explode("models").alias("m"))
    residual = affine_residual(F.col("m")["model"], *(F.col(c) for c in _COORDS))
    return met.select(*points.columns, *[F.col("m")[c].alias(c) for c in ("h", *more)], residual.alias("r"))


def _median_scores(points: DataFrame, models: DataFrame, keys: list[str], sums: list[Column], counts: list[int]) -> DataFrame:
    """Scores of all hypotheses, with ``_median``: the residual step that holds the median.

    Residuals are counted in bins of ``RESIDUAL_STEPS`` steps, a pixel or a doubling wide. Only a hypothesis
    whose median lies in the least bin of those that count for one of the confidences can win, so steps are
    counted for those only, and only inside that bin. All others keep the first step of their bin, which is
    above any step of a winner. So neither pass holds more than some hundred counts per hypothesis.
    """
    bins = F.shiftright(residual_step(F.col("r")), RESIDUAL_STEPS.bit_length() - 1)
    names = [f"_in{i}" for i in range(len(sums))]
    counted = _residuals(points, models, keys).groupBy(*keys, "h", bins.alias("_at")).agg(F.count("*").alias("_n"), *sums)
    total = F.sum("_n").alias("n")
    gathered = counted.groupBy(*keys, "h").agg(total, *[F.sum(name).alias(name) for name in names], _histogram())
    coarse = once(gathered, _found=_walk(F.lit(0).cast("bigint"))).select(
        *keys, "h", "n", *names, F.col("_found.at").alias("_bin"), F.col("_found.below").alias("_below")
    )
    coarse = settle(coarse, "median-bins")
    least = [F.min(F.when(F.col("h") < count, F.col("_bin"))).alias(f"_least{i}") for i, count in enumerate(counts)]
    leading = reduce(or_, [(F.col("h") < count) & (F.col("_bin") <= F.col(f"_least{i}")) for i, count in enumerate(counts)])
    leaders = coarse.join(coarse.groupBy(*keys).agg(*least), keys).where(leading).select(*keys, "h", "n", "_bin", "_below")
    leaders = settle(leaders, "leaders")
    entry = F.struct("_m.h", "_m.model", "_bin")
    open_models = models.select(*keys, F.explode("models").alias("_m")).withColumn("h", F.col("_m.h")).join(leaders, [*keys, "h"])
    open_models = settle(open_models.groupBy(*keys).agg(F.collect_list(entry).alias("models")), "leading-models")
    step = residual_step(F.col("r"))
    near = _residuals(points.select(*keys, *_COORDS), open_models, keys, "_bin").where(bins == F.col("_bin"))
    steps = near.groupBy(*keys, "h", step.alias("_at")).agg(F.count("*").alias("_n"))
    fine = steps.groupBy(*keys, "h").agg(_histogram()).join(leaders, [*keys, "h"]).select(*keys, "h", _walk(F.col("_below"))["at"].alias("_fine"))
    median = F.coalesce("_fine", F.col("_bin") * RESIDUAL_STEPS)
    return coarse.join(fine, [*keys, "h"], "left").select(*keys, "h", "n", *names, median.alias("_median"))


def _histogram() -> Column:
    return F.array_sort(F.collect_list(F.struct("_at", "_n"))).alias("_hist")


def _walk(start: Column) -> Column:
    """Where a histogram of ``_hist`` that begins after ``start`` values reaches half of ``n``, and how many are below."""
    half = lambda acc, s: acc["at"].isNull() & ((acc["seen"] + s["_n"]) * 2 >= F.col("n"))
    return F.aggregate(
        "_hist",
        F.struct(start.alias("seen"), F.lit(None).cast("int").alias("at"), start.alias("below")),
        lambda acc, s: F.struct(
            (acc["seen"] + s["_n"]).alias("seen"),
            F.when(half(acc, s), s["_at"]).otherwise(acc["at"]).alias("at"),
            F.when(half(acc, s), acc["seen"]).otherwise(acc["below"]).alias("below"),
        ),
        lambda acc: F.struct(acc["at"].alias("at"), acc["below"].alias("below")),
    )


def residuals(points: DataFrame, fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points with ``residual`` against their group's model and its ``ransac_threshold``.

    ``fits`` has one fit per group.
    """
    chosen = settle(fits.select(*keys, "model", "ransac_threshold"), "fits")
    residual = affine_residual(F.col("model"), *(F.col(c) for c in _COORDS))
    return join_settled(points, chosen, keys).withColumn("residual", residual).drop("model")


def inliers(points: DataFrame, fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points within the threshold of their group's model."""
    near = residuals(points, fits, keys).where(F.col("residual") <= F.col("ransac_threshold"))
    return near.select(*points.columns)


def large_enough(points: DataFrame, keys: Sequence[str], min_area: float = 200.0) -> DataFrame:
    """Groups whose points span a bounding box of at least ``min_area`` square pixels.

    The definition (image-1 pixels) is this package's own.
    """
    area = (F.max("x1") - F.min("x1")) * (F.max("y1") - F.min("y1"))
    return points.groupBy(*keys).agg(F.count("*").alias("n"), area.alias("area")).where(
        F.col("area") >= min_area
    )


def best_fit_per_chip(fits: DataFrame, chip: Sequence[str]) -> DataFrame:
    """Per chip the combination with most inliers, then lowest RMSE, then name.

    ``fits`` needs ``inliers, rmse, name``. One aggregation; no ranking window.
    """
    return fits.groupBy(*chip).agg(
        F.min(F.struct((-F.col("inliers")).alias("_neg"), "rmse", "name")).alias("_best")
    ).select(
        *chip,
        F.col("_best")["name"].alias("name"),
        (-F.col("_best")["_neg"]).alias("inliers"),
        F.col("_best")["rmse"].alias("rmse"),
    )

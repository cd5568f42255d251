"""Descriptor matching within blocks (chip pairs), and filters on matches.

Blocks of a few tiles are compared as they are, with matrix products. Nearest neighbours of larger blocks are
searched by pivots: descriptors are clustered around a sample of them, and only pairs of clusters are compared
in which the bounds from pivots and radii leave room for a best match. The result is the same.

The definitions are this package's own. Similarities are compared at nine decimals, so that
equal descriptors tie whatever the order of summation; ties go to the lower id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tiepoints.functions.geometry import affine_from_sums, moments
from tiepoints.operators.joins import join_per_key, join_settled, top_per_key
from tiepoints.session import settle

# Default thresholds handed to detectors and matchers.
DETECT_THRESHOLD = 0.015
MATCH_THRESHOLD = 0.2
SMNN_RATIO = 0.95
MAX_KEYPOINTS = 2048

TILE = 2048
LARGE = 4  # a block of more tiles than this, both sides together, is searched by pivots
_UNITS = 1e9

Kernel = Callable[[np.ndarray, np.ndarray, pa.Table, pa.Table], Iterator[dict[str, np.ndarray]]]


def _units(values: np.ndarray) -> np.ndarray:
    return np.rint(values * _UNITS).astype(np.int64)


def _matrix(table: pa.Table) -> np.ndarray:
    lists = table.column("d").combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _hash_tiles(desc: DataFrame, tile: int) -> DataFrame:
    """Every descriptor with the tiles ``_t0, _t1`` that it takes part in.

    Each side of a block is cut by hash into chunks of about ``tile`` rows and every pair of
    opposite chunks is one task-sized group, so a block that holds a third of all rows becomes
    many tiles.
    """
    size = desc.groupBy("block").agg(
        F.ceil(F.count_if(F.col("side") == 0) / tile).cast("int").alias("_n0"),
        F.ceil(F.count_if(F.col("side") == 1) / tile).cast("int").alias("_n1"),
    )
    sized = join_per_key(desc, size.where("_n0 > 0 AND _n1 > 0"), ["block"])
    first = F.col("side") == 0
    own = F.pmod(F.xxhash64("id"), F.when(first, F.col("_n0")).otherwise(F.col("_n1"))).cast("int")
    opposite = F.explode(
        F.sequence(F.lit(0), F.when(first, F.col("_n1")).otherwise(F.col("_n0")) - 1)
    )
    return (
        sized.withColumn("_own", own)
        .withColumn("_other", opposite)
        .withColumns(
            {
                "_t0": F.when(first, F.col("_own")).otherwise(F.col("_other")),
                "_t1": F.when(first, F.col("_other")).otherwise(F.col("_own")),
            }
        )
        .drop("_n0", "_n1", "_own", "_other")
    )


_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<float>": pa.list_(pa.float32())}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def _on_tiles(tiles: DataFrame, kernel: Kernel, out: str) -> DataFrame:
    """Run ``kernel`` on every tile and return its rows with ``block``.

    A kernel returns a bounded number of rows per descriptor, never its pairs.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.rename_columns(left.column_names)
        if not (left.num_rows and right.num_rows):
            return schema.empty_table()
        block = left.column("block")[0].as_py()
        parts = []
        for part in kernel(_matrix(left), _matrix(right), left, right):
            length = len(part["id"])
            columns = {"block": np.full(length, block, dtype=np.int64), **part}
            parts.append(pa.table({f.name: pa.array(columns[f.name], type=f.type) for f in schema}))
        return pa.concat_tables(parts)

    ddl = f"block bigint, side int, {out}"
    schema = _schema(ddl)
    first = F.col("side") == 0
    # Both sides come from one table; new names keep their columns apart.
    second = tiles.where(~first).withColumnsRenamed({c: f"{c}_b" for c in tiles.columns})
    return (
        tiles.where(first).groupBy("block", "_t0", "_t1")
        .cogroup(second.groupBy("block_b", "_t0_b", "_t1_b"))
        .applyInArrow(run, ddl)
    )


def _tiled(desc: DataFrame, kernel: Kernel, out: str, tile: int) -> DataFrame:
    return _on_tiles(_hash_tiles(desc, tile), kernel, out)


# --- tiles by pivots ----------------------------------------------------------------------------

#: For descriptors, pivots of the other side and the radii of their clusters: which clusters each may need.
Needed = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
PIVOTS = 8
MARGIN = 1e-6  # of rounding; more than the steps in which similarities are compared


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


def _may_be_largest_product(a: np.ndarray, pivots: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """A member x of a cluster with pivot p has a.x <= a.p + |a| r, and pivots are descriptors themselves."""
    at_pivot = a @ pivots.T
    norm = np.sqrt((a * a).sum(axis=1))
    return at_pivot + norm[:, None] * (radii[None, :] + MARGIN) + MARGIN >= at_pivot.max(axis=1)[:, None]


def _may_be_two_nearest(a: np.ndarray, pivots: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """By the triangle inequality no member is nearer than d(a, p) - r; two are as near as the second pivot."""
    d = _distances(a, pivots)
    if d.shape[1] < 2:
        return np.ones(d.shape, bool)
    return d - radii[None, :] - MARGIN <= np.partition(d, 1, axis=1)[:, 1:2]


def _pivots(desc: DataFrame, tile: int) -> DataFrame:
    """Per block and side: its size, the number of its chunks, and about ``PIVOTS`` of ``tile`` descriptors as pivots."""
    h, own = F.xxhash64("id"), F.struct("id", "d")
    found = desc.groupBy("block", "side").agg(
        F.count("*").alias("_n"), F.collect_list(F.when(F.pmod(h, F.lit(max(1, tile // PIVOTS))) == 0, own)).alias("_many"), F.min_by(own, h).alias("_one")
    )
    pivots = F.array_sort(F.when(F.size("_many") > 0, F.col("_many")).otherwise(F.array("_one")))
    return found.select("block", "side", "_n", F.ceil(F.col("_n") / tile).cast("int").alias("_chunks"), pivots.alias("_pivots"))


def _per_chunk(left: DataFrame, right: DataFrame, kernel: Callable[[pa.Table, pa.Table], pa.Table], ddl: str) -> DataFrame:
    """Run ``kernel`` on every chunk of descriptors with the one row that ``right`` has for its block and side."""
    each = right.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    each = each.withColumnsRenamed({c: f"{c}_b" for c in ("block", "side", "_chunk")})

    def run(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        return kernel(rows, pivots) if rows.num_rows and pivots.num_rows else _schema(ddl).empty_table()

    return (
        left.groupBy("block", "side", "_chunk").cogroup(each.groupBy("block_b", "side_b", "_chunk_b")).applyInArrow(run, ddl)
    )


def _pivot_matrix(table: pa.Table) -> np.ndarray:
    return np.array([p["d"] for p in table.column("_pivots")[0].as_py()], np.float64)


def _clusters(desc: DataFrame, pivots: DataFrame) -> DataFrame:
    """Every descriptor with the number of its nearest pivot and its distance, as a written table."""
    sized = join_settled(desc.select("block", "side", "id", "d"), pivots.select("block", "side", "_chunks"), ["block", "side"])
    chunked = sized.withColumn("_chunk", F.pmod(F.xxhash64("id", F.lit(1)), F.col("_chunks")).cast("int")).drop("_chunks")

    def nearest(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        d = _distances(_matrix(rows), _pivot_matrix(pivots))
        at = d.argmin(axis=1)
        rows = rows.append_column("_cluster", pa.array(at, pa.int32()))
        return rows.append_column("_away", pa.array(d[np.arange(len(at)), at])).cast(_schema(ddl))

    ddl = "block bigint, side int, id bigint, d array<float>, _chunk int, _cluster int, _away double"
    return settle(_per_chunk(chunked.select("block", "side", "id", "d", "_chunk"), pivots, nearest, ddl), "clusters")


def needed_tiles(desc: DataFrame, needed: Needed, tile: int) -> tuple[DataFrame, DataFrame]:
    """The clustered descriptors, and the pairs of clusters (block, c0, c1) in which a best match can be."""
    pivots = settle(_pivots(desc, tile), "pivots")
    placed = _clusters(desc, pivots)
    radii = placed.groupBy("block", "side", "_cluster").agg(F.max("_away").alias("r"))
    radii = radii.groupBy("block", "side").agg(F.array_sort(F.collect_list(F.struct("_cluster", "r"))).alias("_radii"))
    # Each side asks the pivots of the other, in as many copies as it has chunks itself.
    asked = pivots.drop("_chunks").join(radii, ["block", "side"]).withColumn("side", 1 - F.col("side"))
    asked = asked.join(pivots.select("block", "side", "_chunks"), ["block", "side"])

    def pairs(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        matrix = _pivot_matrix(pivots)
        radius = np.full(len(matrix), -np.inf)  # a pivot without members is needed by none
        for entry in pivots.column("_radii")[0].as_py():
            radius[entry["_cluster"]] = entry["r"]
        own = rows.column("_cluster").to_numpy()
        may = needed(_matrix(rows), matrix, radius) & np.isfinite(radius)[None, :]
        row, other = np.nonzero(may)
        found = np.unique(own[row].astype(np.int64) * len(matrix) + other)
        block, side = rows.column("block")[0].as_py(), rows.column("side")[0].as_py()
        columns = {"block": np.full(len(found), block), "side": np.full(len(found), side, np.int32), "own": found // len(matrix), "other": found % len(matrix)}
        return pa.table({f.name: pa.array(columns[f.name], f.type) for f in _schema(ddl)})

    ddl = "block bigint, side int, own int, other int"
    found = _per_chunk(placed, asked.select("block", "side", "_chunks", "_pivots", "_radii"), pairs, ddl)
    first = F.col("side") == 0
    either = found.select("block", F.when(first, F.col("own")).otherwise(F.col("other")).alias("c0"), F.when(first, F.col("other")).otherwise(F.col("own")).alias("c1"))
    return placed, settle(either.distinct(), "tiles")


def _pivot_tiles(desc: DataFrame, needed: Needed, tile: int) -> DataFrame:
    """Tiles as pairs of clusters instead of pairs of chunks, without those that can hold no best match.

    A cluster of more than twice ``tile`` descriptors, say of copies, is cut by hash into pieces.
    """
    placed, pairs = needed_tiles(desc, needed, tile)
    sizes = placed.groupBy("block", "side", "_cluster").agg(F.count("*").alias("n"))
    sizes = sizes.select("block", "side", "_cluster", F.ceil(F.col("n") / (2 * tile)).cast("int").alias("pieces"))
    sizes = settle(sizes, "sizes")
    out = []
    for side, own, other in ((0, "c0", "c1"), (1, "c1", "c0")):
        cut = sizes.where(F.col("side") == side).select("block", F.col("_cluster").alias(own), F.col("pieces").alias("_own_pieces"))
        beside = sizes.where(F.col("side") == 1 - side).select("block", F.col("_cluster").alias(other), F.col("pieces").alias("_other_pieces"))
        met = settle(pairs.join(cut, ["block", own]).join(beside, ["block", other]), "pairs")
        rows = placed.where(F.col("side") == side).select("block", "side", "id", "d", F.col("_cluster").alias(own))
        rows = join_settled(rows, met, ["block", own])
        piece = F.pmod(F.xxhash64("id", F.lit(2)), F.col("_own_pieces")).cast("string")
        rows = rows.withColumn("_there", F.explode(F.sequence(F.lit(0), F.col("_other_pieces") - 1)))
        there = F.col("_there").cast("string")
        named = {own: F.concat_ws(".", F.col(own).cast("string"), piece), other: F.concat_ws(".", F.col(other).cast("string"), there)}
        out.append(rows.select("block", "side", "id", "d", named["c0"].alias("_t0"), named["c1"].alias("_t1")))
    return out[0].unionByName(out[1])


def _best_tiles(desc: DataFrame, needed: Needed, kernel: Kernel, tile: int) -> DataFrame:
    """The best candidates of every descriptor: small blocks as one tile, large ones by pivots."""
    out = "id bigint, cand bigint, score bigint"
    size = desc.groupBy("block").agg(F.count("*").alias("_n")).where(F.col("_n") > LARGE * tile).drop("_n")
    if size.isEmpty():
        return _tiled(desc, kernel, out, tile)
    size = settle(size, "large-blocks")
    small = _tiled(join_settled(desc, size, ["block"], "left_anti"), kernel, out, tile)
    return small.unionByName(_on_tiles(_pivot_tiles(join_settled(desc, size, ["block"], "left_semi"), needed, tile), kernel, out))


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("id").to_numpy()


def _both_sides(scores: np.ndarray, left: pa.Table, right: pa.Table):
    yield 0, scores, _ids(left), _ids(right)
    yield 1, scores.T, _ids(right), _ids(left)


def _best(scores: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Highest score per row and the lowest candidate id that reaches it."""
    order = np.argsort(candidates, kind="stable")
    at = order[np.argmax(scores[:, order], axis=1)]
    return scores[np.arange(len(scores)), at], candidates[at]


def _best_rows(scores, left, right):
    for side, s, own, other in _both_sides(scores, left, right):
        top, cand = _best(s, other)
        yield {"side": np.full(len(own), side), "id": own, "cand": cand, "score": top}


def _dot_kernel(a, b, left, right):
    yield from _best_rows(_units(a @ b.T), left, right)


def _mutual(best: DataFrame) -> DataFrame:
    """Pairs that are each other's best: ``block, id0, id1, score``."""
    picked = best.groupBy("block", "side", "id").agg(
        F.max(F.struct("score", (-F.col("cand")).alias("_neg"))).alias("_top")
    ).select(
        "block", "side", "id", (-F.col("_top")["_neg"]).alias("cand"), F.col("_top")["score"].alias("score")
    )
    pair = picked.select(
        "block",
        F.when(F.col("side") == 0, F.col("id")).otherwise(F.col("cand")).alias("id0"),
        F.when(F.col("side") == 0, F.col("cand")).otherwise(F.col("id")).alias("id1"),
        "score",
    )
    # Both directions name the pair once, so agreement is a count of two.
    return (
        pair.groupBy("block", "id0", "id1")
        .agg(F.count("*").alias("_n"), F.max("score").alias("score"))
        .where(F.col("_n") == 2)
        .drop("_n")
    )


def mutual_nn(desc: DataFrame, tile: int = TILE) -> DataFrame:
    """Mutual nearest neighbours by dot product: ``block, id0, id1, similarity``."""
    best = _best_tiles(desc, _may_be_largest_product, _dot_kernel, tile)
    return _mutual(best).select("block", "id0", "id1", (F.col("score") / _UNITS).alias("similarity"))


def _distance_kernel(a, b, left, right):
    scores = -_units(_distances(a, b))
    for side, s, own, other in _both_sides(scores, left, right):
        for _ in range(min(2, s.shape[1])):
            top, cand = _best(s, other)
            yield {"side": np.full(len(own), side), "id": own, "cand": cand, "score": top}
            s = np.where(other[None, :] == cand[:, None], np.iinfo(np.int64).min, s)


def smnn_ratio(desc: DataFrame, ratio: float = SMNN_RATIO, tile: int = TILE) -> DataFrame:
    """Mutual nearest neighbours that pass the distance ratio test in both directions.

    Best over second-best Euclidean distance must be at most ``ratio``. A descriptor with a
    single candidate, or with two at distance 0, has no ratio and is dropped.
    Output: ``block, id0, id1, distance, ratio0, ratio1``.
    """
    two = _best_tiles(desc, _may_be_two_nearest, _distance_kernel, tile)
    keys = ["block", "side", "id"]
    # At most two rows per tile of the descriptor reach this window.
    ranked = two.withColumn(
        "rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "cand"))
    ).where(F.col("rank") <= 2)
    best = ranked.groupBy(*keys).agg(
        F.max(F.when(F.col("rank") == 1, F.col("cand"))).alias("cand"),
        F.max(F.when(F.col("rank") == 1, -F.col("score"))).alias("d1"),
        F.max(F.when(F.col("rank") == 2, -F.col("score"))).alias("d2"),
    ).where(F.col("d2") > 0).withColumn("ratio", F.col("d1") / F.col("d2")).where(F.col("ratio") <= ratio)
    first = F.col("side") == 0
    pair = best.select(
        "block",
        F.when(first, F.col("id")).otherwise(F.col("cand")).alias("id0"),
        F.when(first, F.col("cand")).otherwise(F.col("id")).alias("id1"),
        "d1",
        F.when(first, F.col("ratio")).alias("ratio0"),
        F.when(~first, F.col("ratio")).alias("ratio1"),
    )
    return (
        pair.groupBy("block", "id0", "id1")
        .agg(F.max("d1").alias("_d"), F.max("ratio0").alias("ratio0"), F.max("ratio1").alias("ratio1"))
        .where(F.col("ratio0").isNotNull() & F.col("ratio1").isNotNull())
        .select("block", "id0", "id1", (F.col("_d") / _UNITS).alias("distance"), "ratio0", "ratio1")
    )


def dual_softmax(
    desc: DataFrame, temperature: float = 0.1, threshold: float = MATCH_THRESHOLD, tile: int = TILE
) -> DataFrame:
    """Mutual maxima of the product of both softmaxes, at least ``threshold``.

    The first pass over the tiles yields each descriptor's log-sum-exp, the second the products.
    Output: ``block, id0, id1, probability``.
    """

    def partition_sums(a, b, left, right):
        for side, s, own, _ in _both_sides(a @ b.T / temperature, left, right):
            top = s.max(axis=1)
            yield {
                "side": np.full(len(own), side), "id": own,
                "top": top, "total": np.exp(s - top[:, None]).sum(axis=1),
            }

    def products(a, b, left, right):
        lse0, lse1 = left.column("lse").to_numpy(), right.column("lse").to_numpy()
        p = np.exp(2.0 * (a @ b.T) / temperature - lse0[:, None] - lse1[None, :])
        yield from _best_rows(_units(p), left, right)

    sums = _tiled(desc, partition_sums, "id bigint, top double, total double", tile)
    keys = ["block", "side", "id"]
    # One entry per tile of the descriptor.
    lse = (
        sums.groupBy(*keys)
        .agg(F.max("top").alias("_m"), F.collect_list(F.struct("top", "total")).alias("_parts"))
        .select(
            *keys,
            (
                F.col("_m")
                + F.log(
                    F.aggregate(
                        "_parts", F.lit(0.0),
                        lambda acc, e: acc + e["total"] * F.exp(e["top"] - F.col("_m")),
                    )
                )
            ).alias("lse"),
        )
    )
    # Keys are single descriptors, so this join has no hot key.
    best = _tiled(desc.join(lse, keys), products, "id bigint, cand bigint, score bigint", tile)
    return (
        _mutual(best)
        .where(F.col("score") >= round(threshold * _UNITS))
        .select("block", "id0", "id1", (F.col("score") / _UNITS).alias("probability"))
    )


def local_consistency(
    matches: DataFrame, keys: Sequence[str], *, cell: float, radius: float, least: int
) -> DataFrame:
    """Matches with at least ``least`` neighbours that moved alike.

    Neighbours lie in the 3 x 3 grid cells around; alike means both displacement components
    differ by at most ``radius``. Exact, yet no crowd is compared with itself:

    * Matches are counted per cell and displacement bin of width ``radius``. All members of a bin
      move alike, so a bin of more than ``least`` is accepted as a whole.
    * A smaller bin is accepted as a whole if the same displacement bin of the 9 cells around
      holds more than ``least``, and rejected as a whole if all 81 bins around hold too few.
    * Only what is left, at most ``least`` matches per bin, is compared with the rows around.
    """
    keys = list(keys)
    coords = ["x1", "y1", "x2", "y2"]
    place = ["_cx", "_cy", "_bu", "_bv"]
    beside = [f"{name}2" for name in place]
    u, v = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    placed = matches.withColumns(
        {
            "_cx": F.floor(F.col("x1") / cell), "_cy": F.floor(F.col("y1") / cell),
            "_bu": F.floor(u / radius), "_bv": F.floor(v / radius),
        }
    )
    bins = settle(placed.groupBy(*keys, *place).agg(F.count("*").alias("_n")), "bins")
    adjacent = settle(_adjacent_bins(bins, keys, place, least), "adjacent-bins")
    same = (F.col("_bu") == F.col("_bu2")) & (F.col("_bv") == F.col("_bv2"))
    judged = settle(
        adjacent.groupBy(*keys, *place)
        .agg(F.sum("_n").alias("_around"), F.sum(F.when(same, F.col("_n"))).alias("_same"))
        .where(F.col("_around") > least)
        .select(*keys, *place, (F.col("_same") > least).alias("_accepted")),
        "judged-bins",
    )
    open_bins = judged.where(~F.col("_accepted")).drop("_accepted")
    undecided = join_per_key(
        placed.select(*keys, *place, *coords), open_bins, [*keys, *place], "left_semi"
    ).distinct()
    # Few matches per bin on this side; the other side may be hot.
    asked = settle(
        undecided.join(adjacent.drop("_n").hint("merge"), [*keys, *place]).select(
            *keys,
            *[F.col(b).alias(name) for name, b in zip(place, beside)],
            F.struct(*coords).alias("_of"), u.alias("_u"), v.alias("_v"),
        ),
        "asked",
    )
    alike = (F.abs(u - F.col("_u")) <= radius) & (F.abs(v - F.col("_v")) <= radius)
    confirmed = (
        join_settled(placed.select(*keys, *place, *coords), asked, [*keys, *place])
        .where(alike)
        .groupBy(*keys, "_of")
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") > least)
        .select(*keys, "_of.*")
    )
    accepted = bins.where(F.col("_n") > least).select(*keys, *place).unionByName(
        judged.where("_accepted").drop("_accepted")
    )
    whole = join_per_key(placed, accepted, [*keys, *place], "left_semi").select(*matches.columns)
    single = join_per_key(matches, confirmed, [*keys, *coords], "left_semi")
    return whole.unionByName(single)


def _adjacent_bins(bins: DataFrame, keys: list[str], place: list[str], least: int) -> DataFrame:
    """Every small bin with the occupied bins around it, itself included.

    Bins meet in blocks of 3 per dimension: a bin looks into one or two blocks per dimension,
    and a block holds at most 81 bins.
    """
    block = [f"_k{i}" for i in range(len(place))]
    small = bins.where(F.col("_n") <= least).drop("_n")
    for name, k in zip(place, block):
        low, high = F.floor((F.col(name) - 1) / 3), F.floor((F.col(name) + 1) / 3)
        small = small.withColumn(k, F.explode(F.sequence(low, high)))
    others = bins.select(
        *keys, *[F.col(name).alias(f"{name}2") for name in place], "_n",
        *[F.floor(F.col(name) / 3).alias(k) for name, k in zip(place, block)],
    )
    near = F.lit(True)
    for name in place:
        near = near & (F.abs(F.col(name) - F.col(f"{name}2")) <= 1)
    # Bounded on both sides per key, so a plain shuffled join.
    return small.join(others.hint("merge"), [*keys, *block]).where(near).drop(*block)


def seeded_affine(
    matches: DataFrame, keys: Sequence[str], *, cell: float, spread: float, radius: float, least: int, score: str = "score"
) -> DataFrame:
    """Matches that fit the local affine motion around at least one well supported seed.

    The seed of a grid cell is its best match by ``score`` (then the first by coordinates). Its local set are
    the matches in the 3 x 3 cells around that moved like it, up to ``spread`` per component. The least-squares
    affine map of that set is the seed's motion, and a seed with ``least`` matches within ``radius`` of its
    motion is supported. A match is kept if a supported seed around it has it within ``radius``.

    A cell has one seed, so a match meets at most nine; a set is only ever summed up, with map-side combine,
    however many matches it has. What is joined back are at most nine rows of plain columns per cell, its seeds
    or motions, so that all a match is compared with runs in generated code.
    """
    keys = list(keys)
    coords = ["x1", "y1", "x2", "y2"]
    placed = matches.withColumns({"_cx": F.floor(F.col("x1") / cell), "_cy": F.floor(F.col("y1") / cell)})
    place = [*keys, "_cx", "_cy"]
    # A least struct is found by sorting all rows. Ranks alone take a hash aggregation, and few rows share the first.
    rank = -F.col(score)
    first = F.when(~F.max(rank.isNull()), F.min(rank)).alias("_first")
    ranked = join_per_key(placed.select(*place, *coords, rank.alias("_rank")), placed.groupBy(*place).agg(first), place)
    best = F.min(F.struct(*coords)).alias("_s")
    seeds = ranked.where(F.col("_rank").eqNullSafe(F.col("_first"))).groupBy(*place).agg(best).select(*place, *[F.col("_s")[c].alias(c) for c in coords])
    seeds = settle(seeds, "seeds-of-cells")

    def around(table: DataFrame, label: str) -> DataFrame:
        """Rows by every cell that they lie around, themselves in columns ``_s<name>``."""
        beside = table.select(*keys, *[F.col(c).alias("_s" + c.lstrip("_")) for c in table.columns if c not in keys])
        for name in ("cx", "cy"):
            beside = beside.withColumn(f"_{name}", F.explode(F.array(*[F.col(f"_s{name}") + d for d in (-1, 0, 1)])))
        return settle(beside, label)

    own = [*keys, "_scx", "_scy"]
    x, y = F.col("x1") - F.col("_sx1"), F.col("y1") - F.col("_sy1")
    u = F.col("x2") - F.col("x1") - (F.col("_sx2") - F.col("_sx1"))
    v = F.col("y2") - F.col("y1") - (F.col("_sy2") - F.col("_sy1"))
    met = join_settled(placed.select(*place, *coords), around(seeds, "seeds"), place)
    local = met.where((F.abs(u) <= spread) & (F.abs(v) <= spread)).select(*own, x.alias("x"), y.alias("y"), u.alias("u"), v.alias("v"))
    sums = moments(*(F.col(c) for c in "xyuv"))
    summed = local.groupBy(*own).agg(F.count("*").alias("n"), *[F.sum(c).alias(name) for name, c in sums.items()])
    motion = summed.select(
        *keys, F.col("_scx").alias("_cx"), F.col("_scy").alias("_cy"), F.inline(F.array(F.struct(affine_from_sums(F.col("n").cast("double")).alias("m"))))
    ).where("m is not null")
    motion = settle(motion.join(seeds, place).select(*place, *coords, *[F.col("m")[c].alias(c) for c in "abcdef"]), "motions")

    du = F.col("_sa") * x + F.col("_sb") * y + F.col("_sc") - u
    dv = F.col("_sd") * x + F.col("_se") * y + F.col("_sf") - v
    follows = du * du + dv * dv <= radius * radius
    tested = join_settled(placed.select(*place, *coords), around(motion, "motions-around"), place)
    support = tested.where(follows).groupBy(*own).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    support = support.select(*keys, F.col("_scx").alias("_cx"), F.col("_scy").alias("_cy"))
    kept = around(join_per_key(motion, support, place, "left_semi"), "supported")
    return join_settled(placed, kept, place, "left_semi", where=follows).select(*matches.columns)


def top_keypoints(
    keypoints: DataFrame,
    chip: Sequence[str],
    *,
    score: str = "score",
    ties: Sequence[str] = (),
    budget: int = MAX_KEYPOINTS,
    threshold: float = DETECT_THRESHOLD,
) -> DataFrame:
    """The ``budget`` best keypoints of every chip at or above the detection threshold."""
    order: list[Column] = [F.desc(score), *[F.col(c) for c in ties]]
    return top_per_key(keypoints.where(F.col(score) >= threshold), chip, order, budget, "rank")

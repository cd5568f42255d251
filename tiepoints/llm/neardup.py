"""Near duplicates: MinHash candidates, Bayesian pruning, exact confirmation, connected components.

Documents with the same shingle set form a class, and only one document of a class is compared.
Signatures of ``BANDS * ROWS`` hashes are cut into bands; classes that share a band are candidates.
A candidate pair's signatures are compared in batches. After each batch the pair is dropped if
the posterior probability that its similarity reaches the threshold, given the matches so far and a
uniform prior, is below ``MISS``. Pairs that survive are confirmed on their whole shingle sets.

A bucket is never expanded into all its pairs. Every member first meets the hub of its bucket, the most
central member; links give components. What is left are members that are not linked with their
hub h. If such an x is linked with a y of the same group, then x and y share a shingle that h does not have,
or else all they share is in h and |x| + |y| <= (1 + s) / s * min(|x & h|, |y & h|) for the threshold
s. Both cases are found by equi-joins on what differs from the hub, between components only: pairs inside
a component cannot change the result. So no link between two components is lost that banding
finds (at similarity 0.85 a pair shares no band with probability 6e-11, at 0.8 with 5e-8).

Null and empty texts have an empty set and are linked with nothing. Texts of fewer words than a
shingle are one shingle. Rows of equal content are one class. A null doc_id is left alone: its row
takes part in no class and keeps itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import lgamma

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiepoints.llm.common import SLICE, back_to_rows, give_back, texts
from tiepoints.operators.joins import join_settled
from tiepoints.session import settle

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BATCH = 32
MISS = 1e-9
KNOWN = 200_000  # word hashes a task keeps
_ODD = np.random.default_rng(11).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Rule:
    """Words of a shingle, and the least Jaccard similarity as a fraction of integers."""

    words: int = 3
    num: int = 85
    den: int = 100


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hashes of words, kept within a task."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def shingle_set(text: str | None, words: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles.

    On bytes, ``lower`` changes A-Z only and ``split`` parts at blanks and the characters 9 to 13 only.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(known) > KNOWN:
        known.clear()
    ids = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    size = min(words, len(ids))
    out = np.full(len(ids) - size + 1, size, np.uint64)
    for k in range(size):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + len(out)])
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum of ``HASHES`` multiply-shift hashes, 32 bits each."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(least, (_ODD[:, None] * shingles[at : at + 1024]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, digest of the set and signature; the last two are null for an empty set."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part, sizes, digests, sigs = batch.slice(at, SLICE), [], [], []
                for text in part.column("text").to_pylist():
                    found = shingle_set(text, rule.words, known)
                    sizes.append(len(found))
                    digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                    sigs.append(signature(found).tobytes() if len(found) else None)
                columns = [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest", "sig"])
        give_back()

    return texts(docs).mapInArrow(build, "doc_id long, n_shingles long, digest binary, sig binary")


@lru_cache(maxsize=8)
def least_matches(num: int, den: int, miss: float = MISS) -> tuple[int, ...]:
    """Matches a pair needs after 0, 1, ... compared hashes to stay a candidate.

    With a uniform prior the similarity has a Beta(m + 1, n - m + 1) posterior after m matches of n;
    its upper tail is integrated numerically.
    """
    grid = np.linspace(0, 1, 20001)[1:-1]
    high = grid >= num / den
    least = []
    for n in range(HASHES + 1):
        m = 0
        while m <= n:
            density = m * np.log(grid) + (n - m) * np.log1p(-grid) + lgamma(n + 2) - lgamma(m + 1) - lgamma(n - m + 1)
            if np.exp(density)[high].sum() * (grid[1] - grid[0]) >= miss:
                break
            m += 1
        least.append(m)
    return tuple(least)


def survivors(left: np.ndarray, right: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """Which pairs of signatures are still candidates after all batches."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for at in range(0, HASHES, BATCH):
        matches += (left[alive, at : at + BATCH] == right[alive, at : at + BATCH]).sum(axis=1)
        keep = matches >= least[min(at + BATCH, HASHES)]
        alive, matches = alive[keep], matches[keep]
    out = np.zeros(len(left), bool)
    out[alive] = True
    return out


def _pruned(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) that survive the sequential comparison of their signatures."""
    least = least_matches(rule.num, rule.den)

    @F.pandas_udf("boolean")
    def alive(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        left = np.frombuffer(b"".join(a), np.uint32).reshape(-1, HASHES)
        right = np.frombuffer(b"".join(b), np.uint32).reshape(-1, HASHES)
        return pd.Series(survivors(left, right, least))

    sigs = classes.select("node", "sig")
    met = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a")
    met = met.join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
    return settle(met.where(alive("sig_a", "sig_b")).select("a", "b"), "survivors")


def _sets(nodes: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """``node`` and its packed shingle set, for the given nodes only; they are read again."""
    wanted = settle(nodes.select(F.col("node").alias("doc_id")).distinct(), "nodes")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                sets = [shingle_set(t, rule.words, known).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], ["node", "shingles"])
        give_back()

    own = join_settled(texts(docs), wanted, ["doc_id"], "left_semi").dropDuplicates(["doc_id"])
    return settle(own.mapInArrow(build, "node long, shingles binary"), "sets")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a")
    return met.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")


def _confirmed(pairs: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) whose whole shingle sets reach the threshold."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))

    @F.arrow_udf("boolean")
    def linked(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            out = []
            for x, y in zip(a, b):  # one pair of sets at a time, as views of the batch
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(rule.den * both >= rule.num * (len(x) + len(y) - both))
            yield pa.array(out, pa.bool_())
        give_back()

    met = _with_sets(pairs, _sets(nodes, docs, rule))
    return settle(met.where(linked("set_a", "set_b")).select("a", "b"), "links")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest id of its component, for every node with a link.

    Alternates taking the smallest label among neighbours with jumping to the label's own label, so
    the number of rounds is logarithmic in the longest path. Every round is written.
    """
    both = settle(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        now = labels.join(near.withColumnRenamed("a", "node"), "node")
        now = now.select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("upper"))
        now = now.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("upper", "label")).alias("label"))
        now = settle(now, "labels")
        changed = now.where("label < old").limit(1).count()
        labels = now.select("node", "label")
        if not changed:
            return labels


def _stars(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of the hub a of a bucket and every other member b.

    The text that others were made from is in the fullest bucket of every band, a changed copy in
    smaller ones; so the member with the largest sum of bucket sizes is next to most others.
    """
    sizes = members.groupBy("band").agg(F.count("*").alias("n"))
    central = members.join(sizes, "band").groupBy("node").agg(F.sum("n").alias("central"))
    ranked = members.join(settle(central, "central"), "node")
    hubs = ranked.groupBy("band").agg(F.max_by("node", F.struct("central", -F.col("node"))).alias("a"))
    pairs = members.join(hubs, "band").where("node != a").select("a", F.col("node").alias("b"))
    return settle(pairs.distinct(), "stars")


def _beyond_hubs(stars: DataFrame, labels: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of one hub's group and two components that can be linked although one is not with the hub."""
    own = labels.select(F.col("node").alias("b"), "label")
    held = stars.join(own, "b", "left").withColumn("label", F.coalesce("label", "b"))
    hub = labels.select(F.col("node").alias("a"), F.col("label").alias("hub_label"))
    held = held.join(hub, "a", "left").withColumn("hub_label", F.coalesce("hub_label", "a"))
    held = settle(held.withColumn("out", F.col("label") != F.col("hub_label")), "groups")
    mixed = held.groupBy("a").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("out").alias("any"))
    held = settle(held.join(mixed.where("any and lo != hi").select("a"), "a", "left_semi"), "mixed")

    @F.arrow_udf("size long, common long, beyond array<long>")
    def against_hub(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for hub, node in batches:
            size, beyond = [], []
            for h, x in zip(hub, node):
                h, x = np.frombuffer(h.as_buffer(), np.uint64), np.frombuffer(x.as_buffer(), np.uint64)
                size.append(len(x))
                beyond.append(np.setdiff1d(x, h, assume_unique=True).view(np.int64))
            common = [n - len(b) for n, b in zip(size, beyond)]
            values = pa.array(np.concatenate([np.zeros(0, np.int64), *beyond]))
            offsets = pa.array(np.cumsum([0, *map(len, beyond)]), pa.int32())
            columns = [pa.array(size, pa.int64()), pa.array(common, pa.int64()), pa.ListArray.from_arrays(offsets, values)]
            yield pa.StructArray.from_arrays(columns, ["size", "common", "beyond"])
        give_back()

    nodes = held.select(F.col("a").alias("node")).union(held.select("b"))
    met = _with_sets(held, _sets(nodes, docs, rule))
    far = settle(met.select("a", "b", "label", "out", against_hub("set_a", "set_b").alias("d")).select("a", "b", "label", "out", "d.*"), "beyond")

    pieces = far.select("a", "b", "label", F.explode("beyond").alias("e"))
    shared = pieces.groupBy("a", "e").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("a", "e")
    pieces = settle(pieces.join(shared, ["a", "e"], "left_semi").select("a", "b", "e"), "shared")
    # Of what a node has beyond its hub, only as much can be shared with others.
    counts = pieces.groupBy("a", "b").agg(F.count("*").alias("shared"))
    far = far.drop("beyond").join(counts, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    far = settle(far, "far")
    fields = ("b", "label", "out", "size", "common", "shared")
    x = far.where("out").select("a", *[F.col(c).alias(f"x_{c}") for c in fields])
    y = far.select("a", *[F.col(c).alias(f"y_{c}") for c in fields])
    # Pairs of two outsiders are found from either side; one is enough. Sizes must allow the threshold.
    fits = (
        (F.col("x_label") != F.col("y_label")) & (~F.col("y_out") | (F.col("x_b") < F.col("y_b")))
        & (F.col("x_size") * rule.den >= F.col("y_size") * rule.num) & (F.col("y_size") * rule.den >= F.col("x_size") * rule.num)
    )
    # |x & y| is at most what both share with the hub plus what both have beyond it.
    at_most = F.least("x_common", "y_common") + F.least("x_shared", "y_shared")
    enough = (rule.num + rule.den) * at_most >= rule.num * (F.col("x_size") + F.col("y_size"))
    ends = [F.least("x_b", "y_b").alias("a"), F.greatest("x_b", "y_b").alias("b")]

    def able(side: DataFrame, name: str) -> DataFrame:
        """Nodes that can reach the threshold with anything, and their shared pieces."""
        own = F.col(f"{name}_common") + F.col(f"{name}_shared")
        held = side.where((F.col(f"{name}_shared") > 0) & (own * rule.den >= F.col(f"{name}_size") * rule.num))
        return held.join(pieces.withColumnRenamed("b", f"{name}_b"), ["a", f"{name}_b"])

    by_shingle = able(x, "x").join(able(y, "y"), ["a", "e"]).where(fits & enough).select(*ends)

    # |x| + |y| <= (num + den) / num * common for both: the room that x leaves for the size of y.
    room = lambda c, size: (rule.num + rule.den) * F.col(c) / rule.num - F.col(size)
    small_x = x.withColumn("x_room", room("x_common", "x_size"))
    most = small_x.groupBy("a").agg(F.max("x_room").alias("most"))
    small_y = y.withColumn("y_room", room("y_common", "y_size")).join(most, "a").where("y_size <= most").drop("most")
    least = small_y.groupBy("a").agg(F.min("y_size").alias("least"))
    small_x = small_x.join(least, "a").where("x_room >= least").drop("least")
    by_size = small_x.join(small_y, "a").where(fits & (F.col("y_size") <= F.col("x_room")) & (F.col("x_size") <= F.col("y_room"))).select(*ends)
    return settle(by_shingle.union(by_size).distinct(), "stragglers")


def near_duplicates(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    rows = settle(signatures(docs, rule), "signatures")
    known = rows.where("digest is not null and doc_id is not null")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig"), F.count("*").alias("n"))
    classes = settle(classes, "classes")
    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", 4 * ROWS * i + 1, 4 * ROWS)) for i in range(BANDS)])
    # One document can stand for several classes only if its doc_id is repeated with other texts.
    nodes = classes.groupBy("node").agg(F.min("sig").alias("sig"))
    members = nodes.select("node", F.explode(bands).alias("band"))
    shared = members.groupBy("band").agg(F.count("*").alias("_n")).where("_n > 1").select("band")
    members = settle(members.join(shared, "band"), "members")
    stars = _stars(members)
    links = _confirmed(_pruned(stars, nodes, rule), docs, rule)
    labels = components(links)
    more = _confirmed(_pruned(_beyond_hubs(stars, labels, docs, rule), nodes, rule), docs, rule)
    labels = components(links.union(more)) if more.limit(1).count() else labels
    of_class = classes.join(labels, "node", "left").select(
        F.col("digest").alias("key"), F.coalesce("label", "node").alias("component"), "n"
    )
    found = known.select("doc_id", "n_shingles", "digest")
    total = found.count()
    found = back_to_rows(
        found.withColumnRenamed("digest", "key"), settle(of_class, "of-class"), "key", "n", total,
        F.unhex(F.hex(F.xxhash64("doc_id"))),
    ).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = rows.where("digest is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, rule: Rule = Rule(5, 80, 100)) -> DataFrame:
    """One document of each component, with all its columns: that of the smallest doc_id."""
    gone = near_duplicates(docs, rule).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    own = docs.withColumn("_gone", F.col("doc_id").cast("long"))
    return join_settled(own, settle(gone, "gone"), ["_gone"], "left_anti").drop("_gone")


#: For the rule of three words and 85 of 100; components by reachability.
SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM b JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id),
k AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""

"""Exact removal of long repeated byte strings with a distributed difference cover.

Every byte covered by a string of ``LENGTH`` bytes that starts anywhere else too is removed.

A difference cover of period v is a set of residues in which every difference modulo v occurs. If the
positions with such residues are sampled, then two equal strings, wherever they start, have a
sampled position at the same offset below v in both. The cover used here has q + 1 residues for the
period q*q + q + 1, a thirteenth of the positions instead of the two thirds of period 3.

1. Sampled tuples: each sampled position gets a name for the ``LENGTH - v + 1`` bytes from it. Names
   are dealt out by value, sorted, and a name equal to its neighbour is repeated.
2. Recursion on names: a string of ``LENGTH`` bytes can only be repeated if one of the sampled tuples
   inside it is. What is left, some per cent of the positions, is named again, by the whole string.
3. The remaining positions are merged into the order of those names, and equal neighbours have a common
   prefix of ``LENGTH`` bytes. Names that stay alone are sent back; all others are repeated.

Prefixes are bounded, so one level of recursion ends it, and only equality of neighbours counts, so names
are 64-bit hashes instead of ranks; two different strings share one with probability 2^-64. Names travel
as packed arrays, once per block of texts, so a string that occurs everywhere is one entry per
block. Texts that occur more than once are removed as a whole and one of them is searched.

Null and short texts lose nothing. Repeated rows are copies of each other. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiepoints.llm.common import texts
from tiepoints.operators.joins import join_settled
from tiepoints.session import settle

LENGTH = 400
ORDER = 13
BLOCK = 2 << 20
BUCKET = 1 << 20  # names a bucket should hold
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(400).integers(0, 1 << 63, 256, dtype=np.uint64)


@lru_cache(maxsize=4)
def difference_cover(q: int = ORDER) -> tuple[int, ...]:
    """q + 1 residues modulo q*q + q + 1 with all differences, for a prime q.

    Exponents i for which x^i has no square term, in a cubic extension of the field of q elements;
    cubics are tried until the differences are complete.
    """
    v = q * q + q + 1
    for code in range(q**3):
        a, b, c = code % q, code // q % q, code // q // q
        power, found = (1, 0, 0), []  # x^3 = a + b x + c x^2
        for i in range(v):
            if power[2] == 0:
                found.append(i)
            top = power[2]
            power = (top * a % q, (power[0] + top * b) % q, (power[1] + top * c) % q)
        if len(found) == q + 1 and len({(s - t) % v for s in found for t in found}) == v:
            return tuple(found)
    raise ValueError(f"no cover of order {q}")


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.ones(n, np.uint64)
        done, factor = 1, base
        while done < n:
            take = min(done, n - done)
            held[done : done + take] = held[:take] * np.uint64(factor)
            done, factor = done + take, factor * factor % (1 << 64)
        _powers[base] = held
    return held[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Names:
    """Names of substrings of one block in constant time each, from sums of byte values times powers."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[raw] * _power(_BASE, len(raw)), dtype=np.uint64, out=self.sums[1:])
        self.down = _power(pow(_BASE, -1, 1 << 64), len(raw) + 1)

    def at(self, start: np.ndarray, length: int) -> np.ndarray:
        return _mix((self.sums[start + length] - self.sums[start]) * self.down[start])


def _room(ends: np.ndarray, size: int) -> np.ndarray:
    """Bytes from every position of a block to the end of its text."""
    return np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(size)


def sampled(ends: np.ndarray, size: int, tuple_bytes: int, q: int) -> np.ndarray:
    """Positions of the cover at which a whole tuple fits into the text."""
    v = q * q + q + 1
    in_cover = np.zeros(v, bool)
    in_cover[list(difference_cover(q))] = True
    at = np.flatnonzero(np.resize(in_cover, size))
    return at[_room(ends, size)[at] >= tuple_bytes]


def _deal(names: np.ndarray, block: int, buckets: int) -> list[tuple]:
    """Rows (bucket, block, names, twice): distinct names by value, and those met more than once."""
    names, counts = np.unique(names, return_counts=True)
    # By the upper bits, so a bucket is a range of the order.
    bucket = ((names >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    return [
        (i, block, names[a:b].tobytes(), names[a:b][counts[a:b] > 1].tobytes())
        for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist()))
        if b > a
    ]


_DEALT = "bucket int, block long, names binary, twice binary"


def _neighbours(dealt: DataFrame, reply_repeated: bool) -> DataFrame:
    """Sort the names of every bucket, compare neighbours, and tell each block which of its are repeated.

    With ``reply_repeated`` false, which of its names are not. One row per block and bucket.
    """

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        each = [np.frombuffer(n, np.uint64) for n in rows["names"]]
        order = np.sort(np.concatenate(each))
        again = [np.frombuffer(t, np.uint64) for t in rows["twice"]]
        repeated = np.unique(np.concatenate([order[1:][order[1:] == order[:-1]], *again]))
        out = []
        for block, names in zip(rows["block"], each):
            at = np.searchsorted(repeated, names)
            found = np.zeros(len(names), bool)
            inside = at < len(repeated)
            found[inside] = repeated[at[inside]] == names[inside]
            told = names[found == reply_repeated]
            if len(told):
                out.append((block, told.tobytes()))
        return pd.DataFrame(out, columns=["block", "names"])

    return dealt.groupBy("bucket").applyInPandas(compare, "block long, names binary")


def _told(replies: pd.DataFrame) -> np.ndarray:
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(n, np.uint64) for n in replies["names"]]]))


def _isin(names: np.ndarray, order: np.ndarray) -> np.ndarray:
    if not len(order):
        return np.zeros(len(names), bool)
    at = np.minimum(np.searchsorted(order, names), len(order) - 1)
    return order[at] == names


_BLOCKS = "block long, keys array<binary>, ends array<int>, data binary"


def blocks_of(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """Texts packed into blocks of about ``size`` bytes: key and end of every text, compressed bytes."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        zip_, first = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 32
        keys, ends, parts, held, number = [], [], [], 0, 0

        def flush() -> pd.DataFrame:
            frame = pd.DataFrame({"block": [first + number], "keys": [keys], "ends": [ends], "data": [zip_.compress(b"".join(parts))]})
            return frame

        for batch in batches:
            for key, text in zip(batch["key"], batch["text"]):
                data = text.encode("utf-8")
                held += len(data)
                keys.append(key), ends.append(held), parts.append(data)
                if held >= size:
                    yield flush()
                    keys, ends, parts, held, number = [], [], [], 0, number + 1
        if keys:
            yield flush()

    return rows.mapInPandas(pack, _BLOCKS)


def _unpacked(data: bytes, ends) -> tuple[bytes, np.ndarray]:
    return zstandard.ZstdDecompressor().decompress(data), np.asarray(ends, dtype=np.int64)


def _sample_names(blocks: DataFrame, buckets: int, tuple_bytes: int, q: int) -> DataFrame:
    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, ends, data in zip(batch["block"], batch["ends"], batch["data"]):
                data, ends = _unpacked(data, ends)
                names = Names(data).at(sampled(ends, len(data), tuple_bytes, q), tuple_bytes)
                yield pd.DataFrame(_deal(names, block, buckets), columns=["bucket", "block", "names", "twice"])

    return blocks.select("block", "ends", "data").mapInPandas(name, _DEALT)


def _candidates(blocks: DataFrame, replies: DataFrame, length: int, q: int) -> DataFrame:
    """Texts with positions below which a sampled tuple is repeated, and the runs of such positions."""
    period = q * q + q + 1
    tuple_bytes = length - period + 1

    def find(rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out = []
        repeated = _told(replies)
        for block, keys, ends, packed in zip(rows["block"], rows["keys"], rows["ends"], rows["data"]):
            data, ends = _unpacked(packed, ends)
            at = sampled(ends, len(data), tuple_bytes, q)
            before = np.zeros(len(data) + 1, np.int32)  # repeated tuples that start before a position
            before[at[_isin(Names(data).at(at, tuple_bytes), repeated)] + 1] = 1
            before = np.cumsum(before, dtype=np.int32)
            start = np.flatnonzero(_room(ends, len(data)) >= length)
            start = start[before[start + period] > before[start]]
            if not len(start):
                continue
            text = np.searchsorted(ends, start, side="right")
            have = np.unique(text)
            begins = np.concatenate([[0], ends[:-1]])
            sizes = (ends - begins)[have]
            moved = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            start = start - begins[text] + moved[np.searchsorted(have, text)]
            first = np.flatnonzero(np.diff(start, prepend=-2) != 1)
            runs = np.stack([start[first], np.append(start[first[1:] - 1], start[-1]) + 1], axis=1).astype(np.int64)
            parts = b"".join(data[begins[t] : ends[t]] for t in have)
            out.append((block, [keys[t] for t in have], np.cumsum(sizes).tolist(), zstandard.ZstdCompressor(level=3).compress(parts), runs.tobytes(), len(start)))
        return pd.DataFrame(out, columns=["block", "keys", "ends", "data", "runs", "n"])

    met = blocks.groupBy("block").cogroup(replies.groupBy("block"))
    return met.applyInPandas(find, f"{_BLOCKS}, runs binary, n long")


def _positions(runs: bytes) -> np.ndarray:
    pairs = np.frombuffer(runs, np.int64).reshape(-1, 2)
    sizes = pairs[:, 1] - pairs[:, 0]
    return np.repeat(pairs[:, 0] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


def _string_names(candidates: DataFrame, buckets: int, length: int) -> DataFrame:
    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, ends, data, runs in zip(batch["block"], batch["ends"], batch["data"], batch["runs"]):
                data, ends = _unpacked(data, ends)
                names = Names(data).at(_positions(runs), length)
                yield pd.DataFrame(_deal(names, block, buckets), columns=["bucket", "block", "names", "twice"])

    return candidates.select("block", "ends", "data", "runs").mapInPandas(name, _DEALT)


def _cut(candidates: DataFrame, replies: DataFrame, length: int) -> DataFrame:
    """Per text with a repeated string: key, n_removed, n_spans, kept_sha256."""

    def cut(rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out, alone = [], _told(replies)
        for keys, ends, data, runs in zip(rows["keys"], rows["ends"], rows["data"], rows["runs"]):
            data, ends = _unpacked(data, ends)
            start = _positions(runs)
            start = start[~_isin(Names(data).at(start, length), alone)]
            step = np.zeros(len(data) + 1, np.int32)
            np.add.at(step, start, 1)
            np.add.at(step, start + length, -1)
            covered = np.cumsum(step[:-1]) > 0
            raw, begin = np.frombuffer(data, np.uint8), 0
            for key, end in zip(keys, ends.tolist()):
                own = covered[begin:end]
                if own.any():
                    kept = hashlib.sha256(raw[begin:end][~own].tobytes()).hexdigest()
                    spans = int(own[0]) + int(((~own[:-1]) & own[1:]).sum())
                    out.append((key, int(own.sum()), spans, kept))
                begin = end
        return pd.DataFrame(out, columns=["key", "n_removed", "n_spans", "kept_sha256"])

    met = candidates.groupBy("block").cogroup(replies.groupBy("block"))
    return met.applyInPandas(cut, "key binary, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH, q: int = ORDER, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = texts(docs).withColumn("text", F.coalesce("text", F.lit("")))
    data = F.col("text").cast("binary")
    rows = rows.withColumns({"n_bytes": F.octet_length(data).cast("long"), "key": F.unhex(F.sha2(data, 256))})
    known = settle(rows.select("doc_id", "n_bytes", "key"), "texts")
    long_enough = known.where(F.col("n_bytes") >= length)
    copies = long_enough.groupBy("key").agg(F.count("*").alias("_copies"), F.min("doc_id").alias("_first"))
    copies = settle(copies.where("_copies > 1"), "copies")
    once = join_settled(rows.where(F.col("n_bytes") >= length), copies, ["key"], "left")
    once = once.where("_copies is null or doc_id <=> _first").select("key", "text")
    packed = settle(blocks_of(once, block), "blocks")

    tuple_bytes = length - (q * q + q + 1) + 1
    total = long_enough.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    share = (q + 1) / (q * q + q + 1)
    names = _sample_names(packed, max(16, int(total * share) // BUCKET), tuple_bytes, q)
    found = settle(_candidates(packed, _neighbours(names, True), length, q), "candidates")
    left = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    strings = _string_names(found, max(16, left // BUCKET), length)
    cut = settle(_cut(found, _neighbours(strings, False), length), "cut")

    result = join_settled(join_settled(known, copies, ["key"], "left"), cut.dropDuplicates(["key"]), ["key"], "left")
    copy = F.col("_copies").isNotNull()
    whole = F.sha2(F.lit("").cast("binary"), 256)
    return result.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, whole).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("key")))).alias("kept_sha256"),
    )

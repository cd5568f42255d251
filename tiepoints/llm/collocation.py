"""Phrase collocations per language, counted by Rabin-Karp fingerprints.

Texts are lower-cased (A-Z only), cut into pieces at ``PIECE`` and into words at blanks and tabs. Of all
contiguous occurrences of 1 to ``LONGEST`` words inside a piece those with ``LEAST`` or more per language are
counted:

1. A task packs the words of one language into blocks, a blank behind each word and a line end behind each
   piece.
2. Prefix sums of byte values times powers give every n-gram of a block a 64-bit fingerprint in constant time.
   The block deals its distinct fingerprints out by value, sorted, as packed differences with their counts;
   the block is the pointer to their occurrences.
3. Each bucket adds up and tells, for every frequent fingerprint, the total to one block that holds it.
4. That block makes text of it. Rare phrases never become text, and a frequent one only once.
5. Verification of all: a bucket also tells every block which of its fingerprints are frequent. The block compares
   all occurrences under each of them byte by byte and sends their texts, packed by bucket, and the bucket compares
   the texts of all blocks. A fingerprint that stands for one text only has that text's count. Phrases that share
   one are counted again by their text; if more than one in ``SHARED`` do, everything is done again with other
   fingerprints, and after ``TRIES`` it fails.
6. Every phrase of the result, and every part that its score rests on, is counted once more in all blocks by its text.

No group is gathered by a key of the data: buckets are ranges of hash values, and a fingerprint occurs once per
block and bucket however frequent its phrase is. So all counts that decide on the result are exact.

A candidate is a phrase of 2 to ``LONGEST`` words. Its score is ``floor(1000000 * a * a / (l * r))`` with the
counts ``a`` of the phrase and ``l``, ``r`` of both sides of a cut, for the cut with the least score (then the
shortest left side). All parts of a frequent phrase are frequent, so both counts are known. Candidates inside a
longer one that is at least half as frequent are dropped.

Null texts are empty, a null language is ``und``. Repeated rows count each. An empty table, or one without
frequent phrases, gives no rows. Counts may reach 10^15.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiepoints.llm.common import give_back
from tiepoints.operators.joins import join_settled, top_per_key
from tiepoints.session import settle

LEAST = 10
LONGEST = 3
TOP = 2000
SHARE_NUM, SHARE_DEN = 50, 100
PIECE = b".,;:!?\x0a\x0b\x0c\x0d"
BLANK, BREAK = 32, 10
BLOCK = 2 << 20
BUCKET = 1 << 20
TRIES = 3
SHARED = 1000
SMALL = 16 << 20  # bytes up to which per-phrase tables are broadcast
_TABLE = bytes(
    BREAK if c in PIECE else BLANK if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256)
)
_END = re.compile(b"[" + PIECE + b"]")
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(12).integers(0, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


# --- words and fingerprints of a block --------------------------------------------------------


def compact(text: bytes) -> tuple[bytes, int]:
    """Words with one byte behind each, a blank or, at the end of a piece, a line end; and their number."""
    raw = np.frombuffer(text.translate(_TABLE) + b"\n", np.uint8)
    word = (raw != BLANK) & (raw != BREAK)
    behind = np.flatnonzero(word[:-1] & ~word[1:]) + 1  # the byte behind every word
    if not len(behind):
        return b"", 0
    breaks = np.cumsum(raw == BREAK)
    start = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
    last = np.append(breaks[start[1:]] != breaks[start[:-1]], True)
    kept = raw.copy()
    kept[behind] = np.where(last, BREAK, BLANK)
    word[behind] = True
    return kept[word].tobytes(), len(behind)


def _power(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.ones(max(n, BLOCK), np.uint64)
        done, factor = 1, base
        while done < len(held):
            take = min(done, len(held) - done)
            held[done : done + take] = held[:take] * np.uint64(factor)
            done, factor = done + take, factor * factor % (1 << 64)
        _powers[base] = held
    return held[:n]


class Grams:
    """Occurrences of 1 to ``LONGEST`` words in the bytes of a block, and their fingerprints."""

    def __init__(self, data: bytes, lang: str, salt: int = 0, bits: int = 64):
        self.raw = np.frombuffer(data, np.uint8)
        self.ends = np.flatnonzero((self.raw == BLANK) | (self.raw == BREAK))
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]).astype(np.int64)
        self.last = self.raw[self.ends] == BREAK
        sums = np.zeros(len(self.raw) + 1, np.uint64)
        np.take(_BYTES, self.raw, out=sums[1:])
        sums[1:] *= _power(_BASE, len(self.raw))
        np.cumsum(sums, out=sums)
        self.sums, self.down = sums, _power(pow(_BASE, -1, 1 << 64), len(self.raw) + 1)
        mixed = hashlib.blake2b(f"{salt}:{lang}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        self.salt, self.factor = np.frombuffer(mixed, np.uint64)
        self.factor |= np.uint64(1)
        self.shift = np.uint64(64 - bits)

    def occurrences(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First byte and the byte behind every occurrence of n words inside a piece."""
        within = np.ones(max(len(self.starts) - n + 1, 0), bool)
        for k in range(n - 1):
            within &= ~self.last[k : k + len(within)]
        first = np.flatnonzero(within)
        return self.starts[first], self.ends[first + n - 1]

    def fingerprints(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = ((self.sums[end] - self.sums[start]) * self.down[start]) * self.factor ^ self.salt
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) >> self.shift


def pack(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted values as differences, byte by byte from the lowest, and counts of one byte or, where that is full, eight."""
    steps = np.diff(values, prepend=np.uint64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    planes = steps.view(np.uint8).reshape(-1, 8)[:, :width].T
    small, large = np.minimum(counts, 255).astype(np.uint8), counts[counts >= 255].astype(np.int64)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([bytes([width]), planes.tobytes(), small.tobytes(), large.tobytes()]))


def unpack(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = int(raw[0])
    planes = np.zeros((size, 8), np.uint8)
    planes[:, :width] = raw[1 : 1 + width * size].reshape(width, size).T
    at = 1 + width * size
    counts = raw[at : at + size].astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw[at + size :].tobytes(), np.int64)
    return np.cumsum(planes.view(np.uint64).ravel(), dtype=np.uint64), counts


def _among(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    if not len(order):
        return np.zeros(len(values), bool)
    return order[np.minimum(np.searchsorted(order, values), len(order) - 1)] == values


def _gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of all bytes of the given stretches, one after the other."""
    before = np.concatenate([[0], np.cumsum(size)[:-1]])
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


def differing(raw: np.ndarray, one: np.ndarray, other: np.ndarray, size: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Which pairs of stretches of equal size differ in a byte."""
    out = np.zeros(len(one), bool)
    total = np.cumsum(size)
    at = 0
    while at < len(one):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + step)))
        sizes = size[at:to]
        unequal = raw[_gather(one[at:to], sizes)] != raw[_gather(other[at:to], sizes)]
        out[at:to] = np.logical_or.reduceat(unequal, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        at = to
    return out


def distinct(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different values and the positions at which each begins in the sorted ``names``."""
    head = np.flatnonzero(np.diff(names, prepend=names[:1] ^ np.uint64(1)) != 0)
    return names[head], head


def text_table(lang: str, grams: Grams, n: int, start: np.ndarray, size: np.ndarray, f: np.ndarray) -> pa.Table:
    """Rows (lang, phrase, words, f) for stretches of a block."""
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    text = pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(grams.raw[_gather(start, size)]))
    columns = {"lang": pa.array([lang] * len(size), pa.string()), "phrase": text, "words": np.full(len(size), n, np.int32), "f": f.astype(np.int64)}
    return pa.table(columns)


NO_TEXTS = pa.table({"lang": pa.array([], pa.string()), "phrase": pa.array([], pa.string()), "words": pa.array([], pa.int32()), "f": pa.array([], pa.int64())})


def _apart(raw: np.ndarray, start: np.ndarray, size: np.ndarray, head: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which stretches differ from the first one of their group."""
    first = start[head][group]
    odd = size != size[head][group]
    same = np.flatnonzero(~odd & (start != first))
    odd[same] = differing(raw, first[same], start[same], size[same])
    return odd


def count_texts(grams: Grams, n: int, frequent: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """First byte, size and count of every different text of n words whose fingerprint is frequent."""
    start, end = grams.occurrences(n)
    name = grams.fingerprints(start, end)
    held = _among(name, frequent)
    start, size, name = start[held], (end - start)[held], name[held]
    order = np.argsort(name, kind="stable")
    start, size, name = start[order], size[order], name[order]
    _, head = distinct(name)
    counts = np.diff(head, append=len(name))
    group = np.repeat(np.arange(len(head)), counts)
    odd = _apart(grams.raw, start, size, head, group)
    if not odd.any():
        return [(start[head], size[head], counts)]
    # Collisions: those groups are counted by their text.
    mixed = np.zeros(len(head), bool)
    mixed[group[odd]] = True
    found: dict[tuple[int, bytes], list[int]] = {}
    for i in np.flatnonzero(mixed[group]):
        own = found.setdefault((int(group[i]), grams.raw[start[i] : start[i] + size[i]].tobytes()), [int(start[i]), int(size[i]), 0])
        own[2] += 1
    apart = np.array(list(found.values()), np.int64).reshape(-1, 3)
    pure = ~mixed
    return [(start[head][pure], size[head][pure], counts[pure]), (apart[:, 0], apart[:, 1], apart[:, 2])]


def _parts(text: bytes, size: int) -> Iterator[bytes]:
    """A text in stretches that end with a piece; only a piece may be longer than ``size``."""
    at = 0
    while len(text) - at > size and (found := _END.search(text, at + size)):
        yield text[at : found.end()]
        at = found.end()
    if at < len(text):
        yield text[at:]


# --- Spark stages -----------------------------------------------------------------------------


def word_blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """block, lang, words (their number), data: the packed words of about ``size`` bytes of one language."""
    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number = TaskContext.get().partitionId() << 32, 0
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal number
            data, words = compact(b"\n".join(held.pop(lang)))
            sizes.pop(lang)
            number += 1
            if words:
                packed = zstandard.ZstdCompressor(level=1).compress(data)
                yield pa.RecordBatch.from_pydict(
                    {"block": [first + number], "lang": [lang], "words": [words], "bytes": [len(data)], "data": [packed]}
                )

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                for part in _parts(text.as_buffer().to_pybytes(), size):
                    held.setdefault(lang, []).append(part)
                    sizes[lang] = sizes.get(lang, 0) + len(part)
                    if sizes[lang] >= size:
                        yield from flush(lang)
                    elif sum(sizes.values()) >= 4 * size:  # many languages
                        yield from flush(max(sizes, key=sizes.get))
        for lang in list(held):
            yield from flush(lang)
        give_back()

    return rows.mapInArrow(build, "block long, lang string, words long, bytes long, data binary")


def _cut(order: np.ndarray, buckets: int, bits: int) -> list[int]:
    """Where the buckets begin in sorted fingerprints, and their end. By the upper bits, so a bucket is a range of the order."""
    cut = np.searchsorted(order, np.array([i * (1 << bits) // buckets for i in range(buckets)], np.uint64))
    return [*cut.tolist(), len(order)]


def _deal(blocks: DataFrame, buckets: int, salt: int, bits: int) -> DataFrame:
    """Rows (bucket, block, size, names): the distinct fingerprints of every block with their counts."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, lang, packed in zip(batch["block"], batch["lang"], batch["data"]):
                grams = Grams(zstandard.ZstdDecompressor().decompress(packed), lang, salt, bits)
                names = [grams.fingerprints(*grams.occurrences(n)) for n in range(1, LONGEST + 1)]
                names = np.sort(np.concatenate(names))
                order, head = distinct(names)
                counts = np.diff(head, append=len(names))
                cut = _cut(order, buckets, bits)
                yield pd.DataFrame(
                    [(i, block, b - a, pack(order[a:b], counts[a:b])) for i, (a, b) in enumerate(zip(cut, cut[1:])) if b > a],
                    columns=["bucket", "block", "size", "names"],
                )
        give_back()

    return blocks.select("block", "lang", "data").mapInPandas(deal, "bucket int, block long, size int, names binary")


def _frequent(dealt: DataFrame, least: int) -> DataFrame:
    """Rows (bucket, block, size, names, held): frequent fingerprints with their totals, each told to the first block that holds it.

    ``held`` is a bit for every fingerprint that the block dealt to the bucket: whether it is frequent.
    """

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        each, counts = zip(*[unpack(n, s) for n, s in zip(rows["names"], rows["size"])])
        sizes = [len(n) for n in each]
        names, block = np.concatenate(each), np.repeat(rows["block"].to_numpy(), sizes)
        by = np.argsort(names, kind="stable")
        order, head = distinct(names[by])
        total = np.add.reduceat(np.concatenate(counts)[by], head)
        told = total >= least
        held = np.empty(len(by), bool)
        held[by] = np.repeat(told, np.diff(head, append=len(by)))
        held = [np.packbits(h).tobytes() for h in np.split(held, np.cumsum(sizes)[:-1])]
        order, total, block = order[told], total[told], block[by][head][told]
        to = np.argsort(block, kind="stable")
        order, total, block = order[to], total[to], block[to]
        cut = [*np.flatnonzero(np.diff(block, prepend=-1)).tolist(), len(block)]
        packed = {block[a]: (b - a, pack(order[a:b], total[a:b])) for a, b in zip(cut, cut[1:])}
        bucket = rows["bucket"].iloc[0]
        out = [(bucket, b, *packed.get(b, (0, None)), h) for b, h in zip(rows["block"], held)]
        del names, block, order, total, each, counts, held
        give_back()
        return pd.DataFrame(out, columns=["bucket", "block", "size", "names", "held"])

    return dealt.groupBy("bucket").applyInPandas(add, "bucket int, block long, size int, names binary, held binary")


def _phrases(blocks: DataFrame, told: DataFrame, buckets: int, salt: int, bits: int) -> DataFrame:
    """The text of every fingerprint that a block was told, and what the buckets need to compare all texts.

    Rows (lang, phrase, words, f) with a total, and rows (lang, bucket, texts) with the different texts of all
    occurrences in a block whose fingerprint is frequent, a line end behind each.
    """

    def make(block: pa.Table, replies: pa.Table) -> pa.Table:
        parts = [NO_TEXTS]
        told = [(n.as_py(), s.as_py()) for n, s in zip(replies.column("names"), replies.column("size"))]
        pairs = [unpack(n, s) for n, s in told if s]
        frequent = np.concatenate([np.zeros(0, np.uint64), *[n for n, _ in pairs]])
        by = np.argsort(frequent)
        frequent, totals = frequent[by], np.concatenate([np.zeros(0, np.int64), *[t for _, t in pairs]])[by]
        sent = {"lang": [], "bucket": [], "texts": []}
        for lang, packed in zip(block.column("lang").to_pylist(), block.column("data")):
            grams = Grams(zstandard.ZstdDecompressor().decompress(packed.as_py()), lang, salt, bits)
            names = []
            for n in range(1, LONGEST + 1):
                start, end = grams.occurrences(n)
                name = grams.fingerprints(start, end)
                held = np.flatnonzero(_among(name, frequent))
                own, first = np.unique(name[held], return_index=True)
                start, size = start[held][first], (end - start)[held][first]
                parts.append(text_table(lang, grams, n, start, size, totals[np.searchsorted(frequent, own)]))
                names.append(name)
            order, _ = distinct(np.sort(np.concatenate(names)))
            kept, cut = np.zeros(len(order), bool), _cut(order, buckets, bits)
            for bucket, held in zip(replies.column("bucket").to_pylist(), replies.column("held")):
                a, b = cut[bucket], cut[bucket + 1]
                kept[a:b] = np.unpackbits(np.frombuffer(held.as_buffer(), np.uint8), count=b - a)
            for bucket, texts in _packages(grams, order[kept], buckets, bits):
                for column, value in zip(sent.values(), (lang, bucket, texts)):
                    column.append(value)
        made = pa.concat_tables(parts)
        none = len(sent["lang"])
        known = made.append_column("bucket", pa.nulls(len(made), pa.int32())).append_column("texts", pa.nulls(len(made), pa.binary()))
        texts = [sent["lang"], pa.nulls(none, pa.string()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.int64()), sent["bucket"], sent["texts"]]
        return pa.concat_tables([known, pa.table(texts, schema=known.schema)])

    met = blocks.select("block", "lang", "data").groupBy("block").cogroup(told.groupBy("block"))
    return met.applyInArrow(make, "lang string, phrase string, words int, f long, bucket int, texts binary")


def _packages(grams: Grams, frequent: np.ndarray, buckets: int, bits: int) -> Iterator[tuple[int, bytes]]:
    """The different texts of a block whose fingerprints are frequent, packed by bucket."""
    found = [texts for n in range(1, LONGEST + 1) for texts in count_texts(grams, n, frequent)]
    start, size = (np.concatenate([texts[i] for texts in found]).astype(np.int64) for i in (0, 1))
    name = grams.fingerprints(start, start + size)
    by = np.argsort(name, kind="stable")
    start, size, name = start[by], size[by], name[by]
    raw = grams.raw[_gather(start, size + 1)]  # a text is at least followed by the byte behind it
    ends = np.cumsum(size + 1)
    raw[ends - 1] = BREAK
    at = np.concatenate([[0], ends])
    cut = _cut(name, buckets, bits)
    for bucket, (a, b) in enumerate(zip(cut, cut[1:])):
        if b > a:
            yield bucket, zstandard.ZstdCompressor(level=1).compress(raw[at[a] : at[b]].tobytes())


def _shared(texts: DataFrame, salt: int, bits: int) -> DataFrame:
    """lang, phrase of all texts that share a frequent fingerprint with another one; ``texts`` are packed by ``_phrases``."""

    def compare(rows: pa.Table) -> pa.Table:
        of_lang: dict[str, list[bytes]] = {}
        for lang, packed in zip(rows.column("lang").to_pylist(), rows.column("texts")):
            of_lang.setdefault(lang, []).append(zstandard.ZstdDecompressor().decompress(packed.as_py()))
        raws, starts, sizes, names, langs, at = [], [], [], [], [], 0
        for number, parts in enumerate(of_lang.values()):
            lang = list(of_lang)[number]
            held: list[bytes] = []
            for i, part in enumerate(parts):
                held.append(part)
                if sum(map(len, held)) < BLOCK // 2 and i + 1 < len(parts):
                    continue
                grams, held = Grams(b"".join(held), lang, salt, bits), []
                end = np.flatnonzero(grams.raw == BREAK)
                start = np.concatenate([[0], end[:-1] + 1])
                names.append(grams.fingerprints(start, end))
                raws.append(grams.raw)
                starts.append(start + at)
                sizes.append(end - start)
                langs.append(np.full(len(start), number, np.int32))
                at += len(grams.raw)
        raw, start, size, name, lang = (np.concatenate(x) for x in (raws, starts, sizes, names, langs))
        del raws, starts, sizes, names, langs
        by = np.argsort(name, kind="stable")
        start, size, lang = start[by], size[by], lang[by]
        _, head = distinct(name[by])
        group = np.repeat(np.arange(len(head)), np.diff(head, append=len(by)))
        odd = _apart(raw, start, size, head, group) | (lang != lang[head][group])
        found = set()
        if odd.any():
            several = np.zeros(len(head), bool)
            several[group[odd]] = True
            known = list(of_lang)
            found = {(known[lang[i]], raw[start[i] : start[i] + size[i]].tobytes().decode("utf-8", "surrogatepass")) for i in np.flatnonzero(several[group])}
        del raw, start, size, name, lang, by, group, odd
        give_back()
        return pa.table({"lang": pa.array([x for x, _ in found], pa.string()), "phrase": pa.array([x for _, x in found], pa.string())})

    return texts.groupBy("bucket").applyInArrow(compare, "lang string, phrase string")


def frequent_phrases(blocks: DataFrame, least: int = LEAST, salt: int = 0, bits: int = 64) -> DataFrame | None:
    """lang, phrase, words, f for all phrases of 1 to ``LONGEST`` words with f >= ``least``, all counts verified.

    ``blocks`` is a written table. None if too many phrases share fingerprints.
    """
    words = blocks.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    buckets = max(16, LONGEST * words // BUCKET)
    told = _frequent(_deal(blocks, buckets, salt, bits), least)
    made = settle(_phrases(blocks, told, buckets, salt, bits), "phrases")
    known = made.where("phrase is not null").select("lang", "phrase", "words", "f")
    shared = settle(_shared(made.where("texts is not null").select("lang", "bucket", "texts"), salt, bits), "shared")
    several = shared.count()
    if not several:
        return known
    if several * SHARED > known.count():
        return None
    exact = settle(recounted(blocks, shared, salt, bits), "recounted")
    again = exact.where(F.col("f") >= least).select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), "f")
    return settle(join_settled(known, exact.select("lang", "phrase"), ["lang", "phrase"], "left_anti").unionByName(again), "phrases")


def recounted(blocks: DataFrame, phrases: DataFrame, salt: int = 0, bits: int = 64) -> DataFrame:
    """Counts by text of everything that has the fingerprint of one of ``phrases`` (a bounded list per language)."""
    listed = settle(phrases.groupBy("lang").agg(F.array_sort(F.collect_set("phrase")).alias("wanted")), "wanted")
    met = join_settled(blocks.select("lang", "data"), listed, ["lang"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lang, data = batch.column("lang")[i].as_py(), batch.column("data")[i].as_py()
                wanted = [p.encode("utf-8", "surrogatepass") for p in batch.column("wanted")[i].as_py()]
                asked = Grams(b"".join(p + b"\n" for p in wanted), lang, salt, bits)
                ends = np.cumsum([len(p) + 1 for p in wanted]) - 1
                names = np.unique(asked.fingerprints(np.concatenate([[0], ends[:-1] + 1]), ends))
                grams = Grams(zstandard.ZstdDecompressor().decompress(data), lang, salt, bits)
                parts = [text_table(lang, grams, n, *found) for n in range(1, LONGEST + 1) for found in count_texts(grams, n, names)]
                yield from pa.concat_tables([NO_TEXTS, *parts]).to_batches()
        give_back()

    found = met.mapInArrow(count, "lang string, phrase string, words int, f long")
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _ranked(known: DataFrame, top: int) -> DataFrame:
    """The first ``top`` candidates of every language: lang, rank, phrase, words, a, l, r, score."""
    phrases = known.where("words >= 2").withColumnRenamed("f", "a")
    side = lambda k: F.substring_index("phrase", " ", k)
    # A phrase of three words holds two of two; longer phrases do not exist here.
    inside = phrases.where("words = 3").select("lang", F.explode(F.array(side(2), side(-2))).alias("phrase"), "a")
    inside = settle(inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer")), "inside")
    kept = join_settled(phrases, inside, ["lang", "phrase"], "left", limit_bytes=SMALL)
    kept = kept.where(F.col("longer").isNull() | (SHARE_DEN * F.col("longer") < SHARE_NUM * F.col("a"))).drop("longer")
    cuts = kept.select("lang", "phrase", "words", "a", F.inline(_cuts()))
    for name, count in (("first", "l"), ("rest", "r")):
        part = known.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
        cuts = join_settled(cuts, part, ["lang", name], limit_bytes=SMALL)
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    product = lambda x, y: (x * y).cast("decimal(38,0)")
    above = product(F.lit(1_000_000).cast("decimal(7,0)"), product(wide("a"), wide("a")).cast("decimal(30,0)"))
    cuts = cuts.withColumns({"above": above, "below": product(wide("l"), wide("r"))})
    scored = cuts.withColumn("score", F.expr("cast(above div below as long)"))
    best = scored.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")
    return top_per_key(best, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top, "rank")


def _cuts() -> Column:
    side = lambda k: F.substring_index("phrase", " ", k)
    two = F.array(F.struct(F.lit(1).alias("k"), side(1).alias("first"), side(-1).alias("rest")))
    three = F.array(
        F.struct(F.lit(1).alias("k"), side(1).alias("first"), side(-2).alias("rest")),
        F.struct(F.lit(2).alias("k"), side(2).alias("first"), side(-1).alias("rest")),
    )
    return F.when(F.col("words") == 2, two).otherwise(three)


def _confirmed(blocks: DataFrame, known: DataFrame, ranked: DataFrame, salt: int, bits: int) -> bool:
    """Whether the phrases of the result and all their parts have the counts that their texts have."""
    parts = ranked.select("lang", "phrase", F.inline(_cuts()))
    rests_on = parts.select("lang", F.explode(F.array("phrase", "first", "rest")).alias("phrase")).distinct()
    # At most 5 * top phrases per language.
    stated = settle(join_settled(known.select("lang", "phrase", "f"), settle(rests_on, "stated"), ["lang", "phrase"], "left_semi"), "stated")
    actual = recounted(blocks, stated, salt, bits).withColumnRenamed("f", "actual")
    return not stated.join(actual, ["lang", "phrase"], "left").where(~F.col("f").eqNullSafe(F.col("actual"))).limit(1).count()


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, block: int = BLOCK, bits: int = 64) -> DataFrame:
    """The ``top`` phrases of every language: lang, rank, phrase, a, l, r, n, score."""
    blocks = settle(word_blocks(docs, block), "word-blocks")
    totals = settle(blocks.groupBy("lang").agg(F.sum("words").alias("n")), "totals")
    for salt in range(TRIES):
        known = frequent_phrases(blocks, least, salt, bits)
        if known is None:
            continue
        ranked = settle(_ranked(known, top), "ranked")
        if _confirmed(blocks, known, ranked, salt, bits):
            named = join_settled(ranked, totals, ["lang"])
            return named.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    raise RuntimeError(f"phrases share fingerprints of {bits} bits in {TRIES} tries")


SQL = r"""
WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
  SELECT lang, unnest(regexp_split_to_array(s, '[.,;:!?\x0A-\x0D]')) AS piece FROM t)),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM p, (SELECT unnest([1, 2, 3]) AS k)),
f AS (SELECT lang, phrase, k, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
inside AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a AS longer FROM c WHERE k = 3),
most AS (SELECT lang, phrase, max(longer) AS longer FROM inside GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN most USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
cut AS (SELECT lang, phrase, a, i, array_to_string(w[1:i], ' ') AS first, array_to_string(w[i + 1:], ' ') AS rest
  FROM kept, (SELECT unnest([1, 2]) AS i) WHERE i < k),
scored AS (SELECT cut.lang, cut.phrase, a, i, x.f AS l, y.f AS r,
  (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = first JOIN f y ON y.lang = cut.lang AND y.phrase = rest),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

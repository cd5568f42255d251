"""Substring dedup: repeated runs of consecutive sentences.

A text is cut into sentences: after a full stop, question or exclamation mark with white space behind it,
and at line breaks. A stretch without such a break is cut further where its words say so: of every
``WINDOW`` consecutive gaps between words at least one is cut, the one of least hash of the two words beside it,
after commas, semicolons, colons and bars first. So a cut depends on the words around it and not on the
length of the sentence or where it stands. A passage of 50 words or more shared by two texts is cut
equally in both from one of its first ``WINDOW`` gaps to one of its last: 20 words and two pieces at least,
which make a run. A sentence is cut the same whatever stands before and after it.

A run is at least ``RUN`` consecutive sentences with at least ``LEAST_WORDS`` words. From every
sentence the shortest run that starts there and the shortest run that ends there are hashed, so a passage
shared by two texts has equal runs in both wherever it stands. Runs are compared as lower-cased words.

The first place of a run is the smallest doc_id, and there its first occurrence. Every sentence covered
by a run at any other place is removed; runs are judged on the input, not on what is left.

Texts are cut together in slices, and a word is hashed once for all its places there. Runs are compared by
64-bit names made of the names of their words; two different runs share one with probability 2^-64.

Run hashes are counted with partial aggregation. A frequent run is met by broadcast (there can be
only a thousand of those), all others by shuffle, so no run is gathered in one task.

Null and empty texts have no runs and stay as they are. Rows that share a doc_id are one place
in the order; a null doc_id is the last. Texts with fewer sentences or words than a run lose nothing.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiepoints.llm.common import back_to_rows, give_back, texts
from tiepoints.llm.repeats import _mix
from tiepoints.operators.joins import join_settled
from tiepoints.session import settle

RUN, LEAST_WORDS = 2, 20
WINDOW = 15  # gaps; 49 of them, less two windows, leave LEAST_WORDS words between the outermost common cuts
SPACE = np.array([chr(i).isspace() for i in range(0x3001)] + [False])  # there is none beyond
END, CLAUSE = frozenset(".!?"), frozenset(",;:|")
LAST = (1 << 63) - 1
CHARS = 1 << 19  # texts cut at a time; a longer one is cut alone
VOCABULARY = 1 << 16  # words whose codes a worker keeps


class Codes(dict):
    """Two 64-bit numbers of a lower-cased word, found once: a name; and its crc32, bit 32 for an END, bit 33 for a CLAUSE."""

    def __missing__(self, word: str) -> bytes:
        data = word.encode("utf-8", "surrogatepass")
        crc = zlib.crc32(data) | (word[-1] in END) << 32 | (word[-1] in CLAUSE) << 33
        self[word] = code = hashlib.blake2b(data, digest_size=8).digest() + crc.to_bytes(8, "little")
        return code


_codes = Codes()


def cuts(code: np.ndarray, line_end: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Behind which words a piece ends: all sentence ends, the least gap of every window, and the ends of texts."""
    h = code & np.uint64(0xFFFFFFFF)
    cut = line_end | (code >> np.uint64(32) & np.uint64(1)).astype(bool)
    least = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(2)
    least += np.where((code[:-1] >> np.uint64(33)).astype(bool), np.uint64(1), np.uint64(1 << 62))
    least[cut[:-1]] = 0
    place, width = np.arange(len(least)), 1
    while width < WINDOW and len(least):
        step = min(width, WINDOW - width)
        # Of equal gaps the last: a window that reaches out of a passage then cuts nothing between its common cuts.
        later = least[step:] <= least[:-step]
        place = np.where(later, place[step:], place[:-step])
        least = np.where(later, least[step:], least[:-step])
        width += step
    cut[place[text[:-WINDOW] == text[WINDOW:]]] = True
    cut[np.flatnonzero(np.diff(text, append=-1))] = True
    return cut


def cut_words(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """All words of the texts, lower-cased: words, number of the text, codes, and whether a piece ends behind it."""
    words: list[str] = []
    sizes, lines = [0], []
    for text in texts:
        for line in text.lower().split("\n"):
            words += line.split()
            lines.append(len(words))
        sizes.append(len(words))
    if len(_codes) > VOCABULARY:
        _codes.clear()
    codes = np.frombuffer(b"".join(map(_codes.__getitem__, words)), "<u8").reshape(-1, 2)
    text = np.repeat(np.arange(len(texts)), np.diff(sizes))
    line_end = np.zeros(len(words) + 1, bool)
    line_end[lines] = True
    return words, text, codes, cuts(codes[:, 1], line_end[1:], text)


def located(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of the texts; with their white space they cover a text. Words of all, then per piece: text, words, start, end."""
    words, text, codes, cut = cut_words(texts)
    ends = np.cumsum([len(t) + 1 for t in texts])
    begins = np.append(0, ends[:-1])
    chars = np.frombuffer(" ".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    space = SPACE[np.minimum(chars, len(SPACE) - 1)]
    at = np.flatnonzero(space[:-1] > space[1:]) + 1  # words
    if len(space) and not space[0]:
        at = np.append(0, at)
    first = np.append(0, np.flatnonzero(cut)[:-1] + 1) if words else np.zeros(0, np.int64)
    start, own = at[first], text[first]
    # The indent of a line stays with it.
    line = np.append(-1, np.flatnonzero(chars == ord("\n")))
    line = line[np.searchsorted(line, start) - 1]
    before = np.maximum(first - 1, 0)
    ended = (codes[before, 1] >> np.uint64(32) & np.uint64(1)).astype(bool)
    start = np.where((line > at[before]) & ~ended, line + 1, start)
    opens = np.diff(own, prepend=-1) > 0
    start = np.where(opens, begins[own], start)
    end = np.where(np.append(opens[1:], True), ends[own] - 1, np.append(start[1:], 0))
    return words, own, np.append(first[1:], len(words)), start - begins[own], end - begins[own]


def sentences(text: str) -> list[tuple[int, int, tuple[str, ...]]]:
    """(start, end, words) of every piece; pieces with their white space cover the text."""
    words, _, last, start, end = located([text])
    out, word = [], 0
    for a, b, n in zip(start.tolist(), end.tolist(), last.tolist()):
        out.append((a, b, tuple(words[word:n])))
        word = n
    return out


def slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts of about ``CHARS`` bytes together, Python objects only here, and the place of the first."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // CHARS
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(size)) + 1, [len(texts)]]).tolist()
    for a, b in zip(bounds, bounds[1:]):
        if b > a:
            yield a, texts.slice(a, b - a).to_pylist()


def done() -> None:
    """A reused worker keeps neither words nor freed memory."""
    _codes.clear()
    give_back()


def runs(total: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (first, end) of the shortest runs that start or end at a piece.

    ``total`` counts the words before every piece and behind the last; the text of a piece has the pieces ``low`` to ``high``.
    """
    at = np.arange(len(low))
    end = np.maximum(np.searchsorted(total, total[:-1] + LEAST_WORDS), at + RUN)
    begin = np.minimum(np.searchsorted(total, total[1:] - LEAST_WORDS, side="right") - 1, at + 1 - RUN)
    forward, backward = at[end <= high], at[begin >= low]
    backward = backward[end[begin[backward]] != backward + 1]
    return np.concatenate([forward, begin[backward]]), np.concatenate([end[forward], backward + 1])


def names_of(names: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Names of stretches of a sequence, each of one element at least: a sum of element and place, mixed."""
    size = end - first
    begin = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(begin, size)
    each = _mix(names[np.repeat(first, size) + place] + (place + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return _mix(np.add.reduceat(each, begin)) if len(size) else each


def runs_of(texts: list[str]) -> tuple[np.ndarray, ...]:
    """All runs of the texts: number of the text, name, first and end (pieces of that text), again."""
    _, text, codes, cut = cut_words(texts)
    total = np.concatenate([[0], np.flatnonzero(cut) + 1])
    text = text[total[:-1]]
    low, high = np.searchsorted(text, text), np.searchsorted(text, text, side="right")
    first, end = runs(total, low, high)
    h = names_of(names_of(codes[:, 0], total[:-1], total[1:]), first, end)
    low, text = low[first], text[first]
    order = np.lexsort((first, h))
    met = (np.diff(h[order]) == 0) & (np.diff(text[order]) == 0)
    again = np.zeros(len(h), bool)
    again[order[1:][met]] = True
    return text, h, first - low, end - low, again


def span_table(docs: DataFrame) -> DataFrame:
    """Every run: place (doc_id, null last), text_hash, h, first, end, again (met before in this text)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, text_hash = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("place", "text_hash"))
            for at, some in slices(batch.column("text")):
                text, h, first, end, again = runs_of(some)
                text += at
                columns = place[text], text_hash[text], h.view(np.int64), first.astype(np.int32), end.astype(np.int32), again
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["place", "text_hash", "h", "first", "end", "again"])
        done()

    rows = _keyed(docs).where("text is not null").select("place", "text_hash", "text")
    return rows.mapInArrow(build, "place long, text_hash long, h long, first int, end int, again boolean")


def _keyed(docs: DataFrame) -> DataFrame:
    return texts(docs).select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("place"), F.xxhash64("text").alias("text_hash"), "text")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """What runs cover that are not at their first place: place, text_hash, runs (disjoint, first and end)."""
    spans = settle(span_table(docs), "runs")
    counts = spans.groupBy("h").agg(F.count("*").alias("n"), F.min("place").alias("first_place"))
    repeated = settle(counts.where("n > 1"), "repeated")
    rows = spans.count()
    met = back_to_rows(spans, repeated, "h", "n", rows, F.xxhash64("place", "first", "end"))
    later = met.where("place != first_place or again")
    later = later.groupBy("place", "text_hash").agg(F.sort_array(F.collect_set(F.struct("first", "end"))).alias("runs"))

    @F.pandas_udf("array<struct<first:int,end:int>>")
    def merged(runs: pd.Series) -> pd.Series:
        out = []
        for found in runs:
            stretches: list[dict[str, int]] = []
            for run in found:
                if stretches and run["first"] <= stretches[-1]["end"]:
                    stretches[-1]["end"] = max(stretches[-1]["end"], run["end"])
                else:
                    stretches.append({"first": run["first"], "end": run["end"]})
            out.append(stretches)
        return pd.Series(out, dtype=object)

    return later.select("place", "text_hash", merged("runs").alias("runs"))


def remove_repeated_runs(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_removed (sentences), n_spans (removed stretches), n_chars, text."""
    later = settle(repeated_runs(docs), "later")

    @F.arrow_udf("n_removed long, n_spans long, text string")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, first, end in batches:
            n_removed, n_spans, kept = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64), []
            hit = pc.and_(pc.is_valid(text), pc.greater(pc.fill_null(pc.list_value_length(first), 0), 0))
            rows = np.flatnonzero(hit.to_numpy(zero_copy_only=False))
            for at, part in slices(text.filter(hit)):
                _, own, _, begins, stops = located(part)
                low = np.searchsorted(own, np.arange(len(part)))
                for row, t, piece in zip(rows[at:].tolist(), part, low):
                    starts, ends = first[row].values.to_numpy(), end[row].values.to_numpy()
                    n_removed[row], n_spans[row] = (ends - starts).sum(), len(starts)
                    between = zip([0, *stops[piece + ends - 1].tolist()], [*begins[piece + starts].tolist(), len(t)])
                    kept.append("".join(t[a:b] for a, b in between))
            left = pc.replace_with_mask(text, hit, pa.array(kept, text.type))
            yield pa.StructArray.from_arrays([pa.array(n_removed), pa.array(n_spans), left], ["n_removed", "n_spans", "text"])
        done()

    joined = join_settled(_keyed(docs), later, ["place", "text_hash"], "left")
    result = joined.select("doc_id", cut("text", F.col("runs")["first"], F.col("runs")["end"]).alias("r"))
    return result.select("doc_id", "r.n_removed", "r.n_spans", F.length("r.text").cast("long").alias("n_chars"), "r.text")

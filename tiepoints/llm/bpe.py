"""Byte-level BPE encoding and decoding that reuses content-defined chunks.

A text is cut where a rolling hash of its last 32 bytes hits a mask, so that passages shared by
documents fall into equal chunks wherever they stand. Only the inside of a chunk, from its first
to its last word start, is encoded as a chunk; what lies between the inner parts of two chunks is
the join. It is encoded anew, and grows over chunks without a word start until both ends are places
where every tokenization of the whole text must break. So the tokens equal those of the whole text.

Chunks are counted over the corpus. The ``DICTIONARY`` most frequent ones are encoded once, in the
task that holds the first document with them, and shipped to every task; the other shared chunks
are encoded once per task and kept in a cache of ``CACHE_BYTES``. No text is shuffled.

A null text is encoded as the empty text: no tokens. Repeated rows and ties give equal results.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiepoints.llm.common import filled, give_back, texts

DICTIONARY = 8192
CACHE_BYTES = 32 << 20
MEAN_BITS, LEAST_CHUNK = 11, 256
#: What ``\s`` means to the two tokenizer libraries differs in no place where this cuts: a visible
#: ASCII character followed by ASCII white space. No token reaches over such a place.
BREAK = re.compile(rb"(?<=[!-~])[ \t\r\n]")
# Fixed value: the split pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _gear() -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


GEAR = _gear()


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``; cuts stand before the first byte of a character."""
    n = len(data)
    if n <= LEAST_CHUNK:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    rolling = GEAR[raw]
    for width in (1, 2, 4, 8, 16):
        shifted = rolling[:-width] << np.uint32(width)
        rolling = rolling.copy()
        rolling[width:] += shifted
    hits = np.flatnonzero(rolling[:-1] >> np.uint32(32 - MEAN_BITS) == 0) + 1
    hits = hits[(raw[hits] & 0xC0) != 0x80]
    ends, last = [], 0
    for hit in hits.tolist():
        if hit - last >= LEAST_CHUNK:
            ends.append(hit)
            last = hit
    if n - last:
        ends.append(n)
    return ends


def chunk_key(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


class Coder:
    """The vocabulary at ``path``, and the chunk reuse of one task."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        to_byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {
            bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special
        }
        self._bpe = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._bytes = [b""] * (max([*ranks.values(), *special.values()]) + 1)
        for token, i in ranks.items():
            self._bytes[i] = token
        for token, i in special.items():
            self._bytes[i] = token.encode()
        self.texts = [str(i) for i in range(len(self._bytes))]
        self._specials = "all" if special else set()
        self.shared: dict[bytes, array] = {}
        self._cache: dict[bytes, array] = {}
        self._cached = 0
        self.encoded = 0  # chunks encoded, not reused

    def release(self) -> None:
        """Forget reused chunks at the end of a task; the worker may go on to other work."""
        self._cache.clear()
        self.shared, self._cached = {}, 0

    def plain(self, data: bytes) -> list[int]:
        return self._bpe.encode(data.decode("utf-8"), allowed_special=self._specials) if data else []

    def inner(self, chunk: bytes, first: int, last: int) -> array:
        """Tokens between the first and last break of a chunk, encoded or reused."""
        key = chunk_key(chunk)
        ids = self.shared.get(key)
        if ids is None:
            ids = self._cache.get(key)
        if ids is None:
            ids = array("i", self.plain(chunk[first:last]))
            self.encoded += 1
            size = 200 + 4 * len(ids)
            if self._cached + size > CACHE_BYTES:
                self._cache.clear()
                self._cached = 0
            self._cache[key] = ids
            self._cached += size
        return ids

    def encode(self, text: str) -> list[int]:
        data, out, join, start = text.encode("utf-8"), [], b"", 0
        for end in cut_points(data):
            chunk = data[start:end]
            start = end
            found = BREAK.search(chunk)
            if found is None:  # nothing in it is a sure break: the join grows over it
                join += chunk
                continue
            first, last = found.start(), _last_break(chunk)
            out += self.plain(join + chunk[:first])
            out += self.inner(chunk, first, last)
            join = chunk[last:]
        return out + self.plain(join)

    def decode_bytes(self, ids: list[int]) -> bytes:
        table = self._bytes
        return b"".join([table[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def _last_break(chunk: bytes) -> int:
    at = len(chunk)
    while True:
        at = max(chunk.rfind(c, 0, at) for c in (b" ", b"\t", b"\r", b"\n"))
        if BREAK.match(chunk, at):
            return at


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def chunk_census(docs: DataFrame) -> DataFrame:
    """Every chunk with a break inside that occurs more than once: key, occurrences, smallest doc_id."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, found = [], []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                data, start = text.encode("utf-8"), 0
                for end in cut_points(data):
                    ids.append(doc_id)
                    found.append(chunk_key(data[start:end]))
                    start = end
            yield pd.DataFrame({"key": found, "doc_id": pd.array(ids, dtype="Int64")})

    rows = texts(docs).withColumn("text", filled(F.col("text"))).mapInPandas(keys, "key binary, doc_id long")
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where("n > 1")


def dictionary(docs: DataFrame, path: str, size: int = DICTIONARY) -> dict[bytes, array]:
    """The ``size`` most frequent chunks and their inner tokens, each encoded in one place.

    The only rows that reach the driver: at most ``size`` chunks.
    """
    top = chunk_census(docs).orderBy(F.desc("n"), "key").limit(size)
    wanted = F.broadcast(top.where("doc_id is not null").groupBy("doc_id").agg(F.collect_list("key").alias("keys")))
    held = texts(docs).where("text is not null").join(wanted, "doc_id").select("text", "keys")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = coder(path)
        for batch in batches:
            out = []
            for text, keys in zip(batch["text"], batch["keys"]):
                data, start, missing = text.encode("utf-8"), 0, {bytes(k) for k in keys}
                for end in cut_points(data):
                    chunk = data[start:end]
                    start = end
                    found = BREAK.search(chunk)
                    if found and (key := chunk_key(chunk)) in missing:
                        missing.discard(key)
                        out.append((key, own.plain(chunk[found.start() : _last_break(chunk)])))
            yield pd.DataFrame(out, columns=["key", "ids"])

    found = held.mapInPandas(encode, "key binary, ids array<int>").toLocalIterator()
    return {bytes(r.key): array("i", r.ids) for r in found}


def _coder_with(path: str, shared) -> Coder:
    own = coder(path)
    own.shared = shared.value
    return own


def encode_documents(docs: DataFrame, path: str, size: int = DICTIONARY) -> DataFrame:
    """``doc_id``, ``text`` and the token ids of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionary(docs, path, size))

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = _coder_with(path, shared)
        for batch in batches:
            yield pd.Series([own.encode(t) for t in batch], dtype=object)
        own.release()

    return texts(docs).withColumn("ids", encode(filled(F.col("text"))))


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """Replace the column ``ids`` by ``decoded``, the text of those tokens."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = coder(path)
        for batch in batches:
            yield pd.Series([None if ids is None else own.decode(ids) for ids in batch], dtype=object)

    return encoded.withColumn("decoded", decode("ids")).drop("ids")


def encode_digest(docs: DataFrame, path: str, size: int = DICTIONARY) -> DataFrame:
    """Encode, decode and digest every document in one task each: tokens do not travel."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionary(docs, path, size))

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _coder_with(path, shared)
        for batch in batches:
            sizes, listed, decoded = [], [], []
            for text in batch:  # one text at a time becomes a Python object
                ids = own.encode(text.as_py())
                sizes.append(len(ids))
                listed.append(hashlib.sha256(",".join([own.texts[i] for i in ids]).encode()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids).encode("utf-8")).hexdigest())
            columns = [pa.array(sizes, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())]
            yield pa.StructArray.from_arrays(columns, ["n_tokens", "ids_sha256", "decoded_sha256"])
        own.release()
        give_back()

    return texts(docs).select("doc_id", digest(filled(F.col("text"))).alias("d")).select("doc_id", "d.*")

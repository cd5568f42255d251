"""Ranked lexical search: the best documents of every item, by integer scores, with a hybrid of TAAT and DAAT.

Index. Each task cuts its documents into blocks of at most ``BLOCK_DOCS`` rows in order of doc_id and writes,
for the terms that items ask for, packed postings: positions in the block and frequencies. Corpus statistics
(documents, terms, document frequencies) are sums over all blocks and therefore over all rows.

Search of an item in a block:

1. Term at a time: the shortest lists, with at most ``SHORT`` postings together, are summed up by document.
2. The sums become one more list whose scores are bounded by their largest. The k-th largest sum is a
   threshold, since scores only grow.
3. Document at a time: the documents are passed in ranges of ``RANGE`` positions, in order. A range whose lists'
   greatest scores do not add up to the threshold is skipped, by the offsets of every list; the others are
   scored exactly, and the threshold rises with the k best documents found.

A range is left out only if none of its documents can enter the k best: equal scores go to the smaller
doc_id, which was met before. The k best of each block are ranked again over all blocks.

Items are searched in groups of at most ``GROUP_BYTES`` of text. A group's terms are what a task holds beside
its block, and what is collected to hand them to tasks; more items mean more groups.

Defined results. Null and empty texts hold no term: they do not count as documents and match nothing. Rows that
repeat a doc_id are ranked each; a null doc_id comes behind all others. Rows that share an item_id are one
item with the terms of all. An item without terms or matches has no rows, and so has an empty table.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import floor, log

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiepoints.operators.joins import top_per_key
from tiepoints.session import settle

TOP = 50
BLOCK_DOCS = 8192
BLOCK_POSTINGS = 4 << 20
SHORT = 4096
RANGE = 64
GROUP_BYTES = 4 << 20
NO_ID = (1 << 63) - 1
#: On UTF-8 bytes: letters and digits of ASCII, and every byte above it.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms_of(text: str | None) -> list[bytes]:
    """Terms in order; ``bytes.lower`` changes A-Z only."""
    return TERM.findall((text or "").encode("utf-8", "surrogatepass").lower())


# --- index ------------------------------------------------------------------------------------


@dataclass
class Block:
    """Postings of a block by term: ``terms[i]`` has ``at[cut[i]:cut[i + 1]]`` and as many ``tf``."""

    ids: np.ndarray
    lengths: np.ndarray
    terms: np.ndarray
    cut: np.ndarray
    at: np.ndarray
    tf: np.ndarray


def build_index(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """One row per block: its documents (those with terms), their lengths, and postings of the vocabulary."""
    number = {t: i for i, t in enumerate(vocabulary)}

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, made = TaskContext.get().partitionId() << 32, 0
        ids, lengths, at, term, tf = (array(kind) for kind in "qqiii")

        def flush() -> pd.DataFrame:
            nonlocal ids, lengths, at, term, tf, made
            order = np.argsort(np.array(ids, np.int64), kind="stable")
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            where, which, times = place[np.array(at, np.int64)], np.array(term, np.int64), np.array(tf, np.int64)
            by = np.lexsort((where, which))
            known, count = np.unique(which, return_counts=True)
            out = {
                "block": [first + made], "docs": [len(ids)], "length": [sum(lengths)], "ids": [np.array(ids, np.int64)[order].tobytes()],
                "lengths": [np.array(lengths, np.int64)[order].tobytes()], "terms": [known.tolist()], "df": [count.tolist()],
                "at": [where[by].astype(np.int32).tobytes()], "tf": [times[by].astype(np.int32).tobytes()],
            }
            ids, lengths, at, term, tf = (array(kind) for kind in "qqiii")
            made += 1
            return pd.DataFrame(out)

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                found = terms_of(text)
                if not found:
                    continue
                for t, n in Counter(found).items():
                    i = number.get(t)
                    if i is not None:
                        at.append(len(ids)), term.append(i), tf.append(n)
                ids.append(doc_id), lengths.append(len(found))
                if len(ids) >= BLOCK_DOCS or len(at) >= BLOCK_POSTINGS:
                    yield flush()
        if ids:
            yield flush()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "block long, docs long, length long, ids binary, lengths binary, terms array<int>, df array<long>, at binary, tf binary"
    return rows.mapInPandas(build, schema)


def _unpacked(row) -> Block:
    count = np.asarray(row.df, np.int64)
    return Block(
        np.frombuffer(row.ids, np.int64), np.frombuffer(row.lengths, np.int64), np.asarray(row.terms, np.int64),
        np.concatenate([[0], np.cumsum(count)]), np.frombuffer(row.at, np.int32), np.frombuffer(row.tf, np.int32),
    )


# --- search of one block ------------------------------------------------------------------------


def summed(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Term at a time: positions that occur in any of the lists, in order, and their exact sums."""
    at = np.concatenate([np.zeros(0, np.int32), *[a for a, _ in lists]])
    score = np.concatenate([np.zeros(0, np.int64), *[s for _, s in lists]])
    if not len(at):
        return at, score
    order = np.argsort(at, kind="stable")
    at, score = at[order], score[order]
    head = np.flatnonzero(np.diff(at, prepend=-1) != 0)
    return at[head], np.add.reduceat(score, head)


def split_lists(lists: list[tuple[np.ndarray, np.ndarray]], short: int) -> tuple[list, list]:
    """The shortest lists with at most ``short`` postings together, and the others."""
    lists = sorted(lists, key=lambda x: len(x[0]))
    total = np.cumsum([len(a) for a, _ in lists])
    n = int(np.searchsorted(total, short, side="right"))
    return lists[:n], lists[n:]


def range_bounds(at: np.ndarray, score: np.ndarray, n_ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets at which every range begins in a list, and the greatest score of every range (0 if none)."""
    offset = np.searchsorted(at, np.arange(n_ranges + 1) * RANGE)
    most = np.zeros(n_ranges, np.int64)
    full = np.flatnonzero(np.diff(offset))
    if len(full):
        most[full] = np.maximum.reduceat(score, offset[full])
    return offset, most


def best_of(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int = TOP, short: int = SHORT, met: list | None = None):
    """Positions and scores of the k best documents; ``met`` gets the number of ranges that were scored."""
    few, many = split_lists(lists, short)
    sums = summed(few)
    iterators = [sums, *many] if len(sums[0]) else many
    n_ranges = -(-n_docs // RANGE)
    if not iterators:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = max(1, int(np.partition(sums[1], -k)[-k])) if len(sums[0]) >= k else 1
    bounds = [range_bounds(at, score, n_ranges) for at, score in iterators]
    bound = np.sum([most for _, most in bounds], axis=0)
    best_at, best_score = np.zeros(0, np.int64), np.zeros(0, np.int64)
    scored = 0
    left = np.flatnonzero(bound >= least)
    while len(left):
        # Neighbours are scored together; far ones would be scored before the threshold has risen.
        take = left[:8][left[:8] < left[0] + 8]
        lo, hi = int(take[0]), int(take[-1]) + 1
        dense = np.zeros((hi - lo) * RANGE, np.int64)
        for (at, score), (offset, _) in zip(iterators, bounds):
            a, b = offset[lo], offset[hi]
            if b > a:
                dense[at[a:b] - lo * RANGE] += score[a:b]
        scored += hi - lo
        good = np.flatnonzero(dense >= least)
        at, score = np.concatenate([best_at, good + lo * RANGE]), np.concatenate([best_score, dense[good]])
        order = np.lexsort((at, -score))[:k]
        best_at, best_score = at[order], score[order]
        if len(order) == k:
            # Documents behind come after those found, so they need more than the least of the k.
            least = max(least, int(best_score[-1]) + 1)
        left = left[len(take) :]
        left = left[bound[left] >= least]
    if met is not None:
        met.append(scored)
    return best_at, best_score


def term_scores(block: Block, weight: np.ndarray, n_docs: int, n_terms: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Positions and contributions of every term of the block that has a weight."""
    m = 50 + (50 * block.lengths * n_docs) // n_terms
    out = {}
    for i, term in enumerate(block.terms.tolist()):
        if weight[term] > 0:
            at, tf = block.at[block.cut[i] : block.cut[i + 1]], block.tf[block.cut[i] : block.cut[i + 1]].astype(np.int64)
            score = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[at]))
            out[term] = (at, score)
    return out


# --- Spark --------------------------------------------------------------------------------------


def _search(index: DataFrame, items: dict, weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                block = _unpacked(row)
                scores = term_scores(block, weight, n_docs, n_terms)
                found = [best_of([scores[t] for t in terms if t in scores], len(block.ids), k) for terms in items.values()]
                at = np.concatenate([np.zeros(0, np.int64), *[a for a, _ in found]])
                score = np.concatenate([np.zeros(0, np.int64), *[s for _, s in found]])
                item = np.repeat(np.arange(len(found)), [len(a) for a, _ in found])
                yield pd.DataFrame({"item": item, "doc_id": block.ids[at], "score": score, "block": row.block, "at": at})

    found = index.mapInPandas(search, "item int, doc_id long, score long, block long, at long")
    return top_per_key(found, ["item"], [F.desc("score"), "doc_id", "block", "at"], k, "rank")


def _group_of(items: DataFrame, group_bytes: int) -> tuple[DataFrame, int]:
    """Items with the number of their group; rows of one item share it."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    groups = max(1, -(-2 * total // group_bytes))
    return rows.withColumn("group", F.pmod(F.xxhash64("item_id"), F.lit(groups))), groups


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item."""
    spark = docs.sparkSession
    grouped, groups = _group_of(items, group_bytes)
    grouped = settle(grouped, "items") if groups > 1 else grouped
    out = []
    for group in range(groups):
        # About half of group_bytes: the hash deals items out evenly.
        terms: dict = {}
        for row in grouped.where(F.col("group") == group).select("item_id", "text").toLocalIterator():
            terms.setdefault(row["item_id"], set()).update(terms_of(row["text"]))
        vocabulary = sorted(set().union(*terms.values()))
        number = {t: i for i, t in enumerate(vocabulary)}
        asked = {item: sorted(number[t] for t in own) for item, own in terms.items()}
        index = settle(build_index(docs, vocabulary), "index")
        n_docs, n_terms = index.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()
        weight = np.zeros(len(vocabulary), np.int64)
        counted = index.select(F.inline(F.arrays_zip("terms", "df"))).groupBy("terms").agg(F.sum("df").alias("df"))
        for row in counted.toLocalIterator():  # at most one row per term of the group
            weight[row["terms"]] = floor(1000 * log((2 * n_docs + 2) / (2 * row["df"] + 1)))
        named = spark.createDataFrame([(i, item) for i, item in enumerate(asked)], "item int, item_id long")
        found = _search(index, asked, weight, n_docs, n_terms, k)
        doc_id = F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")
        out.append(found.join(F.broadcast(named), "item").select("item_id", "rank", doc_id, "score"))
    return reduce(DataFrame.unionByName, out)


SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT doc_id, w, len(w) AS n FROM t WHERE len(w) > 0),
s AS (SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, nd),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0)
SELECT * FROM k WHERE rank <= 50
"""

"""Benchmark decontamination by size-partitioned MinHash containment search.

Texts are lower-cased; words are runs of letters and digits, shingles are five words. A benchmark item
is contained in a document that has at least four fifths of its distinct shingles.

Items are partitioned by size (powers of two). An item's sketch is its bottom-k MinHash: the k
shingles of smallest hash, where k is one more than the shingles that an item of the partition's
largest size may miss. So a document that contains the item has at least one shingle of the sketch,
and the search loses nothing however long the document is. Documents below four fifths of the item's
size are not candidates. Candidates are verified on all shingles, compared as text.

Only DataFrame functions are used. The sketch and the item table are broadcast only up to a counted
size and joined by shuffle beyond it; documents move only if the candidates exceed that size too.

Null and short texts contain nothing; items that are null, have a null id or fewer than five words
are not searched for. Rows equal in doc_id and text have equal results. Equal items are
reported under each of their ids. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tiepoints.llm.common import filled, texts
from tiepoints.operators.joins import join_settled
from tiepoints.session import once, settle

WORDS = 5
LEAST_NUM, LEAST_DEN = 4, 5  # contained: shingles found / shingles of the item >= 4/5

#: Names no table of documents is asked to keep; rows are known by doc_id and text.
_KEY = ["_doc", "_text_hash"]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def _starts(words: Column, size: int) -> Column:
    """Positions at which a shingle begins, from 0; none in a short text."""
    n = F.size(words) - size
    return F.when(n >= 0, F.sequence(F.lit(0), F.greatest(n, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _hash_at(words: Column, i: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(words, i + k) for k in range(size)])


def _keyed(docs: DataFrame) -> DataFrame:
    return texts(docs).select(
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_doc"), F.xxhash64("text").alias("_text_hash"),
        F.col("doc_id"), F.col("text"),
    )


def item_shingles(items: DataFrame, size: int = WORDS) -> DataFrame:
    """Distinct shingles of every item: item, item_id, n (shingles of the item), shingle, h, in_sketch, least."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where("item_id is not null and text is not null").distinct()
    rows = once(rows, item=F.xxhash64("item_id", "text"), w=words_of(F.col("text"))).drop("text")
    pieces = F.transform(
        _starts(F.col("w"), size),
        lambda i: F.struct(F.array_join(F.slice("w", i + 1, size), " ").alias("shingle"), _hash_at(F.col("w"), i, size).alias("h")),
    )
    rows = rows.select("item", "item_id", F.inline(F.array_distinct(pieces)))
    item = W.partitionBy("item")
    rows = rows.withColumn("n", F.count("*").over(item))
    largest = F.pow(F.lit(2), F.floor(F.log2(F.col("n"))) + 1).cast("long") - 1
    may_miss = F.floor(largest * (LEAST_DEN - LEAST_NUM) / LEAST_DEN)
    return (
        rows.withColumn("in_sketch", F.row_number().over(item.orderBy("h", "shingle")) <= may_miss + 1)
        .withColumn("least", F.ceil(F.col("n") * LEAST_NUM / LEAST_DEN))
    )


def search(docs: DataFrame, items: DataFrame, size: int = WORDS) -> DataFrame:
    """Pairs of documents and items contained in them: the key of the document, item_id, containment.

    ``_doc`` and ``_text_hash`` are the key of ``_keyed``.
    """
    held = settle(item_shingles(items, size), "items")
    sketch = settle(held.where("in_sketch").select("h", "item", "least"), "sketch")
    found = once(_keyed(docs).select(*_KEY, "text"), w=words_of(filled(F.col("text")))).drop("text")
    hashes = F.transform(_starts(F.col("w"), size), lambda i: _hash_at(F.col("w"), i, size))
    probes = found.select(*_KEY, (F.size("w") - size + 1).alias("_n"), F.explode(hashes).alias("h"))
    # A document of fewer shingles than an item needs is no candidate for it.
    hits = join_settled(probes, sketch, ["h"]).where(F.col("_n") >= F.col("least"))
    candidates = settle(hits.select(*_KEY, "item").distinct(), "candidates")
    wanted = settle(candidates.select(*_KEY).distinct(), "candidate-docs")
    again = join_settled(_keyed(docs).select(*_KEY, "text"), wanted, _KEY).dropDuplicates(_KEY)
    again = once(again, w=words_of(F.col("text"))).drop("text")
    pieces = F.transform(
        _starts(F.col("w"), size),
        lambda i: F.struct(_hash_at(F.col("w"), i, size).alias("h"), F.array_join(F.slice("w", i + 1, size), " ").alias("_s")),
    )
    shingles = again.select(*_KEY, F.inline(pieces))
    exact = join_settled(shingles, held.drop("in_sketch", "least"), ["h"]).where(F.col("_s") == F.col("shingle"))
    counted = exact.select(*_KEY, "item", "item_id", "n", "h", "_s").distinct().groupBy(*_KEY, "item", "item_id", "n")
    verified = counted.agg(F.count("*").alias("hits")).where(F.col("hits") * LEAST_DEN >= F.col("n") * LEAST_NUM)
    return verified.join(candidates, [*_KEY, "item"], "left_semi").select(
        *_KEY, "item_id", (F.col("hits") / F.col("n")).alias("containment")
    )


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WORDS) -> DataFrame:
    """One row per document: doc_id, n_items, items (ascending, comma-joined), containment, kept."""
    pairs = search(docs, items, size).groupBy(*_KEY, "item_id").agg(F.max("containment").alias("containment"))
    per_doc = settle(
        pairs.groupBy(*_KEY).agg(
            F.count("*").alias("n_items"),
            F.array_sort(F.collect_list("item_id")).alias("ids"),
            F.max("containment").alias("containment"),
        ).withColumn("items", F.array_join(F.col("ids").cast("array<string>"), ",")).drop("ids"),
        "contaminated",
    )
    joined = join_settled(_keyed(docs).select(*_KEY, "doc_id"), per_doc, _KEY, "left")
    return joined.select(
        "doc_id",
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.lit("")).alias("items"),
        F.round(F.coalesce("containment", F.lit(0.0)), 6).alias("containment"),
        F.col("n_items").isNull().alias("kept"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = WORDS) -> DataFrame:
    """The documents that contain no item, with all their columns."""
    dirty = settle(search(docs, items, size).select(*_KEY).distinct(), "contaminated")
    own = docs.withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    own = own.withColumn("_text_hash", F.xxhash64(F.col("text").cast("string")))
    return join_settled(own, dirty, _KEY, "left_anti").drop(*_KEY)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM d),
bs AS (SELECT DISTINCT item_id, text, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM b),
bn AS (SELECT item_id, text, count(*) AS n FROM bs GROUP BY ALL),
hit AS (SELECT doc_id, item_id, max(c / n) AS containment FROM (
    SELECT doc_id, item_id, text, count(*) AS c FROM ds JOIN bs USING (s) GROUP BY ALL) JOIN bn USING (item_id, text)
  WHERE c * 5 >= n * 4 GROUP BY ALL),
per AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items,
  max(containment) AS containment FROM hit GROUP BY doc_id)
SELECT doc_id, coalesce(n_items, 0) AS n_items, coalesce(items, '') AS items,
  round(coalesce(containment, 0.0), 6) AS containment, n_items IS NULL AS kept
FROM documents LEFT JOIN per USING (doc_id)
"""

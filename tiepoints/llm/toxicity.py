"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document's features are the hashed n-grams that occur in it. Each is scaled by the log ratio of its
smoothed document frequencies in the two classes, and a logistic regression is fitted on top. The
fit sees at most ``PER_CLASS`` labelled documents of each class, those with the smallest hash
of doc_id; every document of the table is scored on its whole text.

Null texts score as empty ones do. A label that is null does not count; conflicting labels of one
doc_id count as toxic; if several texts share a labelled doc_id the fit sees the smallest. Without any
toxic example all scores are 0, without any other 1. Rows do not affect each other's score.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiepoints.llm.common import filled, give_back, texts
from tiepoints.session import settle

PER_CLASS = 4096
BITS = 18
LENGTHS = (3, 4, 5, 6)
#: N-grams whose frequencies differ most between the classes; the others get no weight.
SELECTED = 1 << 12
RIDGE = 1e-3


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # float32, one per hash value
    bias: float


def hashed_ngrams(text: str) -> np.ndarray:
    """Hash values of all n-grams of the lower-cased text, with repeats."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out, rolled = [], np.zeros(len(points) + 1, np.uint32)
    for n in range(1, max(LENGTHS) + 1):
        if len(points) < n:
            break
        rolled = (rolled[:-1] if n > 1 else rolled[: len(points)]) * np.uint32(0x01000193) + points[n - 1 :]
        if n in LENGTHS:
            mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.uint32(n * 0x2C1B3C6D & 0xFFFFFFFF)
            out.append(mixed >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """At most ``per_class`` documents of each class: toxic, text. Held-out rows never appear."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    first = [
        known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)
    ]
    chosen = F.broadcast(first[0].unionAll(first[1]))  # at most 2 * per_class rows
    held = texts(docs).join(chosen, "doc_id").withColumn("text", filled(F.col("text")))
    return held.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))


def _class_counts(rows: DataFrame) -> DataFrame:
    """Documents of each class with an n-gram: gram, p (toxic), q (others).

    Every task adds up its own documents first and emits a hash value once.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for toxic, text in zip(batch["toxic"], batch["text"]):
                held[toxic, np.unique(hashed_ngrams(text))] += 1
        give_back()
        seen = np.flatnonzero(held.any(axis=0))
        yield pd.DataFrame({"gram": seen.astype(np.int32), "p": held[1, seen], "q": held[0, seen]})

    counted = rows.mapInPandas(count, "gram int, p long, q long")
    return counted.groupBy("gram").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))


def _fit(rows: pd.DataFrame, ratios: np.ndarray, step: int = 256) -> pd.DataFrame:
    """Logistic regression by L-BFGS over rows of (toxic, packed positions of features); classes weigh equally.

    Documents are passed in groups of ``step``, so that only the positions of all are held at a time.
    """
    y = rows["toxic"].to_numpy() > 0
    each = [np.frombuffer(p, np.int16) for p in rows["at"]]
    groups = [slice(i, i + step) for i in range(0, len(each), step)]
    held = [(np.concatenate(each[g]), np.array([len(p) for p in each[g]])) for g in groups]
    size = len(ratios)
    weight = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())
    sign = np.where(y, 1.0, -1.0)

    def loss(z):
        scaled, total, grad, bias = z[:-1] * ratios, 0.0, np.zeros(size), 0.0
        for g, (at, lengths) in zip(groups, held):
            at = at.astype(np.intp)
            margin = sign[g] * (np.bincount(np.repeat(np.arange(len(lengths)), lengths), scaled[at], len(lengths)) + z[-1])
            slope = -weight[g] * sign[g] / (1 + np.exp(np.clip(margin, -500, 500)))
            grad += np.bincount(at, np.repeat(slope, lengths), size)
            total += weight[g] @ np.logaddexp(0, -margin)
            bias += slope.sum()
        grad = grad * ratios + RIDGE * z[:-1]
        return total + RIDGE / 2 * z[:-1] @ z[:-1], np.append(grad, bias)

    z, history = np.zeros(size + 1), deque(maxlen=8)
    now, grad = loss(z)
    for _ in range(100):
        step, used = -grad, []
        for s, d, rho in reversed(history):
            used.append(rho * (s @ step))
            step = step - used[-1] * d
        if history:
            s, d, _ = history[-1]
            step = step * (s @ d) / (d @ d)
        for (s, d, rho), a in zip(history, reversed(used)):
            step = step + s * (a - rho * (d @ step))
        rate, slope = 1.0, grad @ step
        while rate > 1e-8:
            then, grad_then = loss(z + rate * step)
            if then <= now + 1e-4 * rate * slope:
                break
            rate /= 2
        s, d = rate * step, grad_then - grad
        if s @ d > 1e-14:
            history.append((s, d, 1 / (s @ d)))
        z, done = z + s, now - then < 1e-7 * max(1.0, now)
        now, grad = then, grad_then
        if done:
            break
    give_back()
    return pd.DataFrame({"at": np.arange(size + 1), "weight": z})


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Counts and regression run in tasks; at most ``SELECTED`` weights reach the driver."""
    rows = settle(training_rows(docs, labels, per_class), "toxicity")
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    weights = np.zeros(1 << BITS, np.float32)
    if not toxic or not other:
        return Model(weights, np.inf if toxic else -np.inf)
    p, q, share = F.col("p"), F.col("q"), (F.col("p") + F.col("q")) / (toxic + other)
    ratio = F.log((p + 1) / (toxic + 2)) - F.log((q + 1) / (other + 2))
    apart = F.abs(p / toxic - q / other) / F.sqrt(share * (1 - share) + 1e-6)
    top = _class_counts(rows).select("gram", ratio.alias("ratio"), apart.alias("apart"))
    top = top.orderBy(F.desc("apart"), "gram").limit(SELECTED).select("gram", "ratio").toPandas()
    grams, ratios = top["gram"].to_numpy(), top["ratio"].to_numpy()
    position = np.full(1 << BITS, -1, np.int32)
    position[grams] = np.arange(len(grams))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for text in batch.column("text"):
                at = np.unique(position[hashed_ngrams(text.as_py())])
                packed.append(at[at >= 0].astype(np.int16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(packed, pa.binary())], ["toxic", "at"])
        give_back()

    # At most 2 * per_class rows of at most SELECTED positions of two bytes.
    bounded = rows.select("toxic", "text").mapInArrow(features, "toxic int, at binary").withColumn("all", F.lit(0))
    fitted = bounded.groupBy("all").applyInPandas(lambda rows: _fit(rows, ratios), "at int, weight double")
    fitted = fitted.toPandas().sort_values("at")
    found = fitted["weight"].to_numpy()
    weights[grams[: len(found) - 1]] = found[:-1] * ratios[: len(found) - 1]
    return Model(weights, float(found[-1]))


def score(text: Column, model: Model) -> Column:
    """Probability of label 1 for a text column."""

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weighted = model.weights != 0
        for batch in batches:
            sums = np.full(len(batch), model.bias)
            for i, text in enumerate(batch):  # one text at a time becomes a Python object
                grams = hashed_ngrams(text.as_py())
                sums[i] += model.weights[np.unique(grams[weighted[grams]])].sum(dtype=np.float64)
            yield pa.array((1 / (1 + np.exp(-np.clip(sums, -500, 500)))).round(12))
        give_back()

    return run(filled(text))


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, per_class)
    scored = texts(docs).select("doc_id", score(F.col("text"), model).alias("score"))
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )

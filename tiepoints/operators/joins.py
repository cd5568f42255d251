"""Joining the point tables with small per-key tables without moving hot keys to one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiepoints.session import settle

BROADCAST_BYTES = 64 * 1024 * 1024
HOT_ROWS = 2_000_000
SALTS = 16


def _bytes(value: Column, kind: T.DataType) -> Column:
    """Bytes a value takes in a broadcast row, from its own length and not from a guess."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value) + 16
    elif isinstance(kind, T.StructType):
        size = reduce(add, [_bytes(value[f.name], f.dataType) for f in kind.fields], F.lit(16))
    elif isinstance(kind, T.ArrayType):
        each = F.transform(value, lambda v: _bytes(v, kind.elementType).cast("long"))
        size = F.aggregate(each, F.lit(24).cast("long"), lambda total, n: total + n)
    elif isinstance(kind, (T.VariantType, T.MapType)):
        size = F.octet_length(F.to_json(value)) + 16
    else:
        size = F.lit(8)
    return F.coalesce(size.cast("long"), F.lit(8).cast("long"))


def table_bytes(small: DataFrame) -> int:
    """Bytes of all rows of a written table."""
    row = reduce(add, [_bytes(F.col(f.name), f.dataType) for f in small.schema], F.lit(32).cast("long"))
    return small.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]


def join_settled(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    *,
    limit_bytes: int = BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
    where: Column | None = None,
) -> DataFrame:
    """Join ``big`` with ``small``, an already written per-key table (see ``settle``).

    ``where`` is a further condition of a join by ``left_semi`` on columns that only one side has.

    Its measured size decides: up to ``limit_bytes`` it is broadcast and ``big`` does not move.
    Above that the rows of ``big`` per key are counted, with partial aggregation. A key with more
    than ``hot_rows`` is split into that many salts and its rows of ``small`` are repeated for
    each; other keys are shuffled as they are.
    """
    on = list(on)
    if table_bytes(small) <= limit_bytes:
        return _met(big, small, on, how, where, "broadcast")
    hot = settle(
        big.groupBy(*on)
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") > hot_rows)
        .select(*on, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts")),
        "hot-keys",
    )
    # Hints on the large side: the size estimate of an exploded table is that of its input, and
    # could pass for broadcastable.
    if hot.count() == 0:
        return _met(big, small, on, how, where, "merge")
    # At most one row per ``hot_rows`` rows of ``big``.
    hot = F.broadcast(hot)
    salts = F.coalesce("_salts", F.lit(1))
    salted = big.join(hot, on, "left").withColumn("_salt", F.pmod(_row_hash(big), salts).cast("int"))
    repeated = small.join(hot, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), salts - 1))
    )
    return _met(salted.drop("_salts"), repeated.drop("_salts"), [*on, "_salt"], how, where, "merge").drop("_salt")


def _met(big: DataFrame, small: DataFrame, on: list[str], how: str, where: Column | None, hint: str) -> DataFrame:
    if where is None:
        return big.join(small.hint(hint), on, how)
    named = small.withColumnsRenamed({c: f"_on_{c}" for c in on})
    return big.join(named.hint(hint), reduce(and_, [F.col(c) == F.col(f"_on_{c}") for c in on]) & where, how)


def _row_hash(df: DataFrame) -> Column:
    """A hash of the whole row, and of the partition so that copies of a row are spread as well.

    A key that sits in one partition still gets all salts, and a retried task makes the same ones.
    """
    plain = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.xxhash64(*plain) + F.spark_partition_id()


def join_per_key(
    big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", **options: int
) -> DataFrame:
    """``join_settled`` for a ``small`` that is still a plan."""
    return join_settled(big, settle(small, "per-key"), on, how, **options)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence, k: int, rank: str) -> DataFrame:
    """The first ``k`` rows of every key in ``order``, numbered from 1 in column ``rank``.

    Ranked twice: among the rows of (key, salt), then among the at most ``SALTS * k``
    survivors of the key. Spark also applies both limits before their shuffles.
    """
    narrow = W.partitionBy(*keys, "_salt").orderBy(*order)
    whole = W.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", F.pmod(_row_hash(df), F.lit(SALTS)))
        .withColumn("_first", F.row_number().over(narrow))
        .where(F.col("_first") <= k)
        .drop("_salt", "_first")
        .withColumn(rank, F.row_number().over(whole))
        .where(F.col(rank) <= k)
    )

"""Registration statistics per configuration and polarisation.

The definitions are this package's own. Percentiles are exact, with linear interpolation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tiepoints.operators.joins import join_per_key, join_settled
from tiepoints.session import settle

SKETCH_ACCURACY = 10_000
WHOLE_GROUP = 20_000

# Which reference polarisation a source polarisation is compared with.
REFERENCE_POL = {"HH": "VV", "VV": "VV", "HV": "VH", "VH": "VH"}


def _bracket(value: str, p: float, n: Column) -> Column:
    """Two values that surely enclose the rows ``p`` is interpolated from.

    The sketch is off by at most ``n / SKETCH_ACCURACY`` ranks; four times that is left on
    either side. Small groups are taken whole.
    """
    slack = 4 / SKETCH_ACCURACY
    low, high = max(p - slack, 0.0), min(p + slack, 1.0)
    sketch = F.percentile_approx(value, F.array(F.lit(low), F.lit(high)), SKETCH_ACCURACY)
    everything = n <= WHOLE_GROUP
    return F.struct(
        F.when(everything | F.lit(low == 0.0), F.lit(float("-inf"))).otherwise(sketch[0]).alias("low"),
        F.when(everything | F.lit(high == 1.0), F.lit(float("inf"))).otherwise(sketch[1]).alias("high"),
    )


def group_statistics(
    points: DataFrame,
    keys: Sequence[str],
    aggregates: Mapping[str, Column],
    percentiles: Mapping[str, tuple[str, float]],
) -> DataFrame:
    """Aggregates and exact percentiles per group, without ever gathering a group.

    ``percentiles`` maps an output name to ``(column, p)``. One pass computes the aggregates
    and, from a mergeable sketch, a narrow bracket around every percentile. A second pass counts
    the rows below each bracket and reduces those inside to distinct values with counts, so
    that only the bracket, a small share of a large group, is ever ranked. NULL values do not count,
    column by column; NaN is the largest value. A group without values has NULL.
    """
    keys = list(keys)
    columns = list(dict.fromkeys(column for column, _ in percentiles.values()))
    summary = settle(
        points.groupBy(*keys).agg(
            F.count("*").alias("n"),
            *[c.alias(name) for name, c in aggregates.items()],
            *[F.count(column).alias(f"_n_{column}") for column in columns],
            *[_bracket(column, p, F.count(column)).alias(f"_{name}") for name, (column, p) in percentiles.items()],
        ),
        "summary",
    )
    if not percentiles:
        return summary
    brackets = summary.select(*keys, *[f"_{name}" for name in percentiles])
    labelled = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("_what"),
                    F.col(column).cast("double").alias("_v"),
                    F.col(f"_{name}")["low"].alias("_low"),
                    F.col(f"_{name}")["high"].alias("_high"),
                )
                for name, (column, _) in percentiles.items()
            ]
        )
    )
    value = F.col("_v")
    # Everything below its bracket collapses to one row of value NULL.
    counted = (
        join_settled(points.select(*keys, *columns), brackets, keys)
        .select(*keys, labelled)
        .where((value <= F.col("_high")) | F.isnan(value) & (F.col("_high") == float("inf")))
        .groupBy(*keys, "_what", F.when(value >= F.col("_low"), value).alias("_v"))
        .agg(F.count("*").alias("_c"))
    )
    upto = W.partitionBy(*keys, "_what").orderBy(F.col("_v").asc_nulls_first())
    ranked = counted.withColumn("_end", F.sum("_c").over(upto))
    position = reduce(
        lambda acc, item: acc.when(
            F.col("_what") == item[0], F.lit(item[1][1]) * (F.col(f"_n_{item[1][0]}") - 1)
        ),
        percentiles.items(),
        F,
    )
    sizes = summary.select(*keys, *[f"_n_{column}" for column in columns])
    found = join_settled(ranked, sizes, keys).withColumn("_pos", position)
    below, above = F.floor("_pos"), F.ceil("_pos")

    def holds(rank: Column) -> Column:
        return (rank >= F.col("_end") - F.col("_c")) & (rank < F.col("_end"))

    picked = found.groupBy(*keys, "_what").agg(
        F.max(F.when(holds(below), value)).alias("_a"),
        F.max(F.when(holds(above), value)).alias("_b"),
        F.max(F.col("_pos") - below).alias("_part"),
    )
    interpolated = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")
    exact = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), interpolated).otherwise(
        F.raise_error(F.lit("percentile outside its bracket")).cast("double")
    )
    wide = picked.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("_what") == name, exact)).alias(name) for name in percentiles
        ]
    )
    return summary.select(*keys, "n", *aggregates).join(wide, keys, "left")


def match_statistics(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, mean, median and deviation of along and across, RMSE, P50 and P90 of distance."""
    squared = F.col("distance") * F.col("distance")
    return group_statistics(
        points,
        keys,
        {
            "mean_along": F.avg("along"),
            "mean_across": F.avg("across"),
            "std_along": F.stddev_pop("along"),
            "std_across": F.stddev_pop("across"),
            "rmse": F.sqrt(F.avg(squared)),
        },
        {
            "median_along": ("along", 0.5),
            "median_across": ("across", 0.5),
            "p50_distance": ("distance", 0.5),
            "p90_distance": ("distance", 0.9),
        },
    )


def polarisation_summary(chips: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Surviving chips per key with subtotals, from the right-most key inwards.

    ``level`` is how many of the keys are subtotalled (0 for a detail row).
    """
    subtotal = reduce(lambda a, b: a + b, [F.grouping(k).cast("int") for k in keys])
    return chips.rollup(*keys).agg(
        subtotal.alias("level"),
        F.count("*").alias("chips"),
        F.sum("n").alias("n"),
        F.avg("across").alias("across"),
        F.avg("along").alias("along"),
    )


def reference_pol(pol: Column) -> Column:
    """Reference polarisation of a source polarisation: co-pol to VV, cross-pol to VH."""
    return reduce(lambda acc, kv: acc.when(pol == kv[0], kv[1]), REFERENCE_POL.items(), F)


def join_reference(runs: DataFrame, reference: DataFrame) -> DataFrame:
    """Attach the reference image of every run, by pair and reference polarisation.

    ``reference`` has one row per key.
    """
    polarised = runs.withColumn("ref_pol", reference_pol(F.col("source_pol")))
    return join_per_key(polarised, reference, ["pair_id", "ref_pol"])

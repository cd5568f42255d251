"""The catalog of matcher configurations, built from spec tables of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiepoints.functions.file_ids import detector_name
from tiepoints.operators.joins import join_per_key, join_settled
from tiepoints.session import settle

# Characters a tag must not contain, and name parts of the heavy dense models.
TAG_FORBIDDEN = "[_( ]"
HEAVY_NEEDLES = ("roma", "dkm")
TAG_UNKNOWN_STATUS = 2


def all_specs(sparse: DataFrame, dense: DataFrame) -> DataFrame:
    """Sparse specs, then dense specs; ``(dense, ordinal)`` is the catalog order."""
    return sparse.withColumn("dense", F.lit(False)).unionByName(
        dense.withColumn("dense", F.lit(True)), allowMissingColumns=True
    )


def tag_violations(specs: DataFrame) -> DataFrame:
    """Tags that are malformed or occur more than once, before any conf lookup.

    A tag whose conf is missing still counts as seen.
    """
    counted = specs.groupBy("tag").agg(F.count("*").alias("n"))
    reason = F.when(F.col("tag").rlike(TAG_FORBIDDEN), "bad_character").when(
        F.col("n") > 1, "duplicate"
    )
    return counted.withColumn("violation", reason).where(F.col("violation").isNotNull())


def require_valid_tags(specs: DataFrame) -> DataFrame:
    """Strict mode: the query fails on the first malformed or repeated tag."""
    first = F.struct("dense", "ordinal")
    checked = specs.groupBy("tag").agg(
        F.count("*").alias("_n"),
        F.min(F.struct(first.alias("_at"), *[c for c in specs.columns if c != "tag"])).alias("_row"),
    )
    message = (
        F.when(F.col("tag").rlike(TAG_FORBIDDEN), F.concat(F.lit("bad tag: "), "tag"))
        .when(F.col("_n") > 1, F.concat(F.lit("duplicate tag: "), "tag"))
    )
    return checked.where(
        F.when(message.isNotNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    ).select(*[F.col("tag") if c == "tag" else F.col("_row")[c].alias(c) for c in specs.columns])


def first_valid(specs: DataFrame) -> DataFrame:
    """Lenient mode: well-formed tags only, and of a repeated tag its first row."""
    rest = [c for c in specs.columns if c != "tag"]
    return (
        specs.where(~F.col("tag").rlike(TAG_FORBIDDEN))
        .groupBy("tag")
        .agg(F.min(F.struct("dense", "ordinal", *[c for c in rest if c not in ("dense", "ordinal")])).alias("_row"))
        .select(*[F.col("tag") if c == "tag" else F.col("_row")[c].alias(c) for c in specs.columns])
    )


def resolve(specs: DataFrame, confs: DataFrame) -> DataFrame:
    """Look up the confs of every spec.

    ``confs(kind, name, conf)`` has one row per kind (``extract``, ``match``, ``dense``) and
    name. Adds ``feature``, ``matcher_conf`` (both VARIANT) and ``skip_reason``, the first
    missing lookup; the extractor is checked first. A conf that is no JSON counts as missing.
    Dense specs have no feature.
    """
    parsed = settle(confs, "confs").select("kind", "name", F.try_parse_json("conf").alias("conf"))
    extract = parsed.where("kind = 'extract'").select(
        F.col("name").alias("extractor"), F.col("conf").alias("feature")
    )
    match = parsed.where("kind <> 'extract'").select(
        (F.col("kind") == "dense").alias("dense"),
        F.col("name").alias("matcher"),
        F.col("conf").alias("matcher_conf"),
    )
    joined = join_settled(
        join_settled(specs, extract, ["extractor"], "left"), match, ["dense", "matcher"], "left"
    )
    missing = (
        F.when(~F.col("dense") & F.col("feature").isNull(), "extractor")
        .when(F.col("matcher_conf").isNull(), F.when(F.col("dense"), "dense matcher").otherwise("matcher"))
    )
    return joined.withColumn("skip_reason", missing)


def catalog(resolved: DataFrame) -> DataFrame:
    """Configurations ready to run: ``ordinal, tag, dense, conf``."""
    return resolved.where(F.col("skip_reason").isNull()).select(
        "ordinal",
        "tag",
        "dense",
        F.struct("feature", F.col("matcher_conf").alias("matcher"), "dense").alias("conf"),
    )


def skips(resolved: DataFrame) -> DataFrame:
    """Specs left out of the catalog, and which lookup missed."""
    return resolved.where(F.col("skip_reason").isNotNull()).select(
        "ordinal", "tag", "dense", "skip_reason",
        F.when(F.col("skip_reason") == "extractor", F.col("extractor"))
        .otherwise(F.col("matcher")).alias("missing"),
    )


def kind_label(dense: Column) -> Column:
    return F.when(dense, "dense").otherwise("sparse")


def listing(cat: DataFrame) -> DataFrame:
    """Tag, kind, detector name and the model name inside the matcher conf, if it has one."""
    return cat.select(
        "ordinal",
        "tag",
        kind_label(F.col("dense")).alias("kind"),
        detector_name(F.col("tag")).alias("detector"),
        F.try_variant_get("conf.matcher", "$.model.name", "string").alias("model_name"),
    )


def counts(cat: DataFrame) -> DataFrame:
    return cat.agg(
        F.count("*").alias("total"),
        F.count_if("dense").alias("dense"),
        F.count_if(~F.col("dense")).alias("sparse"),
    )


def is_heavy(needles: Sequence[str] = HEAVY_NEEDLES) -> Column:
    """Dense configurations whose tag names one of the heavy models."""
    named = F.lit(False)
    for needle in needles:
        named = named | F.col("tag").contains(needle)
    return F.col("dense") & named


def with_run_forward(
    cat: DataFrame, skip_forward: bool = False, needles: Sequence[str] = HEAVY_NEEDLES
) -> DataFrame:
    """Flag the configurations whose forward pass is to run."""
    return cat.withColumn("run_forward", ~(F.lit(skip_forward) | is_heavy(needles)))


def allow_list(cat: DataFrame, tags: str | None) -> DataFrame:
    """Keep the tags of a comma list; unset or empty keeps all. Tags are not trimmed."""
    return cat.where(F.col("tag").isin(tags.split(","))) if tags else cat


def allow_table(cat: DataFrame, allowed: DataFrame) -> DataFrame:
    """The same for a table of comma lists (column ``tags``), of any size.

    Without lists, or with empty ones only, all are kept.
    """
    wanted = allowed.where("tags <> ''").select(F.explode(F.split("tags", ",")).alias("tag")).distinct()
    return cat.join(wanted, "tag", "left_semi") if wanted.limit(1).count() else cat


def lookup_tags(requested: DataFrame, cat: DataFrame) -> DataFrame:
    """Status of every requested tag: 0 if it is in the catalog, 2 if not."""
    known = cat.select("tag", F.col("ordinal").alias("catalog_ordinal"), "dense")
    return join_per_key(requested, known, ["tag"], "left").withColumn(
        "status", F.when(F.col("dense").isNull(), TAG_UNKNOWN_STATUS).otherwise(0)
    )

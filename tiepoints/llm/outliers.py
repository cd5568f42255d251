"""Quality rules with robust multivariate outliers.

Plain rules reject short and repetitive texts. Of the rest, each language and source gets a minimum-
covariance-determinant (MCD) estimate of the transformed statistics, and a document far from its own
group by Mahalanobis distance is rejected.

The estimate is deterministic: three starting scatters of robustly scaled values (identity, spatial
signs, hyperbolic tangents), concentration steps that refit on the three quarters of smallest
distance, the start of smallest determinant, one reweighting. Subsets are cut at fine logarithmic
distance bins, whose counts are a partial aggregation: no group is ordered or gathered, and ties stay
together. ``FLOOR`` keeps statistics that hardly vary (most texts have no symbols) from
making the covariance singular. Groups below ``LEAST_GROUP`` documents are pooled by language, then all
together; if even that is too small, all are kept. Only DataFrame functions are used.

Null texts have no words and fail the base rules. Null languages and sources are values of their own.
Equal rows have equal results; an empty table gives no rows. Shingles of words are compared by a
64-bit hash within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tiepoints.llm.common import filled
from tiepoints.operators.joins import join_settled
from tiepoints.session import once, settle

WORD = r"[^\x20\x09-\x0D]+"
LEAST_GROUP = 100
STEPS = 3
SHARE = 0.75
BINS = 32  # per unit of ln(distance^2)
FLOOR = 0.15  # least standard deviation of a transformed statistic: one repeated line in 40
# Quantiles of the chi-square distribution with five degrees of freedom.
MEDIAN_5, WEIGHT_5, REJECT_5 = 4.3515, 12.8325, 30.0
STATS = ("x0", "x1", "x2", "x3", "x4")
P = len(STATS)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every whole text."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"), filled(F.col("text").cast("string")).alias("_t"),
    )
    lines = F.filter(F.split("_t", "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))
    rows = once(
        rows,
        _w=F.regexp_extract_all("_t", F.lit(WORD), 0),
        _lines=lines,
        word_chars=F.length(F.translate("_t", " \t\n\x0b\f\r", "")).cast("long"),
        n_symbols=(F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long"),
    ).drop("_t")
    last = F.size("_w") - 3
    grams = F.when(
        last >= 0,
        F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    rows = once(
        rows,
        n_words=F.size("_w").cast("long"),
        n_lines=F.size("_lines").cast("long"),
        n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        _g=grams,
    ).drop("_w", "_lines")
    # Only texts with a repeated window need their windows sorted.
    repeated = F.size(F.array_distinct("_g")) < F.size("_g")
    by_hash = F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    rows = once(rows, _s=F.when(repeated, by_hash)).drop("_g")

    def twice(x: Column, j: Column) -> Column:
        before = F.when(j > 0, F.get("_s", j - 1)["g"])
        return (before == x["g"]) | (F.get("_s", j + 1)["g"] == x["g"])

    starts = F.sort_array(F.transform(F.filter("_s", lambda x, j: F.coalesce(twice(x, j), F.lit(False))), lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_s")


def transformed(rows: DataFrame) -> DataFrame:
    """Add the base verdict and the statistics the estimate works on."""
    n = F.nullif(F.col("n_words"), F.lit(0))  # without words there are no statistics
    return rows.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "x0": F.log1p("n_words"),
            "x1": F.log(F.col("word_chars") / n),
            "x2": F.sqrt(F.col("n_symbols") / n),
            "x3": F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
            "x4": F.sqrt(F.col("n_repeat_words") / n),
        }
    )


def with_groups(rows: DataFrame) -> DataFrame:
    """Add ``grp``: language and source, or a pool of the small ones; null if even all are too few."""
    lang, source = (F.coalesce(F.hex(c), F.lit("-")) for c in ("lang", "source"))
    rows = rows.withColumns({"_fine": F.concat(lang, F.lit("/"), source), "_lang": lang})
    counts = rows.where("not base_failed").groupBy("_fine", "_lang").agg(F.count("*").alias("n"))
    small = F.col("n") < LEAST_GROUP
    by_lang = F.sum(F.when(small, F.col("n")).otherwise(0)).over(W.partitionBy("_lang"))
    counts = counts.withColumn("_pool", by_lang)
    level = F.when(~small, F.concat(F.lit("s"), F.col("_fine")))
    level = level.when(F.col("_pool") >= LEAST_GROUP, F.concat(F.lit("l"), F.col("_lang"))).otherwise(F.lit("all"))
    named = counts.select("_fine", "n", level.alias("grp"))
    rest = named.where("grp = 'all'").agg(F.sum("n").alias("n")).first()["n"] or 0
    grp = F.col("grp") if rest >= LEAST_GROUP else F.when(F.col("grp") != "all", F.col("grp"))
    named = settle(named.select("_fine", grp.alias("grp")), "groups")
    return join_settled(rows, named, ["_fine"], "left").drop("_fine", "_lang")


def _moments(prefix: str, values: list[Column]) -> list[Column]:
    """Sums from which mean and covariance of ``values`` follow."""
    sums = [F.count("*").alias(f"{prefix}n"), *[F.sum(v).alias(f"{prefix}s{i}") for i, v in enumerate(values)]]
    return [*sums, *[F.sum(values[i] * values[j]).alias(f"{prefix}q{i}{j}") for i, j in PAIRS]]


def _estimate(sums: DataFrame, keys: list[str], center: bool = True) -> DataFrame:
    """Mean ``m*``, Cholesky factor ``l**`` of the covariance plus ``FLOOR``, and ``logdet``."""
    n = F.col("n")
    out = sums.select(*keys, *[((F.col(f"s{i}") / n) if center else F.lit(0.0)).alias(f"m{i}") for i in range(P)],
                      *[(F.col(f"q{i}{j}") / n).alias(f"q{i}{j}") for i, j in PAIRS])
    for i, j in PAIRS:
        rest = F.col(f"q{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")
        if i == j:
            rest = F.greatest(rest, F.lit(0.0)) + FLOOR**2
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        value = F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}")
        out = out.withColumn(f"l{i}{j}", value)
    logdet = sum((F.log(f"l{i}{i}") for i in range(P)), F.lit(0.0))
    return out.withColumn("logdet", logdet).drop(*[f"q{i}{j}" for i, j in PAIRS])


def _with_distance(rows: DataFrame, values: list[str], name: str = "d") -> DataFrame:
    """Squared Mahalanobis distance by forward substitution, from columns ``m*`` and ``l**``."""
    for i in range(P):
        rest = F.col(values[i]) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"_y{k}")
        rows = rows.withColumn(f"_y{i}", rest / F.col(f"l{i}{i}"))
    total = sum((F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(P)), F.lit(0.0))
    return rows.withColumn(name, total).drop(*[f"_y{i}" for i in range(P)])


def _bin(distance: str) -> Column:
    return F.floor(BINS * F.log(F.greatest(F.col(distance), F.lit(1e-9)))).cast("int")


def _concentrate(points: DataFrame, estimates: DataFrame, keys: list[str], share: float) -> DataFrame:
    """One concentration step: refit on the ``share`` of each group that is nearest under ``estimates``."""
    far = _with_distance(join_settled(points, estimates, keys), list(STATS)).withColumn("_bin", _bin("d"))
    counts = far.groupBy(*keys, "_bin").agg(F.count("*").alias("n"))
    upto = W.partitionBy(*keys).orderBy("_bin")
    counts = counts.withColumn("_before", F.sum("n").over(upto) - F.col("n"))
    counts = counts.withColumn("_all", F.sum("n").over(W.partitionBy(*keys)))
    inside = F.col("_before") < share * F.col("_all")
    cut = settle(counts.where(inside).groupBy(*keys).agg(F.max("_bin").alias("_cut")), "cut")
    near = join_settled(far.select(*keys, *STATS, "_bin"), cut, keys).where(F.col("_bin") <= F.col("_cut"))
    sums = near.groupBy(*keys).agg(*_moments("", [F.col(c) for c in STATS]))
    return settle(_estimate(sums, keys), "estimate")


def mcd(points: DataFrame) -> DataFrame:
    """Per ``grp`` the robust mean and Cholesky factor of columns ``x*``, scaled for consistency."""
    medians = settle(points.groupBy("grp").agg(*[F.percentile_approx(c, 0.5, 10000).alias(f"c{i}") for i, c in enumerate(STATS)]), "medians")
    apart = join_settled(points, medians, ["grp"]).select("grp", *[F.abs(F.col(c) - F.col(f"c{i}")).alias(c) for i, c in enumerate(STATS)])
    spread = apart.groupBy("grp").agg(*[F.percentile_approx(c, 0.5, 10000).alias(f"u{i}") for i, c in enumerate(STATS)])
    scales = settle(medians.join(spread, "grp"), "scales")
    z = [(F.col(c) - F.col(f"c{i}")) / F.greatest(1.4826 * F.col(f"u{i}"), F.lit(FLOOR)) for i, c in enumerate(STATS)]
    scaled = join_settled(points, scales, ["grp"]).select("grp", *[v.alias(f"z{i}") for i, v in enumerate(z)])
    norm = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)), F.lit(1e-12)))
    signs = [F.col(f"z{i}") / norm for i in range(P)]
    tanh = [F.tanh(F.col(f"z{i}")) for i in range(P)]
    ones = [F.lit(0.0)] * P
    start = []
    for k, values in enumerate((ones, signs, tanh)):
        sums = scaled.groupBy("grp").agg(*_moments("", values)).withColumn("start", F.lit(k))
        if k == 0:  # identity: no correlation assumed
            sums = sums.withColumns({f"q{i}{i}": F.col("n").cast("double") for i in range(P)})
        start.append(_estimate(sums, ["grp", "start"], center=False))
    first = start[0].unionByName(start[1]).unionByName(start[2]).join(scales, "grp")
    # Back to the units of the statistics: location at the median, factor times scale.
    unit = [F.greatest(1.4826 * F.col(f"u{i}"), F.lit(FLOOR)) for i in range(P)]
    first = first.select("grp", "start", *[F.col(f"c{i}").alias(f"m{i}") for i in range(P)],
                         *[(F.col(f"l{i}{j}") * unit[i]).alias(f"l{i}{j}") for i, j in PAIRS], "logdet")
    now = settle(first, "estimate")
    tried = points.select("grp", *STATS, F.explode(F.array([F.lit(k) for k in range(3)])).alias("start"))
    now = _concentrate(tried, now, ["grp", "start"], 0.5)
    for _ in range(STEPS):
        now = _concentrate(tried, now, ["grp", "start"], SHARE)
    columns = [f"m{i}" for i in range(P)] + [f"l{i}{j}" for i, j in PAIRS]
    best = now.groupBy("grp").agg(F.min_by(F.struct(*columns), F.struct("logdet", "start")).alias("e"))
    raw = settle(best.select("grp", "e.*"), "estimate")
    # Reweight: all points within the 97.5 % contour of the raw estimate, made consistent by its median.
    far = _with_distance(join_settled(points, raw, ["grp"]), list(STATS))
    middle = settle(far.groupBy("grp").agg((F.percentile_approx("d", 0.5, 10000) / MEDIAN_5).alias("_k")), "middle")
    near = join_settled(far.select("grp", "d", *STATS), middle, ["grp"])
    near = near.where(F.col("d") <= WEIGHT_5 * F.greatest("_k", F.lit(1e-9)))
    final = settle(_estimate(near.groupBy("grp").agg(*_moments("", [F.col(c) for c in STATS])), ["grp"]), "estimate")
    far = _with_distance(join_settled(points, final, ["grp"]), list(STATS))
    # Never below one: a group tighter than FLOOR must not make small differences large.
    middle = far.groupBy("grp").agg(F.greatest(F.percentile_approx("d", 0.5, 10000) / MEDIAN_5, F.lit(1.0)).alias("factor"))
    return settle(final.drop("logdet").join(middle, "grp"), "estimate")


def judge(docs: DataFrame, reject: float = REJECT_5) -> DataFrame:
    """One row per document: the base counts, base_failed, kept, and the squared distance (null if not judged)."""
    rows = settle(transformed(text_statistics(docs)), "statistics")
    rows = settle(with_groups(rows), "grouped")
    estimates = mcd(rows.where("not base_failed and grp is not null").select("grp", *STATS))
    judged = _with_distance(join_settled(rows, estimates, ["grp"], "left"), list(STATS))
    distance = F.when(~F.col("base_failed"), F.col("d") / F.col("factor"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce(distance, F.lit(0.0)) <= reject)).alias("kept"),
        distance.alias("distance"),
    )

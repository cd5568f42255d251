"""Personal data: fixed patterns, and terms that give the protected values away.

Emails, addresses, card and phone numbers found by pattern are protected, and so is what several of them have in
common: the domain and the name of an email, the network of an address, the issuer of a card, the area of a
phone number. Each of these is an entity; that of one text only tells nothing. A term (a word of
three letters or more outside of all entities, anywhere in a text that holds the entity) discloses it as far as
knowing the term tells of the entity: PMI(entity; term) / IC(entity), from counts of distinct texts
over the whole corpus. 1 means that the term never occurs without the entity. From ``GENERALISE``
on every occurrence of the term in the texts with the entity is generalised, from ``REMOVE`` on removed;
at least ``SUPPORT`` texts must show both. Texts without an entity are never changed.

As no more texts show both than show the entity, a term in more than N^(1 - g) * n_entity^g of N texts
(g = ``GENERALISE``) discloses nothing; pairs with such a term are not made.

Only DataFrame functions are used. Patterns are written so that Java's engine takes linear time and
constant stack on texts of any length, with the same matches as the plain forms. Copies of a text
under other doc_ids count once. What a row needs of the corpus is joined by (entity, term), never a group's pairs.

Null texts have no spans. Rows equal in doc_id and text have equal results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiepoints.llm.common import filled, n_kind, of_kinds, sha256, span_list, texts
from tiepoints.operators.joins import join_settled
from tiepoints.session import once, settle

# The kinds in the order of the result. Possessive and anchored forms of
# [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, [0-9]+(\.[0-9]+){3}, [0-9]([\x20-]?[0-9])+ with 13
# digits or more, and \+[0-9][\x20().0-9-]+[0-9]. A local part or first number starts where its run of
# characters starts or where the match before ended; no later start in the run could do better.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE_KINDS = tuple(BASE)
EXTRA_KINDS = ("generalised", "removed")
TERM = r"\p{L}{3,}+"
SUPPORT = 2
GENERALISE, REMOVE = 0.8, 0.95
_FOUND = "array<struct<kind:string,start:int,end:int,value:string>>"


def located(text: Column, matches: Column, pattern: str, kind: str) -> Column:
    """Matches with their positions in code points: what lies between them is the text split at them."""
    between = F.split(text, pattern, -1)
    steps = F.zip_with(
        matches,
        F.slice(between, 1, F.size(matches)),
        lambda m, gap: F.struct(m.alias("m"), F.length(gap).alias("gap"), F.length(m).alias("n")),
    )
    walked = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["n"]).alias("at"),
            F.concat(
                acc["out"],
                F.array(
                    F.struct(
                        F.lit(kind).alias("kind"),
                        (acc["at"] + x["gap"]).alias("start"),
                        (acc["at"] + x["gap"] + x["n"]).alias("end"),
                        x["m"].alias("value"),
                    )
                ),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(F.size(matches) > 0, walked).otherwise(F.array().cast(_FOUND))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), 1, 19).substr(i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0


def _valid(kind: str) -> Callable[[Column], Column]:
    return lambda span: _valid_value(kind, span["value"])


def _valid_value(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    n = F.length(_digits(value))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(value))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def with_base_spans(rows: DataFrame) -> DataFrame:
    """Add ``spans`` with (kind, start, end, value) to a table with a non-null column ``text``."""
    text = F.col("text")
    none = F.array().cast("array<string>")
    hints = {"email": text.contains("@"), "phone": text.contains("+")}
    found = {
        f"_m_{kind}": F.when(hints.get(kind, F.lit(True)), F.regexp_extract_all(text, F.lit(p), 0)).otherwise(none)
        for kind, p in BASE.items()
    }
    rows = once(rows, **found)
    spans = [
        F.filter(located(text, F.col(f"_m_{kind}"), p, kind), _valid(kind))
        for kind, p in BASE.items()
    ]
    return once(rows, spans=F.concat(*spans)).drop(*found)


def entity_of(span: Column) -> Column:
    """The protected value in a form that does not depend on how it was written."""
    plain = F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat(span["kind"], F.lit(":"), plain)


def common_parts(span: Column) -> list[Column]:
    """What a protected value may share with others; null where there is nothing."""
    plain, digits = F.lower(span["value"]), _digits(span["value"])
    name = F.nullif(F.regexp_extract(plain, "^[^a-z@]*([a-z]{3,})[^@]*@", 1), F.lit(""))
    kind = lambda k, value: F.when(span["kind"] == k, value)
    return [
        kind("email", F.concat(F.lit("domain:"), F.substring_index(plain, "@", -1))),
        kind("email", F.concat(F.lit("name:"), name)),
        kind("ip", F.concat(F.lit("network:"), F.substring_index(plain, ".", 2))),
        kind("card", F.concat(F.lit("issuer:"), F.substring(digits, 1, 6))),
        kind("phone", F.concat(F.lit("area:"), digits.substr(F.lit(1), F.length(digits) - 7))),
    ]


def entities_of(spans: Column) -> Column:
    """Every protected value and common part, once."""
    forms = F.flatten(F.transform(spans, lambda s: F.array(entity_of(s), *common_parts(s))))
    return F.array_distinct(F.array_compact(forms))


def outside(text: Column, spans: Column) -> Column:
    """The text with every span replaced by a space."""
    walked = F.aggregate(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.concat(acc["out"], F.array(text.substr(acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))))).alias("out"),
        ),
        lambda acc: F.concat_ws(" ", acc["out"], text.substr(acc["at"] + 1, F.length(text))),
    )
    return walked


def _most(total: int, n_entity: Column) -> Column:
    """Texts a term may be in and still disclose an entity of ``n_entity`` texts."""
    return F.pow(F.lit(float(total)), F.lit(1 - GENERALISE)) * F.pow(n_entity, F.lit(GENERALISE)) * (1 + 1e-9)


def disclosures(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Terms to change in each text: text_hash, marks of (term, disclosure).

    ``found`` has ``text_hash``, ``spans`` and, where there are spans, ``terms``; ``docs`` are all
    documents, whose distinct texts are counted.
    """
    total = found.select("text_hash").distinct().count()
    held = found.where(F.size("spans") > 0).select("doc_id", "text_hash", entities_of(F.col("spans")).alias("entities"), "terms")
    of_text = held.select("text_hash", F.explode("entities").alias("entity")).distinct()
    entities = of_text.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= SUPPORT)
    entities = settle(entities, "entities")
    largest = entities.agg(F.max("n_entity")).first()[0] or 0
    # One row of each text; then every task adds up its own texts, and a term is shuffled once per task.
    copies = found.groupBy("text_hash").agg(F.count("*").alias("_n"), F.min("doc_id").alias("_first"))
    copies = settle(copies.where("_n > 1").select("text_hash", "_first"), "copies")
    one = F.expr("_first is null or doc_id = _first")
    shown = join_settled(held.select("doc_id", "text_hash", "terms"), copies, ["text_hash"], "left").where(one)
    terms = shown.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("_n"))
    terms = settle(terms.where(F.col("_n") >= SUPPORT).select("term"), "terms")
    first = join_settled(texts(docs).withColumn("text_hash", F.xxhash64("text")), copies, ["text_hash"], "left")
    first = first.where(one & F.col("text").isNotNull())
    words = first.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), 0))).alias("term"))
    counts = join_settled(words, terms, ["term"]).groupBy("term").agg(F.count("*").alias("n_term"))
    counts = settle(counts.where(F.col("n_term") <= _most(total, F.lit(largest))), "rare-terms")
    pairs = join_settled(held.select("text_hash", "entities", F.explode("terms").alias("term")), counts, ["term"])
    pairs = pairs.select("text_hash", "term", "n_term", F.explode("entities").alias("entity"))
    pairs = join_settled(pairs, entities, ["entity"]).where(F.col("n_term") <= _most(total, F.col("n_entity")))
    pairs = settle(pairs.distinct(), "pairs")
    both = pairs.groupBy("entity", "term", "n_entity", "n_term").agg(F.count("*").alias("n_both"))
    n_entity, n_term, n_both = F.col("n_entity"), F.col("n_term"), F.col("n_both")
    pmi = F.log(n_both * F.lit(float(total)) / (n_entity * n_term))
    ic = F.log(F.lit(float(total)) / n_entity)
    known = both.where(n_both >= SUPPORT).withColumn("disclosure", F.when(ic > 0, F.least(pmi / ic, F.lit(1.0))))
    known = settle(known.where(F.col("disclosure") >= GENERALISE).select("entity", "term", "disclosure"), "disclosures")
    marks = join_settled(pairs.select("text_hash", "entity", "term"), known, ["entity", "term"])
    marks = marks.groupBy("text_hash", "term").agg(F.max("disclosure").alias("disclosure"))
    return marks.groupBy("text_hash").agg(F.collect_list(F.struct("term", "disclosure")).alias("marks"))


def marked(text: Column, spans: Column, marks: Column) -> Column:
    """Every occurrence of the marked terms outside of all spans: (kind, start, end)."""
    known = F.transform(marks, lambda m: m["term"])
    forms = F.filter(
        F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), 0)), lambda w: F.array_contains(known, F.lower(w))
    )
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(forms, "|"), F.lit(r")(?!\p{L})"))
    found = located(text, F.regexp_extract_all(text, pattern, F.lit(0)), pattern, "term")
    found = F.filter(found, lambda t: ~F.exists(spans, lambda s: (t["start"] < s["end"]) & (s["start"] < t["end"])))
    sure = F.transform(F.filter(marks, lambda m: m["disclosure"] >= REMOVE), lambda m: m["term"])
    kind = lambda t: F.when(F.array_contains(sure, F.lower(t["value"])), "removed").otherwise("generalised")
    return F.sort_array(F.transform(found, lambda t: F.struct(kind(t).alias("kind"), t["start"].alias("start"), t["end"].alias("end"))))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Every document's spans: doc_id, text_hash, spans (base, with values), extra (generalised, removed)."""
    rows = texts(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), filled(F.col("text")).alias("text"))
    rows = with_base_spans(rows)
    words = F.array_distinct(F.regexp_extract_all(F.lower(outside(F.col("text"), F.col("spans"))), F.lit(TERM), 0))
    private = F.size("spans") > 0
    found = rows.select("doc_id", "text_hash", "spans", F.when(private, words).alias("terms"), F.when(private, F.col("text")).alias("text"))
    found = settle(found, "personal")
    marks = settle(disclosures(found.drop("text"), docs), "marks")
    joined = join_settled(found.drop("terms"), marks, ["text_hash"], "left")
    extra = F.when(F.col("marks").isNotNull(), marked(F.col("text"), F.col("spans"), F.col("marks")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return once(joined, extra=F.coalesce(extra, none)).select("doc_id", "text_hash", "spans", "extra")


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with spans replaced: ``[EMAIL]`` and the like, ``[TERM]`` if generalised, nothing if removed.

    Of overlapping spans the first by start counts.
    """
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    mask = lambda s: (
        F.when(s["kind"] == "removed", "").when(s["kind"] == "generalised", "[TERM]").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    )
    walked = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.concat(acc["out"], F.array(text.substr(acc["at"] + 1, s["start"] - acc["at"]), mask(s))).alias("out"),
            )
        ),
        lambda acc: F.concat(F.array_join(acc["out"], ""), text.substr(acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, walked).otherwise(text)


def personal_data_digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans."""
    found = find_personal_data(docs)
    base = _plain(F.col("spans"))
    return found.select(
        "doc_id",
        *[n_kind(base, kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        *[n_kind(F.col("extra"), kind).alias(f"n_{kind}") for kind in EXTRA_KINDS],
        sha256(span_list(of_kinds(base, BASE_KINDS))).alias("base_sha256"),
        span_list(F.concat(base, F.col("extra"))).alias("spans"),
    )

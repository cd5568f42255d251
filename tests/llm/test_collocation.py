"""Collocations against brute force: odd texts, ties, hot phrases, colliding fingerprints, tiny blocks."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import prose
from tiepoints.llm import collocation

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        words = re.findall(r"[^\x20\x09]+", piece)
        if words:
            yield words


def brute(rows, top, least):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        for words in pieces(text):
            total[lang or "und"] += len(words)
            for k in (1, 2, 3):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        scored = []
        for phrase, a in f.items():
            if len(phrase) < 2 or a < least:
                continue
            if any(b >= least and len(o) > len(phrase) and 100 * b >= 50 * a and phrase in (o[:2], o[1:]) for o, b in f.items()):
                continue
            cuts = [(1_000_000 * a * a // (f[phrase[:k]] * f[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def run(spark, rows, top=2000, least=3, **options):
    docs = spark.createDataFrame([(i, t, g, "x", 1) for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, f int")
    found = collocation.collocations(docs.repartition(3), top, least, **options)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in found.collect())


ROWS = [
    *[("en", prose(i % 7, 60)) for i in range(21)], ("en", None), ("en", ""), (None, " \t\n .,;"), (None, "Tie tie tie tie. tie\ttie  tie"),
    ("und", "tie tie! tie tie tie tie"), ("fr", "É é é é é é, É É É É é é é é"), *[("en", "New York New York; new\x0byork City")] * 5,
    ("de", "a b c " * 50), ("de", "b c" * 40), ("en", "hot phrase here " * 3000), ("zz", "only once here"), ("en", "x" * 5000 + " long word"),
    *[("long language name 1", "same words here")] * 4, *[("long language name 2", "same words here")] * 2,
]


@pytest.mark.parametrize("options", [{}, {"block": 300}, {"bits": 48, "block": 2000}])
def test_against_brute_force(spark, options):
    assert run(spark, ROWS, **options) == brute(ROWS, 2000, 3)


def test_only_the_first_of_every_language(spark):
    assert run(spark, ROWS, top=5) == brute(ROWS, 5, 3)


def test_nothing_frequent_and_no_rows(spark):
    assert run(spark, [("en", "a b c"), (None, None)]) == []
    assert run(spark, []) == []


def test_colliding_fingerprints_are_noticed(spark, monkeypatch):
    """Of 8-bit fingerprints almost all collide: no wrong counts are returned."""
    with pytest.raises(RuntimeError, match="share fingerprints"):
        run(spark, ROWS, bits=8)
    # With 16 bits some collide; other fingerprints are tried until the result is confirmed.
    monkeypatch.setattr(collocation, "TRIES", 50)
    rows = [("en", "new york is here " * 12), ("en", "far away " * 11)]
    assert run(spark, rows, bits=9) == brute(rows, 2000, 3)


def names_of(texts, lang, bits):
    grams = collocation.Grams(b"".join(t.encode() + b"\n" for t in texts), lang, 0, bits)
    ends = np.flatnonzero(grams.raw == 10)
    return grams.fingerprints(np.concatenate([[0], ends[:-1] + 1]), ends).tolist()


@pytest.mark.parametrize("shared", [1000, 0])
def test_a_collision_outside_of_the_result_is_noticed(spark, monkeypatch, shared):
    """Two rare phrases share a fingerprint; taken for one frequent phrase they would drop the best candidate.

    With ``SHARED`` of 0 they are counted again by their text, else other fingerprints are taken.
    """
    monkeypatch.setattr(collocation, "SHARED", shared)
    ones, others = [f"aa bb c{i}" for i in range(3000)], [f"zz yy d{i}" for i in range(3000)]
    by_name = dict(zip(names_of(ones, "en", 20), ones))
    one, other = next((by_name[n], t) for n, t in zip(names_of(others, "en", 20), others) if n in by_name)
    rows = [("en", ". ".join([one] * 9 + ["aa bb"] * 11 + [other] * 5 + [one.split()[2]] * 500 + ["mm nn"] * 12 + ["mm. nn"] * 5))]
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    found = collocation.collocations(docs, 1, 10, bits=20).collect()
    assert [tuple(r) for r in found] == brute(rows, 1, 10) and found[0]["phrase"] == "aa bb"


def test_texts_of_all_blocks_are_compared(spark):
    """Every text of a shared fingerprint is listed, whichever block or language it is in, and nothing else."""
    rows = [(g, f"{w} " * 6) for g in ("en", "fr") for w in ("one", "two", "three", "four")]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    from tiepoints.session import settle

    blocks = settle(collocation.word_blocks(docs))
    for bits in (4, 64):
        names = defaultdict(set)
        for g in ("en", "fr"):
            texts = [" ".join([w] * k) for w in ("one", "two", "three", "four") for k in (1, 2, 3)]
            for t, n in zip(texts, names_of(texts, g, bits)):
                names[n].add((g, t))
        told = settle(collocation._frequent(collocation._deal(blocks, 16, 0, bits), 1))
        made = settle(collocation._phrases(blocks, told, 16, 0, bits))
        found = collocation._shared(made.where("texts is not null").select("lang", "bucket", "texts"), 0, bits).collect()
        assert sorted(map(tuple, found)) == sorted(x for held in names.values() if len(held) > 1 for x in held)
        assert bits == 4 or not found


def test_recount_goes_by_text(spark):
    docs = spark.createDataFrame([("en", "a b c. a b", 1), ("fr", "a b", 2)], "lang string, text string, doc_id int")
    from tiepoints.session import settle

    blocks = settle(collocation.word_blocks(docs))
    wanted = spark.createDataFrame([("en", "a b"), ("en", "b")], "lang string, phrase string")
    found = {(r["lang"], r["phrase"]): r["f"] for r in collocation.recounted(blocks, wanted, bits=2).collect()}
    assert found[("en", "a b")] == 2 and found[("en", "b")] == 2 and not any(g == "fr" for g, _ in found)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB .,\n\té\x0b", max_size=60))
def test_compact_keeps_words_and_pieces(text):
    data, words = collocation.compact(text.encode())
    found = [p.split(" ") for p in data.decode().split("\n")[:-1]]
    assert found == list(pieces(text)) and words == sum(map(len, found))


def test_long_texts_are_split_between_pieces_only():
    text = b"aa bb. cc dd ee ff gg hh, ii" + b" jj" * 50 + b"! kk"
    parts = list(collocation._parts(text, 10))
    assert b"".join(parts) == text and all(p.endswith((b".", b",", b"!")) for p in parts[:-1])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, unique=True))
def test_packages_are_exact(values):
    order = np.sort(np.array(values, np.uint64))
    counts = (order % np.uint64(600)).astype(np.int64)
    names, tail = collocation.unpack(collocation.pack(order, counts), len(order))
    assert (names == order).all() and (tail == counts).all()

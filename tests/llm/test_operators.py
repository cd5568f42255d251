"""Every operator against an independent brute-force version, on texts with all the odd cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import prose
from tiepoints.llm import bpe, decontam, neardup, outliers, pii, repeats, secrets, sharding, spans, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def sf_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- sharding -------------------------------------------------------------------------------


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 3), (4, 2)])
def test_hilbert_curve_visits_neighbours(dims, bits):
    cells = np.array(list(product(range(1 << bits), repeat=dims)))
    index = sharding.hilbert_index(cells, bits)
    assert sorted(index) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


def test_shards_are_even_and_gapless(docs_of, odd):
    twice = list(odd.items()) + [(3, "one")] * 40 + [(None, None)]
    found = sharding.shard_documents(docs_of(twice), 5).collect()
    by_shard = defaultdict(list)
    for r in found:
        by_shard[r["shard"]].append(r["slot"])
    sizes = [len(s) for s in by_shard.values()]
    assert len(found) == len(twice) and set(by_shard) == set(range(5)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    for r in found:
        if r["doc_id"] is not None:
            data = (odd[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(data) + 8, zlib.crc32(data))


# --- sentence spans -------------------------------------------------------------------------


def brute_spans(texts):
    cut, occ = {}, defaultdict(list)
    for d, t in sorted(texts.items()):
        cut[d] = found = spans.sentences(t or "")
        held = set()
        for step, order in ((1, range(len(found))), (-1, range(len(found)))):
            for i in order:
                j, n = i, 0
                while 0 <= j < len(found):
                    n += len(found[j][2])
                    if n >= spans.LEAST_WORDS and abs(j - i) + 1 >= spans.RUN:
                        held.add((min(i, j), max(i, j) + 1))
                        break
                    j += step
        for a, b in sorted(held):
            occ[tuple(found[k][2] for k in range(a, b))].append((d, a, b))
    gone = defaultdict(set)
    for places in occ.values():
        for d, a, b in places[1:]:
            gone[d] |= set(range(a, b))
    out = {}
    for d, t in texts.items():
        kept, at = [], 0
        for i, (a, b, _) in enumerate(cut[d]):
            if i in gone[d]:
                kept.append(t[at:a])
                at = b
        out[d] = (len(gone[d]), None if t is None else "".join(kept) + t[at:])
    return out


def test_sentence_spans(docs_of, odd):
    passage = prose(77, 60)
    texts = odd | {20: prose(30) + "\n" + passage + "\n" + prose(31), 21: passage, 22: prose(32) + " " + passage + "\n" + passage}
    found = rows(spans.remove_repeated_runs(docs_of(texts)))
    expected = brute_spans(texts)
    assert {d: (r["n_removed"], r["text"]) for d, r in found.items()} == expected
    assert expected[20][0] == 0 and not expected[21][1].strip() and passage not in expected[22][1]


def test_plain_repeated_passages_are_found(docs_of):
    words = lambda seed, n: prose(seed, n).replace(".", "").split()
    texts, passages = {900: " ".join(words(900, 101)), 901: " ".join(words(900, 101))}, {}
    for i in range(60):
        passage = words(1000 + i, 51 + i % 20)
        passage[7:9] = ["one,", "two,"] if i % 3 else ["end.", "Next"]
        for d in (2 * i, 2 * i + 1):
            texts[d] = " ".join(words(2000 + d, 30 + 7 * d % 50) + passage + words(4000 + d, 20 + 11 * d % 40))
        passages[2 * i + 1] = set(passage)
    found = rows(spans.remove_repeated_runs(docs_of(texts)))
    assert found[901]["text"] == "" and found[900]["text"] == texts[900]
    for d, passage in passages.items():
        gone = Counter(texts[d].split()) - Counter(found[d]["text"].split())
        assert gone.total() >= 20 and set(gone) <= passage, d
        assert found[d - 1]["text"] == texts[d - 1]


def brute_pieces(text):
    """(start, end, words) of every piece, gap by gap."""
    found, words = list(re.finditer(r"\S+", text)), text.lower().split()
    gaps = [text[a.end() : b.start()] for a, b in zip(found, found[1:])]
    ends = [w[-1] in ".!?" or "\n" in g for w, g in zip(words, gaps)]
    crc = [zlib.crc32(w.encode()) for w in words]
    value = [((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) % 2**64 >> 2) + (1 if w[-1] in ",;:|" else 2**62) for a, b, w in zip(crc, crc[1:], words)]
    value = [0 if e else v for e, v in zip(ends, value)]
    cut = {i for i, e in enumerate(ends) if e}
    cut |= {min(range(i, i + spans.WINDOW), key=lambda k: (value[k], -k)) for i in range(len(gaps) - spans.WINDOW + 1)}
    out, begin, word = [], 0, 0
    for i in sorted(cut):
        end = found[i + 1].start()
        if words[i][-1] not in ".!?" and "\n" in gaps[i]:
            end = found[i].end() + gaps[i].rindex("\n") + 1
        out.append((begin, end, tuple(words[word : i + 1])))
        begin, word = end, i + 1
    return [*out, (begin, len(text), tuple(words[word:]))] if words else []


def brute_runs(found):
    """{(first, end): whether the run was met before in this text}"""
    held, seen, out = set(), set(), {}
    for a in range(len(found)):
        for b in range(a + spans.RUN, len(found) + 1):
            inner = [sum(len(w) for *_, w in found[i:j]) < spans.LEAST_WORDS or j - i < spans.RUN for i, j in ((a + 1, b), (a, b - 1))]
            if sum(len(w) for *_, w in found[a:b]) >= spans.LEAST_WORDS and any(inner):
                held.add((a, b))
    for a, b in sorted(held):
        key = tuple(w for *_, w in found[a:b])
        out[a, b] = key in seen
        seen.add(key)
    return out


def odd_texts(n):
    rng = np.random.default_rng(11)
    parts = ["a ", "b ", "c ", "D. ", "e, ", "É ", "İ ", "Σ\t", "\n", " \n  ", "\x1c", "f;\u3000", "long-word "]
    texts = ["".join(rng.choice(parts, int(rng.integers(0, 90)))) for _ in range(n)]
    return ["", " \n ", "one", "a " * 15, "a " * 16 + "b", *texts, prose(3, 200) + "\n" + prose(3, 200), prose(3, 200).replace(".", "")]


def test_texts_cut_together_are_cut_as_alone():
    texts = odd_texts(60)
    cut = [brute_pieces(t) for t in texts]
    assert [spans.sentences(t) for t in texts] == cut
    _, own, _, start, end = spans.located(texts)
    assert [*zip(own.tolist(), start.tolist(), end.tolist())] == [(i, a, b) for i, found in enumerate(cut) for a, b, _ in found]
    text, h, first, end, again = (x.tolist() for x in spans.runs_of(texts))
    expected = {(i, *run): met for i, found in enumerate(cut) for run, met in brute_runs(found).items()}
    assert len(text) == len(expected) and dict(zip(zip(text, first, end), again)) == expected and sum(again)
    keys = {(n, tuple(w for *_, w in cut[i][a:b])) for i, n, a, b in zip(text, h, first, end)}
    assert len(keys) == len({n for n, _ in keys}) == len({k for _, k in keys})


def test_words_are_hashed_once(monkeypatch):
    """Not once per place: that was most of the time of op2_sentence_spans."""
    hashed, crc32 = [], zlib.crc32
    monkeypatch.setattr(zlib, "crc32", lambda data: hashed.append(data) or crc32(data))
    texts = ["once " + prose(900 + i % 3, 300) + " upon" for i in range(9)]
    for text in texts:
        spans.sentences(text)
    assert len(hashed) == len(set(hashed)) <= len({w for t in texts for w in t.lower().split()})


def brute_value_steps(values, steps):
    """Quantile of the middle row of every value among the sorted rows, in exact integers."""
    known = sorted(v.encode() for v in values if v is not None)
    return {v.decode(): 1 + min((2 * known.index(v) + known.count(v)) * steps // (2 * len(known)), steps - 1) for v in set(known)}


def test_places_on_the_curve_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    sources = [f"https://common.example/{i}" for i in range(40)] + ["https://common.example/7"] * 25 + [None, "", "é"]
    data = [
        (int(i), None if i % 50 == 7 else "x" * int(rng.integers(0, 90)), [None, "en", "en", "de", "fr"][int(rng.integers(5))], sources[int(rng.integers(len(sources)))])
        for i in rng.permutation(500)
    ]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string").repartition(5)
    own = docs.select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("c"), (F.octet_length(F.coalesce("text", F.lit(""))) + 8).cast("long").alias("size"))
    slices = {r[0]: r[1] for r in own.select("doc_id", F.pmod(F.xxhash64("doc_id", "c", "size"), F.lit(sharding.SLICES))).collect()}
    steps = (1 << sharding.BITS) - 1
    of_lang, of_source = (brute_value_steps([r[k] for r in data], steps) for k in (2, 3))
    assert len(set(of_source.values())) > 8  # a common beginning does not make one step of all
    size = {r[0]: len((r[1] or "").encode()) + 8 for r in data}
    ordered = sorted(size.values())
    cuts = sorted({ordered[max(-(-i * len(ordered) // steps) - 1, 0)] for i in range(1, steps)})
    cells = np.array([[of_lang.get(r[2], 0), of_source.get(r[3], 0), 1 + sum(size[r[0]] > c for c in cuts)] for r in data])
    curve = sharding.hilbert_index(cells, sharding.BITS)
    order = [d for *_, d in sorted((curve[i], slices[r[0]], r[0]) for i, r in enumerate(data))]
    small, larger = divmod(len(order), 24)
    want = [(d, s, k) for s in range(24) for k, d in enumerate(order[s * small + min(s, larger) :][: small + (s < larger)])]
    got = [(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard_documents(docs).collect()]
    assert sorted(got) == sorted(want)


# --- personal data --------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def brute_personal(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email"
                or (kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")))
                or (kind == "card" and 13 <= len(digits) <= 19 and luhn(digits))
                or (kind == "phone" and 9 <= len(digits) <= 15)
            ):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data_base(docs_of, odd):
    parts = ["a@b.c", "a.b@c-d.e_f@g.h", "1.2.3.4", "0001.2.3.256.5.6.7", "4111 1111-1111 1111", "+1 (017) 555-7713", "é", "\U0001f600"]
    texts = odd | {100 + i: sep.join(parts[i:] + parts[:i]) for i in range(8) for sep in (" ",)}
    texts |= {200: "".join(parts), 201: "x".join(parts), 202: "1 " * 3000, 203: "a@" * 3000, 204: "1." * 3000}
    for d, r in rows(pii.personal_data_digest(docs_of(texts))).items():
        expected = brute_personal(texts[d])
        assert r["base_sha256"] == sha(",".join(expected)), d
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s.startswith(k) for s in expected) for k in PLAIN]


def test_terms_that_disclose_are_sanitised(docs_of):
    filler = {50 + i: prose(50 + i) + " the common words" for i in range(20)}
    texts = filler | {
        1: "the common words of Zanzibar write to secret.person@mail.com today",
        2: "and the common zanzibar secret.person@mail.com again",
        3: "zanzibar alone without an address",
        4: "the common other@mail.com",
    }
    found = pii.find_personal_data(docs_of(texts)).join(docs_of(texts).select("doc_id", "text"), "doc_id")
    out = rows(found.select("doc_id", pii.sanitised(F.col("text"), F.concat(pii._plain(F.col("spans")), F.col("extra"))).alias("t")))
    assert out[1]["t"] in ("the common words of  write to [EMAIL] today", "the common words of [TERM] write to [EMAIL] today")
    assert out[3]["t"] == texts[3] and out[4]["t"] == "the common [EMAIL]" and out[55]["t"] == texts[55]


def test_terms_far_from_their_entity_are_marked(docs_of):
    texts = {50 + i: prose(50 + i) for i in range(20)} | {
        1: "Kestrelwood " + prose(1) + " far.away@mail.com " + prose(2) + " kestrelwood",
        2: "far.away@mail.com " + prose(3, 300) + " KESTRELWOOD, kestrelwoods",
        3: "kestrelwood alone",
    }
    found = rows(pii.find_personal_data(docs_of(texts)))
    for d in (1, 2):
        at = [m.span() for m in re.finditer(r"(?i)\bkestrelwood\b", texts[d])]
        assert [(s["start"], s["end"]) for s in found[d]["extra"]] == at, d
    assert not found[3]["extra"] and not found[55]["extra"]


def brute_entities(text):
    out = set()
    for span in brute_personal(text):
        kind, start, end = span.split(":")
        value = text[int(start) : int(end)].lower()
        digits = re.sub("[^0-9]", "", value)
        if kind == "email":
            local, domain = value.rsplit("@", 1)
            out |= {f"email:{value}", f"domain:{domain}"} | {f"name:{w}" for w in re.findall("[a-z]{3,}", local)[:1]}
        elif kind == "ip":
            out |= {f"ip:{value}", "network:" + ".".join(value.split(".")[:2])}
        elif kind == "card":
            out |= {f"card:{digits}", f"issuer:{digits[:6]}"}
        else:
            out |= {f"phone:{digits}", f"area:{digits[:-7]}"}
    return out


def brute_marks(texts):
    """Per text its terms above the threshold and the disclosure of each, from counts of distinct texts."""
    distinct = {t or "" for t in texts.values()}
    words = lambda t: set(re.findall(r"[^\W\d_]{3,}", t.lower()))
    n_entity, n_term, n_both, outside, entities = Counter(), Counter(), Counter(), {}, {}
    for t in distinct:
        rest = t
        for s in brute_personal(t):
            _, start, end = s.split(":")
            rest = rest[: int(start)] + " " * (int(end) - int(start)) + rest[int(end) :]
        outside[t], entities[t] = words(rest), brute_entities(t)
        n_entity.update(entities[t])
        n_term.update(words(t))
        n_both.update(product(entities[t], outside[t]))
    marks = {}
    for t in distinct:
        for e, w in product(entities[t], outside[t]):
            if n_both[e, w] >= 2 and n_entity[e] < len(distinct):
                share = np.log(n_both[e, w] * len(distinct) / (n_entity[e] * n_term[w])) / np.log(len(distinct) / n_entity[e])
                if share >= 0.8 - 1e-12:
                    own = marks.setdefault(t, {})
                    own[w] = max(own.get(w, 0), min(share, 1.0))
    return marks


def brute_extra(text, marks):
    base = [tuple(map(int, s.split(":")[1:])) for s in brute_personal(text)]
    out = []
    for m in re.finditer(r"[^\W\d_]+", text or ""):
        level = marks.get(m[0].lower())
        if level is not None and not any(m.start() < e and s < m.end() for s, e in base):
            out.append((m.start(), m.end(), "removed" if level >= 0.95 else "generalised"))
    return sorted(out)


def test_disclosures_equal_brute_force(docs_of, odd):
    rng = np.random.default_rng(4)
    texts = dict(odd)
    for i in range(300):
        words = [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}" for k in rng.zipf(1.5, 12) % 100]
        firm = int(rng.integers(0, 12))
        if i % 3 == 0:
            words.insert(5, ["ann.{0}@firm{1}.org", "10.{1}.{0}.7", "+1 (2{1}) 555-{0:04d}", "bob{0}@home.net"][i // 3 % 4].format(i % 200, firm))
            if rng.random() < 0.7:
                words.append(f"project{'abcdefghijkl'[firm]}")
        texts[1000 + i] = " ".join(words)
    texts |= {5000 + i: texts[1000 + 3 * i] for i in range(20)}
    marks = brute_marks(texts)
    found = rows(pii.find_personal_data(docs_of(list(texts.items()))))
    extra = 0
    for d, t in texts.items():
        want = brute_extra(t, marks.get(t or "", {}))
        assert [(s["start"], s["end"], s["kind"]) for s in sorted(found[d]["extra"], key=lambda s: s["start"])] == want, d
        extra += len(want)
    assert extra > 20


def test_planted_disclosing_terms_are_found_and_others_left(docs_of):
    """Ten firms have a code name in nine of ten of their texts; common words and other texts stay whole."""
    codes = [f"codename{c}" for c in "abcdefghij"]
    texts = {i: prose(i, 40) + " meeting about budget" for i in range(200)}
    for i in range(200):
        code = codes[i % 10] if i // 10 % 10 else "nothing"
        texts[1000 + i] = f"{prose(i // 10, 40)} {code} meeting about budget p{i}.mail@firm{i % 10}.com"
    found = rows(pii.find_personal_data(docs_of(texts)))
    marked = {(d, texts[d][s["start"] : s["end"]]) for d, r in found.items() for s in r["extra"]}
    planted = {(d, c) for d, t in texts.items() for c in codes if c in t}
    assert marked == planted


# --- toxicity -------------------------------------------------------------------------------


def test_toxicity_learns_and_never_sees_held_out_labels(spark, docs_of):
    bad = ("rotten", "vilest", "grubby")
    texts = {i: prose(i, 40) + (f" {bad[i % 3]}" if i % 4 == 0 else "") for i in range(400)}
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    found = rows(toxicity.classify(docs_of(texts | {900: None, 901: ""}), labels))
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(found[i]["held_out"] == (i in held) for i in range(400))
    assert np.mean([found[i]["predicted"] == (i % 4 == 0) for i in held]) > 0.9
    assert found[900]["score"] == found[901]["score"] and 0 <= found[901]["score"] <= 1
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = rows(toxicity.classify(docs_of(texts), flipped))
    assert all(again[i]["score"] == found[i]["score"] for i in range(400))


def test_toxicity_without_examples(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.classify(docs_of({1: "a", 2: None}), none).collect()} == {0.0}


# --- outliers -------------------------------------------------------------------------------


def brute_counts(text):
    words = WORD.findall(text or "")
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_outliers(docs_of, odd):
    good = {100 + i: prose(i, 150 + i) for i in range(160)}
    texts = odd | good | {
        500: "a b c a b c", 501: "x|y\nx|y\n\n \nz", 502: ("word " * 30 + "\n") * 5,
        503: " ".join(f"#{i}|<{i}>*" for i in range(200)),
    }
    found = rows(outliers.judge(docs_of(texts)))
    for d, r in found.items():
        n = brute_counts(texts[d])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n, d
        assert r["base_failed"] == (n[0] < 50 or 2 * n[4] > n[0])
        assert not (r["base_failed"] and r["kept"])
    assert all(found[d]["kept"] for d in good) and not found[503]["kept"] and not found[503]["base_failed"]


def test_mcd_agrees_with_numpy_on_clean_groups(spark):
    rng = np.random.default_rng(3)
    scatter = np.diag([1.0, 0.5, 0.3, 0.4, 0.2])
    points = rng.normal(size=(4000, 5)) @ scatter
    points[:400] += 8  # a tenth of outliers, all on one side
    table = spark.createDataFrame([("g", *map(float, p)) for p in points], "grp string, x0 double, x1 double, x2 double, x3 double, x4 double")
    e = outliers.mcd(table).first()
    center = np.array([e[f"m{i}"] for i in range(5)])
    assert np.abs(center).max() < 0.1
    factor = np.array([[e[f"l{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
    expected = np.sqrt(np.diag(np.cov(points[400:].T)) + outliers.FLOOR**2)
    assert np.allclose(np.sqrt(np.diag(factor @ factor.T)), expected, rtol=0.2)


# --- decontamination ------------------------------------------------------------------------


def test_decontamination(spark, docs_of, odd):
    item = prose(90, 30)
    words = item.split()
    texts = odd | {
        30: prose(40, 3000) + " " + item.upper() + " " + prose(41, 3000),
        31: prose(42) + " " + " ".join(words[:26]) + " " + prose(43),  # 22 of 26 shingles
        32: prose(44) + " " + " ".join(words[:22]) + " " + prose(45),  # 18 of 26
        33: item,
    }
    items = [(1, item), (2, item), (3, None), (None, item), (4, "too short"), (5, prose(99, 12)), (5, prose(99, 12))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = rows(decontam.decontaminate(docs_of(texts), benchmark))
    assert {d: r["items"] for d, r in found.items() if not r["kept"]} == {30: "1,2", 31: "1,2", 33: "1,2"}
    assert found[31]["containment"] == round(22 / 26, 6) and len(found) == len(texts)
    kept = decontam.drop_contaminated(docs_of(texts), benchmark)
    assert kept.columns == docs_of(texts).columns and kept.count() == len(texts) - 3


# --- secrets --------------------------------------------------------------------------------


def brute_entropy(text, least, window):
    marked = set()
    for i in range(len(text) - window + 1):
        counts = Counter(text[i : i + window])
        if -sum(c / window * np.log2(c / window) for c in counts.values()) >= least - 1e-9:
            marked |= set(range(i, i + window))
    runs = []
    for i in sorted(marked):
        if runs and runs[-1][1] == i:
            runs[-1][1] = i + 1
        else:
            runs.append([i, i + 1])
    return [tuple(r) for r in runs]


@settings(max_examples=60, deadline=None)
@given(st.text("abcdef0123", max_size=80), st.sampled_from([1.5, 2.5, 3.0]), st.sampled_from([5, 20]))
def test_sliding_entropy(text, least, window):
    assert secrets.high_entropy_runs(text, least, window) == brute_entropy(text, least, window)


def test_secrets(docs_of, odd):
    key = "Zx9Qw3Er7Ty1Ui5Op0As"
    texts = odd | {
        40: 'API_KEY: "abcdef" token=abc PassWord = hunter22',
        41: "AKIA" + "Z" * 16 + " AKIA123 " + "0af" * 8 + " deadbeef",
        42: f"see {key} here", 43: "the 01234567-89ab-cdef-0123-456789abcdef id", 44: "thisisaverylongwordwithoutasecret",
    }
    found = rows(secrets.secret_digest(docs_of(texts)))
    assert found[40]["spans"] == "assign:0:16,assign:28:47" and found[40]["n_assign"] == 2
    assert found[41]["spans"] == "access:0:20,hex:29:53" and found[41]["base_sha256"] == sha("access:0:20,hex:29:53")
    assert found[42]["spans"] == "entropy:4:24" and found[42]["base_sha256"] == sha("")
    assert all(found[d]["spans"] == "" for d in (*odd, 43, 44) if d != 11) and found[0]["n_hex"] == 0
    assert found[11]["spans"] == "hex:0:30000"
    masked = docs_of(texts).select("doc_id", secrets.masked(F.col("text"))["text"].alias("t"))
    assert rows(masked)[42]["t"] == "see [SECRET] here" and rows(masked)[0]["t"] is None


def test_allow_list_judges_the_flagged_span_only():
    key, letters = "Zx9Qw3Er7Ty1Ui5Op0As", "ZxQwErTyUiOpAsDfGhJk"
    for text in (f"host/example-bucket/{key}", f"EXAMPLE_SERVICE_KEY={key}", f"placeholder-{key}", letters, f"0123456789/{letters}"):
        kind, start, end = secrets.spans_of(text)[-1]
        assert kind == "entropy" and start <= max(text.find(key), text.find(letters)) and end == len(text), text
    for text in (
        "id=7f3c9a12-4be8-4d61-9c0f-5a2e81b7d934", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "12345678901234567890",
        "MyVeryLongConfigurationBackgroundName", "home/public/workflow_templates/daylight",
    ):
        assert secrets.spans_of(text, ()) and not secrets.spans_of(text), text


# --- BPE ------------------------------------------------------------------------------------

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["<|endoftext|>", "<|endof", " ", "  ", "\n", "\t", "don't", "'s", "é", "日本", "\U0001f600", "the quick", "123", "#!", "\xa0", " ", "\x85"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=600))
def test_tokens_equal_those_of_the_library(pieces):
    text = "".join(pieces)
    library, own = Tokenizer.from_file(PATH), bpe.coder(PATH)
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_bpe_digest_and_reuse(docs_of, odd):
    library = Tokenizer.from_file(PATH)
    found = rows(bpe.encode_digest(docs_of(odd), PATH))
    for d, text in odd.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert tuple(found[d])[1:] == (len(ids), sha(",".join(map(str, ids))), sha(text or ""))
    shared = bpe.dictionary(docs_of(odd), PATH, 4)
    assert 0 < len(shared) <= 4
    plain = bpe.decode_documents(bpe.encode_documents(docs_of(odd), PATH), PATH)
    assert all((r["text"] or "") == r["decoded"] for r in plain.collect())


# --- near duplicates ------------------------------------------------------------------------


def brute_components(texts, words, num, den):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t in texts.items():
        w = WORD.findall((t or "").translate(lower))
        sets[d] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    up = {d: d for d in texts}

    def top(d):
        return d if up[d] == d else top(up[d])

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: (len(sets[d]), top(d)) for d in texts}


@pytest.mark.parametrize("rule", [neardup.Rule(), neardup.Rule(5, 80, 100)])
def test_near_duplicates(docs_of, odd, rule):
    base = prose(60, 150).split()
    chain = {}
    for i in range(40):  # each differs from the last in one word more: links along the chain only
        words = list(base)
        for k in range(i):
            words[k * 3] = f"w{k}"
        chain[300 + i] = " ".join(words)
    texts = odd | chain | {400: prose(60, 150).upper()}
    found = rows(neardup.near_duplicates(docs_of(texts), rule))
    expected = brute_components(texts, rule.words, rule.num, rule.den)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in found.items()} == expected
    assert all(r["kept"] == (r["component_id"] == d) for d, r in found.items())


def test_posterior_bound_keeps_what_it_must():
    least = neardup.least_matches(85, 100)
    rng = np.random.default_rng(1)
    left = rng.integers(0, 2**32, (2000, neardup.HASHES), dtype=np.uint32)
    right = np.where(rng.random(left.shape) < 0.85, left, left + np.uint32(1))
    assert neardup.survivors(left, right, least).all()
    assert not neardup.survivors(left, left + np.uint32(1), least).any()
    far = np.where(rng.random(left.shape) < 0.3, left, left + np.uint32(1))
    assert neardup.survivors(left, far, least).mean() < 0.01


# --- repeated bytes -------------------------------------------------------------------------


def brute_repeats(texts, length):
    count = Counter()
    data = {d: (t or "").encode() for d, t in texts.items()}
    for b in data.values():
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = {}
    for d, b in data.items():
        covered = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                covered[i : i + length] = True
        spans_ = int((np.diff(covered[:-1].astype(int), prepend=0) == 1).sum())
        kept = bytes(x for x, c in zip(b, covered) if not c)
        out[d] = (len(b), int(covered.sum()), spans_, sha(kept))
    return out


@pytest.mark.parametrize("q", [2, 3, 5, 13])
def test_difference_cover_has_all_differences(q):
    v = q * q + q + 1
    cover = repeats.difference_cover(q)
    assert len(cover) == q + 1 and {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_repeated_bytes(docs_of, odd):
    shared = prose(70, 50)[:399] + "é"
    texts = {d: t for d, t in odd.items() if d != 11} | {
        50: "x" + shared + prose(71), 51: prose(72) + shared, 52: prose(73) + shared[1:], 53: "ab" * 500,
    }
    for block in (1 << 12, repeats.BLOCK):
        found = rows(repeats.remove_repeats(docs_of(texts), block=block))
        assert {d: tuple(r)[1:] for d, r in found.items()} == brute_repeats(texts, 400)


# --- all ------------------------------------------------------------------------------------


def test_empty_tables(spark, docs_of):
    none = docs_of([]) if False else spark.createDataFrame([], docs_of({1: "a"}).schema)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    for result in (
        sharding.shard_documents(none), spans.remove_repeated_runs(none), pii.personal_data_digest(none),
        toxicity.classify(none, labels), outliers.judge(none), decontam.decontaminate(none, benchmark),
        secrets.secret_digest(none), bpe.encode_digest(none, PATH), neardup.near_duplicates(none), repeats.remove_repeats(none),
    ):
        assert result.count() == 0
    assert decontam.decontaminate(docs_of({1: "a", 2: None}), benchmark).where("kept").count() == 2


def test_rows_with_null_or_repeated_ids(spark, docs_of):
    repeated = docs_of([(None, prose(1, 200)), (None, None), (1, prose(1, 200)), (1, prose(1, 200)), (2, prose(2))])
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, None), (2, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, prose(2, 40))], "item_id long, text string")
    for result in (
        sharding.shard_documents(repeated), spans.remove_repeated_runs(repeated), pii.personal_data_digest(repeated),
        toxicity.classify(repeated, labels), outliers.judge(repeated), decontam.decontaminate(repeated, benchmark),
        secrets.secret_digest(repeated), bpe.encode_digest(repeated, PATH), neardup.near_duplicates(repeated),
        repeats.remove_repeats(repeated),
    ):
        assert result.count() == 5


ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


@pytest.mark.parametrize("chars, n", [(ALNUM, 24), (ALNUM, 32), (ALNUM + "+/", 40), ("0123456789ABCDEF", 32), (ALNUM[:52], 32)])
def test_recall_of_entropy_on_planted_keys(chars, n):
    """Random keys that no base pattern finds, in prose; prose alone has no spans."""
    rng, hits = np.random.default_rng(5), 0
    for i in range(500):
        key = "".join(rng.choice(list(chars), n))
        text = f"{prose(i, 9)} {key} {prose(i + 1, 9)}"
        at = text.index(key)
        hits += any(k == secrets.ENTROPY and a < at + n and at < b for k, a, b in secrets.spans_of(text))
    assert hits >= 0.95 * 500
    assert not any(secrets.spans_of(prose(i, 300)) for i in range(100))

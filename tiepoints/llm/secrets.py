"""Secret scan: fixed patterns, and sliding-window entropy of candidate strings.

A null text has no spans. Equal texts have equal spans; rows do not affect each other, so repeated
rows, ties and empty tables need no rule. Texts of any length take linear time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiepoints.llm.common import SPANS, filled, give_back, n_kind, of_kinds, sha256, span_list, texts

# The kinds in the order of the result, their patterns and least lengths.
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_VALUE = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # 20 characters and more
HEX = re.compile(r"[0-9a-f]{24,}")  # the longest run, so a failing shorter one can be skipped unseen
ENTROPY = "entropy"

WINDOW = 20
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}")
#: Class, its characters, bits a window must have. A window of 20 has at most 4.32 bits; random
#: hex averages 3.4 and random base64 4.1, words run together stay below 3.6.
CLASSES = (
    ("hex", re.compile(rf"[0-9a-f]{{{WINDOW},}}|[0-9A-F]{{{WINDOW},}}"), 3.0),
    ("alnum", re.compile(rf"[A-Za-z0-9]{{{WINDOW},}}"), 3.8),
    ("base64", CANDIDATE, 3.9),
)
#: Flagged strings that are no secrets: words run together, numbers, UUIDs, counting sequences,
#: and documentation placeholders. A flagged span is left out only if each of its parts between / and =
#: is allowed: the first three must match all of a part, the last must cover more than half of it.
WORDS = r"[A-Za-z_+-]+"
PLACEHOLDER = r"(?i:0123456789|abcdefghij(?:klmnopqrstuvwxyz)?|example|placeholder|x{6,})"
ALLOW = (
    WORDS,
    r"[0-9_+-]+",
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    PLACEHOLDER,
)
PART = re.compile(r"[^/=]+")
#: Letters count as words if they change case like words and most of their neighbours are common pairs.
CASED = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
COMMON = frozenset(
    "th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le sa si ar ve "
    "ra ld ur ro ri io ic ne li ll co me ma el om us ec ta ch la ho be ce di wa no ei ie au ge un ss sc ck tr pr "
    "pl ct rs ns ts ry ly ee oo ow ai ue qu os do da lo mo po so pe pa ca ad am em im il ir id ig ag ac ap ef if ev "
    "iv av ke ki nk rd rt rn rm rk lt ls mp nc ff pp tt ss mm nn rr ss ub ul ut su tu bu bl br cr cl dr fr fl gr gl".split()
)
WORD_LENGTH, WORD_PAIRS = 3.0, 0.5

_C_LOG_C = [0.0] + [c * log2(c) for c in range(1, WINDOW + 1)]


def high_entropy_runs(text: str, least: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal unions of windows whose Shannon entropy reaches ``least`` bits.

    Entropy is log2(w) - sum(c * log2 c) / w over the counts c in the window; a step changes two
    counts, so a text costs one pass however long it is.
    """
    if len(text) < window:
        return []
    plogp = _C_LOG_C if window <= WINDOW else [0.0] + [c * log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total, runs = 0.0, []
    for end, char in enumerate(text, 1):
        c = counts.get(char, 0)
        total += plogp[c + 1] - plogp[c]
        counts[char] = c + 1
        start = end - window
        if start < 0:
            continue
        if log2(window) - total / window >= least - 1e-9:
            if runs and start <= runs[-1][1]:
                runs[-1][1] = end
            else:
                runs.append([start, end])
        out = text[start]
        c = counts[out]
        total += plogp[c - 1] - plogp[c]
        counts[out] = c - 1
    return [(a, b) for a, b in runs]


def wordlike(part: str) -> bool:
    """Whether letters read as words: cased words of some length, and mostly common pairs of letters."""
    words = CASED.findall(part)
    if len(part) < 4:  # too short to be a secret or to tell
        return True
    pairs = [w[i : i + 2].lower() for w in words for i in range(len(w) - 1)]
    if sum(map(len, words)) < WORD_LENGTH * len(words):
        return False
    return sum(p in COMMON for p in pairs) >= WORD_PAIRS * len(pairs)


@lru_cache(maxsize=8)
def _compiled(allow: tuple[str, ...]) -> tuple[re.Pattern, ...]:
    return tuple(re.compile(p) for p in allow)


def allowed(text: str, start: int, end: int, allow: tuple[str, ...] = ALLOW) -> bool:
    """Whether every part of a flagged span is on the allow-list; an empty list allows nothing."""

    def part_allowed(a: int, b: int) -> bool:
        for pattern, found in zip(allow, _compiled(allow)):
            if pattern == PLACEHOLDER:
                if 2 * sum(m.end() - m.start() for m in found.finditer(text, a, b)) > b - a:
                    return True
            elif found.fullmatch(text, a, b) and (pattern != WORDS or wordlike(text[a:b])):
                return True
        return False

    return bool(allow) and all(part_allowed(*m.span()) for m in PART.finditer(text, start, end))


def spans_of(text: str, allow: tuple[str, ...] = ALLOW) -> list[tuple[str, int, int]]:
    """All spans of one text by start, then kind. Entropy spans inside a base span are left out."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    base, extra = list(found), set()
    for candidate in CANDIDATE.finditer(text):
        for _, pattern, least in CLASSES:
            for run in pattern.finditer(candidate[0]):
                for a, b in high_entropy_runs(run[0], least):
                    start = candidate.start() + run.start() + a
                    end = candidate.start() + run.start() + b
                    if not allowed(text, start, end, allow):
                        extra.add((start, end))
    last = -1
    for start, end in sorted(extra, key=lambda s: (s[0], -s[1])):  # the classes overlap; keep the outer span
        if end > last and not any(a <= start and end <= b for _, a, b in base):
            found.append((ENTROPY, start, end))
            last = end
    order = {kind: i for i, kind in enumerate((*BASE_KINDS, ENTROPY))}
    return sorted(found, key=lambda s: (s[1], order[s[0]]))


def secret_spans(text: Column, allow: tuple[str, ...] = ALLOW) -> Column:
    """Spans ``(kind, start, end)`` of a text column, in code points with the end exclusive."""

    @F.arrow_udf(SPANS)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = [spans_of(text.as_py(), allow) for text in batch]  # one text at a time becomes a Python object
            yield pa.array([[dict(zip(("kind", "start", "end"), s)) for s in spans] for spans in found], kind)
        give_back()

    return scan(filled(text))


def find_secrets(docs: DataFrame) -> DataFrame:
    """Every document with its spans."""
    docs = texts(docs)
    return docs.select("doc_id", "text", secret_spans(F.col("text")).alias("spans"))


def redacted(text: str, spans: list[tuple[str, int, int]], mask: str) -> str:
    """A text with the union of its spans replaced by ``mask``."""
    parts, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        if start >= at:
            parts += [text[at:start], mask]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def masked(text: Column, allow: tuple[str, ...] = ALLOW, mask: str = "[SECRET]") -> Column:
    """Struct of ``text`` with every secret replaced by ``mask``, and whether it had one; null stays null.

    Scanning and replacing are one function, so that a task needs one worker and not two.
    """

    @F.arrow_udf("text string, found boolean")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out, found = [], []
            for value in batch:
                own = value.as_py()
                spans = spans_of(own, allow) if own is not None else []
                out.append(redacted(own, spans, mask) if spans else own)
                found.append(bool(spans))
            yield pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(found, pa.bool_())], ["text", "found"])
        give_back()

    return scan(text)


def secret_digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans."""
    found = find_secrets(docs)
    spans = F.col("spans")
    return found.select(
        "doc_id",
        *[n_kind(spans, kind).alias(f"n_{kind}") for kind in (*BASE_KINDS, ENTROPY)],
        sha256(span_list(of_kinds(spans, BASE_KINDS))).alias("base_sha256"),
        span_list(spans).alias("spans"),
    )

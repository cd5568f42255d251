"""Archives against brute force, hand-made archives, and the odd cases."""

import gzip
import hashlib
from collections import defaultdict

import pytest

from tiepoints.llm import warc

LONG = "<p>" + "word " * 400 + "</p>"
TRICKY = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" + "\r\n" * 3


def brute(pages):
    """(page_id, bytes, sha1, type, refers_to) of every row."""
    largest = defaultdict(list)
    for page_id, _, html in pages:
        largest[html or ""].append(page_id)
    out = []
    for page_id, _, html in pages:
        data = (html or "").encode()
        newest = max((p for p in largest[html or ""] if p is not None), default=None)
        revisit = len(data) >= 1000 and newest is not None and page_id != newest
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", newest if revisit else None))
    return sorted(out, key=repr)


PAGES = [
    (1, "http://a.example/x?y=1", LONG), (5, "http://b.example/", LONG), (3, None, LONG), (5, "http://b.example/", LONG),
    (None, "http://c.example/", LONG), (7, "http://d.example/", None), (8, "http://e.example/", ""), (9, "http://f.example/", TRICKY),
    (10, "http://g.example/", TRICKY + LONG), (11, "http://h.example/", TRICKY + LONG), (12, "bad\r\nWARC-Type: x", "é日本\U0001f600" * 300),
    (13, "not a url", "short"), (14, "http://i.example/", "short"), (15, "http://j.example/", "x" * 2_000_000), (16, "", "y" * 999), (17, "", "y" * 999),
]


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, digest string, `_id` int").repartition(3)


@pytest.mark.parametrize("rows", [PAGES, [(None, None, LONG)] * 3, PAGES[:1]])
def test_round_trip(spark, rows):
    found = warc.round_trip(pages_of(spark, rows)).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute(rows)


def test_no_pages(spark):
    found = warc.round_trip(pages_of(spark, []))
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] and found.count() == 0


def test_archives_hold_three_linked_records_per_page(spark, tmp_path):
    path = warc.write_archives(pages_of(spark, PAGES), str(tmp_path / "out"), records_per_file=6)
    data = [gzip.decompress(f.read_bytes()) for f in (tmp_path / "out").glob("*.gz")]
    assert len(data) > 3 and all(d.startswith(b"WARC/1.1\r\nWARC-Type: ") and d.endswith(b"\r\n\r\n") for d in data)
    found = warc.read_records(spark, path, with_payload=True).collect()
    kinds = defaultdict(list)
    for r in found:
        kinds[r["type"]].append(r)
        assert r["complete"] and r["payload_bytes"] == len(r["payload"])
    assert len(kinds["request"]) == len(kinds["metadata"]) == len(kinds["response"]) + len(kinds["revisit"]) == len(PAGES)
    ids = [r["record_id"] for r in found]
    assert len(set(ids)) == len(ids)
    assert all(r["concurrent_to"][0] in ids for r in kinds["request"] + kinds["metadata"])
    for r in kinds["response"]:
        assert r["payload_digest"] == "sha256:" + r["payload_sha256"] == "sha256:" + hashlib.sha256(r["payload"]).hexdigest()
    assert {bytes(r["payload"]) for r in kinds["response"]} == {(h or "").encode() for _, _, h in PAGES}
    assert all(r["payload"] == b"" for r in kinds["revisit"])
    hosts = {r["fields"]["host"] for r in kinds["request"]}
    assert {"a.example", "b.example", ""} <= hosts
    assert "GET /x?y=1 HTTP/1.1" in {r["start_line"] for r in kinds["request"]}


def record(kind, own, *to, block="", content="application/warc-fields", version="WARC/1.0"):
    lines = [version, f"warc-type: {kind}", f"WARC-Record-ID: {own}", *[f"WARC-Concurrent-To: {t}" for t in to], f"Content-Type: {content}"]
    return ("\r\n".join([*lines, f"Content-Length: {len(block.encode())}"]) + "\r\n\r\n" + block + "\r\n\r\n").encode()


def http(text):
    return {"block": "HTTP/1.1 404 Not Found\r\nX-A: 1\r\nx-a: 2\r\n\r\n" + text, "content": "application/http; msgtype=response"}


def test_transactions_across_archives_in_any_direction(spark, tmp_path):
    one = [
        record("warcinfo", "<w>", block="software: x\r\n"),
        record("response", "<a>", "<q>", **http("A")),  # names its request
        record("metadata", "<m1>", "<q>", block="n: 1\r\n"),  # names the request only
        record("metadata", "<m2>", "<m1>", "<nowhere>", block="n: 2\r\nn: 3\r\n"),  # names other metadata
        record("metadata", "<lost>", "<nobody>"),
    ]
    two = [
        record("request", "<q>", block="GET / HTTP/1.1\r\nHost: h\r\n\r\n", content="application/http;msgtype=request"),
        record("resource", "<b>", block="plain\r\n\r\nbytes", content="text/plain"),
        record("request", "<both>", "<b>", "<a>"),
        record("response", "<alone>", **http("")),
    ]
    members = b"".join(gzip.compress(r) for r in one) + gzip.compress(b"garbage\r\n\r\n")  # a member per record
    (tmp_path / "one.warc.gz").write_bytes(members)
    whole = b"".join(two) + record("response", "<cut>", **http("z" * 100))[:-60]
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(b"\r\n" + whole))
    from tiepoints.session import settle

    records = settle(warc.read_records(spark, str(tmp_path), with_payload=True))
    assert {r["record_id"]: r["complete"] for r in records.collect()} == {
        **dict.fromkeys(["<w>", "<a>", "<m1>", "<m2>", "<lost>", "<q>", "<b>", "<both>", "<alone>"], True), "<cut>": False,
    }
    found = {r["record_id"]: r for r in warc.assemble(records).collect()}
    assert set(found) == {"<a>", "<b>", "<alone>"}
    a, b = found["<a>"], found["<b>"]
    assert [r["record_id"] for r in a["requests"]] == ["<both>", "<q>"]  # <both> takes the smaller id
    assert [(m["record_id"], m["fields"]) for m in a["metadata"]] == [("<m1>", {"n": "1"}), ("<m2>", {"n": "2"})]
    assert (a["start_line"], a["fields"], bytes(a["payload"])) == ("HTTP/1.1 404 Not Found", {"x-a": "1"}, b"A")
    assert b["requests"] is None and b["payload_bytes"] == len("plain\r\n\r\nbytes") and bytes(b["payload"]) == b"plain\r\n\r\nbytes"
    assert found["<alone>"]["metadata"] is None and found["<alone>"]["payload_bytes"] == 0


def test_a_crowded_capture_comes_in_parts(spark, tmp_path):
    data = record("response", "<a>", **http("A")) + b"".join(record("metadata", f"<m{i}>", "<a>") for i in range(100))
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(data))
    from tiepoints.session import settle

    found = warc.assemble(settle(warc.read_records(spark, str(tmp_path))), part=20).collect()
    assert len({r["part"] for r in found}) == len(found) > 5
    assert sorted(m["record_id"] for r in found for m in r["metadata"]) == sorted(f"<m{i}>" for i in range(100))
    assert max(len(r["metadata"]) for r in found) <= 20

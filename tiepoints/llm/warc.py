"""WARC archives: writing pages as transactions, reading records back, assembling captures.

Writing. A page becomes three records that name each other by ``WARC-Concurrent-To``: the request, the
response (or a revisit, if another page has the same payload), and metadata that carry the page's id. A WARC
record ends with two line ends, so a text file whose lines are separated by two line ends is a WARC file:
Spark's own writer makes the archives, on any store it knows and with its commit of task attempts.

Reading. Spark reads the archives with the same separator; gzip files are not split, so a task sees the
pieces of a file in order and puts a record together from its ``Content-Length``. Files with one gzip
member per record are read alike. No more than one record and one batch are held.

Assembly. Requests, metadata and captures are joined through their concurrent-to identifiers, whichever of
them carries the header, in whichever archive, also by way of a third record: each round joins the records
reached last with all that name them or are named by them. One nested row per capture results; a capture
with more than ``PART`` other records gets several, numbered by ``part``.

Defined results. Null html is an empty payload, a null url leaves out ``WARC-Target-URI``, a null page_id is
written without id and read as null. Of pages with equal payloads of ``DEDUP`` bytes or more those with the
largest page_id are responses (all of them, if rows are repeated), the others revisit it. Line ends and other
control characters in a url are percent-encoded. Records cut off by the end of a file are marked as not
``complete`` and belong to no capture; requests and metadata that lead to no capture are left out of them.
Of several captures that a record can belong to it takes the one with the smallest record id. An empty
table gives an archive without records and no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiepoints.operators.joins import join_settled
from tiepoints.session import fresh_path, settle

DEDUP = 1000
PART = 10_000
CAPTURES = ("response", "revisit", "resource", "conversion")
#: Fixed values of the format.
VERSION = "WARC/1.1"
LINE = "\r\n"
END = LINE + LINE
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = (
    "record_id string, type string, target_uri string, date string, concurrent_to array<string>, payload_digest string, "
    "start_line string, fields map<string,string>, payload_bytes long, payload_sha1 string, payload_sha256 string, "
    "payload binary, complete boolean, archive string"
)


# --- writing --------------------------------------------------------------------------------


def with_originals(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, bytes, digest and ``original``, the page a revisit refers to (else null)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("bytes"),
        F.sha2(payload.cast("binary"), 256).alias("digest"),
    )
    shared = rows.where(F.col("bytes") >= DEDUP).groupBy("digest")
    shared = shared.agg(F.count("*").alias("n"), F.max(F.struct("page_id", "url")).alias("original"))
    shared = settle(shared.where("n > 1 and original.page_id is not null").drop("n"), "originals")
    met = join_settled(rows, shared, ["digest"], "left")
    return met.withColumn("original", F.when(~F.col("original.page_id").eqNullSafe(F.col("page_id")), F.col("original")))


def _record(fields: list[tuple[str, Column | str | None]], block: Column) -> Column:
    """Text of a record; fields without a value are left out."""
    lines = [F.lit(VERSION)]
    for name, value in fields:
        value = F.lit(value) if isinstance(value, str) else value
        lines.append(F.concat(F.lit(f"{name}: "), value))
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(LINE, *lines), F.lit(END), block)


def transactions(pages: DataFrame) -> DataFrame:
    """``value``: the text of every record, without the two line ends behind it."""
    rows = with_originals(pages)
    # Random, so never evaluated twice by the optimizer; a transaction is written by one task attempt.
    ids = {f"{kind}_id": F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")) for kind in ("capture", "request", "metadata")}
    rows = rows.withColumns(ids)
    clean = lambda url: F.when(url.rlike(r"[\x00-\x20\x7f]"), F.url_encode(url)).otherwise(url)
    uri, capture = clean(F.col("url")), F.col("capture_id")
    date = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisit = F.col("original").isNotNull()
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "),
        F.col("bytes").cast("string"), F.lit(END),
    )
    common = lambda kind, own: [
        ("WARC-Type", kind), ("WARC-Record-ID", F.col(own)), ("WARC-Date", date), ("WARC-Target-URI", uri)
    ]
    response = _record(
        [
            *common(F.when(revisit, "revisit").otherwise("response"), "capture_id"),
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            ("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
            ("WARC-Refers-To-Target-URI", clean(F.col("original.url"))),
            ("Content-Type", "application/http;msgtype=response"),
        ],
        F.when(revisit, head).otherwise(F.concat(head, F.col("payload"))),
    )
    part = lambda what, default: F.coalesce(F.try_parse_url(uri, F.lit(what)), F.lit(default))
    get = F.concat(F.lit("GET "), part("FILE", "/"), F.lit(f" HTTP/1.1{LINE}Host: "), part("HOST", ""), F.lit(END))
    request = _record(
        [
            *common("request", "request_id"),
            ("WARC-Concurrent-To", capture),
            ("Content-Type", "application/http;msgtype=request"),
        ],
        get,
    )
    about = F.coalesce(F.concat(F.lit("page_id: "), F.col("page_id").cast("string"), F.lit(LINE)), F.lit(""))
    metadata = _record(
        [*common("metadata", "metadata_id"), ("WARC-Concurrent-To", capture), ("Content-Type", "application/warc-fields")],
        about,
    )
    return rows.select(F.explode(F.array(request, response, metadata)).alias("value"))


def write_archives(pages: DataFrame, path: str, records_per_file: int = 300_000) -> str:
    """Write all pages as gzip-compressed archives below ``path``, which must not exist yet."""
    writer = transactions(pages).write.option("lineSep", END).option("compression", "gzip")
    writer.option("maxRecordsPerFile", records_per_file).text(path)
    return path


# --- reading --------------------------------------------------------------------------------


class _Stream:
    """Records of one archive from its bytes in order."""

    def __init__(self, archive: str, with_payload: bool):
        self.archive, self.with_payload = archive, with_payload
        self.held, self.header, self.need = bytearray(), None, 0

    def feed(self, data: bytes) -> Iterator[tuple]:
        self.held += data
        while True:
            if self.header is None:
                while self.held[:2] == b"\r\n":
                    del self.held[:2]
                end = self.held.find(b"\r\n\r\n")
                if end < 0:
                    return
                lines = self.held[:end].decode("utf-8", "replace").split(LINE)
                del self.held[: end + 4]
                if not lines[0].startswith("WARC/"):
                    continue  # not a record: look behind the next separator
                self.header = [(n.strip().lower(), v.strip()) for n, _, v in (x.partition(":") for x in lines[1:])]
                length = dict(self.header).get("content-length", "")
                self.need = int(length) if length.isdigit() else 0
            if len(self.held) < self.need:
                return
            yield self._row(bytes(self.held[: self.need]), True)
            del self.held[: self.need]
            self.header = None

    def close(self) -> Iterator[tuple]:
        """What the end of the file leaves; the last separator belongs to no record."""
        if self.header is not None:
            yield self._row(bytes(self.held), False)

    def _row(self, block: bytes, complete: bool) -> tuple:
        named = dict(reversed(self.header))  # of a repeated field the first counts
        kind, content = named.get("warc-type"), named.get("content-type", "").lower()
        start, fields, payload = None, [], block
        if content.startswith("application/http"):
            head, _, payload = block.partition(b"\r\n\r\n")
            start, *rest = head.decode("utf-8", "replace").split(LINE)
        elif content.startswith("application/warc-fields"):
            rest = block.decode("utf-8", "replace").split(LINE)
        else:
            rest = []
        for line in rest:
            name, colon, value = line.partition(":")
            if colon and name.strip().lower() not in dict(fields):
                fields.append((name.strip().lower(), value.strip()))
        digest = named.get("warc-payload-digest")
        return (
            named.get("warc-record-id"), kind, named.get("warc-target-uri"), named.get("warc-date"),
            [v for n, v in self.header if n == "warc-concurrent-to"], digest, start, fields, len(payload),
            hashlib.sha1(payload).hexdigest(), hashlib.sha256(payload).hexdigest() if digest else None,
            payload if self.with_payload else None, complete, self.archive,
        )


_ARROW = pa.schema(
    [
        ("record_id", pa.string()), ("type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()),
        ("concurrent_to", pa.list_(pa.string())), ("payload_digest", pa.string()), ("start_line", pa.string()),
        ("fields", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("payload_sha1", pa.string()),
        ("payload_sha256", pa.string()), ("payload", pa.binary()), ("complete", pa.bool_()), ("archive", pa.string()),
    ]
)


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Every record of the archives below ``path``; payloads are read and hashed, and kept on request."""
    pieces = spark.read.option("lineSep", END).text(path)
    pieces = pieces.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("archive"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[] for _ in _ARROW]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

        stream, out, held = None, [], 0
        for batch in batches:
            for value, archive in zip(batch.column("value"), batch.column("archive")):
                name = archive.as_py()
                if stream is None or stream.archive != name:
                    out += stream.close() if stream else ()
                    stream = _Stream(name, with_payload)
                for row in stream.feed(value.as_buffer().to_pybytes() + b"\r\n\r\n"):
                    out.append(row)
                    held += len(row[11] or b"")
                    if len(out) >= 5000 or held >= 8 << 20:
                        yield batch_of(out)
                        out, held = [], 0
        out += stream.close() if stream else ()
        yield batch_of(out)

    return pieces.mapInArrow(parse, RECORD)


# --- assembly -------------------------------------------------------------------------------


def anchored(records: DataFrame) -> DataFrame:
    """``x`` and ``anchor``: which capture every other record belongs to. ``records`` is a written table."""
    known = records.where("complete and record_id is not null")
    links = known.select(F.col("record_id").alias("x"), F.explode("concurrent_to").alias("y"))
    links = settle(links.union(links.select("y", "x")).distinct(), "links")
    captures = known.where(F.col("type").isin(*CAPTURES)).select(F.col("record_id").alias("x"), F.col("record_id").alias("anchor"))
    reached = last = settle(captures.distinct(), "anchors")
    while True:
        near = join_settled(links, last.withColumnRenamed("x", "y"), ["y"]).groupBy("x").agg(F.min("anchor").alias("anchor"))
        last = settle(join_settled(near, reached, ["x"], "left_anti"), "reached")
        if not last.limit(1).count():
            return reached.where("x != anchor")
        reached = reached.union(last)


def assemble(records: DataFrame, part: int = PART) -> DataFrame:
    """One nested row per capture: its own columns, ``part``, ``requests`` and ``metadata``."""
    known = records.where("complete and record_id is not null")
    others = known.where(~F.col("type").isin(*CAPTURES))
    belongs = settle(anchored(records).select(F.col("x").alias("record_id"), "anchor"), "belongs")
    placed = join_settled(others.select("record_id", "type", "start_line", "fields"), belongs, ["record_id"])
    crowded = placed.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > part)
    crowded = settle(crowded.select("anchor", F.ceil(F.col("n") * 2 / part).alias("parts")), "crowded")
    placed = join_settled(placed, crowded, ["anchor"], "left")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("record_id"), F.coalesce("parts", F.lit(1))).cast("int"))
    own = F.struct("record_id", "start_line", "fields")
    listed = lambda kind: F.sort_array(F.collect_list(F.when(F.col("type") == kind, own)))

    def plain(column: str) -> Column:  # maps have no order, so lists are sorted as entries and turned back
        return F.transform(column, lambda r: r.withField("fields", F.map_from_entries(r["fields"])))

    placed = placed.withColumn("fields", F.map_entries("fields"))
    gathered = placed.groupBy("anchor", "part").agg(listed("request").alias("requests"), listed("metadata").alias("metadata"))
    gathered = gathered.withColumns({"requests": plain("requests"), "metadata": plain("metadata")})
    captures = known.where(F.col("type").isin(*CAPTURES)).withColumn("anchor", F.col("record_id"))
    joined = captures.join(gathered, "anchor", "left")
    return joined.drop("anchor", "concurrent_to").withColumn("part", F.coalesce("part", F.lit(0)))


def read_pages(captures: DataFrame) -> DataFrame:
    """One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit takes size and digest from the response with the same payload digest.
    """
    ids = F.filter(F.transform("metadata", lambda m: F.try_element_at(m["fields"], F.lit("page_id"))), lambda v: v.isNotNull())
    rows = captures.select(
        F.get(ids, F.lit(0)).try_cast("long").alias("page_id"),
        "type", "payload_digest", "payload_bytes", "payload_sha1", "payload_sha256",
    )
    rows = settle(rows, "captures")
    responses, revisits = rows.where("type != 'revisit'"), rows.where("type = 'revisit'")
    wanted = settle(revisits.select("payload_digest").distinct(), "wanted")
    originals = responses.withColumn("payload_digest", F.concat(F.lit("sha256:"), "payload_sha256"))
    originals = join_settled(originals, wanted, ["payload_digest"], "left_semi").groupBy("payload_digest")
    originals = settle(
        originals.agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("_bytes"), F.max("payload_sha1").alias("_sha1")),
        "originals",
    )
    found = join_settled(revisits, originals, ["payload_digest"], "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return (
        responses.select("page_id", "payload_bytes", F.col("payload_sha1").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
        .union(found.select("page_id", F.col("_bytes"), F.col("_sha1"), F.lit("revisit"), "refers_to"))
        .toDF(*columns)
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as archives in the work folder, read them back and assemble their captures."""
    spark = pages.sparkSession
    path = write_archives(pages, fresh_path(spark, "warc"))
    return read_pages(assemble(settle(read_records(spark, path), "records")))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
r AS (SELECT page_id, h, strlen(h) AS n, max(page_id) OVER (PARTITION BY h) AS newest FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> newest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> newest THEN newest END AS refers_to
FROM r
"""

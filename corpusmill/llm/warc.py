"""WARC archives: writing with revisits, chunked transfer framing and segments; reading with segment reassembly.

write() makes one record a page: a response with the page's bytes in chunked transfer framing, or a revisit of the page
with the smallest id among equal payloads. A record longer than a segment is continued in records that name the first as
their origin. read() groups the segments by origin, orders them by number, verifies the total length and takes the chunk
framing off.

Archives are gzip files written by Spark itself to a folder of any store it knows, a record a line with the record's end as
line end, so that no executor needs a local folder. A record is no longer than a segment, a file has a bounded number of
records: reading a file whole needs bounded memory.

A revisit is found from ids and digests alone. Payloads stay where they are unless a filter of fixed size can't rule out that
their page is a revisit.

Defined cases: null html is the empty payload; a null url is left out of the record; a page without an id is always a
response; rows of one page_id with different payloads are records of their own (a record's id comes from page and payload);
equal rows of one page are all responses or all revisits and come back as often as they went in; an empty table gives an
empty result; other columns are ignored. A record whose segments are missing or don't add up comes back with
complete = false and null payload columns; without its first segment nothing tells the page, and page_id is null too.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, idfilter

END = b"\r\n\r\n"
STAMP = "2024-01-01T00:00:00Z"
SEGMENT_BYTES, CHUNK_BYTES, FILE_RECORDS = 16 << 10, 4 << 10, 2048
HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, complete boolean"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int) -> bytes:
    return b"".join(b"%x\r\n%b\r\n" % (len(part), part) for part in (payload[i : i + size] for i in range(0, len(payload), size))) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The payload; None if the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0 or not re.fullmatch(rb"[0-9A-Fa-f]+", size := body[at:end].split(b";")[0].strip()):
            return None
        n = int(size, 16)
        if n == 0:
            return b"".join(parts)
        part = body[end + 2 : end + 2 + n]
        if len(part) != n or body[end + 2 + n : end + 4 + n] != b"\r\n":
            return None
        parts.append(part)
        at = end + 4 + n


def one_record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line ends after it."""
    lines = "".join(f"{name}: {value}\r\n" for name, value in [*fields, ("Content-Length", len(block))] if value is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block


def records(page: int | None, url: str | None, payload: bytes, refers_to: int | None, segment: int, chunk: int) -> Iterator[bytes]:
    told = digest(payload)
    name = lambda p: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{p}/{told}')}>"
    own = name(page) if page is not None else f"<urn:uuid:{uuid.uuid4()}>"
    uri = re.sub(r"[\r\n]", "", url) if url else None
    fields = [("WARC-Record-ID", own), ("WARC-Date", STAMP), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{told}"), ("X-Page-Id", page), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        more = [("WARC-Refers-To", name(refers_to)), ("X-Refers-To-Page-Id", refers_to), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        yield one_record([("WARC-Type", "revisit"), *fields, *more], head)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    if len(block) <= segment:
        yield one_record([("WARC-Type", "response"), *fields], block)
        return
    for number, at in enumerate(range(0, len(block), segment), 1):
        part, last = block[at : at + segment], at + segment >= len(block)
        total = ("WARC-Segment-Total-Length", len(block) if last else None)
        if number == 1:
            yield one_record([("WARC-Type", "response"), *fields, ("WARC-Segment-Number", 1)], part)
        else:
            one = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{own}/{number}')}>"
            yield one_record([("WARC-Type", "continuation"), ("WARC-Record-ID", one), ("WARC-Date", STAMP), ("WARC-Target-URI", uri), ("WARC-Segment-Number", number), ("WARC-Segment-Origin-ID", own), total], part)


def revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """key, page_id, digest, refers_to of the pages (page_id, digest, key, bytes) whose payload a page of a smaller id has. No payload moves."""
    keys = pages.filter(F.col("bytes") >= least_bytes).select("page_id", "digest", "key").filter("page_id is not null")
    # Written, so that both sides of the join are plain exchanges and a hot payload's rows can be split.
    first = common.written(keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).filter("last > refers_to").drop("last"), "first")
    return keys.join(first, "digest").filter("page_id <> refers_to").select("key", "page_id", "digest", "refers_to").distinct()


def write(pages: DataFrame, path: str, least_bytes: int = 0, segment: int = SEGMENT_BYTES, chunk: int = CHUNK_BYTES, file_records: int = FILE_RECORDS) -> None:
    payload = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    own = own.withColumn("digest", F.sha1("payload")).withColumn("key", F.xxhash64("page_id", "digest"))
    again = common.written(revisits(own.withColumn("bytes", F.octet_length("payload")), least_bytes), "revisits")
    doubtful, clear = idfilter.divided(own, again, "key", "key")
    marked = doubtful.join(again, ["key", "page_id", "digest"], "left").select("page_id", "url", "payload", "refers_to").union(clear.select("page_id", "url", "payload", F.lit(None).cast("long")))

    def start():
        def step(batch):
            columns = [common.strings(batch, c) for c in ("page_id", "url", "payload", "refers_to")]
            return [[r for page, url, body, to in zip(*columns, strict=True) for r in records(page, url, body, to, segment, chunk)]]

        return step

    lines = common.arrow_map(marked, "record binary", start, "payload").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


def parsed(content: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Header fields (names in lower case) and block of each record of an archive."""
    at = 0
    while at < len(content):
        if not content.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        head = content.index(END, at)
        fields = {name.lower(): value for name, value in HEADER.findall(content[at : head + 2])}
        n = int(fields[b"content-length"])
        yield fields, content[head + 4 : head + 4 + n]
        at = head + 4 + n + len(END)


def content(block: bytes) -> bytes | None:
    """The payload of an HTTP response, without its framing; None if that is broken."""
    head, _, body = block.partition(END)
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked", head) else body


def result(fields: dict[bytes, bytes], block: bytes | None) -> tuple:
    """A row of RESULT; block None: segments are missing."""
    number = lambda name: int(fields[name]) if name in fields else None
    page, kind, to = number(b"x-page-id"), fields[b"warc-type"].decode(), number(b"x-refers-to-page-id")
    if kind == "revisit":
        head = (block or b"").partition(END)[0]
        length = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        return page, int(length[1]) if length else None, fields[b"warc-payload-digest"].decode().removeprefix("sha1:"), kind, to, length is not None
    payload = None if block is None else content(block)
    if payload is None:
        return page, None, None, kind, to, False
    return page, len(payload), digest(payload), kind, to, fields.get(b"warc-payload-digest", b"").decode() in ("", f"sha1:{digest(payload)}")


def archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")


PARTS = f"origin string, number long, total long, block binary, first boolean, {RESULT}"


def parts(files: DataFrame) -> DataFrame:
    """PARTS: each record of the archives, whole ones with their RESULT, segments with their block and, if first, their page."""

    def start():
        def step(batch):
            rows = []
            for content in common.strings(batch, "content"):
                for fields, block in parsed(gzip.decompress(content)):
                    own = fields[b"warc-record-id"].decode()
                    if b"warc-segment-number" not in fields:
                        rows.append((own, None, None, None, True, *result(fields, block)))
                        continue
                    first = b"warc-segment-origin-id" not in fields
                    total = fields.get(b"warc-segment-total-length")
                    told = result(fields, None) if first else (None,) * 6
                    digest_ = (fields.get(b"warc-payload-digest", b"").decode().removeprefix("sha1:") or None) if first else None
                    rows.append((fields.get(b"warc-segment-origin-id", fields[b"warc-record-id"]).decode(), int(fields[b"warc-segment-number"]), int(total) if total else None, block, first, *told[:2], digest_, *told[3:]))
            return [list(c) for c in zip(*rows, strict=True)] if rows else None

        return step

    return common.arrow_map(files, PARTS, start, "content")


def reassembled(found: DataFrame) -> DataFrame:
    """RESULT of PARTS. Segments go by origin, in order, if of the right total length.

    Equal segments of rows that went in several times become one first, so that a group is one record's segments.
    """
    told = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete")
    once = found.groupBy("origin", "number").agg(F.count(F.lit(1)).alias("copies"), *(F.any_value(c, True).alias(c) for c in ("total", "block", "first", *told)))
    parts_ = F.array_sort(F.collect_list(F.when(F.col("number").isNotNull(), F.struct("number", "total", "block"))))
    one = once.groupBy("origin").agg(parts_.alias("parts"), F.coalesce(F.max(F.when(F.col("first"), F.col("copies"))), F.lit(1)).alias("copies"), *(F.any_value(c, True).alias(c) for c in told))

    def start():
        def step(batch):
            rows = []
            for parts, copies, page, size, expected, kind, to, sound in zip(*(common.strings(batch, c) for c in ("parts", "copies", *told)), strict=True):
                if parts:
                    total = next((p["total"] for p in parts if p["total"] is not None), None)
                    block = b"".join(p["block"] for p in parts)
                    payload = None
                    if kind is not None and [p["number"] for p in parts] == list(range(1, len(parts) + 1)) and len(block) == total:
                        payload = content(block)
                    sound = payload is not None and expected in (None, digest(payload))
                    size, expected = (None, None) if payload is None else (len(payload), digest(payload))
                rows += [(page, size, expected, kind, to, sound)] * copies
            return [list(c) for c in zip(*rows, strict=True)] if rows else None

        return step

    return common.arrow_map(one, RESULT, start, None)


def read(spark: SparkSession, path: str) -> DataFrame:
    return reassembled(parts(archives(spark, path)))

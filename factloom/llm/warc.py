"""WARC archives of pages, written and read back with segment reassembly.

A page becomes a response record: an HTTP response whose body is sent in chunked framing.  A block over
SEGMENT bytes is split: the record holds the first segment, continuation records the others, with
WARC-Segment-Origin-ID, WARC-Segment-Number and, on the last, WARC-Segment-Total-Length.  Of equal payloads
of at least REVISIT_BYTES, the page with the largest page_id is the response; the others are revisit records,
whose block is the HTTP header alone.

Archives go through Spark's text writer with the record separator of the format (two line ends), gzipped,
so any file system that Spark knows will do; a file holds FILE_RECORDS records at most.  Reading unzips as it parses (one
gzip member for a file or one for each record, as crawlers write them), sends the segments of divided records to their
origin, orders them by number, checks that none is missing and that the lengths add up, decodes the chunks and checks
the declared digest.  Revisits are then joined with the records that they refer to, whose digests must be theirs.
Archives of others are read too: record ids may be any, and what isn't a page (warcinfo, request, metadata) is passed over.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import new_path, stage

REVISIT_BYTES = 1000
#: Bytes of a record's block before it is continued in another record.
SEGMENT = 16 << 10
CHUNK = 8 << 10
#: Records of an archive at most; none has a block over SEGMENT bytes.
FILE_RECORDS = 8192
#: Bytes that are unzipped at a time.
PIECE = 1 << 20
END = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """payload in HTTP chunked transfer framing."""
    out = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        out += [b"%x\r\n" % len(part), part, END]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunked framing; chunk extensions and trailers are skipped, a broken frame raises ValueError."""
    out, at = [], 0
    while True:
        line = body.find(END, at)
        size = body[at:line].split(b";")[0].strip() if line >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]+", size):
            raise ValueError("a chunk does not begin where it should")
        n = int(size, 16)
        at = line + 2
        if not n:
            return b"".join(out)
        if body[at + n : at + n + 2] != END:
            raise ValueError("a chunk does not end where it should")
        out.append(body[at : at + n])
        at += n + 2


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP response, without transfer framing."""
    head, _, body = block.partition(END + END)
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in [*headers, ("Content-Length", len(block))])]
    return END.join(lines) + END + END + block


def record_id(page: int | None, uid: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{uid}')}>"


def page_records(page: int | None, uid: int, url: str | None, payload: bytes, refers_to: str | None, segment: int = SEGMENT) -> list[bytes]:
    """The records of one page, without the separators that follow them; refers_to is a record id."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    own = record_id(page, uid)
    target = [("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A"))] if url is not None else []
    number = [("Page-ID", page)] if page is not None else []
    common = [*target, *number, ("WARC-Date", "2024-01-01T00:00:00Z"), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest)]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        block = head + b"Content-Length: %d\r\n\r\n" % len(payload)
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Refers-To", refers_to), ("WARC-Profile", PROFILE), *common], block)]
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        return [_record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common], block)]
    out = [_record([("WARC-Type", "response"), ("WARC-Record-ID", own), ("WARC-Segment-Number", 1), *common], block[:segment])]
    for k, i in enumerate(range(segment, len(block), segment), 2):
        last = [("WARC-Segment-Total-Length", len(block))] if i + segment >= len(block) else []
        part = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{own}:{k}')}>"
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", part), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k), *last, *target], block[i : i + segment]))
    return out


def unzipped(data: memoryview) -> Iterator[bytes]:
    """The content of all gzip members of a file, PIECE bytes at most at a time; a file that isn't gzipped is itself."""
    if bytes(data[:2]) != b"\x1f\x8b":
        yield from (bytes(data[i : i + PIECE]) for i in range(0, len(data), PIECE))
        return
    while len(data):
        member = zlib.decompressobj(31)
        rest = data
        while not member.eof:
            part = member.decompress(rest[: PIECE // 4], PIECE)
            rest = rest[min(PIECE // 4, len(rest)) :]
            while member.unconsumed_tail and not member.eof:
                yield part
                part = member.decompress(member.unconsumed_tail, PIECE)
            yield part
            if not len(rest) and not member.eof:
                raise ValueError("the archive is cut off")
        data = data[len(data) - len(rest) - len(member.unused_data) :]
        while len(data) and data[0] == 0:  # padding
            data = data[1:]


def records_of(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record; ValueError if something else stands in between."""
    held = b""

    def more() -> bool:
        nonlocal held
        part = next(pieces, None)
        held += part or b""
        return part is not None

    while True:
        held = held.lstrip(END)
        at = held.find(END + END)
        if at < 0:
            if more():
                continue
            if held:
                raise ValueError("the archive is cut off")
            return
        first, *lines = held[:at].decode("utf-8", "replace").split("\r\n")
        headers: dict[str, str] = {}
        for line in lines:
            name, _, value = line.partition(":")
            headers.setdefault(name.strip().lower(), value.strip())
        if not first.startswith("WARC/") or not headers.get("content-length", "").isdigit():
            raise ValueError("not a WARC record")
        begin, n = at + 4, int(headers["content-length"])
        parts = [held[begin:]]
        have = len(parts[0])
        while have < n:
            part = next(pieces, None)
            if part is None:
                raise ValueError("the archive is cut off")
            parts.append(part)
            have += len(part)
        rest = b"".join(parts)
        yield headers, rest[:n]
        held = rest[n:]


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Write pages (page_id, url, html) as gzipped archives.

    Payloads are the html in UTF-8, null as empty.  Of rows that share the largest page_id of a payload all are
    responses; a page whose equals have no page_id is a response too.  Rows without page_id are written, and
    read back without one.
    """
    rows = pages.select(
        "page_id",
        "url",
        F.coalesce("html", F.lit("")).cast("binary").alias("payload"),
        F.monotonically_increasing_id().alias("uid"),
    )
    # A payload that is too short to be revisited is a key of its own.
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= REVISIT_BYTES, F.sha1("payload")).otherwise(F.col("uid").cast("string")))
    newest = F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "uid")))
    same = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), newest.alias("newest")).where("n > 1 and newest is not null").drop("n")
    rows = rows.join(same, "digest", "left").select("page_id", "url", "payload", "uid", F.when(~F.col("page_id").eqNullSafe(F.col("newest.page_id")), F.col("newest")).alias("refers_to"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for row in zip(*(c for c in batch.columns), strict=True):
                page, url, payload, uid, refers_to = (x.as_py() for x in row)
                for r in page_records(page, uid, url, payload, refers_to and record_id(refers_to["page_id"], refers_to["uid"]), segment):
                    held.append(r)
                    size += len(r)
                if size >= 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])

    records = rows.mapInArrow(build, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _parsed(headers: dict[str, str], block: bytes) -> tuple | None:
    """A record as a row of _FIELDS; None if it isn't of a page."""
    kind = headers.get("warc-type", "")
    if kind not in ("response", "revisit", "resource", "continuation"):
        return None
    algorithm, _, value = headers.get("warc-payload-digest", "").partition(":")
    declared = None
    if algorithm.lower() == "sha1":
        declared = value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()
    page = int(headers["page-id"]) if headers.get("page-id", "").lstrip("-").isdigit() else None
    own = headers.get("warc-segment-origin-id", headers.get("warc-record-id"))
    http = headers.get("content-type", "").startswith("application/http")
    if "warc-segment-number" in headers:
        total = headers.get("warc-segment-total-length", "")
        return (own, page, kind if kind != "continuation" else None, None, http or None, declared, None, None, int(headers["warc-segment-number"]), int(total) if total.isdigit() else None, block, None)
    if kind == "revisit":
        lines = dict(line.lower().split(b":", 1) for line in block.split(END)[1:] if b":" in line)
        n = lines.get(b"content-length", b"").strip()
        return (own, page, kind, headers.get("warc-refers-to"), http, declared, int(n) if n.isdigit() else None, declared, None, None, None, None)
    try:
        payload = payload_of(block) if http else block
    except ValueError as e:
        return (own, page, kind, None, http, declared, None, None, None, None, None, str(e))
    return (own, page, kind, None, http, declared, len(payload), hashlib.sha1(payload).hexdigest(), None, None, None, None)


_FIELDS = {
    "record_id": "string", "page_id": "bigint", "record_type": "string", "refers_id": "string", "http": "boolean", "declared": "string", "payload_bytes": "bigint",
    "payload_digest": "string", "number": "int", "total": "bigint", "block": "binary", "problem": "string",
}
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "int": pa.int32(), "binary": pa.binary()}


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """record_id, page_id, payload_bytes, payload_digest, record_type, refers_to, segments, problem; one row per page.

    problem is null, or says what is wrong with the record: a missing segment, a total length or digest that
    does not match, broken framing, a revisit of a record that isn't there.  A file that is cut off or holds something else
    gives a row with the problem alone after the records before it.  page_id is null in archives of others; digests by another
    algorithm than SHA-1 aren't checked.
    """

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(_FIELDS)
        return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, t in zip(columns, _FIELDS.values(), strict=True)], list(_FIELDS))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                size = 0
                try:
                    for headers, block in records_of(unzipped(memoryview(content.as_buffer()))):
                        row = _parsed(headers, block)
                        if row is not None:
                            rows.append(row)
                            size += 256 + len(row[-2] or b"")
                        if size > 4 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                except (ValueError, zlib.error) as e:
                    rows.append((*[None] * (len(_FIELDS) - 1), str(e)))
                yield batch_of(rows)

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in (row for i in range(0, batch.num_rows, 64) for row in batch.slice(i, 64).to_pylist()):
                n, digest, problem = r["payload_bytes"], r["payload_digest"], r["problem"]
                if parts := r.pop("parts"):
                    block = b"".join(p["block"] for p in parts)
                    if [p["number"] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] is None:
                        problem = "a segment is missing"
                    elif parts[-1]["total"] != len(block):
                        problem = "the total length does not match"
                    else:
                        try:
                            payload = payload_of(block) if r["http"] else block
                            n, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        except ValueError as e:
                            problem = str(e)
                if problem is None and r["declared"] is not None and r["declared"] != digest:
                    problem = "the digest does not match"
                out.append((r["record_id"], r["page_id"], n, digest, r["record_type"], r["refers_id"], len(parts) or 1, problem))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
            columns = zip(*out, strict=True) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["record_id", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_id", "segments", "problem"])

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    parsed = files.mapInArrow(parse, ", ".join(f"{k} {t}" for k, t in _FIELDS.items()))
    once = [c for c in _FIELDS if c not in ("record_id", "number", "total", "block")]
    key = F.coalesce("record_id", F.concat(F.lit("#"), F.monotonically_increasing_id()))
    whole = parsed.groupBy(key.alias("key")).agg(
        F.max("record_id").alias("record_id"),
        *(F.max(c).alias(c) for c in once),
        F.sort_array(F.collect_list(F.when(F.col("block").isNotNull(), F.struct("number", "total", "block")))).alias("parts"),
    )
    kind = "record_id string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_id string, segments int, problem string"
    rows = stage(whole.drop("key").mapInArrow(reassemble, kind), "records")
    # Each revisit with the record that it refers to: that record is one row, so a hot side is split by AQE.
    aims = rows.where("record_type <> 'revisit' and record_id is not null").select(
        F.col("record_id").alias("aim"), F.col("page_id").alias("aim_page"), F.col("payload_digest").alias("aim_digest"), F.col("payload_bytes").alias("aim_bytes")
    )
    revisit = F.coalesce(F.col("record_type") == "revisit", F.lit(False))
    lost = F.when(F.col("aim").isNull(), "the record that it refers to is missing").when(F.col("aim_digest") != F.col("payload_digest"), "the digest is not that of the record that it refers to")
    others = rows.where(~revisit).select(
        "record_id", "page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("bigint").alias("refers_to"), "segments", "problem"
    )
    visits = rows.where(revisit).join(aims, F.col("refers_id") == F.col("aim"), "left").select(
        "record_id",
        "page_id",
        F.coalesce("payload_bytes", "aim_bytes").alias("payload_bytes"),
        F.coalesce("payload_digest", "aim_digest").alias("payload_digest"),
        "record_type",
        F.col("aim_page").alias("refers_to"),
        "segments",
        F.coalesce("problem", lost).alias("problem"),
    )
    return others.unionAll(visits)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, segments, problem.

    One row for each row of pages, repeated ones too.  Null and empty html are empty payloads; a null url is left
    out of the record.  Other columns are ignored.  No rows give no rows.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path).drop("record_id")

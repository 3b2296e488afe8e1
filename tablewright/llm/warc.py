"""WARC archives: written with segmented records and chunked bodies, read back by reassembly.

A page becomes a ``response`` record whose block is an HTTP response with a chunked body, or, where an
earlier choice says that another page has the same payload, a ``revisit`` record.  Blocks longer than
``segment_bytes`` are cut into an origin record and ``continuation`` records.  Archives go through
Spark's own text sink, whose line separator is the two line ends that close a WARC record, so they land
in any file system that Spark knows and a lost executor leaves no half file.  Each task writes one file.

Reading is by splits, so files may be of any size: the text source cuts them at the version line that begins a
record.  No block holds that line, as a chunk ends inside each of its occurrences.  Whole records are
decoded on the spot; segments are dealt by their origin's identifier, sorted by segment number, and streamed
through a decoder that holds one segment at a time: it checks numbers and total length, takes the chunk
framing off, and digests.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import stored, text_or_empty
from tablewright.session import shared_folder

END = b"\r\n"
VERSION = b"WARC/1.1"
COPIES = 1 << 16
DATE = "2024-01-01T00:00:00Z"
FLUSH = 4 << 20


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(body: bytes, size: int) -> bytes:
    """The body in chunks of ``size`` bytes, shorter where one would hold ``VERSION``, which is cut in two."""
    out, at = [], 0
    while at < len(body):
        version = body.find(VERSION, at, at + size)
        piece = body[at : at + size if version < 0 else version + 2]
        out += [b"%x" % len(piece), END, piece, END]
        at += len(piece)
    return b"".join([*out, b"0", END, END])


def record(kind: str, identifier: str, fields: dict[str, object], block: bytes) -> bytes:
    """Header and block; the two closing line ends are the sink's line separator."""
    lines = [VERSION.decode(), f"WARC-Type: {kind}", f"WARC-Record-ID: <{identifier}>", f"WARC-Date: {DATE}"]
    lines += [f"{name}: {value}" for name, value in fields.items() if value is not None]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block


def identifier_of(digest: str, size: int) -> str:
    """The name of the one response with this payload that others revisit."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{digest}/{size}')}"


def target_of(page_id: int | None, url: str | None) -> str:
    target = quote(url, safe="/:?#[]@!$&'()*+,;=%~-._") if url else f"urn:page:{page_id}"
    return target.replace(VERSION.decode(), "%57" + VERSION.decode()[1:])


def records_of(page: dict, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """All records of one page in order.  What no record refers to has a random identifier."""
    shared = identifier_of(page["digest"], page["bytes"])
    own = shared if page["kind"] == "shared" else f"urn:uuid:{uuid.uuid4()}"
    fields: dict[str, object] = {
        "WARC-Target-URI": target_of(page["page_id"], page["url"]),
        "Page-ID": page["page_id"],
        "WARC-Payload-Digest": f"sha1:{base64.b32encode(bytes.fromhex(page['digest'])).decode()}",
        "Content-Type": "application/http; msgtype=response",
    }
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if page["kind"] == "revisit":
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["WARC-Refers-To"] = f"<{shared}>"
        yield record("revisit", own, fields, head)
        return
    block = head + chunked(page["body"].encode(), chunk_bytes)
    if len(block) <= segment_bytes:
        yield record("response", own, fields, block)
        return
    yield record("response", own, fields | {"WARC-Segment-Number": 1}, block[:segment_bytes])
    starts = range(segment_bytes, len(block), segment_bytes)
    for number, at in enumerate(starts, 2):
        more = {"WARC-Segment-Origin-ID": f"<{own}>", "WARC-Segment-Number": number}
        more["WARC-Segment-Total-Length"] = len(block) if at == starts[-1] else None
        yield record("continuation", f"{own}-{number}", more, block[at : at + segment_bytes])


def planned_records(pages: DataFrame, revisit_from: int) -> DataFrame:
    """``page_id, url, body, digest, bytes, kind`` per row of ``pages``; ``kind`` is alone, shared or revisit.

    Of rows with equal payloads of at least ``revisit_from`` bytes one is shared: that with the largest page_id,
    then the largest url, NULLs last.  The choice is made by values, so the pages need no numbers and no copy;
    rows equal in all columns are counted, and written as one shared row and the other revisits.
    """
    rows = pages.select("page_id", "url", text_or_empty("html").alias("body"))
    rows = rows.withColumns({"digest": F.sha1("body"), "bytes": F.octet_length("body").cast("bigint")})
    names = rows.groupBy("page_id", "url", "digest", "bytes").agg(F.count("*").alias("copies"))
    first = names.groupBy("digest", "bytes").agg(
        F.max(F.struct("page_id", "url", "copies")).alias("first"), F.sum("copies").alias("n")
    )
    first = first.filter((F.col("n") > 1) & (F.col("bytes") >= revisit_from)).select("digest", "bytes", "first")
    first = stored(first, "repeated-payloads")
    known = rows.join(first, ["digest", "bytes"], "left")
    chosen = F.col("first.page_id").eqNullSafe(F.col("page_id")) & F.col("first.url").eqNullSafe(F.col("url"))
    kind = F.when(F.col("first").isNull(), "alone").when(chosen, "shared").otherwise("revisit")
    known = known.withColumn("kind", kind)
    columns = ("page_id", "url", F.when(F.col("kind") != "revisit", F.col("body")).alias("body"), "digest", "bytes", "kind")
    twins = first.filter("first.copies > 1")
    if twins.isEmpty():
        return known.select(*columns)
    twin = (F.col("kind") == "shared") & (F.col("first.copies") > 1)
    one = known.filter(twin).groupBy("page_id", "url", "digest", "bytes", "kind").agg(F.first("body").alias("body"))
    blocks = twins.select("*", F.explode(F.expr(f"sequence(0L, (first.copies - 2) div {COPIES})")).alias("block"))
    numbers = F.expr(f"sequence(block * {COPIES} + 1, least(first.copies - 1, (block + 1) * {COPIES}))")
    others = blocks.repartition("digest", "block").select("*", F.explode(numbers)).select(
        "first.page_id", "first.url", F.lit(None).cast("string").alias("body"), "digest", "bytes", F.lit("revisit").alias("kind")
    )
    return known.filter(~twin).select(*columns).unionByName(one).unionByName(others)


def write_archives(
    pages: DataFrame,
    folder: str,
    revisit_from: int = 0,
    segment_bytes: int = 1 << 15,
    chunk_bytes: int = 1 << 12,
    records_per_file: int = 0,
) -> None:
    """Writes one or more records per row of ``pages(page_id, url, html)``.

    Of rows with equal payloads of at least ``revisit_from`` bytes one is the response, the others revisit it
    (``planned_records``).  NULL html is an empty payload, a missing url becomes ``urn:page:`` and the id.  A task
    writes one file, or several of ``records_per_file`` segments.
    """
    known = planned_records(pages, revisit_from)

    def in_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(batch.num_rows):
                page = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
                for part in records_of(page, segment_bytes, chunk_bytes):
                    held.append(part)
                    size += len(part)
                    if size > FLUSH:
                        yield pa.RecordBatch.from_pydict({"record": held}, pa.schema([("record", pa.binary())]))
                        held, size = [], 0
        yield pa.RecordBatch.from_pydict({"record": held}, pa.schema([("record", pa.binary())]))

    records = known.mapInArrow(in_batches, "record binary").select(F.col("record").cast("string"))
    records.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).text(folder)


class Payload:
    """Takes an HTTP response piece by piece; counts and digests the body without its framing."""

    def __init__(self) -> None:
        self.head: bytes | None = b""
        self.chunked = False
        self.line, self.left, self.state = b"", 0, "size"
        self.bytes, self.sha1 = 0, hashlib.sha1()

    def feed(self, data: bytes) -> None:
        if self.head is not None:
            self.head += data
            head, mark, data = self.head.partition(END + END)
            if not mark:
                return
            self.chunked = b"transfer-encoding: chunked" in head.lower()
            self.head = None
        if not self.chunked:
            self._take(data)
            return
        at = 0
        while at < len(data):
            if self.state == "data":
                piece = data[at : at + self.left]
                self._take(piece)
                at += len(piece)
                self.left -= len(piece)
                if not self.left:
                    self.state = "after"
                continue
            stop = data.find(b"\n", at)
            self.line += data[at : stop + 1 if stop >= 0 else len(data)]
            at = stop + 1 if stop >= 0 else len(data)
            if stop < 0:
                return
            line, self.line = self.line.rstrip(END), b""
            if self.state == "after":
                self.state = "size" if not line else "broken"
            elif self.state == "size":
                self.left = int(line.partition(b";")[0], 16)
                self.state = "data" if self.left else "trailer"
            elif self.state == "trailer" and not line:
                self.state = "end"

    def _take(self, piece: bytes) -> None:
        self.bytes += len(piece)
        self.sha1.update(piece)

    @property
    def whole(self) -> bool:
        return self.head is None and (not self.chunked or self.state == "end")

    @property
    def digest(self) -> str:
        return base64.b32encode(self.sha1.digest()).decode()


PARSED = pa.schema(
    [
        ("key", pa.string()),
        ("segment", pa.int64()),
        ("page_id", pa.int64()),
        ("record_type", pa.string()),
        ("refers", pa.string()),
        ("promised", pa.string()),
        ("total", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("valid", pa.bool_()),
        ("block", pa.binary()),
    ]
)
PARSED_DDL = (
    "key string, segment bigint, page_id bigint, record_type string, refers string, promised string, total bigint, "
    "payload_bytes bigint, payload_digest string, valid boolean, block binary"
)


def parse(archive: bytes) -> Iterator[dict]:
    """The records of a file, or one without its version line: whole ones decoded, segments with their block."""
    at = 0
    while at < len(archive):
        stop = archive.index(END + END, at)
        lines = archive[at:stop].decode().split("\r\n")
        fields = {name.lower(): value for name, _, value in (line.partition(": ") for line in lines)}
        length = int(fields["content-length"])
        block = archive[stop + 4 : stop + 4 + length]
        at = stop + 4 + length + 4
        own, number = fields["warc-record-id"].strip("<>"), fields.get("warc-segment-number")
        row = dict.fromkeys(PARSED.names) | {
            "key": fields.get("warc-segment-origin-id", own).strip("<>"),
            "segment": int(number or 0),
            "page_id": int(fields["page-id"]) if "page-id" in fields else None,
            "record_type": fields["warc-type"],
            "refers": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
            "promised": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            "total": int(fields["warc-segment-total-length"]) if "warc-segment-total-length" in fields else None,
            "block": block,
        }
        if not number:
            payload = Payload()
            payload.feed(block)
            row |= {"block": None}
            if row["record_type"] == "response":
                good = payload.whole and payload.digest == row["promised"]
                row |= {"payload_bytes": payload.bytes, "payload_digest": payload.digest, "valid": good}
        yield row


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 300 + len(row["block"] or b"")
        if size > FLUSH:
            yield pa.RecordBatch.from_pylist(held, PARSED)
            held, size = [], 0
    yield pa.RecordBatch.from_pylist(held, PARSED)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batches(row for batch in batches for content in batch.column("content") for row in parse(content.as_py()))


def reassembled(rows: Iterator[dict]) -> Iterator[dict]:
    """Whole rows as they are, and one row per origin from its segments, which come sorted and together."""
    origin: dict | None = None

    def close() -> Iterator[dict]:
        if origin is not None:
            good = origin["orderly"] and origin["length"] == origin["total"] and payload.whole and payload.digest == origin["promised"]
            yield {name: origin[name] for name in PARSED.names} | {
                "payload_bytes": payload.bytes,
                "payload_digest": payload.digest,
                "valid": good,
                "block": None,
            }

    for row in rows:
        if not row["segment"]:
            yield row
            continue
        if origin is None or row["key"] != origin["key"]:
            yield from close()
            origin, payload = row | {"orderly": True, "length": 0, "next": 1}, Payload()
        origin["orderly"] &= row["segment"] == origin["next"] and row["record_type"] == ("continuation" if row["segment"] > 1 else "response")
        origin["next"] += 1
        origin["length"] += len(row["block"])
        origin["total"] = origin["total"] if row["total"] is None else row["total"]
        if origin["orderly"]:
            payload.feed(row["block"])
    yield from close()


def _reassembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batches(reassembled(row for batch in batches for row in batch.to_pylist()))


def read_archives(spark: SparkSession, folder: str, whole_files: bool = False) -> DataFrame:
    """One row per page: ``page_id, payload_bytes, payload_digest, record_type, refers_to, valid``.

    Files are read by splits.  Archives of another make, whose blocks may hold a version line, need
    ``whole_files``: each file is then one value in one task.

    ``refers_to`` is the page_id of the response that a revisit names, whose payload counts as the
    revisit's.  ``valid`` is false where segments are missing, the total length or digest differs, or
    the framing is incomplete; a revisit is as valid as its response.
    """
    reader = spark.read.option("pathGlobFilter", "part-*")
    if whole_files:
        pieces = reader.format("binaryFile").load(folder).select("content")
    else:
        lines = reader.option("lineSep", VERSION.decode() + "\r\n").text(folder)
        pieces = lines.filter(F.octet_length("value") > 0).select(F.col("value").cast("binary").alias("content"))
    parsed = pieces.mapInArrow(_parsed, PARSED_DDL).repartition("key").sortWithinPartitions("key", "segment")
    rows = stored(parsed.mapInArrow(_reassembled, PARSED_DDL).drop("block", "segment", "total"), "warc-records")
    responses = rows.filter("record_type = 'response'").select(
        F.col("key").alias("refers"),
        F.col("page_id").alias("refers_to"),
        F.col("payload_bytes").alias("_bytes"),
        F.col("payload_digest").alias("_digest"),
        F.col("valid").alias("_valid"),
    )
    revisits = rows.filter("record_type = 'revisit'").drop("payload_bytes", "payload_digest", "valid")
    answered = revisits.join(responses, "refers", "left")
    right = F.coalesce(F.col("_valid") & (F.col("_digest") == F.col("promised")), F.lit(False))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid"]
    answered = answered.withColumns({"payload_bytes": F.col("_bytes"), "payload_digest": F.col("_digest"), "valid": right})
    whole = rows.filter("record_type != 'revisit'").withColumn("refers_to", F.lit(None).cast("bigint"))
    return whole.select(*names).unionByName(answered.select(*names))


def archive_and_read(pages: DataFrame, **settings: int) -> DataFrame:
    """Writes archives to the shared folder and reads them back; see the two functions.

    Other columns of ``pages`` are ignored whatever their names.  An empty table gives an empty result.
    """
    folder = shared_folder(pages.sparkSession, "warc")
    write_archives(pages, folder, **settings)
    return read_archives(pages.sparkSession, folder)

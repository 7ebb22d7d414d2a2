"""WARC archives: writing with segments, reading back with reassembly.

A record whose block exceeds the segment size is written as a first segment and continuation
records. The reader parses each archive by content lengths alone, groups the segments of a
record by their origin's identifier, orders them by segment number, verifies the total length,
and decodes the chunked transfer framing of the HTTP response.

Archives are written and read through Spark, so they may lie in any store that it knows: a
record ends with two line ends, which is the separator between the rows of a text file.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankframe.llm.common import bounded_batches, save

#: Payloads of fewer bytes are always stored.
LEAST_REVISIT = 100
SEGMENT_BYTES = 32 * 1024
CHUNK_BYTES = 8 * 1024
RECORDS_PER_FILE = 1000
END = b"\r\n\r\n"
#: Bytes of a gzip member that are inflated at a time, and bytes of blocks in a batch of records.
PIECE, HELD = 1 << 20, 32 << 20
#: First bytes of a gzip member (fixed), and the mark of a broken one among inflated pieces.
MEMBER, BROKEN = b"\x1f\x8b\x08", b"broken member"
SPACE = uuid.UUID("00000000-0000-0000-0000-000000000000")


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The body in chunked transfer framing."""
    parts = []
    for at in range(0, len(body), size):
        part = body[at : at + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes:
    """The body of chunked transfer framing; ValueError where it is broken. Trailers are skipped."""
    parts, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0], 16)
        if size < 0:
            raise ValueError("a chunk's size is negative")
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        parts.append(framed[at : at + size])
        at += size + 2


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [b"WARC/1.1"] + [f"{k}: {v}".encode("utf-8", "replace") for k, v in fields if v is not None]
    return b"\r\n".join([*lines, b"Content-Length: %d" % len(block)]) + END + block


def _line(text: str | None) -> str:
    return " ".join((text or "").split())


def records(page_id, url, payload: bytes, digest: str, refers_to, refers_url, date: str, nonce: str, segment: int) -> Iterator[bytes]:
    """The records of one page, each without the two line ends that follow it."""
    name = lambda n: f"<urn:uuid:{uuid.uuid5(SPACE, f'{nonce}/{n}')}>"
    common = [("WARC-Target-URI", _line(url)), ("WARC-Date", date), ("X-Page-Id", None if page_id is None else str(page_id))]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    kind = [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers_to is not None:
        more = [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To-Target-URI", _line(refers_url)),
            ("X-Refers-To-Page-Id", str(refers_to)),
        ]
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", name(1)), *common, *kind, *more], head)
        return
    block = head + chunked(payload)
    cuts = range(0, len(block), segment)
    if len(cuts) == 1:
        yield _record([("WARC-Type", "response"), ("WARC-Record-ID", name(1)), *common, *kind], block)
        return
    for n, at in enumerate(cuts, 1):
        seg = [("WARC-Segment-Number", str(n))]
        if n == 1:
            yield _record([("WARC-Type", "response"), ("WARC-Record-ID", name(1)), *common, *kind, *seg], block[:segment])
        else:
            seg.append(("WARC-Segment-Origin-ID", name(1)))
            if n == len(cuts):
                seg.append(("WARC-Segment-Total-Length", str(len(block))))
            yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", name(n)), *common, *seg], block[at : at + segment])


def write_archives(
    df: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
    date: str = "2024-01-01T00:00:00Z", segment: int = SEGMENT_BYTES, per_file: int = RECORDS_PER_FILE, compression: str = "gzip",
) -> None:
    """Write a record, or its segments, for each row to archives under path.

    Of equal payloads of LEAST_REVISIT bytes or more, the one with the smallest page id is a
    response and the others revisit it; rows repeated with that id are responses too, and if no
    such row has an id, all are. A null html is an empty payload. Other columns are ignored.
    Only payloads that occur twice are looked up, and a payload moves at most once.
    """
    bounded_batches(df.sparkSession)
    body = F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary")
    src = df.select(F.col(f"`{page_id}`").cast("long").alias("id"), F.col(f"`{url}`").alias("url"), body.alias("body"))
    src = src.withColumn("digest", F.sha2("body", 256))
    long = src.where(F.octet_length("body") >= LEAST_REVISIT)
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "url")))
    twice = long.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    joined = src.join(save(twice, "twice"), "digest", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx, row = TaskContext.get(), 0
        task = f"{ctx.partitionId()}.{ctx.taskAttemptId()}" if ctx else "0"
        for b in batches:
            out = []
            for digest, id_, url_, payload, to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                row += 1
                refers = to["id"] if to and to["id"] is not None and to["id"] != id_ else None
                out += records(id_, url_, payload, digest, refers, to and to["url"], date, f"{task}/{row}", segment)
            yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.binary())], ["value"])

    made = joined.select("digest", "id", "url", "body", "first").mapInArrow(run, "value binary")
    text = made.select(F.col("value").cast("string"))  # the writer copies the bytes as they are
    text.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file).option("compression", compression).text(path)


def inflated(raw: bytes) -> Iterator[bytes]:
    """The bytes of an archive in pieces: of each gzip member in turn, or as they are.

    Archives hold one member per record, or one for all. A broken member yields what it holds before the break, then
    BROKEN; reading goes on at the next member.
    """
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    at = 0
    while 0 <= at < len(raw):
        member, end = zlib.decompressobj(31), at
        try:
            while not member.eof and end < len(raw):
                yield member.decompress(raw[end : end + PIECE])
                end += PIECE
            if not member.eof:
                yield BROKEN
                return
            at = min(end, len(raw)) - len(member.unused_data)
            if raw[at : at + 2] != b"\x1f\x8b":
                at = raw.find(MEMBER, at)  # padding between members
        except zlib.error:
            yield BROKEN
            at = raw.find(MEMBER, at + 1)


def parse(raw: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes | None]]:
    """Header fields (names in lower case) and block of each record of an archive; the block is None where the record is broken.

    A record is broken if its header has no end or no length, if its block is cut short, or if it does not
    end where its length says. Reading goes on at the next line that starts a record.
    """
    data, at, pieces = bytearray(), 0, inflated(raw)

    def need(n: int) -> bool:
        """Have n bytes from at on, if the archive has them before a break."""
        nonlocal data, at, broken
        if at > 4 * PIECE:
            del data[:at]
            at = 0
        while len(data) - at < n and not broken:
            piece = next(pieces, None)
            if piece is None:
                return False
            if piece is BROKEN:
                broken = True
            else:
                data += piece
        return len(data) - at >= n

    broken = False
    while need(1) or broken:
        if broken and len(data) == at:  # nothing of the broken member's record could be read
            broken = False
            yield {}, None
            continue
        end, seen = -1, 0
        while (end := data.find(END, at + seen)) < 0:
            seen = max(0, len(data) - at - len(END) + 1)
            if not need(len(data) - at + 1):
                break
        fields: dict[bytes, bytes] = {}
        if end >= 0:
            lines = bytes(data[at:end]).split(b"\r\n")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
        size = fields.get(b"content-length", b"")
        if end >= 0 and lines[0].startswith(b"WARC/") and size.isdigit():
            start = end + len(END) - at
            whole = need(start + int(size) + len(END))
            tail = at + start + int(size)
            if whole and data[tail : tail + len(END)] == END:
                yield fields, bytes(data[at + start : tail])
                at = tail + len(END)
                continue
        yield fields, None
        # Nothing can be trusted before the next record's first line.
        here = at + 1
        while (to := data.find(b"\r\nWARC/1.", here)) < 0:
            here = max(here, len(data) - 9)
            if broken or not need(len(data) - at + 1):
                to = len(data) - 2
                break
        at = to + 2
        if broken and at >= len(data):
            data, at, broken = bytearray(), 0, False


PARSED = (
    "record string, number int, total long, type string, page_id long, url string, refers_to long, refers_to_uri string, "
    "date string, digest string, block binary, fine boolean"
)


def read_archives(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """page_id, url, record_type, refers_to, payload, complete, digest, record, refers_to_uri, date of each record under path.

    pattern selects files by their names; archives of one gzip member per record, of one for all, and uncompressed ones
    are told by their first bytes. payload is decoded, and null for a revisit. complete is false, and payload null, where a
    segment is missing or repeated, the total length differs, the framing is broken, or the payload does not have its
    sha256 digest; a digest of another kind is not verified. A record that is cut short or whose header is broken comes
    out with what its header tells and complete = false; it never fails the others. Records of other writers have no
    page_id: record is the identifier, refers_to_uri what a revisit names. An empty folder's table has no rows.
    Memory: one archive and one payload at a time, as Spark reads files whole.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    files = files.where("length > 0").select("content")
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PARSED.split(", ")]
        for b in batches:
            for content in b.column(0):
                rows, held = [], 0
                for f, block in parse(content.as_py()):
                    rows.append(_row(f, block))
                    held += len(block or b"")
                    if len(rows) == 200 or held > HELD:
                        yield _batch(rows, names)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, names)

    parsed = files.mapInArrow(run, PARSED)
    whole = parsed.where("number is null")
    cols = ["record", "page_id", "url", "type", "refers_to", "refers_to_uri", "date", "digest"]
    pieces = parsed.where("number is not null").groupBy("record").agg(
        F.max("total").alias("total"), F.bool_and("fine").alias("fine"),
        *[F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in cols[1:]],
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("s"),  # one payload's segments
    )
    inorder = F.forall(F.sequence(F.lit(1), F.size("s")), lambda i: F.element_at("s", i)["number"] == i)
    joined = F.aggregate("s", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["block"]))
    pieces = pieces.withColumn("block", F.when(F.col("fine") & inorder, joined))
    fits = F.coalesce(F.octet_length("block") == F.col("total"), F.lit(False))
    pieces = pieces.withColumn("block", F.when(fits, F.col("block")))
    both = whole.select(*cols, "block").unionByName(pieces.select(*cols, "block"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            get = dict(zip(b.schema.names, b.columns, strict=True))
            payloads, fine = [], []
            for kind, digest, block in zip(*(get[n].to_pylist() for n in ("type", "digest", "block")), strict=True):
                body, ok = _payload(kind, digest, block)
                payloads.append(body)
                fine.append(ok)
            yield pa.RecordBatch.from_arrays(
                [get["page_id"], get["url"], get["type"], get["refers_to"], pa.array(payloads, pa.binary()), pa.array(fine),
                 _bare(get["digest"]), get["record"], get["refers_to_uri"], get["date"]],
                ["page_id", "url", "record_type", "refers_to", "payload", "complete", "digest", "record", "refers_to_uri", "date"],
            )

    return both.mapInArrow(
        decode,
        "page_id long, url string, record_type string, refers_to long, payload binary, complete boolean, digest string, "
        "record string, refers_to_uri string, date string",
    )


def _bare(digests: pa.Array) -> pa.Array:
    return pa.array([None if d is None else d.removeprefix("sha256:") for d in digests.to_pylist()], pa.string())


def _payload(kind: str | None, digest: str | None, block: bytes | None) -> tuple[bytes | None, bool]:
    """The payload of a record's block, and whether the record is complete."""
    if block is None:
        return None, False
    if kind == "revisit":
        return None, True
    try:
        if block.startswith(b"HTTP/"):
            head, _, body = block.partition(END)
            if re.search(rb"\r\ntransfer-encoding:[^\r]*chunked", head, re.IGNORECASE):
                body = dechunked(body)
        else:
            body = block  # warcinfo, metadata, resources
    except ValueError:
        return None, False
    name, _, want = (digest or "").rpartition(":")
    if name == "sha256" and re.fullmatch("[0-9a-fA-F]{64}", want) and hashlib.sha256(body).hexdigest() != want.lower():
        return None, False
    return body, True


def _row(f: dict[bytes, bytes], block: bytes | None) -> tuple:
    """A row of PARSED; a number that is none, or an identifier that is missing, makes the record a broken one."""
    broken = block is None

    def text(name: bytes) -> str | None:
        return f[name].decode("utf-8", "replace") if name in f else None

    def num(name: bytes, most: int = 1 << 63) -> int | None:
        nonlocal broken
        try:
            got = int(f[name]) if name in f else None
        except ValueError:
            got = None
            broken = True
        if got is not None and not -most <= got < most:
            got, broken = None, True
        return got

    own, origin = text(b"warc-record-id"), text(b"warc-segment-origin-id")
    number, total = num(b"warc-segment-number", 1 << 31), num(b"warc-segment-total-length")
    ids = num(b"x-page-id"), num(b"x-refers-to-page-id")
    name = origin or own
    if name is None:
        broken, number = True, None
    return (name, number, total, text(b"warc-type"), ids[0], text(b"warc-target-uri"), ids[1], text(b"warc-refers-to"),
            text(b"warc-date"), text(b"warc-payload-digest"), None if broken else block, not broken)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

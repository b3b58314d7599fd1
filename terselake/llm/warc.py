"""Legacy ARC archives to WARC: parse by version and declared length, convert, deduplicate, write, read back.

An ARC archive opens with a ``filedesc`` record whose second line names the version and whose third names
the header's fields; the converter reads each record's header by those names (version 1 and 2 differ in
them) and its body by the declared length, so content that looks like a header can't mislead it. Each
record gets a WARC identifier (a UUID of its own fields), an ISO timestamp, a type and SHA-256 digests.

Content is bytes from end to end, so pages in any encoding and images come through as they are. Every record is a
gzip member of its own and can be read from its offset alone. Spark's text writer puts the members one after
another, with an empty member for its line end, so files land on any file system Spark writes to and are committed
task by task. ``FILE_BYTES`` bounds a file: the larger the records of a size class, the fewer go into one. Files
are read with ``binaryFile`` and again parsed member by member, by declared length.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, materialise, small

#: Fixed values of the two formats.
ARC_V1 = "URL IP-address Archive-date Content-type Archive-length"
ARC_V2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
WARC = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE_BYTES = 4 << 20
FILE_BYTES = 128 << 20
#: The largest content of each size class of records; a larger one has a file of its own.
CLASSES = (1 << 16, 1 << 20, 1 << 24)
MIN_DUPLICATE = 100
#: Bytes that the reader unpacks at once.
STEP = 1 << 16
#: A gzip member of no bytes.
_EMPTY = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 255, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
_UNSAFE = re.compile(r"[\s\x00-\x1f\x7f]")
_BYTE = re.compile("[\udc80-\udcff]")
RECORD = (
    "page_id long, uri string, warc_date string, warc_type string, record_id string, block_digest string, "
    "payload_digest string, payload_bytes long, http binary, payload binary"
)


def _arc_head(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 terselake\n{ARC_V1 if version == 1 else ARC_V2}\n\n".encode()
    extra = "" if version == 1 else f" 200 - - 0 {name}"
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{extra} {len(body)}\n".encode() + body + b"\n"


def arc_archives(pages: DataFrame, *, date: str = "20240101000000") -> DataFrame:
    """``pages`` (page_id, url, html) as ARC archives (arc binary) of about ``ARCHIVE_BYTES``, versions 1 and 2 in turn.

    A null html is an empty payload, a null url ``urn:unknown``; white space in a url is percent-encoded.
    """

    def record(version: int, page_id, url: str | None, html: str | None, offset: int, name: str) -> bytes:
        payload = (html or "").encode()
        mine = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
        body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{mine}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
        uri = _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "urn:unknown"
        extra = "" if version == 1 else f" 200 {hashlib.md5(body).hexdigest()} - {offset} {name}"
        return f"{uri} 0.0.0.0 {date} text/html{extra} {len(body)}\n".encode() + body + b"\n"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held = 0, bytearray()
        for b in batches:
            for page_id, url, html in zip(b.column(0), b.column(1), b.column(2), strict=True):
                version, name = 1 + n % 2, f"part-{n}.arc"
                if not held:
                    held += _arc_head(version, name, date)
                held += record(version, page_id.as_py(), url.as_py(), html.as_py(), len(held), name)
                if len(held) >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([bytes(held)], pa.binary())], ["arc"])
                    n, held = n + 1, bytearray()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([bytes(held)], pa.binary())], ["arc"])

    return pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")
    ).mapInArrow(run, "arc binary")


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, content) of every record; a record cut off at the end of the archive is an error.

    A byte of a header line that isn't UTF-8 is percent-encoded.
    """
    fields, at = ARC_V1.split(" "), 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.index(b"\n", at)
        line = _BYTE.sub(lambda m: f"%{ord(m[0]) - 0xDC00:02X}", data[at:end].decode("utf-8", "surrogateescape")).rstrip("\r")
        values = line.split(" ")
        head = line.startswith("filedesc://")
        length = int(values[-1])
        content = data[end + 1 : end + 1 + length]
        if length < 0 or len(content) < length:
            raise ValueError(f"an ARC record declares {length} bytes and has {len(content)}: {line[:200]}")
        at = end + 1 + length
        if head:
            version, names = content.decode("utf-8", "replace").split("\n")[:2]
            if version.split(" ")[0] not in ("1", "2"):
                raise ValueError(f"not a known ARC version: {version[:50]}")
            fields = names.strip().split(" ")
            yield {"URL": values[0], "Archive-date": values[2], "Content-type": "text/plain", "type": "warcinfo"}, content
        elif len(values) != len(fields):
            raise ValueError(f"an ARC header has {len(values)} fields, its version {len(fields)}: {line[:200]}")
        else:
            yield dict(zip(fields, values, strict=True)) | {"type": "response"}, content


def _iso(stamp: str) -> str:
    d = stamp.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def convert(arcs: DataFrame) -> DataFrame:
    """ARC archives (arc binary) to WARC records in columns; content without an HTTP head is all payload.

    A record's identifier is a UUID of its fields, its task and its number there, so repeated rows differ in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        names, types = zip(*(f.split(" ") for f in RECORD.split(", ")), strict=True)
        task, n = TaskContext.get().partitionId(), 0
        for b in batches:
            for arc in b.column(0):
                cols: list[list] = [[] for _ in names]
                for header, content in parse_arc(arc.as_py()):
                    cut = content.find(b"\r\n\r\n") if content.startswith(b"HTTP/") else -1
                    http, payload = (content[: cut + 4], content[cut + 4 :]) if cut >= 0 else (b"", content)
                    mine = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", http)
                    digest = hashlib.sha256(payload).hexdigest()
                    page_id = int(mine[1]) if mine else None
                    name = f"{header['URL']} {header['Archive-date']} {page_id} {digest} {task} {n}"
                    row = (
                        page_id, header["URL"], _iso(header["Archive-date"]), header["type"],
                        str(uuid.uuid5(uuid.NAMESPACE_URL, name)), hashlib.sha256(content).hexdigest(), digest, len(payload), http, payload,
                    )
                    n += 1
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(cols, types, strict=True)], list(names))

    return arcs.mapInArrow(run, RECORD)


def mark_revisits(records: DataFrame, least: int = MIN_DUPLICATE) -> DataFrame:
    """Adds ``refers_to``, ``refers_id``: of equal payloads of ``least`` bytes or more, the smallest page_id's record.

    Null for that record itself and for records without an equal. Rows that share the smallest page_id are
    all responses; a null page_id is never the smallest, and a group of nulls only stays as it is.
    """
    slim = records.where((F.col("warc_type") == "response") & (F.col("payload_bytes") >= least)).select("payload_digest", "page_id", "record_id")
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "record_id"))
    first = slim.groupBy("payload_digest").agg(F.count("*").alias("n"), F.min(named).alias("first")).where("n > 1 and first is not null")
    # Digests are matched without payloads; what comes out has a row per revisit, and they are mostly few.
    revisits = join_counted(slim, materialise(first, "firsts"), "payload_digest", slim.count()).where(~F.col("page_id").eqNullSafe(F.col("first.page_id")))
    revisits = materialise(revisits.select("record_id", F.col("first.page_id").alias("refers_to"), F.col("first.record_id").alias("refers_id")), "revisits")
    return records.join(small(revisits), "record_id", "left")


def mark_revisits(records: DataFrame, least: int = MIN_DUPLICATE) -> DataFrame:
    """Adds ``refers_to``, ``refers_id``: of equal payloads of ``least`` bytes or more, the smallest page_id's record.

    Null for that record itself and for records without an equal. Rows that share the smallest page_id are
    all responses; a null page_id is never the smallest, and a group of nulls only stays as it is.
    """
    whole = records.where((F.col("warc_type") == "response") & (F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
    first = (
        whole.groupBy("payload_digest")
        .agg(F.min(F.struct("page_id", "record_id")).alias("first"))
        .select("payload_digest", F.col("first.page_id").alias("refers_to"), F.col("first.record_id").alias("refers_id"))
    )
    # Only digests that more than one row holds matter; the join side shrinks to those.
    several = records.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.count("*").alias("n")).where("n > 1")
    # They are mostly few: then payloads need no shuffle.
    first = small(materialise(first.join(several.select("payload_digest"), "payload_digest", "left_semi"), "firsts"))
    found = records.join(first, "payload_digest", "left")
    own = (F.col("warc_type") != "response") | (F.col("payload_bytes") < least) | F.col("page_id").eqNullSafe(F.col("refers_to"))
    return found.withColumns({c: F.when(~own, F.col(c)) for c in ("refers_to", "refers_id")})


def _fields(*pairs: tuple[str, Column]) -> Column:
    """Header lines of those values that aren't null, each with its line end."""
    return F.concat(*[F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))).otherwise("") for k, v in pairs])


def write(records: DataFrame, path: str) -> None:
    """Writes records, with ``refers_to`` and ``refers_id``, as gzip WARC files. A revisit has no payload."""
    revisit = F.col("refers_id").isNotNull()
    block = F.when(revisit, F.col("http")).otherwise(F.concat("http", "payload"))
    http = F.octet_length("http") > 0
    kind = F.when(F.col("warc_type") == "warcinfo", "text/plain").when(http, "application/http; msgtype=response").otherwise("text/html")
    uri = F.when(F.col("warc_type") != "warcinfo", F.col("uri"))
    header = _fields(
        ("WARC-Type", F.when(revisit, "revisit").otherwise(F.col("warc_type"))),
        ("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), "record_id", F.lit(">"))),
        ("WARC-Date", F.col("warc_date")),
        ("WARC-Target-URI", uri),
        ("Content-Type", kind),
        ("WARC-Block-Digest", F.when(~revisit, F.concat(F.lit("sha256:"), "block_digest"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        ("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:uuid:"), "refers_id", F.lit(">")))),
        ("X-Refers-To-Page-Id", F.col("refers_to").cast("string")),
        ("X-Payload-Length", F.col("payload_bytes").cast("string")),
        ("Content-Length", F.octet_length(block).cast("string")),
    )
    head = F.concat(F.lit(f"{WARC}\r\n"), header, F.lit("\r\n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, n = [], 0
            for h, x in zip(b.column(0), b.column(1), strict=True):
                packer = zlib.compressobj(wbits=31)
                held.append(b"".join([packer.compress(h.as_py().encode()), packer.compress(x.as_py()), packer.compress(b"\r\n\r\n"), packer.flush()]))
                n += len(held[-1])
                if n >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])
                    held, n = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])

    size = F.coalesce(F.octet_length("payload"), F.lit(0))
    used = [r[0] for r in records.select(sum((size > n).cast("int") for n in CLASSES).alias("k")).distinct().collect()]
    for k in sorted(used) or [0]:
        low, high = (0, *CLASSES)[k], (*CLASSES, None)[k]
        mine = size <= high if not k else size > low if high is None else (size > low) & (size <= high)
        members = records.where(mine).select(head.alias("head"), block.alias("block")).mapInArrow(run, "value binary")
        # A string column carries the bytes as they are, and in this encoding each character of the line end is a byte.
        members.select(F.col("value").cast("string")).write.mode("append").option("encoding", "ISO-8859-1").option("lineSep", _EMPTY.decode("latin-1")).option(
            "maxRecordsPerFile", FILE_BYTES // high if high else 1
        ).text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of every record of a file, member by member and by declared lengths."""
    view, at = memoryview(data), 0
    while at < len(view):
        packed, parts = zlib.decompressobj(wbits=31), []
        while not packed.eof:
            if at >= len(view):
                raise ValueError("a WARC file ends within a record")
            parts.append(packed.decompress(view[at : at + STEP]))
            at = min(at + STEP, len(view))
        at -= len(packed.unused_data)
        record = b"".join(parts)
        if not record:
            continue
        end = record.index(b"\r\n\r\n")
        first, *rest = record[:end].decode().split("\r\n")
        if first != WARC:
            raise ValueError(f"not a WARC record: {first[:50]}")
        header = dict(x.split(": ", 1) for x in rest)
        length = int(header["Content-Length"])
        if len(record) != end + 8 + length or record[-4:] != b"\r\n\r\n":
            raise ValueError(f"a WARC record doesn't end where its length says: {rest[:3]}")
        yield header, record[end + 4 : end + 4 + length]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The content records of WARC files: page_id, uri, payload (null for a revisit), digest, type and reference.

    A stored payload's digest and length are those of its bytes as read; a mismatch with the header is an error.
    """
    schema = "page_id long, uri string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                cols: list[list] = [[] for _ in range(7)]
                for header, block in parse_warc(content.as_py()):
                    kind = header["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    cut = block.find(b"\r\n\r\n") + 4 if block.startswith(b"HTTP/") else 0
                    digest, n = header["WARC-Payload-Digest"].removeprefix("sha256:"), int(header["X-Payload-Length"])
                    payload = None if kind == "revisit" else block[cut:]
                    if payload is not None and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"payload and digest differ: {header['WARC-Record-ID']}")
                    mine = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", block[:cut])
                    to = header.get("X-Refers-To-Page-Id")
                    row = (
                        int(mine[1]) if mine else None, header["WARC-Target-URI"],
                        payload, n, digest, kind, int(to) if to else None,
                    )
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                kinds = [pa.int64() if k in (0, 3, 6) else pa.binary() if k == 2 else pa.string() for k in range(7)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.split(" ")[0] for f in schema.split(", ")]
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content")
    return files.mapInArrow(run, schema)


def archive(pages: DataFrame, path: str) -> DataFrame:
    """Pages through ARC archives to WARC files at ``path``, and what reading those back gives.

    Every row of ``pages`` (page_id, url, html) gives one record, repeated rows too; other columns are
    ignored; an empty table gives an empty archive.
    """
    records = materialise(convert(arc_archives(pages)), "records")
    write(mark_revisits(records), path)
    return read_archives(pages.sparkSession, path)

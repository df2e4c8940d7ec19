"""WARC archives of pages: a writer with revisit records, and a reader that salvages what damage leaves.

Writing.  Narrow rows (id, digest, length) decide which row of a group of equal payloads is the response; only then do
payloads move, once, dealt by page id, so that no group of copies meets in one task.  Each task writes archives of
bounded size under a temporary name and renames them, which makes a task that runs twice harmless.

Reading.  Each record is a gzip member (or a plain record).  A record that fails a check (member, version line, length,
block or payload digest) sends the reader to the next member or version line from which a whole record can be read; the
bytes between are logged as a quarantined gap and all later records are recovered.  Records of every type are returned; a
digest, HTTP length or HTTP head that a record does not have is not checked.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import materialize, new_path
from loam.sources.address import filesystem

#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
#: An archive is closed at this size, so that a reader's task holds no more than an archive and its largest record.
ARCHIVE_BYTES = 16 << 20
#: A payload of more pages than this, and than a ``HOT_SHARE``-th of all, is planned without dealing them by payload.
HOT_PAGES = 100_000
HOT_SHARE = 10_000
#: About how many bytes of payload a writing task gets.
TASK_BYTES = 32 << 20

_EPOCH = "1970-01-01T00:00:00Z"  # archives of equal pages are equal
_VERSION = b"WARC/1."
_MEMBER = b"\x1f\x8b\x08"
#: Headers that a record has once; others, such as WARC-Concurrent-To, may be repeated.
_ONCE = frozenset(
    "content-length content-type warc-block-digest warc-date warc-filename warc-identified-payload-type warc-ip-address warc-payload-digest warc-profile warc-record-id warc-refers-to"
    " warc-refers-to-date warc-refers-to-target-uri warc-segment-number warc-segment-origin-id warc-segment-total-length warc-target-uri warc-truncated warc-type warc-warcinfo-id".split()
)


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None, copy: int) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}:{copy}>"


def _page(urn: str | None) -> int | None:
    found = re.match(r"<urn:x-page:(-?\d+):\d+>", urn or "")
    return int(found[1]) if found else None


def _header_safe(value: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value or "")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, copy: int = 0, compress: bool = True) -> bytes:
    """One record; with ``refers_to`` a revisit, whose block has the HTTP head but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id, copy)}",
        f"WARC-Target-URI: {_header_safe(url)}",
        f"WARC-Date: {_EPOCH}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {_sha1(payload)}",
        f"WARC-Block-Digest: {_sha1(block)}",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to, 0)}"]
    plain = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    if not compress:
        return plain
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(plain) + z.flush()


@dataclass
class Record:
    kind: str
    page_id: int | None
    refers_to: int | None
    url: str
    payload: bytes | None
    payload_bytes: int | None
    digest: str | None
    start: int
    end: int


class Damaged(ValueError):
    pass


def _plain_record(data: bytes, start: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of a plain record at ``start``."""
    if data[start : start + len(_VERSION)] != _VERSION:
        raise Damaged("no version line")
    stop = data.find(b"\r\n\r\n", start)
    if stop < 0:
        raise Damaged("headers do not end")
    headers: dict[str, str] = {}
    name = ""
    for line in data[start:stop].split(b"\r\n")[1:]:
        if line[:1] in (b" ", b"\t") and name:  # a folded line
            headers[name] += " " + line.decode("utf-8", "replace").strip()
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header without a colon")
        name = name.decode("latin-1").strip().lower()
        value = value.decode("utf-8", "replace").strip()
        if name not in headers:
            headers[name] = value
        elif name in _ONCE:
            raise Damaged("two records' headers run together")
        else:
            headers[name] += ", " + value
    if not headers.get("content-length", "").isdigit():
        raise Damaged("no content length")
    if not re.fullmatch(r"<[^<>\s]+>", headers.get("warc-record-id", "")):
        raise Damaged("no record id")
    end = stop + 4 + int(headers["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("block does not end where its length says")
    return headers, data[stop + 4 : end], end + 4


def _digest(stated: str | None) -> tuple[str, bytes] | None:
    """Algorithm and value of a stated digest, in base 32 or 16; none if there is none or its algorithm is not known."""
    name, _, value = (stated or "").partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        return None
    size = hashlib.new(name).digest_size
    try:
        found = bytes.fromhex(value) if len(value) == 2 * size else base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except (binascii.Error, ValueError):
        found = b""
    if len(found) != size:
        raise Damaged("digest cannot be read")
    return name, found


def _agrees(stated: str | None, data: bytes, sha1: str | None = None) -> bool:
    """Whether data has the stated digest, if one is stated; ``sha1`` is the data's, if known."""
    digest = _digest(stated)
    if digest is None:
        return True
    return (bytes.fromhex(sha1) if sha1 and digest[0] == "sha1" else hashlib.new(digest[0], data).digest()) == digest[1]


def _dechunked(data: bytes) -> bytes:
    """The body of an HTTP message in chunks, as far as they can be read."""
    out, at = [], 0
    while size := re.compile(rb"([0-9a-fA-F]+)[^\r\n]*\r\n").match(data, at):
        n = int(size[1], 16)
        if not n:
            break
        out.append(data[size.end() : size.end() + n])
        at = size.end() + n + 2
    return b"".join(out)


def read_record(data: bytes, start: int) -> Record:
    """The record at ``start``, whole and checked, or ``Damaged``."""
    if data[start : start + 3] == _MEMBER:
        z, end, parts = zlib.decompressobj(31), start, []
        try:
            while not z.eof and end < len(data):  # by pieces: what follows a member is copied by the library
                parts.append(z.decompress(memoryview(data)[end : end + 8192]))
                end += 8192
        except zlib.error as e:
            raise Damaged(f"member: {e}") from None
        if not z.eof:
            raise Damaged("member is cut off")
        plain, end = b"".join(parts), min(end, len(data)) - len(z.unused_data)
        headers, block, used = _plain_record(plain, 0)
        if used != len(plain):
            raise Damaged("member holds more than a record")
    else:
        headers, block, end = _plain_record(data, start)
    if not _agrees(headers.get("warc-block-digest"), block):
        raise Damaged("block digest differs")
    kind = headers.get("warc-type", "")
    if not kind:
        raise Damaged("no record type")
    stop = block.find(b"\r\n\r\n") if kind in ("response", "revisit") and block.startswith(b"HTTP/") else -1
    http = block[: max(stop, 0)]
    length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    payload = None if kind == "revisit" else block[stop + 4 :] if stop >= 0 else block
    stated = headers.get("warc-payload-digest")
    if payload is None:
        digest = _digest(stated)
        size = int(length[1]) if length else None
        read = digest[1].hex() if digest else None
    else:
        size, read = len(payload), hashlib.sha1(payload).hexdigest()
        # Of a request the payload is what follows its HTTP head; of other types that are not of pages, the block.
        body = block[block.find(b"\r\n\r\n") + 4 :] if kind == "request" and b"\r\n\r\n" in block else payload
        chunked = re.search(rb"(?im)^transfer-encoding:.*chunked", http)
        cut = "warc-truncated" in headers or "warc-segment-number" in headers
        if not (cut or _agrees(stated, body, read if body is payload else None) or chunked and _agrees(stated, _dechunked(payload))):
            raise Damaged("payload digest or length differs")
        if length and not chunked and not cut and size != int(length[1]):
            raise Damaged("payload digest or length differs")
    return Record(kind, _page(headers.get("warc-record-id")), _page(headers.get("warc-refers-to")), headers.get("warc-target-uri", ""), payload, size, read, start, end)


def salvage(data: bytes) -> Iterator[Record | tuple[int, int, str]]:
    """All whole records of an archive in order, and (start, end, reason) of each quarantined gap."""
    at = 0
    starts = re.compile(re.escape(_MEMBER) + b"|" + re.escape(_VERSION))
    while at < len(data):
        try:
            record = read_record(data, at)
        except Damaged as e:
            lost, reason = at, str(e)
            record = None
            for found in starts.finditer(data, at + 1):
                try:
                    record = read_record(data, found.start())
                    break
                except Damaged:
                    continue
            yield lost, record.start if record else len(data), reason
            if record is None:
                return
        yield record
        at = record.end


class _Archives:
    """Archives of one task: bounded size, temporary names, renamed when whole."""

    def __init__(self, folder: str, part: int, limit: int):
        self.fs, self.path = filesystem(folder)
        self.part, self.limit, self.number, self.out = part, limit, 0, None

    def add(self, data: bytes) -> tuple[str, int]:
        if self.out is not None and self.size + len(data) > self.limit:
            self.close()
        if self.out is None:
            self.name = f"part-{self.part:06d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.path}/.{self.name}.{uuid.uuid4().hex}"
            self.fs.create_dir(self.path, recursive=True)
            self.out, self.size = self.fs.open_output_stream(self.temporary, compression=None), 0
            self.number += 1
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return self.name, at

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, f"{self.path}/{self.name}")
            self.out = None


def plan_revisits(pages: DataFrame, id_col: str, body_col: str, count: int) -> DataFrame:
    """Of the narrow rows: page_id, digest, copies, target of each (page, payload) that takes part in a revisit.

    Groups of more than ``HOT_PAGES`` rows and a ``HOT_SHARE``-th of all ``count`` rows, fewer than ``HOT_SHARE``, go to where their
    pages are.
    """
    body = F.coalesce(F.col(body_col).cast("string").cast("binary"), F.lit(b""))
    narrow = pages.select(F.col(id_col).alias("page_id"), F.sha1(body).alias("digest"), F.octet_length(body).alias("size")).filter(F.col("size") >= REVISIT_BYTES)
    each = narrow.groupBy("digest", "page_id").agg(F.count("*").alias("copies"))
    # A null id is below all others; target_known tells a null target from none.
    groups = each.groupBy("digest").agg(F.max("page_id").alias("target"), F.sum("copies").alias("n")).filter(F.col("n") > 1)
    hot = F.col("n") > max(HOT_PAGES, count // HOT_SHARE)
    known = each.join(F.broadcast(groups.filter(hot).select("digest", F.col("target").alias("of_hot"), F.lit(True).alias("in_hot"))), "digest", "left")
    others = known.filter("in_hot is null").join(groups.filter(~hot), "digest").select("page_id", "digest", "target")
    return known.filter("in_hot").select("page_id", "digest", F.col("of_hot").alias("target")).unionByName(others)


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per row below ``folder`` (any store that pyarrow opens by its address) and returns the index,
    written too: page_id, archive, at, length.

    A null html is an empty payload, a null url an empty one, a null id is written as null and never a target unless its
    whole group has null ids.  Of rows that repeat with the largest id one is the response and the others revisit it.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(html_col).cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("body"), F.sha1(body).alias("digest"))
    size, count = pages.select(F.coalesce(F.sum(F.octet_length(F.col(html_col).cast("string")) + 300), F.lit(0)), F.count("*")).first()
    plan = plan_revisits(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")), "page_id", "html", count)
    parts = max(1, -(-size // TASK_BYTES), spark.sparkContext.defaultParallelism)
    pair = F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.lit(" "), F.col("digest")).alias("pair")
    plan = plan.select(pair, "target", F.lit(True).alias("grouped"))
    # Both sides are dealt by the same key into as many parts, so that payloads move once and equal rows meet.
    joined = rows.withColumn("pair", pair).repartition(int(parts), "pair").join(plan.repartition(int(parts), "pair").hint("merge"), "pair", "left")
    ordered = joined.select("page_id", "url", "body", "digest", F.coalesce("grouped", F.lit(False)).alias("grouped"), "target").sortWithinPartitions("page_id", "digest", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives = _Archives(folder, TaskContext.get().partitionId(), archive_bytes)
        before, copy = None, 0
        for batch in batches:
            index = []
            for row in batch.to_pylist():
                same = (row["page_id"], row["digest"])
                copy = copy + 1 if same == before else 0
                before = same
                # The first copy of the target page is the response.  A group of null ids alone cannot be referred to.
                revisit = row["grouped"] and row["target"] is not None and (row["page_id"] != row["target"] or copy > 0)
                data = record_bytes(row["page_id"], row["url"], row["body"], row["target"] if revisit else None, copy)
                index.append((row["page_id"], *archives.add(data), len(data)))
            columns = zip(*index, strict=True) if index else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["page_id", "archive", "at", "length"])
        archives.close()

    return materialize(ordered.mapInArrow(run, "page_id long, archive string, at long, length long"), "warc-index")


RECORDS = "archive string, start long, end long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, reason string"


def read(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """Rows of all archives below ``folder``: records, and gaps as rows of type ``gap`` with a reason.

    An empty folder's archives give no rows; an archive of rubbish gives one gap.  ``payload=False`` leaves payloads out
    after they have been checked.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("reason", pa.string())])
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                name, out, held = path.as_py(), [], 0
                for x in salvage(content.as_py()):
                    if isinstance(x, Record):
                        out.append((name, x.start, x.end, x.page_id, x.url, x.payload_bytes, x.digest, x.kind, x.refers_to, x.payload if payload else None, None))
                        held += len(x.payload or b"") if payload else 0
                    else:
                        out.append((name, x[0], x[1], None, None, None, None, "gap", None, None, x[2]))
                    if len(out) >= 4096 or held >= 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return files.mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes archives to the shared folder and reads them back: a row per page.  A gap in what was just written is an error, as a
    page would be missing."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    index = write(pages, folder, id_col, url_col, html_col)
    if not index.take(1):
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    found = read(spark, folder, payload=False)
    lost = F.raise_error(F.concat_ws(" ", F.lit("damaged archive"), "archive", "start", "end", "reason"))
    found = found.withColumn("record_type", F.when(F.col("record_type") == "gap", lost.cast("string")).otherwise(F.col("record_type")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def oracle() -> str:
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest,
             row_number() OVER (PARTITION BY sha1(body) ORDER BY page_id DESC) AS k,
             max(page_id) OVER (PARTITION BY sha1(body)) AS target FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND k > 1 THEN target END AS refers_to FROM d"""

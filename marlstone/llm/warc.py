"""WARC archives: writing, and a reader that salvages what damage has left.

The writer makes one record per page. Each record is a gzip member of its own, so that damage to one costs no other;
tasks pack members into parts of bounded size, and Spark's text writer writes a bounded number of parts to a file.
Of pages with equal payloads, the one with the largest page id is stored as a response and the others as revisits
that refer to it.

The reader takes archive files, plain, gzip as one member, or gzip by record, and yields records as it goes. A record
is accepted if its version line, its headers, its type, its length, the blank lines after it and, where its payload is
there, its digest are right. After a failed check the reader searches for the next member or version line from the
byte after, resumes there, and logs the gap that it left out. Bytes are never skipped without a log entry.

Defined cases: a null payload is an empty one; a page without id is a response of its own; a null url is written
as an empty one, and line breaks in urls are percent-encoded; pages that share an id and a payload are each
written; an empty table gives archives without records; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import common

#: Bytes of compressed records that make a part, and parts of a file: a task reads a file whole. A longer record is a part.
PART_BYTES, FILE_PARTS = 4 << 20, 8
#: Bytes of payloads that the reader holds before it hands records on.
READ_BYTES = 8 << 20
#: Rows of the table of repeated payloads up to which it is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000
RECORD_END = b"\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the payload's SHA-1, from eight letters for every ten digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def plan_records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """page_id, url, payload, payload_bytes, digest, refers_to (null for responses)."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    url = F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"[\x00-\x20\x7F]", "%20")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": base32_sha1(F.col("payload").cast("binary"))})
    long_enough = F.col("payload_bytes") >= least_bytes
    # A first pass over the payloads makes a narrow table, so that only digests are dealt out.
    seen = rows.filter(long_enough & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
    repeated = common.written(seen.filter("n > 1").select("digest", "original"), "warc-repeated")
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    rows = rows.join(repeated, "digest", "left")
    is_revisit = long_enough & (F.col("page_id") != F.col("original"))
    return rows.withColumn("refers_to", F.when(is_revisit, F.col("original"))).drop("original")


def record_text(rows: DataFrame) -> DataFrame:
    """value: each row's record as WARC/1.1, without the blank lines after it."""
    revisit = F.col("refers_to").isNotNull()

    def uid(column: Column) -> Column:
        h = F.md5(F.concat(F.lit("page "), column.cast("string")))
        cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))

    block = F.when(revisit, F.lit(_HTTP)).otherwise(F.concat(F.lit(_HTTP), F.col("payload")))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), F.coalesce(uid(F.col("page_id")), F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">")))),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes")),
        F.concat(F.lit("X-Page-ID: "), F.col("page_id")),
        F.concat(F.lit("X-Refers-To-Page-ID: "), F.col("refers_to")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), uid(F.col("refers_to")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block)),
    ]
    return rows.select(F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block).alias("value"))


def _gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, wbits=31)
    return packer.compress(data) + packer.flush()


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> None:
    """Write the pages as archives, gzip by record, into the folder `path`."""

    def members(batches):
        held, size = [], 0
        for batch in common.slices(batches):
            for value in batch.column(0).to_pylist():
                held.append(_gzip_member(value.encode() + RECORD_END))
                size += len(held[-1])
                if size >= PART_BYTES:
                    yield pa.RecordBatch.from_pydict({"value": pa.array([b"".join(held)], pa.binary())})
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"value": pa.array([b"".join(held)], pa.binary())})

    records = record_text(plan_records(pages, id_col, url_col, payload_col, least_bytes)).mapInArrow(members, "value binary")
    # The writer puts a separator after each part: a member without content, its bytes as letters of Latin-1.
    separator = _gzip_member(b"").decode("latin-1")
    writer = records.select(F.col("value").cast("string")).write.option("lineSep", separator).option("encoding", "ISO-8859-1")
    writer.option("compression", "none").option("maxRecordsPerFile", FILE_PARTS).text(path)


_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_GZIP = b"\x1f\x8b\x08"
_FIELDS = ("record_type", "record_id", "url", "date", "page_id", "refers_to", "payload_bytes", "payload_digest")


def inflate(data: bytes):
    """For each run of the file: the bytes that its member gives, and a gap (from, to, why) where it can't be read.

    Where a member breaks off, its readable beginning is kept: its records are checked one by one.
    """
    at = 0
    while at < len(data):
        out, fault = b"", "no gzip member"
        if data[at : at + 3] == _GZIP:
            member = zlib.decompressobj(31)
            pieces, fault = [], "gzip member ends early"
            try:
                # Small steps keep what was read before a fault.
                for step in range(at, len(data), 1 << 16):
                    pieces.append(member.decompress(data[step : step + (1 << 16)]))
                    if member.eof:
                        break
            except zlib.error as error:
                fault = str(error)
            out = b"".join(pieces)
            if member.eof:
                yield out, None
                at = min(step + (1 << 16), len(data)) - len(member.unused_data)
                continue
        after = data.find(_GZIP, at + 1)
        after = len(data) if after < 0 else after
        yield out, (at, after, f"compressed: {fault}")
        at = after


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record at `at` and the place after it; ValueError says which check failed."""
    version = _VERSION.match(data, at)
    if not version:
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", version.end())
    if end < 0:
        raise ValueError("headers do not end")
    headers = {}
    for line in data[version.end() : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError("bad header line")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise ValueError("no content length")
    start, stop = end + 4, end + 4 + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("no blank lines at the stated end")
    kind, block = headers.get("warc-type"), data[start:stop]
    if not kind:
        raise ValueError("no type")
    payload = block.partition(b"\r\n\r\n")[2] if "application/http" in headers.get("content-type", "") else block
    digest = headers.get("warc-payload-digest", "").rpartition(":")[2]
    numbers = {k: int(v) for k, v in headers.items() if k.startswith("x-") and re.fullmatch(r"-?\d+", v)}
    if kind != "revisit":
        actual = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if digest and digest != actual:
            raise ValueError("payload digest differs")
        digest, size = actual, len(payload)
    else:
        payload, size = None, numbers.get("x-payload-length")
    record = {"record_type": kind, "record_id": headers.get("warc-record-id"), "url": headers.get("warc-target-uri"), "date": headers.get("warc-date"), "page_id": numbers.get("x-page-id"), "refers_to": numbers.get("x-refers-to-page-id"), "payload_bytes": size, "payload_digest": digest, "payload": payload}
    return record, stop + 4


def _records(data: bytes, base: int, more: bool):
    """Records and gaps of plain bytes from `base` of the archive on; at last how many bytes a later part may complete."""
    at = 0
    while at < len(data):
        try:
            record, after = parse_record(data, at)
            yield record, None
        except ValueError as error:
            found = _VERSION.search(data, at + 1)
            if more and not found and (_VERSION.match(data, at) or len(data) - at < 10):
                break
            # The last bytes may begin a version line (of ten bytes) that the next part ends.
            after = found.start() if found else len(data) - 9 * more
            yield None, (base + at, base + after, str(error))
        at = after
    yield None, at


def salvage(data: bytes):
    """(record, None) for each record that passes the checks, (None, gap) for each quarantined gap (from, to, why).

    Places are those in the uncompressed archive, or in the file where its compression fails.
    """
    packed = data.startswith(_GZIP) or _GZIP in data and not _VERSION.search(data)
    rest, base = b"", 0
    for part, gap in inflate(data) if packed else [(data, None)]:
        rest += part
        if not rest:
            yield from [(None, gap)] if gap else []
            continue
        # A record may go on in the next member, unless this one has broken off.
        *found, (_, done) = _records(rest, base, packed and gap is None)
        yield from found
        rest, base = rest[done:], base + done
        if gap:
            yield None, gap
    if rest:
        *found, _ = _records(rest, base, False)
        yield from found


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all archives below `path`, and its gaps.

    Columns: path, record_type (`gap` for a gap), record_id, url, date, page_id, refers_to, payload_bytes,
    payload_digest, payload (null for revisits and gaps), gap_from, gap_to, gap_reason.
    """
    kinds = {"payload_bytes": pa.int64(), "page_id": pa.int64(), "refers_to": pa.int64()}

    def table(name: str, rows: list[dict]) -> pa.RecordBatch:
        out = {"path": pa.array([name] * len(rows), pa.string())}
        out |= {f: pa.array([r[f] for r in rows], kinds.get(f, pa.string())) for f in _FIELDS}
        out["payload"] = pa.array([r["payload"] for r in rows], pa.binary())
        for i, (f, kind) in enumerate((("gap_from", pa.int64()), ("gap_to", pa.int64()), ("gap_reason", pa.string()))):
            out[f] = pa.array([r["gap"][i] for r in rows], kind)
        return pa.RecordBatch.from_pydict(out)

    def run(batches):
        for batch in common.slices(batches, 1):
            name, held, size = batch.column(0)[0].as_py(), [], 0
            for record, gap in salvage(batch.column(1)[0].as_py() or b""):
                if gap:
                    record = dict.fromkeys((*_FIELDS, "payload")) | {"record_type": "gap"}
                held.append(record | {"gap": gap or (None, None, None)} | ({} if payloads else {"payload": None}))
                size += 1000 + len(held[-1]["payload"] or b"")
                if size >= READ_BYTES:
                    yield table(name, held)
                    held, size = [], 0
            yield table(name, held)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    fields = ", ".join(f"{f} {'long' if f in kinds else 'string'}" for f in _FIELDS)
    return files.mapInArrow(run, f"path string, {fields}, payload binary, gap_from long, gap_to long, gap_reason string")


def op7_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written and read back; a gap in archives that were just written is an error, not a lost page."""
    folder = f"{common.shared_dir(spark, 'warc')}/archives"
    write_archives(common.table(spark, sf_dir, "pages"), folder)
    records = read_archives(spark, folder, payloads=False)
    gap = F.concat_ws(" ", F.lit("gap in"), "path", "gap_from", "gap_to", "gap_reason")
    kind = F.when(F.col("record_type") == "gap", F.raise_error(gap).cast("string")).otherwise(F.col("record_type"))
    return records.select("page_id", "payload_bytes", "payload_digest", kind.alias("record_type"), "refers_to")

"""WARC records in ZIP-packaged archives: written once, then read by byte ranges.

An archive is a ZIP file whose members are stored, not compressed: `archive/data.warc.gz`, where each
record is a gzip member of its own, and `indexes/index.cdxj`, a line for each record with its place.
The reader parses the end record, the ZIP64 records where they are needed and the central
directory, finds the two members, and reads records by their ranges without unpacking anything.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Payload bytes after which a writer starts the next archive.
ARCHIVE_BYTES = 64 << 20
#: Payloads from this length on are stored once.
LEAST_SHARED = 100


def filesystem(uri: str):
    """(file system, path there) for any address that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


# --- records -------------------------------------------------------------------------------------


def planned_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_SHARED) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to for every row.

    Null payloads are empty. Of rows with equal payloads of at least `least` bytes, those with the
    smallest id are responses (null ids count as larger than any), the others revisit it; shorter
    payloads are always responses. An empty table gives no records; other columns are left out.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    first = rows.where(F.col("payload_bytes") >= least).groupBy(F.col("payload_digest").alias("_key")).agg(F.min("page_id").alias("_first"))
    # short payloads never meet another row, so a payload that many rows leave empty is no hot key
    rows = rows.withColumn("_key", F.when(F.col("payload_bytes") >= least, F.col("payload_digest")).otherwise(F.concat(F.lit("short "), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.join(first, "_key", "left").select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_first")).alias("refers_to"))


def record_bytes(page_id, url: str, payload: bytes, length: int, digest: str, kind: str, refers_to) -> bytes:
    body = payload if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"), "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"Payload-Length: {length}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode("utf-8") + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the content."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers["content-length"])
    if len(rest) < n:
        raise ValueError("the record is cut short")
    return headers, rest[:n]


# --- writing -------------------------------------------------------------------------------------


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write planned records to archives in the folder; returns the manifest (path, records) as a
    table. Each attempt of a task writes files of its own names, and only those of the attempt that
    counted are in the manifest, so a repeated task leaves no record twice."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = filesystem(folder)
        fs.create_dir(top, recursive=True)
        made: list[tuple[str, int]] = []
        out = zf = member = None
        lines: list[str] = []
        at = size = 0

        def close() -> None:
            nonlocal out
            member.close()
            zf.writestr(zipfile.ZipInfo(INDEX), "\n".join(lines))
            zf.close()
            out.close()
            made[-1] = (made[-1][0], len(lines))
            out = None

        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.wacz"
                    made.append((f"{folder.rstrip('/')}/{name}", 0))
                    out = fs.open_output_stream(f"{top}/{name}")
                    zf = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                    member = zf.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
                    lines, at, size = [], 0, 0
                payload = r["payload"].encode("utf-8")
                raw = gzip.compress(record_bytes(r["page_id"], r["url"], payload, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]), 1, mtime=0)
                member.write(raw)
                lines.append(json.dumps({"offset": at, "length": len(raw)}))
                at += len(raw)
                size += len(payload)
                if size >= ARCHIVE_BYTES:
                    close()
        if out is not None:
            close()
        if made:
            paths, counts = zip(*made, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], ["path", "records"])

    return written(records.mapInArrow(write, "path string, records long"), "manifest")


# --- reading -------------------------------------------------------------------------------------


def members(read_at, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (offset of the data, stored bytes, compression method), from the central directory alone.
    read_at(offset, length) gives bytes of the archive."""
    tail_at = max(0, size - 65_557)
    tail = read_at(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    # a comment may hold the signature: the end record is the one whose comment ends the file
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP archive")
    count, length, at = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or at == 0xFFFFFFFF:
        sign, _, far, _ = struct.unpack("<4sIQI", read_at(tail_at + end - 20, 20))
        if sign != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        record = read_at(far, 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        length, at = struct.unpack_from("<QQ", record, 40)
    directory = read_at(at, length)
    found, pos = {}, 0
    while pos < len(directory):
        if directory[pos : pos + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method = struct.unpack_from("<H", directory, pos + 10)[0]
        packed, full, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", directory, pos + 20)
        head = struct.unpack_from("<I", directory, pos + 42)[0]
        name = directory[pos + 46 : pos + 46 + n_name].decode("utf-8")
        extra = directory[pos + 46 + n_name : pos + 46 + n_name + n_extra]
        while len(extra) >= 4:
            tag, n = struct.unpack_from("<HH", extra)
            if tag == 1:  # 64-bit fields stand only for those that don't fit, in this order
                wide = [x[0] for x in struct.iter_unpack("<Q", extra[4 : 4 + n // 8 * 8])]
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                head = wide.pop(0) if head == 0xFFFFFFFF else head
            extra = extra[4 + n :]
        local = read_at(head, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        found[name] = (head + 30 + sum(struct.unpack_from("<HH", local, 26)), packed, method)
        pos += 46 + n_name + n_extra + n_note
    return found


def archive_index(manifest: DataFrame) -> DataFrame:
    """path, offset, length of every record (offsets in the archive file), from the archives' index
    members; where one has none, from a walk over the gzip members of its data."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, p = filesystem(path)
                with fs.open_input_file(p) as f:
                    def read_at(at, n, f=f):
                        f.seek(at)
                        return f.read(n)

                    inside = members(read_at, f.size())
                    start, size, method = inside[DATA]
                    if method != 0:
                        raise ValueError(f"{DATA} is compressed as a whole; only stored members can be read by ranges")
                    if INDEX in inside and inside[INDEX][2] == 0:
                        text = read_at(*inside[INDEX][:2]).decode("utf-8")
                        places = [(x["offset"], x["length"]) for x in map(json.loads, text.split("\n") if text else [])]
                    else:
                        places, at = [], 0
                        while at < size:
                            un, n = zlib.decompressobj(31), 0
                            while not un.eof:
                                part = read_at(start + at + n, min(1 << 16, size - at - n))
                                if not part:
                                    raise ValueError("the data member is cut short")
                                un.decompress(part)
                                n += len(part)
                            n -= len(un.unused_data)
                            places.append((at, n))
                            at += n
                for i in range(0, len(places), 10_000):
                    part = places[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part), pa.string()), pa.array([start + a for a, _ in part], pa.int64()), pa.array([n for _, n in part], pa.int64())], ["path", "offset", "length"])

    return manifest.select("path").mapInArrow(look, "path string, offset long, length long")


RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records at the places of the index. A response's length and SHA-256 are taken from its content
    and must agree with its headers; a revisit has those of the payload it refers to in its headers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = opened = None
        number = lambda x: int(x[10:-1]) if x and x != "<urn:page:>" else None
        for batch in batches:
            rows = []
            for place in batch.to_pylist():
                if place["path"] != opened:
                    if f is not None:
                        f.close()
                    fs, p = filesystem(place["path"])
                    f, opened = fs.open_input_file(p), place["path"]
                f.seek(place["offset"])
                head, body = parse_record(gzip.decompress(f.read(place["length"])))
                digest, n = head["warc-payload-digest"].partition(":")[2], int(head["payload-length"])
                if head["warc-type"] == "response" and (len(body), hashlib.sha256(body).hexdigest()) != (n, digest):
                    raise ValueError(f"{opened}: a payload differs from its digest")
                rows.append((number(head["warc-record-id"]), head["warc-target-uri"], head["warc-type"], number(head.get("warc-refers-to")), digest, n, body if with_payload else None))
            if rows:
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in RECORD.split(", ")])
        if f is not None:
            f.close()

    return index.mapInArrow(read, RECORD)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_SHARED, with_payload: bool = False) -> DataFrame:
    """Write a record for each page, then read all of them back from the archives."""
    manifest = write_archives(planned_records(pages, id_col, url_col, payload_col, least), new_path(pages.sparkSession, "warc"))
    return read_records(archive_index(manifest), with_payload)

"""Web archives packed in ZIP files: written by tasks, read by ranges without extraction.

An archive is a ZIP whose members are stored, not deflated: ``archive/data.warc.gz``, a gzip member per record, and
``indexes/index.cdxj``, a line per record with its offset and length in that member. The reader takes the paths
from Spark's listing, reads an archive's tail, its end record (ZIP64 too) and central directory, the local header of
each member and the index; records then become rows of (path, offset, length) that Spark deals out anew, and each is
fetched by a range read, neighbours together. Archives without an index are walked record by record.

Of records with equal payloads the one with the smallest id is the response, the others are revisits that name it
and keep only the HTTP header with the payload's length. Equal payloads are found by a partial aggregation; the join
back is a plain equi-join, whose hot digests Spark's skew handling splits.

Files are written to a new name per task attempt through pyarrow's file systems (local, HDFS, S3, GCS by the path's
scheme); the paths that count are those of attempts whose rows Spark kept, so a lost executor leaves at most files
that nothing names.

Cases: a null payload is empty; a null id is a revisit of the smallest id with the same payload, or a response where
there is none; rows that repeat the smallest id and payload are responses each; an empty table gives no archive and
an empty result; a foreign or cut file raises ValueError.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, col

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
RUN_BYTES = 4 << 20  # neighbouring records fetched at once
GZIP_LEVEL = 1
NO_ID = "-"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1) if path.startswith("file:/") else f"file://{path}")


# --- records ---

def record_bytes(record_id: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A WARC record: a response with the payload, or a revisit of ``refers_to`` with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:record:{record_id}>",
            f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:record:{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines = "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}"])
    return lines.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers of a record, its payload, and the payload's full length."""
    head, _, block = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = block[:int(fields["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    sizes = [int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    return {"type": fields["warc-type"], "id": _urn(fields["warc-record-id"]), "refers_to": _urn(fields.get("warc-refers-to")),
            "digest": fields["warc-payload-digest"].removeprefix("sha1:"), "payload": body, "size": sizes[0] if sizes else len(body),
            "url": fields.get("warc-target-uri")}


def _urn(value: str | None) -> str | None:
    return None if value is None else value.strip("<>").removeprefix("urn:record:")


# --- writing ---

def with_originals(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """(id, url, payload, digest, refers_to): refers_to is the smallest id with the same payload, null for itself."""
    payload = F.coalesce(col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(col(id_col).cast("long").alias("id"), col(url_col).cast("string").alias("url"), payload.alias("payload"),
                        F.sha1(payload).alias("digest"))
    firsts = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("n > 1").drop("n")
    same = F.col("id").eqNullSafe(F.col("first")) | F.col("first").isNull()
    return rows.join(firsts, "digest", "left").select("id", "url", "payload", F.when(~same, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   records_per_archive: int = 200_000) -> DataFrame:
    """Writes one or more archives per task and returns their (path, records)."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _open(folder)
        where.create_dir(base, recursive=True)
        archive, done = None, []
        for batch in batches:
            for rid, url, payload, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive is None:
                    archive = _Archive(where, f"{base}/{uuid.uuid4().hex}.zip")
                digest = b32encode(hashlib.sha1(payload).digest()).decode()
                archive.add(NO_ID if rid is None else str(rid), url or "", payload, digest, None if refers is None else str(refers))
                if archive.n >= records_per_archive:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{p.rpartition('/')[2]}" for p, _ in done], "records": [n for _, n in done]},
                                         pa.schema([("path", pa.string()), ("records", pa.int64())]))

    written = with_originals(pages, id_col, url_col, payload_col).mapInArrow(write, "path string, records long")
    return Scratch(pages.sparkSession, "archives").store(written, "written", result=True)


class _Archive:
    """A ZIP under way. The index stays in memory until the data member is complete."""

    def __init__(self, where: fs.FileSystem, path: str):
        self.path, self.n, self.at, self.lines = path, 0, 0, []
        self.stream = where.open_output_stream(path, compression=None)
        self.zip = zipfile.ZipFile(_Forward(self.stream), "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(DATA, "w", force_zip64=True)

    def add(self, rid: str, url: str, payload: bytes, digest: str, refers: str | None) -> None:
        raw = gzip.compress(record_bytes(rid, url, payload, digest, refers), GZIP_LEVEL, mtime=0)
        self.data.write(raw)
        self.lines.append(json.dumps({"id": rid, "offset": self.at, "length": len(raw), "digest": f"sha1:{digest}"}))
        self.at += len(raw)
        self.n += 1

    def close(self) -> tuple[str, int]:
        self.data.close()
        self.zip.writestr(INDEX, "\n".join(self.lines) + "\n")
        self.zip.close()
        self.stream.close()
        return self.path, self.n


class _Forward(io.RawIOBase):
    """A stream that can only go on, as object stores have it: the ZIP then carries sizes behind the data."""

    def __init__(self, stream):
        self.stream = stream

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.stream.write(data)
        return len(data)


# --- reading ---

def central_directory(file, size: int) -> list[dict]:
    """Members of a ZIP: name, method, place of the local header, stored and full size.

    ``file`` has read_at(length, offset). The end record is looked for in the last 64 KiB + 22 bytes, the longest
    that a comment allows; sizes and places that do not fit 32 bits come from the ZIP64 records.
    """
    tail_at = max(0, size - 65557)
    tail = file.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0 or len(tail) < end + 22:
        raise ValueError("no end record: not a ZIP, or cut")
    entries, length, start = struct.unpack("<HII", tail[end + 10:end + 20])
    if tail[end - 20:end - 16] == b"PK\x06\x07" and end >= 20:
        wide_at = struct.unpack("<Q", tail[end - 12:end - 4])[0]
        wide = file.read_at(56, wide_at)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("broken ZIP64 end record")
        entries, length, start = struct.unpack("<QQQ", wide[32:56])
    raw, at, out = file.read_at(length, start), 0, []
    for _ in range(entries):
        if raw[at:at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack("<HH", raw[at + 8:at + 12])
        stored, full, n, extra, comment = struct.unpack("<IIHHH", raw[at + 20:at + 34])
        header = struct.unpack("<I", raw[at + 42:at + 46])[0]
        name = raw[at + 46:at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        fields = raw[at + 46 + n:at + 46 + n + extra]
        while len(fields) >= 4:
            kind, width = struct.unpack("<HH", fields[:4])
            if kind == 1:  # ZIP64: only what the short fields leave out, in this order
                wide = iter(struct.unpack(f"<{width // 8}Q", fields[4:4 + width // 8 * 8]))
                full = next(wide) if full == 0xFFFFFFFF else full
                stored = next(wide) if stored == 0xFFFFFFFF else stored
                header = next(wide) if header == 0xFFFFFFFF else header
            fields = fields[4 + width:]
        out.append({"name": name, "method": method, "header": header, "stored": stored, "size": full})
        at += 46 + n + extra + comment
    return out


def member_start(file, member: dict) -> int:
    """Where a member's bytes begin: its local header has lengths of its own."""
    raw = file.read_at(30, member["header"])
    if raw[:4] != b"PK\x03\x04":
        raise ValueError("broken local header")
    return member["header"] + 30 + sum(struct.unpack("<HH", raw[26:30]))


def member_bytes(file, member: dict) -> bytes:
    raw = file.read_at(member["stored"], member_start(file, member))
    return zlib.decompress(raw, -15) if member["method"] == 8 else raw


def record_places(file, size: int) -> Iterator[tuple[int, int]]:
    """(offset in the file, length) of every record: from the indexes, or by walking members without one."""
    members = central_directory(file, size)
    data = [m for m in members if m["name"].startswith("archive/") and m["name"].endswith((".warc", ".warc.gz"))]
    if any(m["method"] for m in data):
        raise ValueError("archive members must be stored, not deflated")
    indexes = [m for m in members if m["name"].startswith("indexes/") and m["name"].endswith(".cdxj")]
    for m in data:
        start = member_start(file, m)
        if len(data) == 1 and indexes:
            for index in indexes:
                for line in member_bytes(file, index).splitlines():
                    if line.strip():
                        entry = json.loads(line[line.index(b"{"):])
                        yield start + int(entry["offset"]), int(entry["length"])
        elif m["name"].endswith(".gz"):
            yield from ((start + a, n) for a, n in _gzip_members(file, start, m["stored"]))
        else:
            yield from ((start + a, n) for a, n in _plain_records(file, start, m["stored"]))


def _gzip_members(file, start: int, size: int) -> Iterator[tuple[int, int]]:
    at, begin, engine = 0, 0, zlib.decompressobj(31)
    while at < size:
        chunk = file.read_at(min(RUN_BYTES, size - at), start + at)
        at += len(chunk)
        while chunk:
            engine.decompress(chunk)
            if not engine.eof:
                break
            chunk = engine.unused_data
            yield begin, at - len(chunk) - begin
            begin, engine = at - len(chunk), zlib.decompressobj(31)


def _plain_records(file, start: int, size: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at < size:
        head = file.read_at(min(1 << 16, size - at), start + at)
        end = head.find(b"\r\n\r\n")
        sizes = [x for x in head[:end].lower().split(b"\r\n") if x.startswith(b"content-length:")]
        if end < 0 or not sizes:
            raise ValueError("broken WARC record")
        length = end + 8 + int(sizes[0].partition(b":")[2])
        yield at, length
        at += length


def read_archives(paths: DataFrame, records_per_task: int = 5_000) -> DataFrame:
    """(path) -> a row per record: record_id, type, url, refers_to, digest (as written), payload_bytes, payload.

    A revisit's payload is empty; its payload_bytes is that of the payload it stands for.
    """
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("at", pa.int64()), ("n", pa.int64())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                where, name = _open(path)
                with where.open_input_file(name) as file:
                    found = list(record_places(_At(file), file.size()))
                for low in range(0, len(found), 10_000):
                    part = found[low:low + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array([a for a, _ in part], pa.int64()),
                                                      pa.array([n for _, n in part], pa.int64())], schema=schema)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            low = 0
            while low < len(rows):
                path, first, n = rows[low]
                high, end = low + 1, first + n
                while high < len(rows) and rows[high][:2] == (path, end) and end + rows[high][2] - first <= RUN_BYTES:
                    end += rows[high][2]
                    high += 1
                where, name = _open(path)
                with where.open_input_file(name) as file:
                    run = _At(file).read_at(end - first, first)
                out = []
                for _, at, n in rows[low:high]:
                    raw = run[at - first:at - first + n]
                    out.append(parse_record(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw))
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[k] for r in out], kind) for k, kind in (
                        ("id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("refers_to", pa.string()),
                        ("digest", pa.string()), ("size", pa.int64()), ("payload", pa.binary()))],
                    ["record_id", "type", "url", "refers_to", "digest", "payload_bytes", "payload"])
                low = high

    found = paths.select("path").repartition("path").mapInArrow(places, "path string, at long, n long")
    # records of an archive are dealt out by ranges of the file, so a large archive is many tasks
    found = Scratch(paths.sparkSession, "places").store(found, "places", result=True)
    dealt = found.repartitionByRange(max(1, -(-found.count() // records_per_task)), "path", "at")
    return dealt.mapInArrow(fetch, "record_id string, type string, url string, refers_to string, digest string, payload_bytes long, payload binary")


class _At:
    """read_at over pyarrow's random access files, with short reads as errors."""

    def __init__(self, file):
        self.file = file

    def read_at(self, length: int, offset: int) -> bytes:
        self.file.seek(offset)
        raw = self.file.read(length)
        if len(raw) != length:
            raise ValueError("cut file")
        return raw


def round_trip(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes the pages' archives into ``folder``, reads them back: id, payload_bytes, payload_digest, record_type, refers_to.

    A response's digest is computed from the bytes that were read and must equal the written one.
    """
    back = read_archives(write_archives(pages, folder, id_col, url_col, payload_col))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for kind, written, payload in zip(*(batch.column(c).to_pylist() for c in ("type", "digest", "payload")), strict=True):
                if kind == "response" and b32encode(hashlib.sha1(payload).digest()).decode() != written:
                    raise ValueError("payload and digest differ")
                digests.append(written)
            yield pa.RecordBatch.from_arrays([batch.column("record_id"), batch.column("payload_bytes"), pa.array(digests, pa.string()),
                                              batch.column("type"), batch.column("refers_to")], ["i", "payload_bytes", "payload_digest", "record_type", "r"])

    rows = back.mapInArrow(check, "i string, payload_bytes long, payload_digest string, record_type string, r string")
    return rows.select(F.when(F.col("i") != NO_ID, F.col("i")).cast("long").alias(id_col), "payload_bytes", "payload_digest", "record_type",
                       F.col("r").cast("long").alias("refers_to"))

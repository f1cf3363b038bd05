"""WARC records in ZIP-packaged archives: written by tasks, read back by byte ranges without extraction.

An archive is a ZIP file with two stored members: archive/data.warc.gz, one gzip member for each record, and
indexes/index.jsonl, a line with offset and length for each record. The reader finds the central directory from the
file's end (or the ZIP64 directory, where sizes ask for it), the members from that, the records from the index, and
reads runs of records by range. Files are opened through pyarrow, so that the shared folder may be any store it knows.
"""
from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import parts, written
from pricelens.session import ensure_checkpoint_dir

DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
#: Bytes of records after which a task begins another archive, and of a range that is read at once.
ROLL, RANGE = 64 << 20, 1 << 20
#: Payloads of fewer bytes are always written in full.
LEAST_REVISIT = 0
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 3


def opened(uri: str):
    """A random-access file; plain paths are local ones."""
    store, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return store.open_input_file(path)


def created(uri: str):
    store, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return store.open_output_stream(path)


def local_uri(folder: str) -> str:
    """file:/x as file:///x."""
    return "file:///" + folder.removeprefix("file:").lstrip("/") if folder.startswith("file:") else folder


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Target-URI", target),
            ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}")]
    if revisit:
        head += [("WARC-Refers-To", f"<urn:page:{'' if refers_to is None else refers_to}>"), ("WARC-Profile", PROFILE)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """Header fields by lower-case name; http: the block's own header fields; payload: what follows them."""
    def fields(lines):
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}

    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    out = fields(lines)
    block = rest[:int(out["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return out | {"http": fields(http.decode("latin-1").split("\r\n")[1:]), "payload": payload}


class Archive:
    """Writes one ZIP archive as a stream."""

    def __init__(self, uri: str):
        self.uri, self.out, self.index, self.size = uri, created(uri), [], 0
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)

    def add(self, raw: bytes) -> None:
        packed = gzip.compress(raw, LEVEL, mtime=0)
        self.data.write(packed)
        self.index.append((self.size, len(packed)))
        self.size += len(packed)

    def close(self) -> tuple[str, int]:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(json.dumps({"offset": a, "length": n}) + "\n" for a, n in self.index))
        self.zip.close()
        self.out.close()
        return self.uri, len(self.index)


def members(file) -> dict[str, tuple[int, int, int]]:
    """Name -> (offset of the data, stored length, compression method) from the central directory, ZIP64 included."""
    size = file.size()
    tail_at = max(0, size - (1 << 16) - 22)
    tail = file.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HII", tail[end + 10:end + 20])
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = tail[end - 20:end]
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        at, = struct.unpack("<Q", locator[8:16])
        count, length, start = struct.unpack("<QQQ", file.read_at(56, at)[32:56])
    directory, out, at = file.read_at(length, start), {}, 0
    for _ in range(count):
        if directory[at:at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, = struct.unpack("<H", directory[at + 10:at + 12])
        stored, plain, named, extra, note = struct.unpack("<IIHHH", directory[at + 20:at + 34])
        local, = struct.unpack("<I", directory[at + 42:at + 46])
        name = directory[at + 46:at + 46 + named].decode()
        more, at = directory[at + 46 + named:at + 46 + named + extra], at + 46 + named + extra + note
        while len(more) >= 4:
            kind, n = struct.unpack("<HH", more[:4])
            if kind == 1:
                wide = iter(struct.unpack(f"<{n // 8}Q", more[4:4 + n // 8 * 8]))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                stored = next(wide) if stored == 0xFFFFFFFF else stored
                local = next(wide) if local == 0xFFFFFFFF else local
            more = more[4 + n:]
        named, extra = struct.unpack("<HH", file.read_at(30, local)[26:30])
        out[name] = (local + 30 + named + extra, stored, method)
    return out


def _write(folder: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            for page_id, url, html, first, revisit in zip(*batch.columns):
                archive = archive or Archive(f"{folder}/{uuid.uuid4().hex}.wacz")
                archive.add(record(page_id.as_py(), url.as_py(), html.as_buffer().to_pybytes() if html.is_valid else b"", first.as_py(), revisit.as_py()))
                if archive.size >= roll:
                    done, archive = [*done, archive.close()], None
        done = [*done, archive.close()] if archive else done
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["archive", "records"])
    return run


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_REVISIT, roll: int = ROLL) -> DataFrame:
    """Writes `pages` (page_id, url, html) and returns archive, records; of an attempt that failed no archive is listed.

    Of records with equal payloads of `least` bytes or more the one with the largest page_id is written as response,
    the others as revisit; null payloads count as empty, null ids are below all others. Rows repeated with the largest
    id are responses each.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    first = rows.groupBy("digest").agg(F.max("page_id").alias("first"))
    typed = rows.join(first, "digest").select("page_id", "url", "html", "first", ((F.octet_length("html") >= least) & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"))
    return written(typed.mapInArrow(_write(folder, roll), "archive string, records long"))


def _runs(file) -> Iterator[tuple[int, int]]:
    """Ranges of whole records in the data members, of about RANGE bytes."""
    found = members(file)
    at, size, method = found[DATA]
    index_at, index_size, index_method = found[INDEX]
    if method or index_method:
        raise ValueError("members must be stored")
    start, stop = 0, 0
    for line in io.BytesIO(file.read_at(index_size, index_at)):
        entry = json.loads(line)
        if stop > start and entry["offset"] + entry["length"] - start > RANGE:
            yield at + start, stop - start
            start = entry["offset"]
        stop = entry["offset"] + entry["length"]
    if stop > size:
        raise ValueError("index beyond its data")
    if stop > start:
        yield at + start, stop - start


def _locate(batches):
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            with opened(uri) as file:
                found = list(_runs(file))
            yield pa.RecordBatch.from_arrays([pa.array([uri] * len(found), pa.string()), pa.array([a for a, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], names=["archive", "start", "length"])


def gunzipped(raw: bytes) -> Iterator[bytes]:
    """The gzip members of a range, one after another."""
    while raw:
        one = zlib.decompressobj(31)
        yield one.decompress(raw)
        if not one.eof:
            raise ValueError("cut gzip member")
        raw = one.unused_data


def _id(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def _read(batches):
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    for batch in batches:
        for uri, start, length in zip(*(c.to_pylist() for c in batch.columns)):
            with opened(uri) as file:
                raw = file.read_at(length, start)
            rows = []
            for one in map(parsed, gunzipped(raw)):
                kind, digest = one["warc-type"], one["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and sha1_base32(one["payload"]) != digest:
                    raise ValueError(f"payload of {one['warc-record-id']} in {uri} differs from its digest")
                rows.append((_id(one["warc-record-id"]), one["warc-target-uri"], kind, int(one["http"]["content-length"]), digest, _id(one.get("warc-refers-to")), one["payload"] if kind == "response" else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of the files named in column archive: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload (null for revisits)."""
    n = parts(archives.sparkSession)
    found = archives.select("archive").repartition(n, "archive").mapInArrow(_locate, "archive string, start long, length long")
    return found.repartition(n, "archive", "start").mapInArrow(_read, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """One row per row of `pages`, as read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = f"{local_uri(ensure_checkpoint_dir(pages.sparkSession)).rstrip('/')}/warc-{uuid.uuid4().hex}"
    store, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    store.create_dir(path, recursive=True)
    return read_archives(write_archives(pages, folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

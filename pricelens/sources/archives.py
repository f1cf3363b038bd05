"""Files and members of ZIP archives as byte ranges: listed, digested, probed and read by tasks, never extracted.

A source is a plain file or one member of an archive. The central directory at an archive's end (or the ZIP64 one that it
points to) tells where members lie, so members are read apart from their archive: a large one by a task of its own, small
ones some megabytes to a task, so that tasks grow with bytes. A task holds a few blocks of one source at a time.

Files are opened through ``pyarrow.fs``; paths without a scheme are local ones or those of a shared mount.
"""
from __future__ import annotations

import codecs
import hashlib
import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import csv, fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import SNAPSHOT_FILE
from ..session import materialize

BLOCK = 1 << 20
COLUMNS = [c.strip().split(" ")[0] for c in SNAPSHOT_FILE.split(",")]
#: Tried in this order for every file; UTF-8 may begin with a mark.
ENCODINGS = ("utf-8-sig", "gb18030")
OK, UNDECODABLE, BAD_ARCHIVE = "ok", "undecodable", "bad_archive"
#: Where a source's bytes are: a plain file has no member and no offset.
SOURCE = "path string, member string, header_at bigint, stored bigint, size bigint, method int, crc bigint, status string"
ROWS = ", ".join(f"{c} string" for c in COLUMNS) + ", source_file string, source_path string, source_status string, snapshot_seq bigint"


@dataclass(frozen=True)
class Source(InputPartition):
    path: str
    member: str | None = None
    header_at: int | None = None
    stored: int | None = None
    size: int | None = None
    method: int | None = None
    crc: int | None = None
    status: str = OK


@dataclass(frozen=True)
class Sources(InputPartition):
    items: tuple[Source, ...]


#: Bytes of sources that make a task, tasks that a small input is dealt over, and what opening one source weighs.
TASK_BYTES, LEAST_TASKS, OPENING = 32 << 20, 64, 64 << 10


def task_bytes(total: int) -> int:
    return max(1, min(TASK_BYTES, total // LEAST_TASKS))


def grouped(listed: list[Source]) -> list[Sources]:
    """The sources in their order, as many to a group as their bytes allow."""
    weight = lambda s: (s.size or 0) + OPENING
    limit, groups, held = task_bytes(sum(map(weight, listed))), [[]], 0
    for s in listed:
        if groups[-1] and held + weight(s) > limit:
            groups.append([])
            held = 0
        groups[-1].append(s)
        held += weight(s)
    return [Sources(tuple(g)) for g in groups if g]


def uri(path: str) -> str:
    """A path as Spark prints it (file:/x, /x, scheme://x) in the form that pyarrow takes."""
    if path.startswith("file:") and not path.startswith("file://"):
        return "file://" + path[5:]
    return path if "://" in path else f"file://{path}"


def opened(path: str):
    store, name = fs.FileSystem.from_uri(uri(path).replace(" ", "%20"))
    return store.open_input_file(name)


def members(path: str) -> list[Source]:
    """The members of an archive by its central directory."""
    file = opened(path)
    size = file.size()
    tail_at = max(0, size - 65_557)  # the end record and its longest comment
    tail = file.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise zipfile.BadZipFile(f"no central directory: {path}")
    length, start = struct.unpack_from("<II", tail, end + 12)
    count = struct.unpack_from("<H", tail, end + 10)[0]
    if 0xFFFFFFFF in (length, start) or count == 0xFFFF:
        if tail[end - 20:end - 16] != b"PK\x06\x07":
            raise zipfile.BadZipFile(f"no ZIP64 directory: {path}")
        record = file.read_at(56, struct.unpack_from("<Q", tail, end - 12)[0])
        length, start = struct.unpack_from("<QQ", record, 40)
    directory, at, found = file.read_at(length, start), 0, []
    while directory[at:at + 4] == b"PK\x01\x02":
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        crc, stored, full, name, extra, comment = struct.unpack_from("<IIIHHH", directory, at + 16)
        header_at = struct.unpack_from("<I", directory, at + 42)[0]
        label = directory[at + 46:at + 46 + name].decode("utf-8" if flags & 0x800 else "cp437")
        fields = directory[at + 46 + name:at + 46 + name + extra]
        while len(fields) >= 4:
            kind, n = struct.unpack_from("<HH", fields)
            if kind == 1:  # sizes beyond 32 bits, in this order, each only where it is needed
                wide = list(struct.unpack_from(f"<{n // 8}Q", fields, 4))
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                stored = wide.pop(0) if stored == 0xFFFFFFFF else stored
                header_at = wide.pop(0) if header_at == 0xFFFFFFFF else header_at
            fields = fields[4 + n:]
        if not label.endswith("/"):
            found.append(Source(path, label, header_at, stored, full, method, crc))
        at += 46 + name + extra + comment
    return found


def blocks(source: Source) -> Iterator[bytes]:
    """The bytes of a source, some at a time; a member is inflated as it is read and its checksum compared."""
    file = opened(source.path)
    if source.member is None:
        while block := file.read(BLOCK):
            yield block
        return
    name, extra = struct.unpack_from("<HH", file.read_at(30, source.header_at), 26)
    at, left, crc = source.header_at + 30 + name + extra, source.stored, 0
    if source.method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise zipfile.BadZipFile(f"compression {source.method} of {source.member}")
    inflate = zlib.decompressobj(-15) if source.method == zipfile.ZIP_DEFLATED else None
    while left:
        block = file.read_at(min(BLOCK, left), at)
        if not block:
            raise zipfile.BadZipFile(f"cut short: {source.path}")
        at, left = at + len(block), left - len(block)
        while block:
            out = inflate.decompress(block, 4 * BLOCK) if inflate else block
            block = inflate.unconsumed_tail if inflate else b""
            crc = zlib.crc32(out, crc)
            if out:
                yield out
    rest = inflate.flush() if inflate else b""
    if zlib.crc32(rest, crc) != source.crc:
        raise zipfile.BadZipFile(f"wrong checksum: {source.member} in {source.path}")
    if rest:
        yield rest


def encoding_of(source: Source) -> str | None:
    """The first of ENCODINGS that decodes every byte of a source."""
    for encoding in ENCODINGS:
        decoder = codecs.getincrementaldecoder(encoding)()
        try:
            for block in blocks(source):
                decoder.decode(block)
            decoder.decode(b"", final=True)
            return encoding
        except UnicodeDecodeError:
            continue
    return None


class _Recoded(io.RawIOBase):
    """A source as a stream of UTF-8 bytes without a mark."""

    def __init__(self, source: Source, encoding: str):
        self.blocks, self.decoder, self.held = blocks(source), codecs.getincrementaldecoder(encoding)(), b""

    def readable(self) -> bool:
        return True

    def read(self, size: int = -1) -> bytes:
        while self.blocks and (size < 0 or len(self.held) < size):
            block = next(self.blocks, None)
            if block is None:
                self.blocks = None
                self.held += self.decoder.decode(b"", final=True).encode()
            else:
                self.held += self.decoder.decode(block).encode()
        size = len(self.held) if size < 0 else size
        out, self.held = self.held[:size], self.held[size:]
        return out


def _table(columns: list[pa.Array], source: Source, status: str, seq: int | None) -> pa.RecordBatch:
    n = len(columns[0])
    same = lambda x: pa.array([x] * n, pa.string())
    at = pa.nulls(n, pa.int64()) if seq is None else pa.array(range(seq, seq + n), pa.int64())
    name = (source.member or source.path).rsplit("/", 1)[-1]
    return pa.RecordBatch.from_arrays([*columns, same(name), same(source.path), same(status), at], names=[*COLUMNS, "source_file", "source_path", "source_status", "snapshot_seq"])


def csv_rows(source: Source) -> Iterator[pa.RecordBatch]:
    """Rows of a snapshot CSV by column name, as text; a source that cannot be read gives one row with its status."""
    failed = lambda status: _table([pa.nulls(1, pa.string())] * len(COLUMNS), source, status, None)
    try:
        encoding = encoding_of(source) if source.status == OK else None
    except (zipfile.BadZipFile, zlib.error, OSError):
        yield failed(BAD_ARCHIVE)
        return
    if encoding is None:
        yield failed(UNDECODABLE if source.status == OK else source.status)
        return
    stream = _Recoded(source, encoding)
    first = stream.read(BLOCK)
    if not first.strip():
        return
    stream.held = first + stream.held
    seq = 0
    reader = csv.open_csv(stream, csv.ReadOptions(block_size=4 * BLOCK, use_threads=False), csv.ParseOptions(newlines_in_values=True), csv.ConvertOptions(
        include_columns=COLUMNS, include_missing_columns=True, column_types={c: pa.string() for c in COLUMNS}, strings_can_be_null=True, null_values=[""]))
    for batch in reader:
        for at in range(0, batch.num_rows, 20_000):
            part = batch.slice(at, 20_000)
            yield _table([c.cast(pa.string()) for c in part.columns], source, OK, seq)
            seq += part.num_rows


def _named(path: str) -> list[Source]:
    try:
        return [s for s in members(path) if s.member.lower().endswith(".csv")]
    except (zipfile.BadZipFile, UnicodeDecodeError, struct.error, OSError):
        return [Source(path, status=BAD_ARCHIVE)]


class _MemberReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.date = options["path"], options.get("trade_date")

    def partitions(self) -> list[Sources]:
        store, name = fs.FileSystem.from_uri(uri(self.path).replace(" ", "%20"))
        scheme = uri(self.path)[:-len(name)] if uri(self.path).endswith(name) else ""
        info = store.get_file_info(name)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(name))
        archives = sorted(scheme + f.path for f in found if f.is_file and f.path.lower().endswith(".zip"))
        with ThreadPoolExecutor(16) as pool:  # a few kilobytes of each archive
            listed = [s for some in pool.map(_named, archives) for s in some]
        return grouped(sorted((s for s in listed if not self.date or s.member is None or s.member.lower().endswith(f"_{self.date}.csv")), key=lambda s: (s.path, s.member or "")))

    def read(self, partition: Sources) -> Iterator[pa.RecordBatch]:
        for source in partition.items if isinstance(partition, Sources) else ():
            yield from csv_rows(source)


class ZipMembers(DataSource):
    """``spark.read.format("zip_members").load(path)``: partitions of the CSV members of the archive, or of those in a folder."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return _MemberReader(self.options)


def read_archives(spark: SparkSession, path: str, trade_date: str | None = None) -> DataFrame:
    """Text rows of all CSV members (of those named ``_{trade_date}.csv``), members dealt to tasks by their bytes."""
    spark.dataSource.register(ZipMembers)
    reader = spark.read.format("zip_members")
    return (reader.option("trade_date", trade_date) if trade_date else reader).load(path)


# ---- listings and digests, by tasks ------------------------------------------------------------------------

def listing(spark: SparkSession, root: str, pattern: str = "*.{csv,zip,CSV,ZIP}") -> DataFrame:
    """path and length of the files below a folder; no file is read, and empty ones are left out."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length")


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = _named(path) if path.lower().endswith(".zip") else [Source(path, size=length)]
            for at in range(0, len(found), 10_000):
                rows = [(s.path, s.member, s.header_at, s.stored, s.size, s.method, s.crc, s.status) for s in found[at:at + 10_000]]
                types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[c.split(" ")[0] for c in SOURCE.split(", ")])


def sources(spark: SparkSession, root: str) -> DataFrame:
    """Every CSV file below a folder and every CSV member of the archives below it; archives are opened by tasks."""
    return listing(spark, root).mapInArrow(_expanded, SOURCE)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[Source]:
    names = [c.split(" ")[0] for c in SOURCE.split(", ")]
    for batch in batches:
        for row in batch.to_pylist():
            yield Source(**{n: row[n] for n in names})


def spread(listed: DataFrame) -> DataFrame:
    """Sources dealt over tasks by their number and bytes: no more tasks than sources, and a few large ones do not share one."""
    n, total = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.coalesce("size", F.lit(0)) + OPENING), F.lit(0))).first()
    return listed.repartition(max(1, min(n, total // task_bytes(total), 20_000)))


def probe(listed: DataFrame) -> DataFrame:
    """The sources with ``encoding`` (null where none fits) and ``status``: ok, undecodable or bad_archive."""
    def run(batches):
        for s in _each(batches):
            try:
                encoding = encoding_of(s) if s.status == OK else None
                status = s.status if s.status != OK else OK if encoding else UNDECODABLE
            except (zipfile.BadZipFile, zlib.error, OSError):
                encoding, status = None, BAD_ARCHIVE
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (s.path, s.member, encoding, status)], names=["path", "member", "encoding", "status"])

    return spread(listed).mapInArrow(run, "path string, member string, encoding string, status string")


def read_sources(listed: DataFrame) -> DataFrame:
    """Text rows of the listed sources, each decoded as it asks for; one that cannot be read is one row with its status."""
    def run(batches):
        for s in _each(batches):
            yield from csv_rows(s)

    return spread(listed).mapInArrow(run, ROWS)


def file_digests(listed: DataFrame) -> DataFrame:
    """path, member, bytes and SHA-256 of every source, block by block."""
    def run(batches):
        for s in _each(batches):
            digest, n = hashlib.sha256(), 0
            for block in blocks(s):
                digest.update(block)
                n += len(block)
            yield pa.RecordBatch.from_arrays([pa.array([s.path]), pa.array([s.member], pa.string()), pa.array([n]), pa.array([digest.hexdigest()])], names=["path", "member", "bytes", "sha256"])

    return spread(listed).mapInArrow(run, "path string, member string, bytes bigint, sha256 string")


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row's columns as text, nulls apart from empty ones and lengths before values."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws("|", *parts), 256)


def result_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """n_rows and signature of a result as a multiset of rows: equal for every order and partitioning.

    The signature is the sums of four pieces of the rows' SHA-256, so that a row added twice does not cancel out.
    """
    digest = row_digest(sorted(columns))
    pieces = [F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)") for k in range(4)]
    sums = rows.agg(F.count(F.lit(1)).alias("n_rows"), *[F.coalesce(F.sum(p), F.lit(0)).cast("decimal(38,0)").cast("string").alias(f"s{k}") for k, p in enumerate(pieces)])
    return sums.select("n_rows", F.sha2(F.concat_ws("|", *[f"s{k}" for k in range(4)]), 256).alias("signature"))


# ---- writing --------------------------------------------------------------------------------------------------

def _written(root: str):
    def run(batches):
        store, base = fs.FileSystem.from_uri(uri(root).replace(" ", "%20"))
        path = out = archive = aside = None

        def finish():
            if archive:
                archive.close()
            out.close()
            store.move(aside, f"{base}/{path}")  # a task that is lost and repeated leaves whole files only

        for batch in batches:
            for at in range(batch.num_rows):  # one text at a time: a batch may hold thousands
                row = {name: column[at].as_py() for name, column in zip(batch.schema.names, batch.columns)}
                if row["path"] != path:
                    if path is not None:
                        finish()
                        yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])
                    path = row["path"]
                    folder, name = f"{base}/{path}".rsplit("/", 1)
                    store.create_dir(folder)
                    aside = f"{folder}/_{uuid.uuid4().hex}"
                    out = store.open_output_stream(aside)
                    archive = None if row["member"] is None else zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                content = (row["text"] or "").encode(row["encoding"] or "utf-8") + (row["tail"] or b"")
                if archive:
                    archive.writestr(zipfile.ZipInfo(row["member"]), content, zipfile.ZIP_DEFLATED)
                else:
                    out.write(content)
        if path is not None:
            finish()
            yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])
    return run


def write_files(contents: DataFrame, root: str) -> DataFrame:
    """Paths of the files written below ``root``: archives where rows name a member, plain files elsewhere; one task a file.

    ``contents``: path, member, text, encoding (null: UTF-8), tail (bytes put after the text). Members stand in name order.
    """
    rows = contents.select("path", "member", "text", "encoding", "tail").repartition("path").sortWithinPartitions("path", "member")
    return materialize(rows.mapInArrow(_written(root), "path string"))

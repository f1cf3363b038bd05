"""What the operators share: tables, the shared folder, label folds, and words and shingles as numpy arrays."""
from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.session import ensure_checkpoint_dir

#: Bytes of text that are turned into numpy arrays at once; bounds a task's memory.
SLICE_BYTES = 1 << 20
MASK = (1 << 64) - 1
STEP = 0x9E3779B97F4A7C15
BASE = 0xD6E8FEB86659FD93 | 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Frames made and run inside leave no shuffle files behind their jobs; else these wait for the driver's collector.

    For results that are written and read again, so that nothing reads the shuffles once more.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Jobs run inside pass at most so many rows at once to Python; texts of thousands of rows would stand whole in both processes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if rows and 0 < int(before) < rows:
        rows = None
    if rows:
        spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The rows written once as a table in the shared folder and read again: lineage ends, lost executors cost no recount.

    ``rows``: most rows that the job passes to Python at once.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    with shuffles_dropped(spark), arrow_rows(spark, rows):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    """Partitions of the session's shuffles; the session sizes them to its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(column: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo the number of folds; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}
BYTE_CODE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(STEP))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0..n-1, modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 2 * len(_POWERS.get("up", ())), 1 << 16)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            run = np.full(size, base, dtype=np.uint64)
            run[0] = 1
            _POWERS[name] = np.cumprod(run)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Rolling sums: (P[j] - P[i]) * inverse power i is the fingerprint of bytes i..j-1 wherever they stand."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODE[data] * powers(len(data))[0], out=out[1:])
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, end to end, and the offsets of each; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data[offsets[0]:offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `limit` bytes of text; a longer text stands alone."""
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all else as it is."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each run of bytes other than ASCII white space; none crosses documents."""
    return runs(~space(data), offsets)


def runs(solid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each unbroken run of marked bytes; none crosses documents."""
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(solid))]
    first[inner] |= solid[inner]
    last[inner - 1] |= solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def spans_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of byte spans."""
    return mixed((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts] + (ends - starts).astype(np.uint64) * np.uint64(STEP))


def shingle_sets(column: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, as ascending 64-bit fingerprints end to end, and the offsets of each text.

    Shingles are runs of `size` lower-cased words; a text with fewer words, but one at least, is one shingle.
    """
    data, offsets = text_bytes(column)
    docs = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
    data = lowered(data)
    starts, ends, doc = words(data, offsets)
    codes = spans_hash(prefix_hash(data), starts, ends)
    count = np.bincount(doc, minlength=docs)
    begin = np.concatenate(([0], np.cumsum(count)))
    grams, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(codes) >= size:
        grams = np.zeros(len(codes) - size + 1, np.uint64)
        for k in range(size):
            grams = grams * np.uint64(BASE) + codes[k:len(codes) - size + 1 + k]
        whole = doc[:len(grams)] == doc[size - 1:]
        grams, owner = mixed(grams[whole]), doc[:len(whole)][whole]
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):
        short = np.zeros(len(few), np.uint64)
        for k in range(size - 1):
            has = count[few] > k
            short[has] = short[has] * np.uint64(BASE) + codes[begin[few][has] + k]
        grams, owner = np.concatenate((grams, mixed(short + np.uint64(STEP)))), np.concatenate((owner, few))
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], np.concatenate(([0], np.cumsum(np.bincount(owner[new], minlength=docs))))

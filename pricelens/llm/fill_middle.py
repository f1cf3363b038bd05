"""Fill-in-the-middle texts by block rotation in place.

A text is scanned for its two cuts, which are counted in code points and found as bytes. Sentinels go into a bytearray in
reading order, `<P>`prefix`<M>`middle`<S>`suffix; then two neighbouring blocks change places by three reversals:

* psm swaps `<M>`middle with `<S>`suffix: `<P>`prefix`<S>`suffix`<M>`middle
* spm swaps `<P>`prefix`<M>`middle with `<S>`suffix: `<S>`suffix`<P>`prefix`<M>`middle

Restoring finds the sentinels in the output, rotates the blocks back and takes the sentinels out. Texts that hold a sentinel
stay plain, and no sentinel can arise across a seam, for each begins with `<` and ends with `>`, its only ones; so output and
form are enough to restore the exact text.

A task holds one slice of about a megabyte of text at a time, its output and one buffer; a longer text is a slice of its own
and needs about four times its bytes.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pricelens.llm.common import slices, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that are transformed, and of those the percent in the order suffix, prefix, middle.
RATE, SPM = 90, 20


def rotate(data: np.ndarray, start: int, middle: int, stop: int) -> None:
    """data[start:middle] and data[middle:stop] change places, by three reversals."""
    for a, b in ((start, middle), (middle, stop), (start, stop)):
        data[a:b] = data[a:b][::-1].copy()


def transformed(text: bytes, first: int, second: int, form: str) -> bytes:
    """The text with its cuts at bytes `first` and `second`, in the order that `form` names."""
    if form == "plain":
        return text
    marks = [PREFIX.encode(), MIDDLE.encode(), SUFFIX.encode()]
    buffer = bytearray(marks[0] + text)
    for mark, at in ((marks[1], first), (marks[2], second + len(marks[1]))):
        at += len(marks[0])
        buffer[at:at] = mark
    suffix = len(buffer) - (len(text) - second) - len(marks[2])
    rotate(np.frombuffer(buffer, np.uint8), 0 if form == "spm" else len(marks[0]) + first, suffix, len(buffer))
    return bytes(buffer)


def original(output: bytes, form: str) -> bytes:
    """The text that `transformed` was given."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    start, middle = (0, output.index(PREFIX.encode())) if form == "spm" else (output.index(SUFFIX.encode()), output.index(MIDDLE.encode()))
    rotate(np.frombuffer(buffer, np.uint8), start, middle, len(buffer))
    for mark in (SUFFIX, MIDDLE, PREFIX):
        at = buffer.index(mark.encode())
        del buffer[at:at + len(mark)]
    return bytes(buffer)


def _binary(column: pa.Array) -> list[bytes]:
    data, offsets = text_bytes(column)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(offsets, offsets[1:])]


def _outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, text, form, first, second (code points) -> row, form, output."""
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = text_bytes(part.column(1))
            begins = np.flatnonzero((data & 0xC0) != 0x80)  # first bytes of code points
            ends = np.append(begins, len(data))
            base = np.searchsorted(begins, offsets[:-1])
            cuts = [ends[base + np.asarray(part.column(k).fill_null(0))] - offsets[:-1] for k in (3, 4)]
            forms = part.column(2).to_pylist()
            out = [transformed(t, int(a), int(b), f).decode() for t, a, b, f in zip(_binary(part.column(1)), *cuts, forms)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(out, pa.string())], names=["row", "form", "output"])


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "output"):
            forms = part.column(part.schema.get_field_index("form")).to_pylist()
            out = [original(t, f).decode() for t, f in zip(_binary(part.column(part.schema.get_field_index("output"))), forms)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], names=[*part.schema.names, "restored"])


def _draw(key: Column, k: int) -> Column:
    """The k-th group of eight hex digits of the key's SHA-256 as an integer."""
    return F.conv(F.substring(F.sha2(key, 256), 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, keep: list[str], rate: int = RATE, spm: int = SPM) -> DataFrame:
    """row (struct of the columns `keep`), n, form, prefix_chars, middle_chars, output: one row per row of `docs`.

    Cuts and form depend on doc_id alone, so repeated rows and reruns agree; a null id counts as the empty text. Null texts
    count as empty; empty texts and those that hold a sentinel are plain. Texts are cut whole, whatever their length. An
    empty table gives no rows. Columns of `docs` outside `keep` are not read.
    """
    key = F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")
    rows = docs.select(F.struct(*keep).alias("row"), F.coalesce("text", F.lit("")).alias("text"), *[_draw(key, k).alias(f"h{k + 1}") for k in range(4)])
    n = F.length("text").cast("long")
    held = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when((n == 0) | held | (F.col("h3") % 100 >= rate), "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("row", "text", n.alias("n"), form.alias("form"), *[F.when(form != "plain", f(F.col("h1") % (n + 1), F.col("h2") % (n + 1))).alias(c) for f, c in ((F.least, "first"), (F.greatest, "second"))])
    inner = rows.select(F.struct("row", "n", "first", "second").alias("row"), "text", "form", "first", "second")
    out = inner.mapInArrow(_outputs, f"row {inner.schema['row'].dataType.simpleString()}, form string, output string")
    return out.select(F.col("row.row").alias("row"), F.col("row.n").alias("n"), "form", F.col("row.first").alias("prefix_chars"), (F.col("row.second") - F.col("row.first")).alias("middle_chars"), "output")


def restore(rows: DataFrame) -> DataFrame:
    """The rows (with form and output) and the exact text of each, `restored`, rebuilt from output and form alone."""
    return rows.mapInArrow(_restored, StructType([*rows.schema.fields, StructField("restored", StringType())]))


def round_trips(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    rows = restore(fill_in_middle(docs, ["doc_id"]))
    return rows.select(F.col("row.doc_id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))

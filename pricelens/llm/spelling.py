"""Spelling variants by neighbourhoods over a reduced alphabet.

Words are counted over all texts. Each letter is hashed to one of a few symbols, more of them for short words, whose reduced
forms are few. Every reduced word's one-edit neighbourhood is generated and joined with the reduced vocabulary: its own
reduced form, each letter left out and each letter replaced. An insertion is the other word's deletion and a replacement
works both ways, so a pair is generated from its longer word or from the one with the greater symbol: once, by one code.
Reduced words travel as 64-bit fingerprints; the original strings of each pair found are compared, which settles it.

A word's form is its near word of largest count, if that is at least twice its own; counts double along forms, so these
chains are short and end, and pointer doubling finds their roots.

Memory of a task: one slice of a text (a longer text is its own, and needs about twenty times its bytes), HELD distinct
words, and for each word a matrix row of its letters. Words beyond LONG letters are joined by a fingerprint in place of
their string, as their neighbourhoods have many rows.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import STEP, lowered, mixed, parts, powers, runs, slices, text_bytes, written

LEAST_LETTERS, LEAST_TIMES, RATIO = 5, 3, 2
#: A run is mistyped, by contract, where this number divides the checksum of its document's id and itself.
TYPO = 97
#: Symbols of words up to SHORT letters, and of longer ones.
SHORT, SHORT_SYMBOLS, SYMBOLS = 6, 16, 8
#: Distinct words, and bytes of them, that a counting task holds before it hands them on.
HELD, HELD_BYTES = 300_000, 16 << 20
#: Bytes up to which checksums run over all words at once; letters up to which a word's string goes along in the join.
WIDE, LONG = 64, 64
#: Letters turned into numbers at once.
BLOCK = 200_000

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
LEAD = 0xC3  # of all two-byte letters, U+00C0 to U+00FF
CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, (CRC >> 1) ^ np.uint32(0xEDB88320), CRC >> 1).astype(np.uint32)


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each span of bytes, carried on from the crc32 `before` it."""
    state = before ^ np.uint32(0xFFFFFFFF)
    size = ends - starts
    for j in range(min(int(size.max(initial=0)), WIDE)):
        on = np.flatnonzero((size > j) & (size <= WIDE))
        now = state[on]
        state[on] = CRC[(now ^ data[starts[on] + j]) & np.uint32(255)] ^ (now >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(size > WIDE):
        state[k] = zlib.crc32(data[starts[k]:ends[k]].tobytes(), int(before[k]))
    return state


def _combined(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]).combine_chunks()


def _counted(part: pa.RecordBatch) -> pa.Table:
    """Words of a slice of texts with their counts, after the mistyped letters are gone."""
    data, offsets = text_bytes(part.column(1))
    data, lead = lowered(data), data == LEAD
    solid = LETTER[data] | lead
    solid[1:] |= lead[:-1]
    starts, ends, doc = runs(solid, offsets)
    leads = np.concatenate(([0], np.cumsum(lead)))
    letters = ends - starts - (leads[ends] - leads[starts])
    enough = letters >= LEAST_LETTERS
    starts, ends, doc, letters = starts[enough], ends[enough], doc[enough], letters[enough]
    ids = part.column(0).to_pylist()
    before = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    check = checksums(data, starts, ends, before[doc])
    typo = check % np.uint32(TYPO) == 0
    mistyped = []
    for k in np.flatnonzero(typo & (letters > LEAST_LETTERS)):
        word = data[starts[k]:ends[k]].tobytes().decode()
        at = int(check[k]) % len(word)
        mistyped.append(word[:at] + word[at + 1:])
    starts, ends = starts[~typo], ends[~typo]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    cuts = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    plain = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    counts = pa.chunked_array([plain, pa.array(mistyped, pa.large_string())]).value_counts()
    return pa.table({"word": counts.field(0), "n": counts.field(1)})


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    for batch in batches:
        for part in slices(batch, "text"):
            held.append(_counted(part))
            if sum(t.num_rows for t in held) > 2 * HELD or sum(t.nbytes for t in held) > 2 * HELD_BYTES:
                held = [_combined(held)]
                if held[0].num_rows > HELD or held[0].nbytes > HELD_BYTES:
                    yield from _rows(held.pop())
    if held:
        yield from _rows(_combined(held))


def _rows(table: pa.Table) -> Iterator[pa.RecordBatch]:
    for at in range(0, table.num_rows, 50_000):
        some = table.slice(at, 50_000).combine_chunks()
        yield pa.RecordBatch.from_arrays([some["word"].chunk(0).cast(pa.string()), some["n"].chunk(0)], names=["word", "n"])


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: all words of LEAST_LETTERS letters that occur LEAST_TIMES times in the whole texts of `docs`."""
    counts = docs.select("doc_id", "text").mapInArrow(_words, "word string, n long")  # combined in the tasks already
    counts = counts.repartition(parts(docs.sparkSession), "word").groupBy("word").agg(F.sum("n").alias("n"))
    return written(counts.where(F.col("n") >= LEAST_TIMES).withColumn("letters", F.length("word")))


def _symbols(letters: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    count = SHORT_SYMBOLS if size <= SHORT else SYMBOLS
    return letters % np.uint64(count) + np.uint64(1), count


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the batch with words of one length, and their letters as a matrix."""
    words, sizes = batch.column(1).to_pylist(), np.asarray(batch.column(2))
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        step = max(1, BLOCK // int(size))
        for at in range(0, len(rows), step):
            some = rows[at:at + step]
            yield some, np.array([words[k] for k in some], f"<U{size}").view(np.uint32).reshape(len(some), size).astype(np.uint64)


def _code(total: np.ndarray, size: int) -> np.ndarray:
    return mixed(total + np.uint64(size * STEP & (1 << 64) - 1)).view(np.int64)


def _emit(batch, rows, code, same):
    return pa.RecordBatch.from_arrays([pa.array(code), batch.column(0).take(pa.array(rows)), batch.column(3).take(pa.array(rows)), pa.array(np.full(len(rows), same))],
                                      names=["code", "ref", "n", "same"])


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ref, word, letters, n -> code of each reduced word."""
    for batch in batches:
        for rows, letters in _blocks(batch):
            size = letters.shape[1]
            terms = _symbols(letters, size)[0] * powers(size)[0]
            yield _emit(batch, rows, _code(terms.sum(1, dtype=np.uint64), size), True)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ref, word, letters, n -> codes of each reduced word, of its deletions and of its replacements by lesser symbols."""
    for batch in batches:
        for rows, letters in _blocks(batch):
            size = letters.shape[1]
            up, down = powers(size + 1)
            symbols, count = _symbols(letters, size)
            whole = (symbols * up[:size]).sum(1, dtype=np.uint64)
            yield _emit(batch, rows, _code(whole, size), True)
            for s in range(1, count):
                at, k = np.nonzero(symbols > np.uint64(s))
                yield _emit(batch, rows[at], _code(whole[at] - (symbols[at, k] - np.uint64(s)) * up[k], size), False)
            if size > LEAST_LETTERS:
                shorter = _symbols(letters, size - 1)[0]
                sums = np.zeros((len(rows), size + 1), np.uint64)
                np.cumsum(shorter * up[:size], axis=1, out=sums[:, 1:])
                new = np.ones(letters.shape, bool)  # leaving out any letter of a run of one symbol gives one word
                new[:, 1:] = shorter[:, 1:] != shorter[:, :-1]
                at, k = np.nonzero(new)
                yield _emit(batch, rows[at], _code(sums[at, k] + (sums[at, size] - sums[at, k + 1]) * down[1], size - 1), False)


def _joined(asking: DataFrame, asked: DataFrame, ref: str) -> DataFrame:
    """a, a_n, b, b_n for every pair of which b's reduced form is in the neighbourhood of a's; a and b are the column `ref`."""
    schema = f"code long, ref {dict(asked.dtypes)[ref]}, n long, same boolean"
    rows = lambda df: df.select(F.col(ref).alias("ref"), "word", "letters", "n")
    a = rows(asking).mapInArrow(_neighbours, schema).select("code", F.col("ref").alias("a"), F.col("n").alias("a_n"), "same")
    b = rows(asked).mapInArrow(_own, schema).select("code", F.col("ref").alias("b"), F.col("n").alias("b_n"))
    return a.join(b.hint("shuffle_hash"), "code").where(~F.col("same") | (F.col("a") < F.col("b"))).select("a", "a_n", "b", "b_n")


def near_pairs(vocab: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: each pair of words that differ by exactly one letter inserted, deleted or replaced, once."""
    short = _joined(vocab.where(F.col("letters") <= LONG), vocab.where(F.col("letters") <= LONG), "word")
    keyed = vocab.where(F.col("letters") >= LONG).withColumn("key", F.xxhash64("word"))
    name = lambda c: keyed.select(F.col("key").alias(c), F.col("word").alias(f"{c}_word"))
    long = _joined(keyed.where(F.col("letters") > LONG), keyed, "key").join(name("a"), "a").join(name("b"), "b")
    long = long.select(F.col("a_word").alias("a"), "a_n", F.col("b_word").alias("b"), "b_n").distinct()
    return short.union(long).where(F.levenshtein("a", "b", 1) == 1)


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word of the chain from each word that has a form."""
    links = written(forms.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        links = moved.select("word", "root")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Only doc_id and text are read; null and empty texts have no words, a null id counts as the empty text in the checksum.
    Repeated rows are counted each. Of near words with equal counts the smallest by code points is the form. An empty table
    gives no rows.
    """
    vocab = vocabulary(docs)
    pairs = near_pairs(vocab)
    sides = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("m")),
                                           F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("m")))).alias("s")).select("s.*")
    near = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    fits = -F.col("best.m") >= RATIO * F.col("n")
    forms = written(vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n")))
    return forms.join(_roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

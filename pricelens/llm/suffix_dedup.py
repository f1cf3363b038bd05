"""Removal of repeated passages by suffix arrays.

1. A shard is about a megabyte of whole texts in a task. Its suffixes are sorted by Larsson-Sadakane refinement: first by
   eight bytes, then only the groups that are still together, by the ranks half-way on, until 256 bytes are compared.
   Neighbours' common prefixes follow by Kasai's rule (a suffix shares at least what its predecessor shares, less one
   byte), so only the heads of runs are compared. Both give the shard's own repeats of 200 bytes or more.
2. Every window of 200 bytes names an anchor, the k-gram with the least fingerprint in it: equal windows name equal
   anchors at equal places. Shards hand on their anchors, without those whose windows all repeat another of the shard.
3. Anchors are sorted by fingerprint across shards; those that stand in two places or more bring the bytes around them.
   In each merge the fingerprints of all windows of an anchor are sorted, and each is looked up by binary search: a
   range of two or more is a repeat. Anchors with more than HOT places are not gathered: their windows are counted as
   rows, by partial sums.
Texts are named by a 64-bit hash; equal texts of 200 bytes or more are repeats of each other as a whole.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import STEP, mixed, powers, prefix_hash, runs, slices, spans_hash, text_bytes, written

WINDOW, GRAM = 200, 64
#: Places of an anchor up to which one task compares them.
HOT = 2048
FIRST_SCHEMA = "key long, lo int, hi int, off int, fp long"


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as one big-endian number."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | padded[k:len(data) + k].astype(np.uint64)
    return out


def suffix_array(data: np.ndarray, depth: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by their first `depth` bytes, and for each place whether its suffix differs from the one before."""
    n = len(data)
    eight = eight_bytes(data)
    order = np.argsort(eight)
    ranked = eight[order]
    new = np.ones(n + 1, bool)
    new[1:n] = ranked[1:] != ranked[:-1]
    rank = np.zeros(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new[:n], np.arange(1, n + 1), 0))
    done = 8
    while done < depth:
        at = np.flatnonzero(~(new[:n] & new[1:]))
        if not len(at):
            break
        here = order[at]
        both = rank[here].astype(np.uint64) << np.uint64(32) | rank[np.minimum(here + done, n)].astype(np.uint64)
        sort = np.argsort(both)
        here, both = here[sort], both[sort]
        order[at] = here
        differs = np.ones(len(at), bool)
        differs[1:] = both[1:] != both[:-1]
        new[at] |= differs
        rank[here] = np.maximum.accumulate(np.where(new[at], at + 1, 0))
        done *= 2
    return order, new[:n]


def common_prefixes(rolling: np.ndarray, p: np.ndarray, q: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at p and q (p ascending) share before either's document ends.

    Kasai's rule: where p - 1 stands beside q - 1, the length is that of p - 1 less one. Other pairs are compared by
    fingerprints, halving the range in which they begin to differ.
    """
    head = np.ones(len(p), bool)
    head[1:] = (p[1:] != p[:-1] + 1) | (q[1:] != q[:-1] + 1)
    a, b = p[head], q[head]
    down = powers(len(rolling))[1]
    same, most = np.zeros(len(a), np.int64), np.minimum(ends[a] - a, ends[b] - b)
    while (same < most).any():
        half = (same + most + 1) // 2
        equal = (rolling[a + half] - rolling[a]) * down[a] == (rolling[b + half] - rolling[b]) * down[b]
        same, most = np.where(equal, half, same), np.where(equal, most, half - 1)
    run = np.cumsum(head) - 1
    return np.minimum(same[run] - (p - a[run]), np.minimum(ends[p] - p, ends[q] - q))


def shard_repeats(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of bytes in windows that repeat within the shard, and of windows that repeat an earlier one in its order."""
    n = len(data)
    later, edges = np.zeros(n, bool), np.zeros(n + 1, np.int64)
    if n < WINDOW:
        return edges[:n] > 0, later
    ends = np.repeat(offsets[1:], np.diff(offsets))
    order, new = suffix_array(data)
    eight = eight_bytes(data)
    order = order[ends[order] - order >= WINDOW]
    near = np.flatnonzero(eight[order[1:]] == eight[order[:-1]]) + 1
    for k in (8, 64, WINDOW - 8):
        near = near[eight[order[near] + k] == eight[order[near - 1] + k]]
    p, q = order[near], order[near - 1]
    sort = np.argsort(p)
    p, q = p[sort], q[sort]
    shared = common_prefixes(prefix_hash(data), p, q, ends)
    long = shared >= WINDOW
    p, q, shared = p[long], q[long], shared[long]
    later[p] = True
    for x in (p, q):
        edges += np.bincount(x, minlength=n + 1) - np.bincount(x + shared, minlength=n + 1)
    return np.cumsum(edges)[:n] > 0, later


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start, place and fingerprint of each anchor; no window crosses documents."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return none, none, none, none.astype(np.uint64)
    rolling = prefix_hash(data)
    grams = mixed((rolling[GRAM:] - rolling[:-GRAM]) * powers(n + 1)[1][:n - GRAM + 1])
    bits = max(1, int(n).bit_length())
    least = grams >> np.uint64(bits) << np.uint64(bits) | np.arange(len(grams), dtype=np.uint64)
    wide, span = 1, WINDOW - GRAM + 1
    while 2 * wide <= span:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if span > wide:
        least = np.minimum(least[:wide - span], least[span - wide:])
    starts = np.arange(len(least))
    ends = np.repeat(offsets[1:], np.diff(offsets))
    starts = starts[ends[starts] - starts >= WINDOW]
    place = (least[starts] & np.uint64((1 << bits) - 1)).astype(np.int64)
    first = np.ones(len(starts), bool)
    first[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(first)
    last = np.append(at[1:] - 1, len(starts) - 1) if len(at) else at
    return starts[at], starts[last], place[at], grams[place[at]]


def spans_of(mark: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each marked run, cut at the documents' bounds."""
    start, stop, _ = runs(mark, offsets)
    return start, stop


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = text_bytes(part.column(1))
            keys = part.column(0).to_numpy()
            covered, later = shard_repeats(data, offsets)
            lo, hi, place, fp = anchors(data, offsets)
            fresh = np.concatenate(([0], np.cumsum(~later)))
            keep = fresh[hi + 1] > fresh[lo]
            lo, hi, place, fp = lo[keep], hi[keep], place[keep], fp[keep]
            start, stop = spans_of(covered, offsets)
            doc = np.searchsorted(offsets, np.concatenate((lo, start)), side="right") - 1
            base = offsets[doc]
            none = np.zeros(len(start), np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(keys[doc]), pa.array(np.concatenate((lo, start)) - base, pa.int32()), pa.array(np.concatenate((hi, stop)) - base, pa.int32()),
                pa.array(np.concatenate((place - lo, none)), pa.int32()), pa.array(np.concatenate((fp.view(np.int64), none)), mask=np.arange(len(doc)) >= len(lo))], names=["key", "lo", "hi", "off", "fp"])


def _shared(hot: int):
    """From anchors sorted by fingerprint: those in two places or more, and whether there are more than `hot`."""
    def run(batches):
        held: list[pa.RecordBatch] = []
        flooded = None

        def out(rows, last):
            nonlocal flooded
            cols = [np.concatenate([b.column(k).to_numpy() for b in rows]) for k in range(5)]
            key, lo, hi, off, fp = cols
            new = np.ones(len(fp), bool)
            new[1:] = (fp[1:] != fp[:-1]) | (key[1:] != key[:-1]) | (lo[1:] != lo[:-1])
            key, lo, hi, off, fp = (c[new] for c in cols)
            _, begin, count = np.unique(fp, return_index=True, return_counts=True)
            group = np.repeat(np.arange(len(begin)), count[np.argsort(begin)])
            count = count[np.argsort(begin)][group]
            was = np.full(len(fp), False) if flooded is None else fp == flooded
            is_hot = (count > hot) | was
            ready = np.full(len(fp), True) if last else (fp != fp[-1]) | is_hot
            if not last:
                flooded = fp[-1] if is_hot[-1] else None
            left = pa.RecordBatch.from_arrays([pa.array(c[~ready]) for c in (key, lo, hi, off, fp)], names=["key", "lo", "hi", "off", "fp"])
            give = ready & ((count > 1) | was)
            return left, pa.RecordBatch.from_arrays([pa.array(c[give]) for c in (key, lo, hi, off, fp, is_hot)], names=["key", "lo", "hi", "off", "fp", "hot"])

        for batch in batches:
            if not batch.num_rows:
                continue
            left, give = out([*held, batch], False)
            held = [left] if left.num_rows else []
            yield give
        if held:
            yield out(held, True)[1]
    return run


def _contexts(batches):
    """Bytes around the shared anchors of each text; windows of hot anchors as fingerprints."""
    names = ["fp", "key", "lo", "off", "ctx", "window"]
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = text_bytes(part.column(1))
            lists = part.column(2)
            doc = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            x = lists.flatten()
            lo, hi, off, fp, hot = (x.field(k).to_numpy(zero_copy_only=False) for k in range(5))
            keys = part.column(0).to_numpy()[doc]
            begin = lo + offsets[doc]
            cold = np.flatnonzero(~hot)
            raw = data.tobytes()
            for some in (cold[i:i + 10_000] for i in range(0, len(cold), 10_000)):
                texts = [raw[a:b] for a, b in zip(begin[some], begin[some] + hi[some] - lo[some] + WINDOW)]
                yield pa.RecordBatch.from_arrays([pa.array(fp[some]), pa.array(keys[some]), pa.array(lo[some]), pa.array(off[some]), pa.array(texts, pa.binary()), pa.nulls(len(some), pa.int64())], names=names)
            some = np.flatnonzero(hot)
            if len(some):
                count = hi[some] - lo[some] + 1
                row = np.repeat(some, count)
                step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                at = begin[row] + step
                code = spans_hash(prefix_hash(data), at, at + WINDOW) + (off[row] - step).astype(np.uint64) * np.uint64(STEP)
                yield pa.RecordBatch.from_arrays([pa.array(fp[row]), pa.array(keys[row]), pa.array((lo[row] + step).astype(np.int32)), pa.array(off[row]), pa.nulls(len(row), pa.binary()), pa.array(code.view(np.int64))], names=names)


def _merged(batches):
    """Repeated spans among the contexts of equal anchors, which stand together; windows are looked up by binary search."""
    held = None

    def spans(t: pa.Table):
        fp, key, lo, off = (t.column(k).to_numpy() for k in range(4))
        data, offsets = text_bytes(t.column(4).combine_chunks())
        count = np.diff(offsets) - WINDOW + 1
        row = np.repeat(np.arange(len(count)), count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        at = offsets[row] + step
        code = mixed(spans_hash(prefix_hash(data), at, at + WINDOW) + (off[row] - step).astype(np.uint64) * np.uint64(STEP)) ^ mixed(fp[row].view(np.uint64))
        ranked = np.sort(code)
        twice = np.searchsorted(ranked, code, side="right") - np.searchsorted(ranked, code, side="left") > 1
        row, step = row[twice], step[twice]
        first, last = np.ones(len(row), bool), np.ones(len(row), bool)
        apart = (row[1:] != row[:-1]) | (step[1:] != step[:-1] + 1)
        first[1:], last[:-1] = apart, apart
        row, a, b = row[first], step[first], step[last]
        return pa.RecordBatch.from_arrays([pa.array(key[row]), pa.array((lo[row] + a).astype(np.int32)), pa.array((lo[row] + b + WINDOW).astype(np.int32))], names=["key", "start", "stop"])

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        fp = t.column(0).to_numpy()
        done = int(np.argmax(fp == fp[-1])) if len(fp) else 0
        held = t.slice(done)
        if done:
            yield spans(t.slice(0, done))
    if held is not None:
        yield spans(held)


def _cut(batches):
    """Of each text without its spans: what was removed, and the SHA-256 of what is kept; the kept text itself too."""
    for batch in batches:
        rows = []
        for key, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            raw = text.as_buffer().to_pybytes()
            x = spans.values
            start, stop = x.field(0).to_numpy(), x.field(1).to_numpy()
            order = np.argsort(start, kind="stable")
            start, reach = start[order], np.maximum.accumulate(stop[order])
            first = np.ones(len(start), bool)
            first[1:] = start[1:] > reach[:-1]
            a, b = start[first], reach[np.append(np.flatnonzero(first)[1:] - 1, len(start) - 1)]
            kept = b"".join(raw[i:j] for i, j in zip([0, *b], [*a, len(raw)]))
            rows.append((key, int((b - a).sum()), len(a), hashlib.sha256(kept).hexdigest(), [{"start": int(i), "stop": int(j)} for i, j in zip(a, b)]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=["key", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, stop in bytes of removed runs).

    A byte goes when a 200-byte string over it starts at another place too, in any document or the same one. Null
    texts count as empty; texts under 200 bytes stay whole; rows repeated whole repeat each other. Other columns than
    doc_id and text are not read.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    first = written(rows.where(F.octet_length("text") >= WINDOW).select("key", "text").mapInArrow(_first_pass, FIRST_SCHEMA))
    near = first.where("fp is not null").repartition("fp").sortWithinPartitions("fp", "key", "lo")
    shared = near.mapInArrow(_shared(hot), FIRST_SCHEMA + ", hot boolean")
    places = shared.groupBy("key").agg(F.collect_list(F.struct("lo", "hi", "off", "fp", "hot")).alias("places"))
    texts = rows.where(F.octet_length("text") >= WINDOW).groupBy("key").agg(F.first("text").alias("text"))
    around = written(texts.join(places, "key").mapInArrow(_contexts, "fp long, key long, lo int, off int, ctx binary, window long"))
    cold = around.where("ctx is not null").select("fp", "key", "lo", "off", "ctx").repartition("fp").sortWithinPartitions("fp")
    spans = cold.mapInArrow(_merged, "key long, start int, stop int")
    windows = around.where("window is not null").select("fp", "window", "key", "lo")
    place = F.struct("key", "lo")
    twice = windows.groupBy("fp", "window").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("fp", "window")
    spans = spans.union(windows.join(twice, ["fp", "window"]).select("key", F.col("lo").alias("start"), (F.col("lo") + WINDOW).alias("stop")))
    spans = spans.union(first.where("fp is null").select("key", F.col("lo").alias("start"), F.col("hi").alias("stop")))
    spans = spans.groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    cut = texts.join(spans, "key").mapInArrow(_cut, "key long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: int, stop: int>>")
    copies = rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    known = copies.join(cut, "key", "left")
    size = F.col("n_bytes")
    whole = (F.col("copies") > 1) & (size >= WINDOW)
    base = rows.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("own"))
    return base.join(known, "key").select(
        "doc_id", "n_bytes", F.when(whole, size).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"), F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "own")).alias("kept_sha256"),
        F.when(whole, F.array(F.struct(F.lit(0).alias("start"), size.cast("int").alias("stop")))).otherwise(F.coalesce("spans", F.array().cast("array<struct<start: int, stop: int>>"))).alias("spans"))

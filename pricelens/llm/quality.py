"""Document quality by kernel ridge regression with random Fourier features, calibrated by isotonic regression.

1. Each whole text is read once for about twenty statistics: lengths, kinds of characters, repetition of words, pairs and
   lines, how words and lines end. Only the text counts; ids choose the fold.
2. Standardized statistics x go through FEATURES random cosines, cos(Wx + b) with normal W: their dot products approximate a
   Gaussian kernel of width WIDTH * sqrt(dimensions).
3. Every task sums the outer products of its rows' features and labels, a part of the normal equations; parts of the matrix
   are summed in further tasks, by block, so the driver gets one matrix for each of two folds, whatever the number of tasks.
   Each fold's ridge solution is judged on the other, which chooses the penalty; the final one has both.
4. Scores that the other fold's solution gives to a row, counted in BINS bins with their labels, are made monotone by pooling
   adjacent violators; between pool centres scores are interpolated.

All labelled rows outside the held-out fold are learnt from. A task holds one slice of about a megabyte of text and the
arrays made of it, some forty bytes for each of its bytes; a longer text is a slice of its own.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import BASE, fold, lowered, mixed, parts, prefix_hash, runs, slices, space, spans_hash, text_bytes, words, written

FOLDS, HELD_OUT = 3, 1
CUT = 0.5
FEATURES, WIDTH, SEED = 256, 1.0, 7
PENALTIES = (1e-6, 1e-5, 1e-4, 1e-3, 1e-2)
#: Standardized statistics are held to this many deviations.
REACH = 6.0
#: Score bins of the calibration, over the range of LOW to LOW + SPAN.
BINS, LOW, SPAN = 2048, -1.0, 3.0
#: Blocks of rows that the normal equations are summed in.
BLOCKS = 16
STATISTICS = ("letters", "words", "lines", "word_length", "word_spread", "digits", "capitals", "stops", "commas", "symbols", "spaces", "foreign", "doubled", "distinct_words", "distinct_pairs",
              "distinct_lines", "short_words", "long_words", "wordless", "odd_endings", "even_endings", "line_stops", "capital_starts", "entropy")


@dataclass(frozen=True)
class Model:
    """Mean and spread of the statistics, weights of the cosines and a constant, and the calibration's points."""
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    raw: np.ndarray
    calibrated: np.ndarray


def _share(marks: np.ndarray, owner: np.ndarray, docs: int, of: np.ndarray) -> np.ndarray:
    return np.bincount(owner[marks], minlength=docs) / np.maximum(of, 1)


def _distinct(codes: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
    """Distinct codes of each document over all its codes; 1 without codes."""
    _, first = np.unique(mixed(codes + mixed(owner.astype(np.uint64) + np.uint64(1))), return_index=True)
    n = np.bincount(owner, minlength=docs)
    return np.where(n > 0, np.bincount(owner[first], minlength=docs) / np.maximum(n, 1), 1.0)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text; null and empty texts have no characters and all shares 0, all distinct shares 1."""
    data, offsets = text_bytes(column)
    docs = len(offsets) - 1
    out = np.zeros((docs, len(STATISTICS)))
    put = lambda name, values: out.__setitem__((slice(None), STATISTICS.index(name)), values)
    size = np.diff(offsets)

    def of_bytes(mark):
        total = np.concatenate(([0], np.cumsum(mark)))
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(size, 1)

    low = lowered(data)
    capital, small, digit, foreign, blank = low != data, (data >= 97) & (data <= 122), (data >= 48) & (data <= 57), data >= 128, space(data)
    letter = capital | small | foreign
    stop, comma = np.isin(data, (33, 46, 63)), np.isin(data, (44, 58, 59))
    put("letters", np.log1p(size * (1 - of_bytes(blank))))
    put("digits", of_bytes(digit))
    put("capitals", of_bytes(capital) / np.maximum(of_bytes(capital | small), 1e-9))
    for name, mark in (("stops", stop), ("commas", comma), ("symbols", ~(letter | digit | stop | comma | blank)), ("spaces", blank), ("foreign", foreign)):
        put(name, of_bytes(mark))
    put("doubled", of_bytes(np.concatenate((np.zeros(min(1, len(data)), bool), data[1:] == data[:-1]))))
    counts = np.bincount(np.repeat(np.arange(docs), size) * 256 + data, minlength=docs * 256).reshape(docs, 256) / np.maximum(size, 1)[:, None]
    put("entropy", -(counts * np.log2(np.where(counts > 0, counts, 1))).sum(1))

    starts, ends, owner = words(data, offsets)
    rolling = prefix_hash(low)
    codes, length, n = spans_hash(rolling, starts, ends), ends - starts, np.bincount(owner, minlength=docs)
    mean = np.bincount(owner, weights=length, minlength=docs) / np.maximum(n, 1)
    square = np.bincount(owner, weights=length.astype(float) ** 2, minlength=docs) / np.maximum(n, 1)
    put("words", np.log1p(n))
    put("word_length", np.log1p(mean))
    put("word_spread", np.log1p(np.sqrt(np.maximum(square - mean ** 2, 0))))
    put("distinct_words", _distinct(codes, owner, docs))
    pair = owner[1:] == owner[:-1]
    put("distinct_pairs", _distinct((codes[:-1] * np.uint64(BASE) + codes[1:])[pair], owner[1:][pair], docs))
    put("short_words", _share(length <= 3, owner, docs, n))
    put("long_words", _share(length >= 12, owner, docs, n))
    within = np.concatenate(([0], np.cumsum(letter)))
    put("wordless", _share(within[ends] == within[starts], owner, docs, n))
    last = ends - 1
    put("odd_endings", _share(~(letter | digit | stop | comma)[last], owner, docs, n))
    put("even_endings", _share((stop | comma)[last], owner, docs, n))
    put("capital_starts", _share(capital[starts], owner, docs, n))

    starts, ends, owner = runs(data != 10, offsets)
    n = np.bincount(owner, minlength=docs)
    put("lines", np.log1p(n))
    put("distinct_lines", _distinct(spans_hash(rolling, starts, ends), owner, docs))
    put("line_stops", _share(stop[ends - 1], owner, docs, n))
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            values = statistics(part.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * len(STATISTICS), pa.int32()), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["row", "statistics"])


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """row (struct of the columns `keep`) and statistics (array of doubles, named by STATISTICS) of every row of `docs`."""
    rows = docs.select(F.struct(*keep).alias("row"), "text")
    return rows.mapInArrow(_measured, f"row {rows.schema['row'].dataType.simpleString()}, statistics array<double>")


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """statistics, y, half (0 or 1) of the rows that have a quality label outside the held-out fold."""
    mine = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
    mine = mine.groupBy(F.col("doc_id").alias("id_")).agg((F.max("quality") > 0).cast("double").alias("y"))
    rows = stats.select(F.col("row.doc_id").alias("id_"), "statistics").join(mine, "id_")
    return rows.select("statistics", "y", (fold("id_", FOLDS) != 0).cast("int").alias("half"))


def _cosines(dims: int) -> tuple[np.ndarray, np.ndarray]:
    pick = np.random.default_rng(SEED)
    return pick.normal(0, 1 / (WIDTH * np.sqrt(dims)), (dims, FEATURES)), pick.uniform(0, 2 * np.pi, FEATURES)


def _features(values: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """sqrt(2 / FEATURES) * cos(Wx + b) of the standardized rows, and a constant."""
    x = np.clip((values - mean) / spread, -REACH, REACH)
    w, b = _cosines(x.shape[1])
    return np.hstack((np.sqrt(2 / FEATURES) * np.cos(x @ w + b), np.ones((len(x), 1))))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), len(STATISTICS))


def _products(mean: np.ndarray, spread: np.ndarray):
    """Each task's part of the normal equations: for both halves, the products of (features, 1, y), by block of rows."""
    def run(batches):
        total = np.zeros((2, FEATURES + 2, FEATURES + 2))
        for batch in batches:
            z = np.hstack((_features(_matrix(batch.column(0)), mean, spread), batch.column(1).to_numpy()[:, None]))
            half = batch.column(2).to_numpy()
            for k in (0, 1):
                total[k] += z[half == k].T @ z[half == k]
        blocks = [(k, i, block.tobytes()) for k in (0, 1) for i, block in enumerate(np.array_split(total[k], BLOCKS))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*blocks), (pa.int32(), pa.int32(), pa.binary()))], names=["half", "block", "sums"])
    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[tuple, np.ndarray] = {}
    for batch in batches:
        for half, block, sums in zip(*(c.to_pylist() for c in batch.columns)):
            totals[half, block] = totals.get((half, block), 0) + np.frombuffer(sums)
    for (half, block), sums in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([half], pa.int32()), pa.array([block], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["half", "block", "sums"])


def _other_half(mean, spread, weights):
    """Score bin and label of each row, by the weights of the half that it is not in."""
    def run(batches):
        for batch in batches:
            z = _features(_matrix(batch.column(0)), mean, spread)
            raw = np.where(batch.column(2).to_numpy() == 0, z @ weights[1], z @ weights[0])
            at = np.clip((raw - LOW) / SPAN * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], names=["bin", "y"])
    return run


def isotonic(good: np.ndarray, n: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and means of pools, never falling, of ordered bins with `good` of `n` rows at `at`."""
    pools: list[list[float]] = []
    for g, m, x in zip(good, n, at):
        pools.append([g, m, x * m])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    g, m, x = np.array(pools).T
    return x / m, g / m


def train(stats: DataFrame, labels: DataFrame) -> Model:
    """The model of all labelled rows of `stats` (row with doc_id, statistics) outside the held-out fold.

    Without labels of both kinds every score is their share of good rows, 0.5 without any.
    """
    rows = written(labelled(stats, labels))
    cells = [F.col("statistics")[i] for i in range(len(STATISTICS))]
    sums = rows.agg(F.count(F.lit(1)), F.sum("y"), *[f(c) for f in (F.avg, F.stddev_pop) for c in cells]).first()
    n, good, rest = sums[0], sums[1] or 0.0, np.array(sums[2:], float).reshape(2, -1)
    if good in (0.0, float(n)):
        return Model(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)), np.zeros(FEATURES + 1), np.zeros(1), np.array([good / n if n else 0.5]))
    mean, spread = rest[0], np.where(rest[1] > 1e-9, rest[1], 1.0)
    schema = "half int, block int, sums binary"
    blocks = rows.mapInArrow(_products(mean, spread), schema).repartition(min(2 * BLOCKS, parts(rows.sparkSession)), "half", "block").mapInArrow(_summed, schema).collect()
    width = FEATURES + 2
    gram = [np.frombuffer(b"".join(r.sums for r in sorted(blocks, key=lambda r: r.block) if r.half == k)).reshape(width, width) for k in (0, 1)]

    def solved(g, penalty):
        ridge = np.diag([penalty * max(g[-2, -2], 1)] * FEATURES + [1e-9])
        return np.linalg.solve(g[:-1, :-1] + ridge, g[:-1, -1])

    def missed(w, g):
        v = np.append(w, -1.0)
        return v @ g @ v

    penalty = min(PENALTIES, key=lambda p: missed(solved(gram[0], p), gram[1]) + missed(solved(gram[1], p), gram[0]))
    halves = [solved(g, penalty) for g in gram]
    bins = rows.mapInArrow(_other_half(mean, spread, halves), "bin int, y double").groupBy("bin").agg(F.sum("y").alias("good"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    raw, calibrated = isotonic(np.array([r.good for r in bins]), np.array([float(r.n) for r in bins]), np.array([LOW + (r.bin + 0.5) * SPAN / BINS for r in bins]))
    return Model(mean, spread, solved(gram[0] + gram[1], penalty), raw, calibrated)


def _scored(model: Model):
    def run(batches):
        for batch in batches:
            raw = _features(_matrix(batch.column(1)), model.mean, model.spread) @ model.weights
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(np.interp(raw, model.raw, model.calibrated), 6))], names=["row", "score"])
    return run


def score(stats: DataFrame, model: Model) -> DataFrame:
    """row and score (0 to 1) of every row of `stats`."""
    return stats.mapInArrow(_scored(model), f"row {stats.schema['row'].dataType.simpleString()}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted.

    Null and empty texts are scored by their statistics as any other; repeated rows are scored each; a null id is in the fold
    of the empty text and has no label. Of several labels of one id the best counts. An empty table gives no rows.
    """
    stats = written(measured(docs, ["doc_id"]))
    scored = score(stats, train(stats, labels)).select(F.col("row.doc_id").alias("doc_id"), "score")
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))

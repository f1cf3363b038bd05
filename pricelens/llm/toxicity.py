"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence is toxic with probability p = sigmoid(b + sum of its words' weights), and a
document with 1 - product of (1 - p) over its sentences (noisy-or). Weights are trained on document labels alone, by
gradients that tasks sum and the driver adds up; the sentences' own probabilities then point at the offending ones.
Words are runs of ASCII letters, digits and non-ASCII bytes, lower-cased; the first bytes of a longer word are one more
feature, which carries over to words that training has not seen. Sentences end at . ! ? or a line break.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import fold, lowered, prefix_hash, runs, slices, spans_hash, text_bytes, written

FOLDS, HELD_OUT = 3, 1
CUT = 0.7
#: The classifier is fitted on so many labelled documents of each class at most, the first in an order by hash.
SAMPLE = 10_000
#: Words that tell most about the labels, and the least G^2 of a word that counts.
FEATURES, LEAST_G2 = 4096, 30.0
ROUNDS, RATE, SHRINK = 60, 0.2, 1e-5
#: Bytes of text that are cut into words at once; the arrays over single bytes are many times as large.
PIECE = 1 << 18
#: Bytes of a stem, and of the shortest word that has one.
STEM, LONG = 4, 6


@dataclass(frozen=True)
class Model:
    """codes: ascending word fingerprints; weights: theirs; bias: of every sentence."""
    codes: np.ndarray
    weights: np.ndarray
    bias: float


def _words(column: pa.Array):
    """Fingerprint, document and sentence of every word and stem, byte spans of the sentences, and their document."""
    data, offsets = text_bytes(column)
    low = lowered(data)
    solid = (data >= 128) | ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57))
    starts, ends, doc = runs(solid, offsets)
    rolling = prefix_hash(low)
    codes = spans_hash(rolling, starts, ends)
    stops = np.cumsum((data == 46) | (data == 33) | (data == 63) | (data == 10))
    mark = stops[starts] if len(starts) else np.zeros(0, np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (mark[1:] != mark[:-1]) | (doc[1:] != doc[:-1])
    sentence = np.cumsum(new) - 1
    last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)[:new.sum()]
    long = ends - starts >= LONG
    codes = np.concatenate((codes, ~spans_hash(rolling, starts[long], starts[long] + STEM)))
    spans = starts[new], ends[last], doc[new], offsets
    return codes, np.concatenate((doc, doc[long])), np.concatenate((sentence, sentence[long])), *spans


def _hits(codes, doc, sentence, known):
    """Sentence and feature of every word that is a feature, once for each sentence."""
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    mine = known[at] == codes
    pairs = np.unique(sentence[mine] * len(known) + at[mine])
    return pairs // len(known), pairs % len(known)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text, toxic of the labelled documents outside the held-out fold, at most `sample` of each class."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    some = [marked.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(sample) for k in (0, 1)]
    some = some[0].union(some[1]).withColumnRenamed("doc_id", "label_id_")
    return docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("label_id_")).select("text", "toxic")


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", PIECE):
            codes, doc, *_ = _words(part.column(0))
            toxic = np.asarray(part.column(1).to_numpy(zero_copy_only=False)) == 1
            order = np.lexsort((doc, codes))
            codes, doc = codes[order], doc[order]
            new = np.ones(len(codes), bool)
            new[1:] = (codes[1:] != codes[:-1]) | (doc[1:] != doc[:-1])
            word, where = np.unique(codes[new], return_inverse=True)
            bad = np.bincount(where, weights=toxic[doc[new]], minlength=len(word)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(bad), pa.array(np.bincount(where, minlength=len(word)) - bad)], names=["code", "bad", "good"])


def _bags(known: np.ndarray):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                codes, doc, sentence, _, _, owner, offsets = _words(part.column(0))
                docs = len(offsets) - 1
                at, feature = _hits(codes, doc, sentence, known)
                cuts = np.searchsorted(owner[at] if len(at) else at, np.arange(docs + 1))
                lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, pa.int64())) for x in (at, feature)]
                yield pa.RecordBatch.from_arrays([part.column(1).cast(pa.int32()), pa.array(np.bincount(owner, minlength=docs), pa.int32()), *lists], names=["toxic", "sentences", "at", "feature"])
    return run


def _gradient(weights: np.ndarray, bias: float):
    """Sum of the log-likelihood's gradient over a task's documents; the last entry is the bias's."""
    def run(batches):
        total, loss, n = np.zeros(len(weights) + 1), 0.0, 0
        for batch in batches:
            y = batch.column(0).to_numpy().astype(float)
            count = batch.column(1).to_numpy()
            lists = batch.column(2)
            doc = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
            at, feature = lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
            sentence = np.cumsum(new) - 1
            owner = doc[new]
            p = _sigmoid(bias + np.bincount(sentence, weights=weights[feature], minlength=new.sum()))
            empty = count - np.bincount(owner, minlength=len(y))
            none = np.bincount(owner, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y)) + empty * np.log1p(-_sigmoid(bias))
            clean = np.exp(none)
            share = np.where(y == 1, clean / np.maximum(1 - clean, 1e-12), -1.0)
            step = share[owner] * p
            total[:-1] += np.bincount(feature, weights=step[sentence], minlength=len(weights))
            total[-1] += step.sum() + (share * empty * _sigmoid(bias)).sum()
            loss -= np.where(y == 1, np.log(np.maximum(1 - clean, 1e-12)), none).sum()
            n += len(y)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()]), pa.array([float(loss)]), pa.array([n])], names=["gradient", "loss", "n"])
    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, rounds: int = ROUNDS) -> Model:
    """The model of the labelled documents outside the held-out fold. Without labels of both kinds it calls nothing toxic.

    Only texts and labels are read; ids choose the fold and the sample. The words are chosen over the sample by the
    G^2 of word against label, and start at their log odds; noisy-or training refines them.
    """
    rows = written(training_rows(docs, labels, sample))
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    good, bad = sizes.get(0, 0), sizes.get(1, 0)
    if not good or not bad:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -30.0)
    counts = rows.mapInArrow(_document_counts, "code long, bad long, good long").groupBy("code").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))

    def term(n, of, base):
        return F.when(n > 0, n * F.log(n * F.lit(good + bad) / (of * base))).otherwise(F.lit(0.0))

    seen = F.col("bad") + F.col("good")
    g2 = 2 * (term(F.col("bad"), seen, F.lit(bad)) + term(F.col("good"), seen, F.lit(good)) + term(bad - F.col("bad"), good + bad - seen, F.lit(bad)) + term(good - F.col("good"), good + bad - seen, F.lit(good)))
    odds = F.log((F.col("bad") + 0.5) / (F.lit(bad) + 1.0)) - F.log((F.col("good") + 0.5) / (F.lit(good) + 1.0))
    chosen = counts.where("bad + good >= 3").select("code", odds.alias("odds"), g2.alias("g2")).where(F.col("g2") >= LEAST_G2).orderBy(F.desc("g2"), "code").limit(features).collect()
    chosen = sorted((np.uint64(r.code & ((1 << 64) - 1)), r.odds) for r in chosen)
    codes, weights = np.array([c for c, _ in chosen], np.uint64), np.array([o for _, o in chosen], float)
    bags = written(rows.mapInArrow(_bags(codes), "toxic int, sentences int, at array<long>, feature array<long>"))
    x = np.append(weights, -8.0)
    speed, size = np.zeros(len(x)), np.zeros(len(x))
    for k in range(1, rounds + 1):
        sums = bags.mapInArrow(_gradient(x[:-1], float(x[-1])), "gradient binary, loss double, n long").collect()
        g = sum((np.frombuffer(r.gradient) for r in sums), np.zeros(len(x))) / (good + bad) - SHRINK * np.append(x[:-1], 0)
        speed, size = 0.9 * speed + 0.1 * g, 0.9 * size + 0.1 * g * g
        x = x + RATE * (speed / (1 - 0.9 ** k)) / (np.sqrt(size / (1 - 0.9 ** k)) + 1e-8)
    return Model(codes, x[:-1], float(x[-1]))


def _scored(model: Model):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                codes, doc, sentence, starts, ends, owner, offsets = _words(part.column(1))
                at, feature = _hits(codes, doc, sentence, model.codes)
                p = _sigmoid(model.bias + np.bincount(at, weights=model.weights[feature], minlength=len(owner)))
                docs = len(offsets) - 1
                score = -np.expm1(np.bincount(owner, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=docs))
                bad = np.flatnonzero(p >= 0.5)
                cuts = pa.array(np.searchsorted(owner[bad], np.arange(docs + 1)), pa.int32())
                spans = pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays([pa.array(starts[bad] - offsets[owner[bad]], pa.int64()), pa.array(ends[bad] - offsets[owner[bad]], pa.int64()), pa.array(np.round(p[bad], 6))], names=["start", "end", "p"]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.round(score, 6)), spans], names=["row", "score", "spans"])
    return run


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """row (struct of the columns `keep`), score, spans: start, end (bytes of the UTF-8 text) and p of sentences with p >= 0.5.

    Whole texts are read; null and empty texts have no sentence and score 0. Repeated rows are scored each.
    """
    rows = docs.select(F.struct(*keep).alias("row"), "text")
    return rows.mapInArrow(_scored(model), f"row {rows.schema['row'].dataType.simpleString()}, score double, spans array<struct<start: bigint, end: bigint, p: double>>")


def offending_sentences(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each sentence with p >= 0.5: doc_id, start, end, p, sentence."""
    found = score(docs, model, ["doc_id", "text"]).select("row.doc_id", "row.text", F.explode("spans").alias("s"))
    raw = F.col("text").cast("binary")
    return found.select("doc_id", "s.start", "s.end", "s.p", F.substring(raw, F.col("s.start").cast("int") + 1, (F.col("s.end") - F.col("s.start")).cast("int")).cast("string").alias("sentence"))


def toxic_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted, offending (sentences with p >= 0.5)."""
    scored = score(docs, train(docs, labels), ["doc_id"])
    return scored.select(F.col("row.doc_id").alias("doc_id"), "score", F.size("spans").cast("long").alias("offending")).select(
        "doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "offending")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without the rows whose score reaches the cut, all columns as they were."""
    scored = score(docs, train(docs, labels), docs.columns)
    return scored.where(F.col("score") < CUT).select(*[F.col("row")[c].alias(c) for c in docs.columns])

"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

Counts. Words are named by 64-bit fingerprints. The KNOWN most frequent words of the training documents and the end of
a text are the model's own symbols; all other words are one symbol, RARE, and among themselves follow their add-one
unigram. Postings of rare words (word, document, times) are packed by shards and dealt by word, so that every count is
over all documents and each document gets back its sums.

Model. Symbols fall into classes by frequency. P(symbol | history) = P(class | history) P(symbol | class, history), both
softmaxes over sums of hashed feature rows: the word before (bigram), the classes of the two before (n-gram), and the
word before that (skip). A rare word in a history is named by its last bytes.

Training. Biases start at the unigram. Each round gives every task the current weights and the documents of that round (all training
documents are in one round); it makes gradient updates over its batches, and the updates of all tasks, weighted by tokens, are averaged block
by block in Spark. Weights have a fixed size, whatever the corpus.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import STEP, fold, lowered, mixed, parts, prefix_hash, slices, spans_hash, text_bytes, words, written

FOLDS, HELD_OUT = 7, 2
KNOWN, CLASSES, ROWS = 2046, 64, 1 << 12
ROUNDS, RATE, BATCH = 2, 0.3, 1024
#: Times that a word must stand in a shard to be counted for the choice of the known words.
SHARD_TIMES = 3
#: Rows with another gradient in a batch from which on the rest are summed by runs.
FEW = 32
BLOCK = 1 << 14
START = np.uint64(0x5851F42D4C957F2D)
PASS_SCHEMA = "symbol int, times long, bucket int, payload binary"


def planes(x: np.ndarray, width: int) -> bytes:
    """Numbers by byte planes, lowest first; compresses well where high bytes are mostly 0."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def from_planes(blob: bytes, n: int, width: int, at: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n).T
    return out.view("<u8").ravel()


@dataclass(frozen=True)
class Vocabulary:
    """Fingerprints of the known words, ascending, and of all symbols their counts, class, place in the class, and the classes' sizes.

    Symbols are the known words in that order, then RARE, then the end."""
    codes: np.ndarray
    counts: np.ndarray
    group: np.ndarray
    place: np.ndarray
    sizes: np.ndarray

    @property
    def rare(self) -> int:
        return len(self.codes)

    @property
    def end(self) -> int:
        return len(self.codes) + 1


def tokens(column: pa.Array, known: np.ndarray):
    """Fingerprints, symbols, history names and documents of all words and of each text's end, and the offsets of the texts in them."""
    data, offsets = text_bytes(column)
    data = lowered(data)
    starts, ends, doc = words(data, offsets)
    rolling = prefix_hash(data)
    codes = spans_hash(rolling, starts, ends)
    docs = len(offsets) - 1
    at = np.searchsorted(known, codes)
    symbol = np.where(known[np.minimum(at, len(known) - 1)] == codes, at, len(known)) if len(known) else np.zeros(len(codes), np.int64)
    tails = spans_hash(rolling, np.maximum(starts, ends - 3), ends) ^ np.uint64(STEP)
    names = np.where(symbol < len(known), codes, tails)
    bounds = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=docs)))) + np.arange(docs + 1)
    slot = np.arange(len(codes)) + doc
    n = len(codes) + docs
    out = np.zeros(n, np.uint64), np.full(n, len(known) + 1), np.full(n, START), np.repeat(np.arange(docs), np.diff(bounds))
    for x, v in zip(out, (codes, symbol, names)):
        x[slot] = v
    return *out, bounds


def features(names: np.ndarray, group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows of the three features of each token; histories end at the text's beginning."""
    n = len(names)
    one, two = np.full(n, START), np.full(n, START)
    g1, g2 = np.full(n, CLASSES), np.full(n, CLASSES)
    same1, same2 = np.flatnonzero(doc[1:] == doc[:-1]) + 1, np.flatnonzero(doc[2:] == doc[:-2]) + 2
    one[same1], two[same2] = names[same1 - 1], names[same2 - 2]
    g1[same1], g2[same2] = group[same1 - 1], group[same2 - 2]
    rows = np.uint64(ROWS)
    return np.stack([(mixed(one + np.uint64(1)) % rows).astype(np.int64), (mixed((g1 * 1009 + g2).astype(np.uint64) + START) % rows).astype(np.int64), (mixed(two + np.uint64(2)) % rows).astype(np.int64)])


def shapes(sizes: np.ndarray) -> dict[str, tuple]:
    """Weight tables: of classes by feature row, of places by feature row, and the biases of classes and of symbols."""
    return {"class": (3 * ROWS, len(sizes)), "word": (3 * ROWS, int(sizes.max())), "class_bias": (len(sizes),), "word_bias": (len(sizes), int(sizes.max()))}


def unpack(flat: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes(sizes).items():
        n = int(np.prod(shape))
        out[name] = flat[at:at + n].reshape(shape)
        at += n
    return out


def vocabulary(codes: np.ndarray, counts: np.ndarray, rare: int, texts: int) -> Vocabulary:
    """Classes: RARE and the end alone, the words by frequency in equal shares."""
    counts = np.append(counts, [rare, texts]).astype(np.int64)
    order = np.argsort(-counts[:len(codes)], kind="stable")
    rank = np.empty(len(codes), np.int64)
    rank[order] = np.arange(len(codes))
    per = max(1, -(-len(codes) // (CLASSES - 2)))
    group = np.append(rank // per, [0, 0])
    group[-2:] = group[:-2].max(initial=-1) + np.array([1, 2])
    return Vocabulary(codes, counts, group, np.append(rank % per, [0, 0]), np.bincount(group))


def first_weights(vocab: Vocabulary) -> np.ndarray:
    """All features 0, biases the add-one unigram; places that a class does not have stay far below."""
    flat = np.zeros(sum(int(np.prod(s)) for s in shapes(vocab.sizes).values()), np.float32)
    tables = unpack(flat, vocab.sizes)
    tables["word_bias"][:] = -60
    tables["word_bias"][vocab.group, vocab.place] = np.log(vocab.counts + 1)
    tables["class_bias"][:] = np.log(np.bincount(vocab.group, weights=vocab.counts + 1))
    return flat


def _exp(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of z, which is overwritten, the exponentials over that of its largest, and their sum."""
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    return z, z.sum(axis=1, keepdims=True)


def _layers(tables, rows, group):
    """Class probabilities, and place probabilities within the given classes; each as weights and their sum."""
    z = tables["class"].take(rows[0], axis=0)
    z += tables["class"].take(rows[1] + ROWS, axis=0)
    z += tables["class"].take(rows[2] + 2 * ROWS, axis=0)
    z += tables["class_bias"]
    many = np.flatnonzero(tables["word_bias"][group, 1] > -50) if tables["word_bias"].shape[1] > 1 else np.zeros(0, np.int64)
    y = tables["word_bias"].take(group[many], axis=0)
    for k in range(3):
        y += tables["word"].take(rows[k, many] + k * ROWS, axis=0)
    return _exp(z), many, _exp(y)


def _row_sums(index: np.ndarray, gradient: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in `index`, and of each the sum of its gradients; entry i has gradient i modulo their number.

    The rows stand by how often they occur, so that those with another entry are always the first ones: they are added
    place by place while they are many, the entries that the few frequent ones have left by runs.
    """
    order = np.argsort(index.astype(np.uint16) if 3 * ROWS <= 1 << 16 else index, kind="stable")
    first = np.flatnonzero(np.diff(index[order], prepend=-1))
    times = np.diff(first, append=len(index))
    by = np.argsort(-times, kind="stable")
    first, times = first[by], times[by]
    entry = order % len(gradient)
    total = gradient.take(entry[first], axis=0)
    place, more = 1, int(np.count_nonzero(times > 1))
    while more > FEW:
        total[:more] += gradient.take(entry[first[:more] + place], axis=0)
        place += 1
        more = int(np.count_nonzero(times > place))
    if more:
        left = times[:more] - place
        begin = np.cumsum(left) - left
        at = np.repeat(first[:more] + place - begin, left) + np.arange(left.sum())
        total[:more] += np.add.reduceat(gradient.take(entry[at], axis=0), begin, axis=0)
    return index[order[first]], total


def _step(table, seen, index, gradient):
    """AdaGrad over the touched rows, one rate for each row: sums of the gradients of equal rows."""
    touched, total = _row_sums(index, gradient)
    much = seen[touched] + np.einsum("ij,ij->i", total, total) / np.float32(total.shape[1])
    seen[touched] = much
    total *= (np.float32(RATE) / np.sqrt(much + np.float32(1)))[:, None]
    table[touched] -= total


def _updates(vocab: Vocabulary, weights):
    """Gradient updates over a task's documents; gives the change of all weights, times its tokens, in blocks."""
    def run(batches):
        before = weights.value
        flat = before.copy()
        tables, total = unpack(flat, vocab.sizes), 0
        seen = {k: np.zeros(len(tables[k]), np.float32) for k in ("class", "word")}
        for batch in batches:
            for part in slices(batch, "text"):
                _, symbol, names, doc, _ = tokens(part.column(0), vocab.codes)
                group = vocab.group[symbol]
                rows = features(names, group, doc)
                total += len(symbol)
                for a in range(0, len(symbol), BATCH):
                    some, mine, r = symbol[a:a + BATCH], group[a:a + BATCH], rows[:, a:a + BATCH]
                    (p, p_sum), many, (q, q_sum) = _layers(tables, r, mine)
                    p /= p_sum
                    q /= q_sum
                    p[np.arange(len(some)), mine] -= 1
                    q[np.arange(len(many)), vocab.place[some[many]]] -= 1
                    # The features have rows of their own, so one step takes all three.
                    r = r + np.arange(3)[:, None] * ROWS
                    _step(tables["class"], seen["class"], r.ravel(), p)
                    if len(many):
                        _step(tables["word"], seen["word"], r[:, many].ravel(), q)
        change = (flat - before) * np.float32(total)
        blocks = [change[a:a + BLOCK] for a in range(0, len(change), BLOCK)] if total else []
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary()), pa.array([total] * len(blocks), pa.int64())], names=["block", "change", "tokens"])
    return run


def _summed(batches):
    sums: dict = {}
    for batch in batches:
        for block, change, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            x, m = sums.get(block, (0.0, 0))
            sums[block] = x + np.frombuffer(change.as_buffer(), np.float32).astype(np.float64), m + n
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(x / m).tobytes() for x, m in sums.values()], pa.binary())], names=["block", "mean"])


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = text_bytes(part.column(0))
            data = lowered(data)
            starts, ends, _ = words(data, offsets)
            code, times = np.unique(spans_hash(prefix_hash(data), starts, ends), return_counts=True)
            often = times >= SHARD_TIMES
            yield pa.RecordBatch.from_arrays([pa.array(code[often].view(np.int64)), pa.array(times[often])], names=["code", "times"])


def _postings(known: np.ndarray, buckets: int):
    """Exact counts of the symbols in training texts, and packed postings of the rare words of all texts."""
    def run(batches):
        counts = np.zeros(len(known) + 2, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                codes, symbol, _, doc, _ = tokens(part.column(2), known)
                shard = int(part.column(0)[0].as_py())
                keys, train = part.column(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                counts += np.bincount(symbol[train[doc]], minlength=len(counts))
                rare = symbol == len(known)
                code, owner = codes[rare] >> np.uint64(16), doc[rare]
                order = np.lexsort((owner, code))
                code, owner = code[order], owner[order]
                first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (owner[1:] != owner[:-1]))) if len(code) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(code)))
                code, owner = code[first], owner[first]
                bucket = ((code >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                blobs = []
                for a, b in zip(cuts, [*cuts[1:], len(code)]):
                    used, mine = np.unique(owner[a:b], return_inverse=True)
                    head = np.array([b - a, len(used), shard & ((1 << 64) - 1)], "<u8").tobytes()
                    blobs.append(head + keys[used].astype("<i8").tobytes() + train[used].tobytes() + planes(np.diff(code[a:b], prepend=np.uint64(0)), 6) + planes(mine, 3) + planes(times[a:b], 4))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(blobs), pa.int32()), pa.nulls(len(blobs), pa.int64()), pa.array(bucket[cuts], pa.int32()), pa.array(blobs, pa.binary())], names=["symbol", "times", "bucket", "payload"])
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some]), pa.nulls(len(some), pa.int32()), pa.nulls(len(some), pa.binary())], names=["symbol", "times", "bucket", "payload"])
    return run


def _rare_sums(batches):
    """For each shard of texts, packed: its documents with the sum of times * log10(count + 1) over a bucket's words and
    the times of counted ones; without shard, the number of the bucket's words that training texts have."""
    held, docs_of, base = [], [], 0
    for batch in batches:
        for blob in batch.column(0):
            raw = blob.as_buffer().to_pybytes()
            n, docs, shard = (int(x) for x in np.frombuffer(raw, "<u8", 3))
            at = 24 + 9 * docs
            train = np.frombuffer(raw, bool, docs, 24 + 8 * docs)
            owner = from_planes(raw, n, 3, at + 6 * n).astype(np.int64)
            held.append((np.cumsum(from_planes(raw, n, 6, at), dtype=np.uint64), owner + base, train[owner], from_planes(raw, n, 4, at + 9 * n).astype(np.int64)))
            docs_of.append((shard, base, base + docs, raw[24:24 + 8 * docs]))
            base += docs
    if held:
        code, place, train, times = (np.concatenate(x) for x in zip(*held))
        _, where = np.unique(code, return_inverse=True)
        count = np.bincount(where, weights=times * train)
        logs = np.bincount(place, weights=times * np.log10(count + 1)[where], minlength=base)
        known = np.bincount(place, weights=times * (count > 0)[where], minlength=base).astype("<i8")
        packed = [keys + logs[a:b].tobytes() + known[a:b].tobytes() for _, a, b, keys in docs_of]
        shards = np.array([x[0] for x in docs_of], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(shards, 0), mask=np.append(np.zeros(len(shards), bool), True)), pa.array([*packed, None], pa.binary()), pa.array([0] * len(packed) + [int((count > 0).sum())])], names=["shard", "sums", "words"])


def _document_sums(batches):
    """The buckets' packed sums, which stand together by shard, added up for each document."""
    blobs = [x.as_buffer().to_pybytes() for batch in batches for x in batch.column(0)]
    if blobs:
        ends = [len(b) // 24 * 8 for b in blobs]
        key = np.concatenate([np.frombuffer(b[:n], "<i8") for b, n in zip(blobs, ends)])
        logs = np.concatenate([np.frombuffer(b[n:2 * n], "<f8") for b, n in zip(blobs, ends)])
        known = np.concatenate([np.frombuffer(b[2 * n:], "<i8") for b, n in zip(blobs, ends)])
        doc, place = np.unique(key, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(np.bincount(place, weights=logs)), pa.array(np.bincount(place, weights=known).astype(np.int64))], names=["key", "logs", "known"])


def _scores(vocab: Vocabulary, weights):
    """Of each text: tokens, rare ones, the sum of log10(count + 1) and number of counted among the others, log10 of the symbols' probability."""
    logs = np.log10(vocab.counts + 1)
    logs[vocab.rare] = 0
    counted = vocab.counts > 0
    counted[vocab.rare] = False

    def run(batches):
        tables = unpack(weights.value, vocab.sizes)
        for batch in batches:
            for part in slices(batch, "text"):
                _, symbol, names, doc, bounds = tokens(part.column(1), vocab.codes)
                group = vocab.group[symbol]
                rows = features(names, group, doc)
                each = np.zeros(len(symbol))
                for a in range(0, len(symbol), BATCH):
                    some, mine = symbol[a:a + BATCH], group[a:a + BATCH]
                    (p, p_sum), many, (q, q_sum) = _layers(tables, rows[:, a:a + BATCH], mine)
                    chance = (p[np.arange(len(some)), mine] / p_sum[:, 0]).astype(np.float64)
                    chance[many] *= q[np.arange(len(many)), vocab.place[some[many]]] / q_sum[:, 0]
                    each[a:a + BATCH] = np.log10(np.maximum(chance, 1e-30))
                n = len(bounds) - 1
                sums = [np.bincount(doc, weights=w, minlength=n) for w in (symbol == vocab.rare, logs[symbol], counted[symbol], each)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2].astype(np.int64)), pa.array(sums[3])], names=["row", "n_tokens", "n_rare", "logs", "known", "model"])
    return run


def lm_scores(docs: DataFrame, rounds: int = ROUNDS, known: int = KNOWN) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    base_score is the add-one unigram's, score the model's log10 probability of the whole text with its end. Null and
    empty texts are an end alone. Rows repeated whole count each time and score alike. Without training documents every
    count is 0 and score is the untrained model's. An empty table gives no rows. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    train = rows.where(~F.col("held_out"))
    often = train.select("text").mapInArrow(_frequent, "code long, times long").groupBy("code").agg(F.sum("times").alias("times"))
    chosen = np.array(sorted(r.code & ((1 << 64) - 1) for r in often.orderBy(F.desc("times"), "code").limit(known).collect()), np.uint64)
    buckets = parts(spark)
    first = written(rows.select("key", (~F.col("held_out")).alias("train"), "text").mapInArrow(_postings(chosen, buckets), PASS_SCHEMA))
    sums = first.where("payload is not null").repartitionById(buckets, F.col("bucket")).select("payload").mapInArrow(_rare_sums, "shard long, sums binary, words long")
    packed = written(sums)
    sums = packed.where("shard is not null").repartition(buckets, "shard").select("sums").mapInArrow(_document_sums, "key long, logs double, known long")
    sums = written(sums.groupBy("key").agg(F.sum("logs").alias("rare_logs"), F.sum("known").alias("rare_known")))
    counts = np.zeros(len(chosen) + 2, np.int64)
    for r in first.where("symbol is not null").groupBy("symbol").agg(F.sum("times").alias("times")).collect():
        counts[r.symbol] = r.times
    vocab = vocabulary(chosen, counts[:-2], int(counts[-2]), int(counts[-1]))
    flat = first_weights(vocab)
    tasks = max(6, buckets // 4)
    for k in range(rounds):
        weights = spark.sparkContext.broadcast(flat)
        mine = train.where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == k).select("text")
        means = mine.coalesce(tasks).mapInArrow(_updates(vocab, weights), "block int, change binary, tokens long").repartition(tasks, "block").mapInArrow(_summed, "block int, mean binary").collect()
        flat = flat.copy()
        for r in means:
            flat[r.block * BLOCK:(r.block + 1) * BLOCK] += np.frombuffer(r.mean).astype(np.float32)
        weights.unpersist()
    weights = spark.sparkContext.broadcast(flat)
    n, rare_words = int(counts.sum()), packed.agg(F.sum("words")).first()[0] or 0
    v = rare_words + int((counts[:-2] > 0).sum()) + int(counts[-1] > 0)
    scored = rows.select(F.struct("doc_id", "held_out", "key").alias("row"), "text").mapInArrow(
        _scores(vocab, weights), f"row struct<doc_id: {docs.schema['doc_id'].dataType.simpleString()}, held_out: boolean, key: bigint>, n_tokens long, n_rare long, logs double, known long, model double")
    scored = scored.withColumn("key", F.col("row.key"))
    copies = rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    sums = sums.join(copies, "key").select("key", (F.col("rare_logs") / F.col("copies")).alias("rare_logs"), (F.col("rare_known") / F.col("copies")).cast("long").alias("rare_known"))
    out = scored.join(sums, "key", "left").withColumn("rare_logs", F.coalesce("rare_logs", F.lit(0.0)))
    base = F.col("logs") + F.col("rare_logs") - F.col("n_tokens") * float(np.log10(n + v + 1))
    score = F.col("model") + F.col("rare_logs") - F.col("n_rare") * float(np.log10(int(counts[-2]) + rare_words + 1))
    return out.select("row.doc_id", "row.held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), F.round(base, 6).alias("base_score"), F.round(score, 4).alias("score"))

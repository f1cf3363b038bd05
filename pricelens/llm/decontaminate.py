"""Benchmark decontamination with SimHash windows of the items' sizes and a multi-index Hamming search.

Words are lower-cased runs of letters and digits; shingles weigh as much as they have letters, and the weight of the common
ones over that of all must reach 0.8. A window has the size of a benchmark item. Every window of a document gets a
fingerprint in which the item's shingles, in whatever order they stand, weigh 0.8 of the item: no other window can reach
the similarity. A window's 64-bit SimHash falls into four blocks of 16 bits. Two fingerprints within RADIUS = 15 bits agree
in one block up to three bits, so the items' blocks are indexed with up to three bits turned, and a look-up of the
window's four blocks finds every item in the radius. Pairs within it are compared exactly. A pair at a similarity of just
0.8 lies within the radius in about 97 cases of a hundred; a document has several windows at every leak.
"""
from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.llm.common import written

SHINGLE, SIMILARITY = 5, 0.8
BLOCKS, BLOCK_BITS, FLIPS = 4, 16, 3
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: Rows of the items' shingle index up to which it is sent to every executor; a longer one is joined by shuffle.
BROADCAST_ROWS = 1_000_000
WORD_GAP = "[^\\p{L}\\p{N}]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_GAP), lambda w: w != "")


def _gram(w: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(w, at + k) for k in range(size)])


def _starts(w: Column, size: int) -> Column:
    last = F.size(w) - size
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def shingles(w: Column) -> Column:
    """Distinct (code, weight) of the five-word shingles; fewer words are one shingle."""
    def entry(at, size):
        letters = reduce(lambda a, b: a + b, [F.length(F.get(w, at + k)) for k in range(size)])
        return F.struct(_gram(w, at, size).alias("code"), letters.alias("weight"))

    out = F.array_distinct(F.transform(_starts(w, SHINGLE), lambda at: entry(at, SHINGLE)))
    for size in range(1, SHINGLE):
        out = F.when(F.size(w) == size, F.array(entry(F.lit(0), size))).otherwise(out)
    return out


def simhash(grams: Column) -> Column:
    """64-bit SimHash: bit b is the weighted majority of the shingles' bits b."""
    total = F.aggregate(grams, F.lit(0), lambda s, g: s + g["weight"])
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda out, b: F.when(
        2 * F.aggregate(grams, F.lit(0), lambda s, g: s + g["weight"] * F.getbit(g["code"], b)) > total,
        out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(out))


def _block(code: Column, k: int) -> Column:
    return F.shiftrightunsigned(code, BLOCK_BITS * k).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def _keys(code: Column) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("block"), _block(code, k).alias("value")) for k in range(BLOCKS)])


def block_index(items: DataFrame) -> DataFrame:
    """(block, value, item_key): every value within FLIPS bits of the items' own in that block."""
    masks = [sum(1 << b for b in bits) for n in range(FLIPS + 1) for bits in combinations(range(BLOCK_BITS), n)]
    own = items.select("item_key", F.explode(_keys(F.col("code"))).alias("x"))
    spread = own.select("item_key", "x.block", "x.value", F.explode(F.lit(masks)).alias("mask"))
    return spread.select("block", F.col("value").bitwiseXOR(F.col("mask")).alias("value"), "item_key")


def _anchors(items: DataFrame) -> DataFrame:
    """item_key, len, gram, weight, least: the items' distinct shingles, and the common weight that a window must have."""
    least = SIMILARITY * F.aggregate("grams", F.lit(0), lambda s, g: s + g["weight"]) - 1e-9
    return items.select("item_key", "len", least.alias("least"), F.explode("grams").alias("g")).select("item_key", "len", "least", F.col("g.code").alias("gram"), "g.weight")


def _spots(hits: DataFrame) -> DataFrame:
    """row_key, len, start of every window in which hits on one item weigh enough; hits: row_key, pos, gram and its item.

    Rows of which all hits on an item together weigh too little go first. A hit is in the windows that start at most an
    item's length before it: its weight comes at the first of these starts and goes after the last, and the running
    sum along the starts is every window's weight.
    """
    pair = ["row_key", "item_key"]
    enough = hits.groupBy(*pair, "gram").agg(F.max("weight").alias("weight"), F.max("least").alias("least")).groupBy(*pair).agg(F.sum("weight").alias("all_"), F.max("least").alias("least"))
    hits = hits.join(enough.where(F.col("all_") >= F.col("least")).select(*pair), pair)
    last = F.col("len") - F.least(F.col("len"), F.lit(SHINGLE))
    turns = F.array(F.struct(F.greatest(F.col("pos") - last, F.lit(0)).alias("start"), F.col("weight")), F.struct((F.col("pos") + 1).alias("start"), (-F.col("weight")).alias("weight")))
    steps = hits.select(*pair, "len", "least", F.explode(turns).alias("t")).groupBy(*pair, "len", "least", "t.start").agg(F.sum("t.weight").alias("step"))
    along = Window.partitionBy(*pair).orderBy("start")
    heavy = steps.select("row_key", "len", "least", "start", F.sum("step").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("weight"), F.lead("start").over(along).alias("next_"))
    heavy = heavy.where(F.col("weight") >= F.col("least"))
    return heavy.select("row_key", "len", F.explode(F.sequence(F.col("start"), F.col("next_") - 1)).alias("start")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of `docs`: doc_id, contaminated, item_id (of the most similar item, the smallest of ties),
    similarity, n_items, start_word (where that item's window begins).

    Whole texts are searched. Null or empty texts are clean; null, empty or wordless items match nothing; items with a
    null id count, with a null item_id. Rows repeated with id and text carry the same result. Other columns are not read.
    """
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    items = items.select("item_id", F.size("w").alias("len"), "w", F.xxhash64("item_id", "w").alias("item_key")).dropDuplicates(["item_key"])
    items = written(items.withColumn("grams", shingles(F.col("w"))).withColumn("code", simhash(F.col("grams"))))
    sizes = [r[0] for r in items.select(F.least("len", F.lit(SHINGLE)).alias("n")).distinct().orderBy("n").collect()]
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("row_key"))
    if not sizes:
        return rows.select("doc_id", F.lit(False).alias("contaminated"), F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(None).cast("double").alias("similarity"), F.lit(0).cast("long").alias("n_items"), F.lit(None).cast("int").alias("start_word"))
    anchors = written(_anchors(items))
    known = anchors.select("gram").distinct()
    split = rows.select("row_key", words(F.col("text")).alias("w"))
    grams = F.concat(*[F.transform(_starts(F.col("w"), n), lambda at: F.struct(at.alias("pos"), _gram(F.col("w"), at, n).alias("gram"))) for n in sizes])
    each = split.select("row_key", F.explode(grams).alias("x")).select("row_key", "x.pos", "x.gram")
    hits = each.join(F.broadcast(known) if known.count() <= BROADCAST_ROWS else known, "gram")
    spots = written(_spots(written(hits.join(anchors, "gram"))))
    # The rows with hits grow with the corpus, so they are never broadcast: texts move once, at every size.
    texts = rows.join(spots.select("row_key").distinct().hint("merge"), "row_key", "left_semi").dropDuplicates(["row_key"]).select("row_key", words(F.col("text")).alias("w"))
    windows = spots.join(texts, "row_key").select("row_key", "start", F.slice("w", F.col("start") + 1, F.col("len")).alias("w"), "len")
    windows = windows.where(F.size("w") == F.col("len"))
    windows = windows.withColumn("grams", shingles(F.col("w"))).withColumn("code", simhash(F.col("grams")))  # two steps: shingles are made once
    windows = written(windows.select("row_key", "start", "len", "w", "code"))
    probes = windows.select("code", F.explode(_keys(F.col("code"))).alias("x")).select("code", "x.block", "x.value").distinct()
    near = probes.join(block_index(items), ["block", "value"]).select(F.col("code").alias("window_code"), "item_key").distinct()
    targets = items.select("item_key", "item_id", F.col("len").alias("item_len"), F.col("grams").alias("item_grams"), F.col("code").alias("item_code"))
    near = near.join(targets, "item_key").where(F.bit_count(F.col("window_code").bitwiseXOR(F.col("item_code"))) <= RADIUS)
    pairs = windows.join(near, (F.col("code") == F.col("window_code")) & (F.col("len") == F.col("item_len"))).withColumn("grams", shingles(F.col("w")))

    def weight(x):
        return F.aggregate(x, F.lit(0), lambda s, g: s + g["weight"])

    common = weight(F.array_intersect("grams", "item_grams"))
    scored = pairs.select("row_key", "start", "item_id", "item_key", (common / (weight(F.col("grams")) + weight(F.col("item_grams")) - common)).alias("similarity")).where(F.col("similarity") >= similarity)
    best = scored.groupBy("row_key").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "item_id", "start")).alias("b"), F.count_distinct("item_key").alias("n_items"))
    return rows.select("doc_id", "row_key").join(best, "row_key", "left").select(
        "doc_id", F.col("b").isNotNull().alias("contaminated"), "b.item_id", (-F.col("b.s")).alias("similarity"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.col("b.start").alias("start_word"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """`docs` without contaminated rows, all columns as they were; rows without an id stay unless every such row is contaminated."""
    found = contamination(docs, benchmark, similarity).groupBy("doc_id").agg(F.min("contaminated").alias("all_"), F.max("contaminated").alias("any_"))
    gone = found.where(F.when(F.col("doc_id").isNull(), F.col("all_")).otherwise(F.col("any_"))).select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("gone_id_"))
    return docs.join(gone, F.coalesce(docs["doc_id"], F.lit(-(1 << 63))) == gone["gone_id_"], "left_anti")

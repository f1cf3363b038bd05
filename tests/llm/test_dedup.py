"""Exact, suffix-array and n-gram deduplication against plain versions."""
import hashlib
import random
from collections import defaultdict

import brute
import numpy as np
from messy_rows import CLASHING, ROWS

from pricelens.llm.common import prefix_hash
from pricelens.llm import exact_dedup, graph, ngram_join, suffix_dedup

PAIRS = [(d, t) for d, t, _ in ROWS]


def _exact(pairs):
    groups = defaultdict(list)
    for d, t in pairs:
        groups[t or ""].append(d)
    best = {t: max((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
    return sorted(((d, best[t or ""], len(groups[t or ""]), d == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for d, t in pairs), key=repr)


def test_exact_groups(messy):
    for salts in (1, 16):
        assert sorted(map(tuple, exact_dedup.exact_groups(messy, salts).collect()), key=repr) == _exact(PAIRS)


def test_drop_copies_keeps_one_row_as_it_was(messy):
    out = exact_dedup.drop_copies(messy)
    rows = out.collect()
    assert out.columns == messy.columns and len(rows) == len({t or "" for _, t in PAIRS})
    assert all(r[c] == f"mine_{c}" for r in rows for c in CLASHING)
    assert {r.doc_id for r in rows} == {k for _, k, *_ in _exact(PAIRS)}


def test_nothing_in_nothing_out(nothing):
    for df in (exact_dedup.exact_groups(nothing), exact_dedup.drop_copies(nothing), ngram_join.jaccard_groups(nothing), ngram_join.one_of_each_group(nothing), suffix_dedup.repeated_spans(nothing)):
        assert df.count() == 0


def _removed(df):
    return sorted(map(tuple, df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


def _removed_plainly(pairs):
    return sorted(((d, n, r, s, hashlib.sha256(k).hexdigest()) for d, n, r, s, k in brute.repeated_bytes(pairs)), key=repr)


def test_suffix_dedup_on_messy_rows(messy):
    assert _removed(suffix_dedup.repeated_spans(messy)) == _removed_plainly(PAIRS)


def test_suffix_dedup_across_shards_with_hot_and_cold_anchors(spark):
    pick = random.Random(3)
    line = "".join(pick.choice("abcdefgh ") for _ in range(420))
    docs = []
    for i in range(60):
        own = "".join(pick.choice("abcdefgh ") for _ in range(pick.randint(0, 900)))
        at = pick.randint(0, len(own))
        docs.append((i, own[:at] + line[pick.randint(0, 150):pick.randint(260, 420)] + own[at:]))
    want = _removed_plainly(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8, "doc_id")
    for hot in (1, 5, 2048):
        assert _removed(suffix_dedup.repeated_spans(df, hot)) == want


def test_suffix_array_and_common_prefixes():
    pick = np.random.default_rng(1)
    data = np.concatenate([pick.integers(97, 100, 3000), np.full(600, 98), np.tile(pick.integers(97, 123, 70), 9)]).astype(np.uint8)
    raw = data.tobytes()
    order, _ = suffix_dedup.suffix_array(data)
    assert [raw[i:i + 256] for i in order] == sorted(raw[i:i + 256] for i in range(len(raw)))
    p, q = np.arange(1, len(raw)), pick.integers(0, len(raw), len(raw) - 1)
    q[500:900] = np.arange(2000, 2400)
    found = suffix_dedup.common_prefixes(prefix_hash(data), p, q, np.full(len(raw), len(raw)))
    for a, b, n in zip(p, q, found):
        assert raw[a:a + n] == raw[b:b + n] and (a + n == len(raw) or b + n == len(raw) or raw[a + n] != raw[b + n])


def test_ngram_groups_on_messy_rows(messy):
    got = sorted(map(tuple, ngram_join.jaccard_groups(messy).collect()), key=repr)
    assert got == brute.jaccard_groups(PAIRS)


def _families(seed, families, copies):
    pick = random.Random(seed)
    docs = []
    for f in range(families):
        base = [f"w{pick.randint(0, 4000)}" for _ in range(pick.choice([6, 9, 20, 60, 150, 400]))]
        for _ in range(pick.randint(1, copies)):
            w = list(base)
            for _ in range(pick.choice([0, 0, 1, 1, 2, 4])):
                w[pick.randrange(len(w))] = f"e{pick.randint(0, 10 ** 6)}"
            docs.append((len(docs), " ".join(w)))
    return docs


def test_ngram_groups_of_near_copies_chained(spark):
    docs = _families(5, 120, 25)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = sorted(map(tuple, ngram_join.jaccard_groups(df).collect()), key=repr)
    assert got == brute.jaccard_groups(docs)
    left = {r.doc_id for r in ngram_join.one_of_each_group(df).collect()}
    assert left == {c for _, n, c in got}


def test_frequent_tokens_and_all_sets_light_or_heavy(spark, monkeypatch):
    docs = _families(6, 40, 15)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = brute.jaccard_groups(docs)
    for name, value, boundary in (("RARE_LIMIT", 3, 0), ("HELD", 10, 10 ** 6)):
        monkeypatch.setattr(ngram_join, name, value)
        monkeypatch.setattr(ngram_join, "_boundary", lambda ranked, b=boundary: b)
        assert sorted(map(tuple, ngram_join.jaccard_groups(df).collect()), key=repr) == want


def test_packed_tokens_come_back():
    tokens = np.sort(np.random.default_rng(2).integers(0, 1 << 48, 500).astype(np.uint64))
    owner = np.random.default_rng(3).integers(0, 40, 500)
    sids, sizes = np.arange(50, dtype=np.uint64) * np.uint64(1 << 58), np.arange(50)
    a, b, c = ngram_join.unpacked(ngram_join.packed(tokens, owner, sids, sizes))
    assert (a == tokens).all() and (b == sids[owner]).all() and (c == sizes[owner]).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


def test_many_sets_that_share_a_passage_or_are_edited_too_far(spark):
    """No pair of them links, and none is compared with all others."""
    pick = random.Random(12)
    passage, base = [f"p{i}" for i in range(60)], [f"b{i}" for i in range(120)]
    docs = []
    for i in range(2000):
        if i % 2:
            w = [f"o{i}x{k}" for k in range(20)] + passage
        else:
            w = list(base)
            for k in pick.sample(range(120), 14):
                w[k] = f"e{i}x{k}"
        docs.append((i, " ".join(w)))
    docs += [(5000, " ".join(base)), (5001, " ".join(base[1:])), (5002, " ".join(passage)), (5003, " ".join(passage[:-1] + ["tail"]))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_groups(df).collect()}
    assert got == {d: {5001: 5000, 5003: 5002}.get(d, d) for d, _ in docs}


def test_copies_without_their_source_meet_by_their_edits(spark):
    """Copies with an edit each, no two of them near but where the edits are; and sets that the star of a cluster connects."""
    pick = random.Random(14)
    docs = []
    for f in range(4):
        base = [f"f{f}w{k}" for k in range(70)]
        for i in range(120):
            w = list(base)
            for k in pick.sample(range(70), pick.choice([1, 1, 1, 2, 3])):
                w[k] = f"e{pick.randint(0, 3)}f{f}k{k}" if i % 3 else f"e{i}f{f}k{k}"
            docs.append((len(docs), " ".join(w if i % 10 else w[:-1])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, ngram_join.jaccard_groups(df).collect()), key=repr)
    assert got == brute.jaccard_groups(docs)


def test_rounds_leave_no_shuffle_files(spark):
    """Components and written tables drop the shuffles of their jobs, so that many rounds do not fill the disk."""
    import time
    from pyspark.sql import functions as F
    from pricelens.llm.common import written
    from pricelens.llm.graph import components
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("|").split("|") if "/shuffle_" in f}
    before = files()
    chain = spark.range(64).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert written(components(chain).groupBy("component").count()).collect() == [(0, 65)]
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.5)
    assert not files() - before


def test_components_of_few_and_of_many_edges(spark, monkeypatch):
    pick = random.Random(3)
    edges = [(pick.randrange(300), pick.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(-5, 2000), (2000, -(1 << 62))]
    df = spark.createDataFrame(edges, "a long, b long")
    few = sorted(map(tuple, graph.components(df).collect()))
    monkeypatch.setattr(graph, "FEW", 0)
    assert few == sorted(map(tuple, graph.components(df).collect()))
    assert {n: c for n, c in few}[1060] == 1000 and {n: c for n, c in few}[-5] == -(1 << 62)
    none = graph.components(df.limit(0))
    assert none.columns == ["node", "component"] and not none.collect()


def test_components_of_few_edges_take_few_jobs(spark):
    chain = spark.range(64).selectExpr("id as a", "id + 1 as b")
    spark.sparkContext.setJobGroup("chain", "")
    graph.components(chain).collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("chain")
    spark.sparkContext.setJobGroup("", "")
    assert len(jobs) <= 8


def test_heads_are_dealt_by_the_bytes_of_the_texts(spark, monkeypatch):
    """However few partitions the session has, a task holds the rare shingles of so many bytes only."""
    docs, asked, first = _families(8, 30, 6), [], ngram_join._first_pass
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(ngram_join, "BUCKET_BYTES", 4096, raising=False)
    monkeypatch.setattr(ngram_join, "_first_pass", lambda buckets: asked.append(buckets) or first(buckets))
    assert sorted(map(tuple, ngram_join.jaccard_groups(df).collect()), key=repr) == brute.jaccard_groups(docs)
    assert asked == [-(-sum(len(t) for _, t in docs) // 4096)] and asked[0] > 4


def test_hub_rounds_when_pairs_are_many(spark, monkeypatch):
    docs = _families(9, 30, 25)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(ngram_join, "FEW_PAIRS", 0)
    monkeypatch.setattr(graph, "FEW", 0)
    assert sorted(map(tuple, ngram_join.jaccard_groups(df).collect()), key=repr) == brute.jaccard_groups(docs)

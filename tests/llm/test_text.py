"""URL rules, toxicity, mixing, licences, archives, language model, decontamination and the pipeline on small inputs."""
import base64
import hashlib
import math
import random
import zipfile
import zlib
from collections import Counter

import brute
import corpus_pipeline
import numpy as np
import pytest
from messy_rows import CLASHING, ROWS
from oracle import compare, connect
from pyspark.sql import functions as F

from pricelens.llm import decontaminate, licenses, maxent_lm, mixing, toxicity, url_filter, warc
from pricelens.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_with_sql(spark, name):
    assert compare(spark, connect(SF), QUERIES[name], ORACLE[name], SF) is None


# URL filter

URLS = [(1, "https://a.example.org/es/x", "example.org/es/", "block"), (2, "HTTP://WWW.Example.ORG/en/12?q", "example.org/en/1", "block"), (3, "http://x.org", None, None),
        (4, "http://x.org/", "org/", "allow"), (5, "http://a.com/de/1#f", "com/de/", "block"), (6, "http://com/fr/", "com/fr/", "allow"), (7, "no scheme", None, "allow"), (8, None, None, "allow"),
        (9, "http://notexample.org/es/", "org/", "allow"), (10, "x://y://z.com/de/", None, "allow"), (11, "http://h.net?x://a.org/", None, "allow")]


def test_site_rules(spark):
    pages = spark.createDataFrame([(i, u) for i, u, _, _ in URLS] + [(8, None)], "page_id long, url string").withColumn("tokens", F.lit("clash"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = url_filter.judge_urls(pages, labels).collect()
    got = {r.page_id: (r.rule, r.verdict) for r in rows}
    assert len(rows) == len(URLS) + 1
    for i, _, rule, verdict in URLS:
        assert got[i] == (rule, verdict or "allow"), i
    assert {r.page_id: (r.host, r.path) for r in rows}[2] == ("www.example.org", "/en/12")
    assert {r.page_id: (r.host, r.path) for r in rows}[10] == ("y:", "//z.com/de/")
    assert url_filter.judge_urls(pages.limit(0), labels).count() == 0


def test_mined_rules_block_unlabelled_pages(spark):
    pages, labels, pick = [], [], random.Random(1)
    for i in range(600):
        bad = i % 3 == 0
        host = f"{pick.choice(['shop', 'deal'])}.{'pills' if bad else 'garden'}.net"
        pages.append((i, f"http://{host}/{pick.choice(['en', 'fr'])}/{i}"))
        if i % 2:
            labels.append((i, None if i % 5 else 1, int(bad)))
    rows = url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert all(r.verdict == ("block" if "pills" in r.host else "allow") for r in rows) and len(rows) == 600


# Toxicity

def _marked(n, seed=2):
    pick, docs, labels = random.Random(seed), [], []
    for i in range(n):
        sentences = [" ".join(f"w{pick.randint(0, 300)}" for _ in range(pick.randint(3, 9))) for _ in range(pick.randint(1, 8))]
        bad = pick.random() < 0.3
        if bad:
            sentences.insert(pick.randrange(len(sentences) + 1), "You vile" + pick.choice(["Worm", "slug", "toad"]) + " there")
        docs.append((i, ". ".join(sentences)))
        labels.append((i, int(bad)))
    return docs, labels


def test_toxicity_on_held_out_documents(spark):
    docs, labels = _marked(900)
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels + labels[:50] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    rows = {r.doc_id: r for r in toxicity.toxic_scores(d, y).collect()}
    for i, bad in labels:
        assert rows[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and rows[i].predicted == (rows[i].score >= 0.7) == bad
    model = toxicity.train(d, y)
    told = toxicity.offending_sentences(d, model).collect()
    assert {r.doc_id for r in told} == {i for i, bad in labels if bad}
    assert all("vile" in r.sentence and "." not in r.sentence for r in told)


def test_toxicity_of_messy_rows_and_without_labels(spark, messy, nothing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.toxic_scores(messy, none).collect()
    assert len(rows) == len(ROWS) and all(r.score <= 0.01 and r.predicted == 0 for r in rows)
    assert all(r.score == 0 for r in rows if r.doc_id in (5, 6, 7))
    kept = toxicity.drop_toxic(messy, none)
    assert kept.columns == messy.columns and kept.count() == len(ROWS) and toxicity.toxic_scores(nothing, none).count() == 0


# Mixing

def _filled(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    held, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in held)
        free = sum(weight[s] for s in names if s not in held)
        target = {s: 3 * sizes[s] if s in held else rest * weight[s] / free for s in names}
        over = {s for s in names if target[s] > 3 * sizes[s]}
        if not over:
            return target
        held |= over


def test_mix_reaches_its_targets(spark):
    pick = random.Random(4)
    docs = [(i, " ".join(["x"] * pick.randint(0, 60)), pick.choice(["a", "a", "a", "a", "b", "c", "d", None, "é"]) if i % 40 else "z") for i in range(3000)]
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), ["doc_id", "source"]).collect()
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += len(t.split())
    want, taken = _filled(sizes), Counter()
    for r in rows:
        taken[r.row.source] += r.taken
        assert r.taken <= 3 * r.size and abs(r.target - want[r.row.source]) < 1e-6 and r.source_size == sizes[r.row.source]
        assert (r.position is None) == (r.taken == 0) and 0 <= (r.position or 0) <= 1
    assert all(abs(taken[s] - want[s]) <= 60 for s in want) and len(rows) == 3000


def test_positions_follow_the_schedule(spark):
    docs = spark.createDataFrame([(i, "a b c d", "ab"[i % 2]) for i in range(2000)], "doc_id long, text string, source string")
    rows = mixing.curriculum(docs, weights=(1, 1), slopes=(1.0, -1.0)).collect()
    at = [r.mix_position for r in rows]
    assert at == sorted(at) and len({(r.doc_id, r.mix_pass) for r in rows}) == len(rows) == 2000
    early = Counter(r.source for r in rows if r.mix_position < 0.5)
    assert abs(early["a"] - 250) <= 2 and abs(early["b"] - 750) <= 2


def test_mix_of_messy_rows(messy, nothing):
    out = mixing.curriculum(messy)
    assert out.columns[:len(messy.columns)] == messy.columns and all(r[c] == f"mine_{c}" for r in out.collect() for c in CLASHING)
    assert mixing.mix(messy, ["doc_id"]).count() == len(ROWS) and mixing.curriculum(nothing).count() == 0


# Licences

def test_licences(spark, messy, nothing):
    notices = {1: "Released under the MIT license.", 2: "licensed under CC BY-NC 4.0.", 3: "This work is licensed under the GNU General Public License, version 3.", 4: "Licensed under the Apache License, Version 2.0.", 5: "Licensed under CC BY 4.0."}
    want = {1: "MIT", 2: "CC-BY-NC-4.0", 3: "GPL-3.0", 4: "Apache-2.0", 5: "CC-BY-4.0"}
    filler = [f"plain line {i} about the public garden version {i % 7} of this work" for i in range(300)]
    docs = [(i, "\n".join(filler[k] for k in range(i, i + 5)) + "\n" + notices.get(i, "The licence was under the table.") + "\nend") for i in range(1, 200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = licenses.train(df)
    rows = licenses.scan(df, model).collect()
    assert {r.doc_id: r.license for r in rows if r.license} == want
    first = next(r for r in rows if r.doc_id == 1).notices[0]
    assert docs[0][1].encode()[first.start:first.end].decode() == "Released under the MIT license"
    assert licenses.scan(messy, model).count() == len(ROWS) and licenses.scan(nothing, model).count() == 0 and licenses.train(nothing).families[0] == "unknown"


# Archives

def test_archives_come_back(spark, tmp_path):
    pages = [(1, "http://a/\r\nx", "same"), (2, None, "same"), (3, "http://c", "Ünï"), (4, "u", None), (5, "u", ""), (None, "u", "other"), (6, "u", "big" * 40_000), (6, "u", "big" * 40_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    for least, roll in ((0, 1 << 20), (10, 100)):
        listed = warc.write_archives(df, f"file://{tmp_path}", least, roll)
        rows = warc.read_archives(listed).collect()
        got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=repr)
        want = []
        for i, _, html in pages:
            raw = (html or "").encode()
            top = max((p for p, _, h in pages if (h or "") == (html or "") and p is not None), default=None)
            again = len(raw) >= least and i != top
            want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", top if again else None))
        assert got == sorted(want, key=repr)
        assert all(r.payload == (dict((p, h) for p, _, h in pages)[r.page_id] or "").encode() for r in rows if r.record_type == "response")
    assert warc.round_trip(df.limit(0)).count() == 0


def test_zip64_directory(tmp_path):
    path = tmp_path / "many.zip"
    with zipfile.ZipFile(path, "w") as z:
        for i in range(66_000):
            z.writestr(zipfile.ZipInfo(f"m{i}"), b"")
        z.writestr(zipfile.ZipInfo("last"), b"payload")
    with warc.opened(str(path)) as file:
        found = warc.members(file)
        at, n, method = found["last"]
        assert len(found) == 66_001 and file.read_at(n, at) == b"payload" and method == 0


# Language model

def test_language_model(spark, messy, nothing):
    pick = random.Random(9)
    docs = [(i, " ".join(f"{'ab'[i % 2]}{int(pick.random() ** 3 * 60)}" for _ in range(pick.randint(0, 80)))) for i in range(400)] + [(None, None), (7, "Again"), (7, "Again")]
    rows = maxent_lm.lm_scores(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), known=50).collect()
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in docs]
    texts = [[*brute.words(t), "\0"] for _, t in docs]
    counts = Counter(w for ws, h in zip(texts, held) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((repr(d), h, len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for (d, _), h, ws in zip(docs, held, texts))
    got = sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows)
    assert [g[:5] for g in got] == [w[:5] for w in want] and all(abs(g[5] - w[5]) < 1e-5 for g, w in zip(got, want))
    unseen = [r for r in rows if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    assert maxent_lm.lm_scores(messy).count() == len(ROWS) and maxent_lm.lm_scores(nothing).count() == 0


def test_gradients_of_equal_rows_are_summed():
    """Often and seldom repeated rows, in three runs over the same gradients, and a batch of one."""
    draw = np.random.default_rng(3)
    for n, top in ((1024, 4096), (1024, 90), (700, 40), (1024, 3), (1, 5)):
        index = (draw.zipf(1.3, (3, n)) % top + np.arange(3)[:, None] * maxent_lm.ROWS).ravel()
        gradient = draw.normal(size=(n, 7)).astype(np.float32)
        plain = np.zeros((3 * maxent_lm.ROWS, 7))
        np.add.at(plain, index, np.tile(gradient, (3, 1)))
        touched, total = maxent_lm._row_sums(index, gradient)
        assert sorted(touched) == sorted(set(index)) and np.abs(total - plain[touched]).max() < 1e-3


# Decontamination

def test_contamination(spark, messy, nothing):
    pick = random.Random(11)
    items = [(i, " ".join(f"q{pick.randint(0, 5000)}" for _ in range(pick.choice([3, 14, 30, 59])))) for i in range(30)] + [(40, None), (41, ""), (None, "one lonely item with a null id here")]
    docs = []
    for i in range(120):
        own = [f"q{pick.randint(0, 5000)}" for _ in range(pick.randint(0, 120))]
        if i % 3 == 0:
            leak = items[pick.randrange(30)][1].split()
            for _ in range(pick.choice([0, 0, 0, 1, 3])):
                leak[pick.randrange(len(leak))] = "changed"
            at = pick.randint(0, len(own))
            own[at:at] = [w.upper() + "," for w in leak]
        docs.append((i, " ".join(own)))
    docs += [(200, "See: One lonely, item with a NULL id here!"), (None, items[5][1]), (None, "clean")]

    def shingles(w):
        return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    def similarity(a, b):
        common, every = a & b, a | b
        return sum(len("".join(g)) for g in common) / sum(len("".join(g)) for g in every)

    want = {}
    for key, (_, text) in enumerate(docs):
        w = "".join(c if c.isalnum() else " " for c in text.lower()).split()
        for _, item in items:
            x = (item or "").split()
            for k in range(len(w) - len(x) + 1) if x else []:
                s = similarity(shingles(w[k:k + len(x)]), shingles(x))
                if s >= 0.8:
                    want[key] = max(want.get(key, 0), s)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contamination(d, b).collect()
    assert len(rows) == len(docs)
    got = sorted((repr(r.doc_id), round(r.similarity, 9)) for r in rows if r.contaminated)
    assert got == sorted((repr(docs[k][0]), round(s, 9)) for k, s in want.items())
    left = decontaminate.drop_contaminated(d, b)
    assert sorted(map(repr, (r.doc_id for r in left.collect()))) == sorted(repr(i) for k, (i, _) in enumerate(docs) if k not in want or i is None)
    assert decontaminate.contamination(messy, b).where("contaminated").count() == 0 and decontaminate.contamination(nothing, b).count() == 0
    assert decontaminate.contamination(messy, b.limit(0)).count() == len(ROWS)


# Pipeline

def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    leaks = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = corpus_pipeline.written(stage(spark, docs, SF))
        assert name == "mixing" or out.columns == docs.columns
        after = [(r.doc_id, r.text) for r in out.collect()]
        assert all(before[i] == t for i, t in after)
        if name == "exact dedup":
            best = {t: max(i for i, x in before.items() if x == t) for t in set(before.values())}
            assert sorted(i for i, _ in after) == sorted(best.values())
        if name == "n-gram Jaccard join":
            assert {i for i, _ in after} == {c for _, _, c in brute.jaccard_groups(list(before.items()))}
        if name == "benchmark decontamination":
            assert all(not any(x in (t or "") for x in leaks) for _, t in after) and len(after) >= len(before) - sum(any(x in (t or "") for x in leaks) for t in before.values())
        docs = out
    assert docs.count() > 0


def test_rearranged_and_edited_items_are_found(spark):
    """Recall at each level of similarity against windows compared by brute force, rearranged items among them."""
    pick = random.Random(21)
    items = [(i, " ".join(f"q{pick.randint(0, 9000)}" for _ in range(pick.choice([40, 100])))) for i in range(40)]
    docs, kinds = [], {}
    for i in range(240):
        w = items[i % 40][1].split()
        cuts = sorted(pick.sample(range(1, len(w)), i % 3))
        parts = [w[a:b] for a, b in zip([0, *cuts], [*cuts, len(w)])]
        w = [x for p in reversed(parts) for x in p]
        for k in pick.sample(range(len(w)), (i // 40) % 3 * len(w) // 100):
            w[k] = f"new{i}"
        docs.append((i, " ".join([f"d{pick.randint(0, 9000)}" for _ in range(pick.randint(0, 60))] + w + [f"t{i}"])))
        kinds[i] = len(parts)

    def grams(w):
        return {tuple(w[k:k + 5]) for k in range(len(w) - 4)}

    weigh = lambda x: sum(len("".join(g)) for g in x)
    best = {}
    for i, text in docs:
        w, x = text.split(), items[i % 40][1].split()
        whole = grams(x)
        scores = [weigh(g & whole) / weigh(g | whole) for g in (grams(w[k:k + len(x)]) for k in range(len(w) - len(x) + 1))]
        best[i] = max(scores, default=0)
    found = {r.doc_id for r in decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect() if r.contaminated}
    assert all(best[i] >= 0.8 for i in found)
    for low, high in ((0.8, 0.87), (0.87, 0.95), (0.95, 1.01)):
        level = [i for i in best if low <= best[i] < high]
        assert len(level) >= 10 and len(found & set(level)) >= 0.9 * len(level), (low, len(level))
    turned = [i for i in best if kinds[i] > 1 and best[i] >= 0.85]
    assert len(turned) >= 15 and len(found & set(turned)) >= 0.97 * len(turned)

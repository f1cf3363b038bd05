"""Spelling variants against a plain version."""
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from messy_rows import ROWS
from pyspark.sql import functions as F

from pricelens.llm import spelling


def _near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    k = next((k for k in range(len(b)) if a[k] != b[k]), len(b))
    return a[k + 1:] == (b[k + 1:] if len(a) == len(b) else b[k:])


def _plainly(docs):
    counts = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    near = {w: [x for x in n if _near(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    root = {}
    for w in n:
        r = w
        while form[r]:
            r = form[r]
        root[w] = r
    return sorted(((w, form[w], root[w], n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n), key=repr)


def _got(df):
    return sorted(map(tuple, spelling.spelling_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def _edited(pick, word, letters):
    k = pick.randrange(len(word))
    return pick.choice([word[:k] + word[k + 1:], word[:k] + pick.choice(letters) + word[k:], word[:k] + pick.choice(letters) + word[k + 1:]])


@pytest.mark.parametrize("long", [64, 6])
def test_variants_of_random_words(spark, monkeypatch, long):
    monkeypatch.setattr(spelling, "LONG", long)
    pick, letters = random.Random(8), "abcdeiqyèé"
    words = ["".join(pick.choice(letters) for _ in range(pick.randint(4, 9))) for _ in range(60)] + ["x" * 70, "aaaaa"]
    for _ in range(400):
        words.append(_edited(pick, pick.choice(words), letters))
    docs = [(i, " ".join(words[int(pick.random() ** 2 * len(words))].upper() if pick.random() < 0.3 else pick.choice(words) for _ in range(pick.randint(0, 90))) + pick.choice([".", "3", "Āx", "x" * 70])) for i in range(300)]
    docs += [(None, "abcde-abcde,abcde"), (7, None), (9, ""), (9, "abcdé ÀBCDÈ àbcdè abcd×e×")]
    want = _plainly(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit("clash")).repartition(5)
    assert _got(df) == want
    assert len({r[2] for r in want}) < len(want) and any(r[1] and r[2] != r[1] for r in want)


def test_counting_hands_on_early(spark, monkeypatch, messy, nothing):
    monkeypatch.setattr(spelling, "HELD", 3)
    assert _got(messy) == _plainly([(d, t) for d, t, _ in ROWS])
    assert _got(nothing) == []


def test_checksums():
    raw = np.frombuffer(b"abc" * 100, np.uint8)
    starts, ends = np.array([0, 5, 7, 3]), np.array([1, 5, 60, 300])
    before = np.array([zlib.crc32(b"12:")] * 4, np.uint32)
    assert [int(x) for x in spelling.checksums(raw, starts, ends, before)] == [zlib.crc32(b"12:" + raw[a:b].tobytes()) for a, b in zip(starts, ends)]

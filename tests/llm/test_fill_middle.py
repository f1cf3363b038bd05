"""Fill-in-the-middle round trips on hand-made texts."""
import hashlib

import numpy as np
import pytest
from messy_rows import CLASHING, ROWS
from pyspark.sql import functions as F

from pricelens.llm import fill_middle as fim


def _plainly(doc_id, text):
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    t = text or ""
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(t), "plain", None, None, t
    if h4 % 100 < 20:
        return len(t), "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return len(t), "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


ODD = [(i, t) for i, t in enumerate(["<", "<S", "P>", "<<P", "S>M>", "a<M>b", "<P>", "😀é́ß" * 7, "x", "\u0000\n", "<S<P<M", "❤" * 3] * 6, 100)]


def test_outputs_and_round_trips(spark, messy):
    rows = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("form", F.lit("clash"))
    for df, texts in ((rows, ODD), (messy, [(d, t) for d, t, _ in ROWS])):
        got = fim.restore(fim.fill_in_middle(df, ["doc_id", "text"])).collect()
        assert len(got) == len(texts)
        assert sorted(((r.row.doc_id, r.row.text) for r in got), key=repr) == sorted(texts, key=repr)
        for r in got:
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == _plainly(r.row.doc_id, r.row.text)
            assert r.restored == (r.row.text or "")
    assert {"plain", "psm", "spm"} == {r.form for r in got}


def test_columns_of_the_query_and_empty_table(messy, nothing):
    assert fim.round_trips(nothing).count() == 0
    kept = fim.fill_in_middle(messy, messy.columns).select("row.*")
    assert kept.columns == messy.columns and all(r[c] == f"mine_{c}" for r in kept.collect() for c in CLASHING)
    for r in fim.round_trips(messy).collect():
        assert r.restored_sha256 in {hashlib.sha256((t or "").encode()).hexdigest() for d, t, _ in ROWS if d == r.doc_id}


@pytest.mark.parametrize("cut", [0, 1, 5, 9])
def test_rotation_swaps_blocks_and_back(cut):
    data = np.arange(9)
    fim.rotate(data, 0, cut, 9)
    assert list(data) == [*range(cut, 9), *range(cut)]
    fim.rotate(data, 0, 9 - cut, 9)
    assert list(data) == list(range(9))

"""Quality scores: kernel, normal equations and calibration against plain versions, held-out accuracy, edge rows."""
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from messy_rows import ROWS
from pyspark.sql import functions as F

from pricelens.llm import quality

SF = "/root/testdata/sf0.01"


def test_cosines_approximate_the_kernel():
    x = np.random.default_rng(1).normal(0, 1, (40, len(quality.STATISTICS)))
    z = quality._features(x, np.zeros(x.shape[1]), np.ones(x.shape[1]))[:, :-1]
    apart = ((x[:, None] - x[None]) ** 2).sum(2)
    assert np.abs(z @ z.T - np.exp(-apart / (2 * quality.WIDTH ** 2 * x.shape[1]))).max() < 0.35
    assert np.abs(z @ z.T - np.exp(-apart / (2 * quality.WIDTH ** 2 * x.shape[1]))).mean() < 0.06


def test_isotonic_equals_brute_force():
    pick = random.Random(2)
    for _ in range(50):
        n = [pick.randint(1, 5) for _ in range(12)]
        good = [pick.randint(0, m) for m in n]
        at, mean = quality.isotonic(np.array(good, float), np.array(n, float), np.arange(12.0))
        assert (np.diff(mean) > 0).all() and (np.diff(at) > 0).all()
        fit = [max(min(sum(good[a:b + 1]) / sum(n[a:b + 1]) for b in range(k, 12)) for a in range(k + 1)) for k in range(12)]
        assert sorted(set(np.round(fit, 9))) == list(np.round(mean, 9))


def test_statistics_of_a_text():
    row = dict(zip(quality.STATISTICS, quality.statistics(pa.array(["Ab ab, 12 c$$\nxx. xx.\nxx. xx."]))[0]))
    assert row["words"] == np.log1p(8) and row["lines"] == np.log1p(3) and row["distinct_words"] == 5 / 8 and row["distinct_pairs"] == 5 / 7
    assert row["distinct_lines"] == 2 / 3 and row["line_stops"] == 2 / 3 and row["wordless"] == 1 / 8 and row["odd_endings"] == 1 / 8 and row["even_endings"] == 5 / 8
    assert row["digits"] == 2 / 29 and row["capital_starts"] == 1 / 8 and row["capitals"] == pytest.approx(1 / 13)
    empty = quality.statistics(pa.array(["", None]))
    assert np.isfinite(empty).all() and (empty[0] == empty[1]).all()


def test_normal_equations_do_not_depend_on_partitions(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    stats = quality.written(quality.measured(docs.repartition(7), ["doc_id"]))
    one, more = quality.train(stats.coalesce(1), labels), quality.train(stats.repartition(6), labels)
    rows = stats.toPandas()
    rows["id"] = [r["doc_id"] for r in rows.row]
    marked = rows.merge(labels.toPandas().rename(columns={"doc_id": "id"}), on="id")
    marked = marked[[zlib.crc32(str(i).encode()) % 3 != 1 for i in marked.id]]
    x, y = np.stack(marked.statistics), marked.quality.to_numpy(float)
    assert np.allclose(one.mean, x.mean(0)) and np.allclose(one.spread, np.where(x.std(0) > 1e-9, x.std(0), 1))
    z = quality._features(x, one.mean, one.spread)
    fits = [np.linalg.solve(z.T @ z + np.diag([p * len(y)] * quality.FEATURES + [1e-9]), z.T @ y) for p in quality.PENALTIES]
    assert min(np.abs(z @ f - z @ one.weights).max() for f in fits) < 1e-6
    assert np.abs(z @ one.weights - z @ more.weights).max() < 1e-6


def test_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    shown = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.quality_scores(docs.drop("lang", "source").withColumn("row", F.lit("clash")).withColumn("statistics", F.lit("clash")), labels).collect()
    assert len(rows) == docs.count()
    unseen = [r for r in rows if r.held_out and r.doc_id in shown]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == shown[r.doc_id] for r in unseen) >= 0.97 * len(unseen)
    kept = labels.withColumn("quality", F.when(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1"), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {(r.doc_id, r.score) for r in quality.quality_scores(docs, kept).collect()}
    assert max(abs(a - b) for (_, a), (_, b) in zip(sorted(again), sorted((r.doc_id, r.score) for r in rows))) < 1e-5  # held-out labels change nothing


def test_messy_rows_and_missing_labels(spark, messy, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int")
    some = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (6, 0), (8, None), (10, 1), (11, 1), (13, 0), (None, 1)], "doc_id long, quality int")
    bad = spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, quality int")
    for labels, want in ((none, 0.5), (bad, 0.0), (some, None)):
        rows = quality.quality_scores(messy, labels).collect()
        assert sorted((repr(r.doc_id) for r in rows)) == sorted(repr(d) for d, _, _ in ROWS)
        assert all(0 <= r.score <= 1 and (want is None or r.score == want) for r in rows)
        assert len({r.score for r in rows if r.doc_id in (5, 6)}) == 1
    assert quality.quality_scores(nothing, some).count() == 0 and quality.quality_scores(nothing, none).count() == 0

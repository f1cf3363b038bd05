"""Split execution must equal whole-group execution, and both must equal brute force."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricelens.operators.asof import asof_join, forward_join, nearest_join
from pricelens.operators.baseline import mad_rows, quantile_rows, window_blocks
from pricelens.operators.chunked import CHUNK, chunk_of, gap_islands, ordered_state
from pricelens.operators.quantiles import exact_quantiles
from pricelens.operators.rangejoin import range_join


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    # One key holds most of the rows.
    pdf = pd.DataFrame({"g": np.where(rng.random(900) < 0.7, "hot", rng.choice(list("abc"), 900)), "t": rng.choice(40_000, 900, replace=False),
                        "v": rng.integers(0, 50, 900).astype(float)})
    pdf.loc[pdf.v > 40, "v"] = np.nan
    return pdf, spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None)))


def test_ordered_state_chunked_equals_whole(points):
    _, df = points
    args = dict(previous={"p": F.col("t")}, last_known={"k": F.col("v")}, running={"s": F.col("v")})
    whole = ordered_state(df, ["g"], ["t"], None, **args).orderBy("g", "t").toPandas()
    split = ordered_state(df.withColumn(CHUNK, chunk_of("t", 1500)), ["g"], ["t"], CHUNK, **args).drop(CHUNK).orderBy("g", "t").toPandas()
    pd.testing.assert_frame_equal(whole, split[whole.columns])


def test_islands_chunked_and_gap_equal_to_limit_merges(points, spark):
    _, df = points
    n = lambda x: x.groupBy("g").agg(F.max("island")).orderBy("g").collect()
    assert n(gap_islands(df, ["g"], "t", 60)) == n(gap_islands(df, ["g"], "t", 60, chunk_width=700))
    edge = spark.createDataFrame([("x", 0), ("x", 3000), ("x", 6001)], "g string, t bigint")
    assert [r["island"] for r in gap_islands(edge, ["g"], "t", 3000).orderBy("t").collect()] == [1, 1, 2]


@pytest.mark.parametrize("width", [400, 50_000])
def test_asof_forward_nearest(points, spark, width):
    pdf, df = points
    right = df.filter("t % 3 = 0").select("g", F.col("t").alias("rt"), "v")
    left = df.filter("t % 3 <> 0").select("g", "t")
    rp = pdf[pdf.t % 3 == 0].sort_values("t")
    tol = 300
    back = {(r.g, r.t): r.m and r.m.rt for r in asof_join(left, right, ["g"], "t", "rt", tol, "m", width).collect()}
    ahead = {(r.g, r.t): r.m and r.m.rt for r in forward_join(left, right, ["g"], "t", "rt", tol, "m", width).collect()}
    near = {(r.g, r.t): r.m and r.m.rt for r in nearest_join(left, right, ["g"], "t", "rt", tol, "m", width).collect()}
    for g, t in back:
        keys = rp[rp.g == g].t.to_numpy()
        b, a = keys[(keys <= t) & (keys >= t - tol)], keys[(keys >= t) & (keys <= t + tol)]
        assert back[g, t] == (b.max() if len(b) else None)
        assert ahead[g, t] == (a.min() if len(a) else None)
        both = [k for k in keys if abs(k - t) <= tol]
        assert near[g, t] == (min(both, key=lambda k: (abs(k - t), k)) if both else None)


def test_range_join_equals_brute_force(points):
    pdf, df = points
    spans = df.select("g", F.col("t").alias("a"), (F.col("t") + 777).alias("b"))
    got = range_join(spans, df.select("g", "t"), ["g"], "a", "b", "t", width=500).count()
    want = sum(((pdf.g == r.g) & pdf.t.between(r.t, r.t + 777)).sum() for r in pdf.itertuples())
    assert got == want


@pytest.mark.parametrize("slice_values", [3, 50_000])
def test_ranked_quantiles_equal_numpy(points, monkeypatch, slice_values):
    monkeypatch.setattr("pricelens.operators.quantiles.SLICE_VALUES", slice_values)
    pdf, df = points
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.973, "e": 1.0}
    got = exact_quantiles(df, ["g"], "v", probs).toPandas().set_index("g")
    for g, rows in pdf.dropna().groupby("g"):
        assert got.loc[g, "n"] == len(rows)
        np.testing.assert_allclose([got.loc[g, k] for k in probs], np.quantile(rows.v, list(probs.values())))


def test_window_statistics():
    keys = np.array([0, 10, 20, 35, 50])
    values = np.array([1.0, 5.0, 2.0, 9.0, 4.0])
    blocks = list(window_blocks(keys, np.arange(5), 40, 10))
    (_, idx, inside), = blocks
    counts, med, sigma = mad_rows(values[idx], inside)
    assert counts.tolist() == [0, 1, 2, 3, 3]
    assert med[3] == 2.0 and abs(sigma[3] - 1.4826) < 1e-12
    assert quantile_rows(values[idx], inside, 0.95)[1][2] == pytest.approx(np.quantile([1, 5], 0.95))


def test_windows_of_several_contracts_share_a_block():
    """Fair prices of all contracts in one call equal plain medians over each window, where spreads beyond a limit leave no pair."""
    from pricelens.config import TickConfig
    from pricelens.operators.baseline import align_peers, fair_prices
    cfg, rng = TickConfig(min_pairs=3, min_pair_span_ms=1_000, baseline_ms=20_000, exclude_recent_ms=1_000), np.random.default_rng(5)
    sizes, codes = [40, 55], ["a", "b"]
    keys = np.concatenate([np.sort(rng.choice(60, n, replace=False)) * 1000 for n in sizes])
    n = len(keys)
    whole = {"market_time_key": keys, "quote_valid": rng.random(n) < 0.9, "mid_price": rng.normal(100, 1, n), "spread_ticks": np.where(rng.random(n) < 0.04, 50.0, rng.integers(1, 4, n))}
    spans = {"a": (0, 40), "b": (40, 95)}
    peers = align_peers(whole, spans, {"a": ["b", "gone"], "b": ["a"]}, cfg.reference_age_ms)
    fair, basis, _ = fair_prices(keys + np.repeat([0, 1 << 40], sizes), whole["mid_price"], whole["spread_ticks"], whole["quote_valid"], peers, np.arange(n), cfg)
    seen = 0
    for code, other in (("a", "b"), ("b", "a")):
        (lo, hi), (plo, phi) = spans[code], spans[other]
        for i in range(lo, hi):
            def latest(t):
                at = [j for j in range(plo, phi) if keys[j] <= t]
                return at[-1] if at and t - keys[at[-1]] <= cfg.reference_age_ms and whole["quote_valid"][at[-1]] else None
            window = [j for j in range(lo, hi) if keys[i] - 20_000 <= keys[j] <= keys[i] - 1_000]
            own = [whole["spread_ticks"][j] for j in window if whole["quote_valid"][j]]
            theirs = [(j, latest(keys[j])) for j in window if latest(keys[j]) is not None]
            want = np.nan
            if len(own) >= 3 and len(theirs) >= 3 and latest(keys[i]) is not None:
                limit, plimit = np.quantile(own, 0.95) + 1, np.quantile([whole["spread_ticks"][k] for _, k in theirs], 0.95) + 1
                pairs = [(j, k) for j, k in theirs if whole["quote_valid"][j] and whole["spread_ticks"][j] <= limit and whole["spread_ticks"][k] <= plimit]
                if whole["spread_ticks"][latest(keys[i])] <= plimit and len(pairs) >= 3 and keys[pairs[-1][1]] - keys[pairs[0][1]] >= 1_000:
                    want = np.median([whole["mid_price"][j] - whole["mid_price"][k] for j, k in pairs])
            assert np.isnan(basis[i, 0]) if np.isnan(want) else basis[i, 0] == pytest.approx(want)
            seen += not np.isnan(want)
    assert seen > 20 and np.isnan(basis[:, 1]).all()


def test_frames_are_ordered_once(spark):
    """The day's limits come from the collapsed frames, so the previous-row step stands once in the plan."""
    from pricelens.registry.ticks import frames
    plan = frames(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lag(_tail") == 1

"""Rows around trades: no broadcast of exploded spans, no ordering of the pairs."""
from pyspark.sql import functions as F

from pricelens.operators.rangejoin import range_join
from pricelens.plans import logs as G

DAY = ["2024-01-01", "A"]
DAY_KEYS = ["trade_date", "contract"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def trades(spark):
    rows = [(1, *DAY, 1000, 1500, 9000), (2, *DAY, 5, None, 20), (3, *DAY, 700_000, 700_900, 7_300_000), (4, "2024-01-02", "A", 10, 20, 30)]
    return spark.createDataFrame(rows, "trade_id long, trade_date string, contract string, entry_key long, hedge_key long, exit_key long")


def frames(spark):
    keys = [0, 900, 1000, 1501, 8000, 9500, 690_000, 700_901, 7_299_999, 7_310_001]
    return spark.createDataFrame([(*DAY, k, float(k), 0.0, 0.0) for k in keys], "trade_date string, contract string, market_time_key long, LastPrice double, BidPrice1 double, AskPrice1 double")


def brute(keys, trade, names, pad):
    lo, hi = trade["entry_key"] - pad, trade["exit_key"] + pad
    inside = [k for k in keys if lo <= k <= hi]
    held = {n: max([k for k in inside if trade[f"{n}_key"] is not None and k <= trade[f"{n}_key"]], default=None) for n in names}
    return {(trade["trade_id"], k, "+".join(n for n in names if held[n] == k)) for k in inside}


def expected(spark, names, pad):
    keys = [r[0] for r in frames(spark).select("market_time_key").collect()]
    return set().union(*[brute(keys, t, names, pad) for t in trades(spark).collect() if t["trade_date"] == DAY[0]])


def test_spans_are_never_broadcast(spark):
    spans = spark.range(10).select(F.lit("A").alias("k"), F.col("id").alias("a"), (F.col("id") + 15_600_000).alias("b"))
    points = spark.range(50).select(F.lit("A").alias("k"), (F.col("id") * 1_000_000).alias("p"))
    joined = range_join(spans, points, ["k"], "a", "b", "p")
    assert "Broadcast" not in plan(joined)
    assert joined.count() == sum(a <= p * 1_000_000 <= a + 15_600_000 for a in range(10) for p in range(50))


def test_trade_context_orders_only_its_inputs(spark):
    out = G.trade_context(trades(spark), frames(spark))
    assert {tuple(r) for r in out.select("trade_id", "market_time_key", "phases").collect()} == expected(spark, ["entry", "exit"], 10_000)
    assert "SortMergeJoin" in plan(out).split("Window", 1)[0]  # the join with the frames stands above every window


def test_reference_context_orders_only_its_inputs(spark):
    references = spark.createDataFrame([("A", "A", True, True)], "contract string, reference string, is_fair_reference boolean, is_hedge boolean")
    out = G.reference_context(trades(spark), frames(spark), references)
    assert {tuple(r) for r in out.select("trade_id", "market_time_key", "phases").collect()} == expected(spark, ["entry", "hedge", "exit"], 10_000)
    assert {r[0] for r in out.select("roles").collect()} == {"fair_reference+hedge"}
    assert "SortMergeJoin" in plan(out).split("Window", 1)[0]


def test_frames_know_the_next_key(spark):
    keys = [5, 5, 9, 3_599_999, 3_600_000, 3_600_000, 20_000_000, None]
    rows = [("d", c, k, i) for c in ("A", "B") for i, k in enumerate(keys) if c == "A" or k != 9] + [("d", None, 7, 0)]
    out = G.until_next(spark.createDataFrame(rows, "trade_date string, contract string, market_time_key long, n int"), DAY_KEYS)
    got = sorted(((r.contract, r.market_time_key, r.n, r._next) for r in out.collect() if r.contract), key=repr)
    after = lambda c, k: min((x[2] for x in rows if x[1] == c and x[2] is not None and x[2] > k), default=None)
    assert got == sorted(((c, k, n, after(c, k)) for _, c, k, n in rows if c and k is not None), key=repr)


def test_spans_are_shuffled_once_and_without_bounds(spark):
    references = spark.createDataFrame([("A", "A", True, True)], "contract string, reference string, is_fair_reference boolean, is_hedge boolean")
    for out, most in ((G.trade_context(trades(spark), frames(spark)), 5), (G.reference_context(trades(spark), frames(spark), references), 7)):
        text = plan(out)
        above = text.split("explode(sequence", 1)[0]
        assert text.count("explode(") == 1 and text.count("Exchange hashpartitioning") <= most
        assert "_span" not in text and "_from" not in above and "_until" not in above


def test_equal_trades_count_once_and_frames_as_often_as_they_are(spark):
    once = {tuple(r) for r in G.trade_context(trades(spark), frames(spark)).select("trade_id", "market_time_key", "phases").collect()}
    twice = G.trade_context(trades(spark).union(trades(spark)), frames(spark).union(frames(spark))).select("trade_id", "market_time_key", "phases").collect()
    assert sorted(map(tuple, twice)) == sorted([*once, *once])


def test_trade_flow_has_both_kinds_on_one_line(spark):
    events = spark.createDataFrame([(*DAY, k, "x") for k in (0, 900, 900, 30_000, 690_000)] + [(*DAY, None, "x")], "trade_date string, contract string, market_time_key long, event string")
    states = events.withColumnRenamed("event", "to_state").filter("market_time_key >= 900")
    got = sorted(map(tuple, G.trade_flow(trades(spark), events, states).select("trade_id", "market_time_key", "priority", "kind", "detail").collect()))
    inside = {1: (0, 900, 900), 2: (0, 900, 900), 3: (690_000,)}
    assert got == sorted((t, k, p, kind, "x") for t, ks in inside.items() for k in ks for p, kind in ((0, "transition"), (1, "order")) if p or k >= 900)


def test_pairs_come_point_by_point(spark):
    """Points repeat down the rows, so that a file of pairs takes little; the intervals are the side that is held."""
    spans = spark.range(40).select(F.lit("A").alias("k"), F.col("id").alias("a"), (F.col("id") + 1000).alias("b"))
    points = spark.range(50).select(F.lit("A").alias("k"), (F.col("id") + 100).alias("p"))
    found = [r.p for r in range_join(spans, points, ["k"], "a", F.col("b") + 0, "p", tasks=1).collect()]
    assert len(found) == 2000 and sum(x != y for x, y in zip(found, found[1:])) == 49

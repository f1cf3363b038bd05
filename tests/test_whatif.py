"""Statuses and costs of what-if outcomes on hand-made frames."""
from pyspark.sql import functions as F

from pricelens.config import WhatIfConfig
from pricelens.plans import whatif as W

CFG = WhatIfConfig(order_ages_seconds=(5.0,), entry_distances_bps=(10.0,), hedge_delays_seconds=(1.0,), exit_delays_seconds=(2.0,), commissions=(("D", 2.0),), margin_rates=(("D", 0.2),))
FRAME = ("trade_date string, commodity string, contract string, market_time_key bigint, is_tradable_session boolean, delta_volume double, LastPrice double, interval_vwap double, "
         "BidPrice1 double, AskPrice1 double, tick_size double, contract_multiplier int")


def _frames(contract, tick=0.1, multiplier=10, last=101.0, closed=(), bid=100.5, ask=100.2, commodity="C"):
    return [("d", commodity, contract, k, k not in closed, 1.0, 99.0 if k == 10_000 and last else last, None, bid, ask, tick, multiplier) for k in range(5_000, 13_000, 500)]


def test_statuses_in_order(spark, monkeypatch):
    frames = _frames("R", bid=100.0) + _frames("R2", multiplier=None) + _frames("Rd", bid=100.0, commodity="D") + _frames("Rc", bid=100.0, closed=range(0, 13_000, 500))
    cases = {"fill": ("R", 100.0, {}), "lost": ("R", 100.0, {}), "unpriced": ("R", None, {}), "bare": ("R", 100.0, {"tick": None}), "plainhedge": ("R2", 100.0, {}), "nohedge": ("R9", 100.0, {}),
             "closed": ("Rc", 100.0, {}), "costs": ("Rd", 100.0, {"commodity": "D"})}
    for name, (_, _, how) in cases.items():
        frames += _frames(name, **how)
    events = [("d", cases[n][2].get("commodity", "C"), n, 10_250 if n == "lost" else 10_000, "down", [cases[n][0]]) for n in cases] + [("d", "C", "fill", 10_500, "up", ["R"])]
    df = spark.createDataFrame(frames, FRAME)
    ev = spark.createDataFrame(events, "trade_date string, commodity string, contract string, event_anchor_key bigint, event_direction string, valid_peers array<string>")
    prices = spark.createDataFrame([(n, p) for n, (_, p, _) in cases.items()], "contract string, order_fair_price double")

    def placed(down, frames, cfg, ticks):
        meta = frames.groupBy(*W.K).agg(F.max("tick_size").alias("tick_size"), F.max("contract_multiplier").alias("multiplier"))
        return down.select(*W.EVENT, "valid_peers").withColumns({"order_age_seconds": F.lit(5.0), "order_time_key": F.col("event_anchor_key") - 5000}).join(prices, "contract").join(meta, W.K)

    monkeypatch.setattr(W, "placement_fairs", placed)
    got = {r.contract: r for r in W.outcomes(ev, df, CFG).collect()}
    assert {n: r.status for n, r in got.items()} == {"fill": "event_fill", "lost": "anchor_not_found", "unpriced": "order_fair_missing", "bare": "target_metadata_missing", "plainhedge": "hedge_metadata_missing",
                                                     "nohedge": "reference_contract_missing", "closed": "hedge_quote_missing", "costs": "event_fill"}
    assert round(got["fill"].net_pnl, 6) == 1 - 12 and round(got["costs"].net_pnl, 6) == 1 - 8
    assert round(got["costs"].gross_margin, 6) == round(2 * got["fill"].gross_margin, 6)

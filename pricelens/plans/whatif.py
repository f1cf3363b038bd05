"""Event-conditional what-if outcomes: events x scenarios -> placement, fill, two-leg exit, risk and status.

The outcome of one event under one scenario depends only on prices around the event, so the whole study is a
sequence of as-of and interval joins followed by one status cascade.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import TickConfig, WhatIfConfig
from ..functions.quotes import floor_to_tick
from ..operators.asof import asof_join
from ..operators.pointfair import point_fairs
from ..operators.quantiles import exact_quantiles
from ..operators.rangejoin import range_join
from ..session import materialize
from .ticks import contract_volumes, eligible_pool, reference_contracts

K = ["trade_date", "commodity", "contract"]
EVENT = [*K, "event_anchor_key"]
ORDER = [*EVENT, "order_age_seconds", "entry_distance_bps"]
TRADE = [*ORDER, "hedge_delay_seconds", "exit_delay_seconds"]


def _list(values) -> Column:
    return F.explode(F.array(*[F.lit(float(v)) for v in values]))


def _of_commodity(values: tuple[tuple[str, float], ...], default: float) -> Column:
    """The commodity's own value, else the default."""
    if not values:
        return F.lit(default)
    pairs = F.create_map(*[F.lit(x) for pair in values for x in pair])
    return F.coalesce(F.try_element_at(pairs, F.col("commodity")), F.lit(default))


def scenarios(events: DataFrame, cfg: WhatIfConfig = WhatIfConfig()) -> DataFrame:
    """The events under all parameter combinations that do not exit before they hedge."""
    return (
        events.withColumn("order_age_seconds", _list(cfg.order_ages_seconds))
        .withColumn("entry_distance_bps", _list(cfg.entry_distances_bps))
        .withColumn("hedge_delay_seconds", _list(cfg.hedge_delays_seconds))
        .withColumn("exit_delay_seconds", _list(cfg.exit_delays_seconds))
        .filter("exit_delay_seconds >= hedge_delay_seconds")
    )


def placement_fairs(events: DataFrame, frames: DataFrame, cfg: WhatIfConfig = WhatIfConfig(), ticks: TickConfig = TickConfig()) -> DataFrame:
    """Fair price of the target's latest frame at each order time, computed for these instants alone.

    order_fair_reason is empty where there is a price; ``order_fair_key`` is null where the latest frame is too old.
    """
    c = F.col
    ask = events.select(*EVENT, "valid_peers").withColumn("order_age_seconds", _list(cfg.order_ages_seconds)).withColumn(
        "order_time_key", (c("event_anchor_key") - F.rint(c("order_age_seconds") * 1000)).cast("bigint"))
    latest = frames.select(*K, "market_time_key", "tick_size", "contract_multiplier")
    found = asof_join(ask, latest, K, "order_time_key", "market_time_key", cfg.quote_age_ms, "f").withColumn("at_key", c("f.market_time_key"))
    found = materialize(found)  # asked for twice: the instants, and the orders that get their prices
    volumes = contract_volumes(frames)
    references = reference_contracts(volumes, ticks).join(eligible_pool(volumes, ticks).select(*K), K, "left_semi")
    fairs = point_fairs(found.filter("at_key is not null"), frames, references, ticks)
    reason = F.when(c("at_key").isNull(), "target_snapshot_stale").otherwise(F.coalesce("fair_reason", F.lit("insufficient_peers")))
    return found.join(fairs, [*K, "at_key"], "left").select(
        *EVENT, "valid_peers", "order_age_seconds", "order_time_key", c("at_key").alias("order_fair_key"), F.when(c("fair_price") > 0, c("fair_price")).alias("order_fair_price"),
        reason.alias("order_fair_reason"), c("f.tick_size").alias("tick_size"), c("f.contract_multiplier").alias("multiplier"))


def orders(placed: DataFrame, cfg: WhatIfConfig = WhatIfConfig()) -> DataFrame:
    c = F.col
    x = placed.withColumn("entry_distance_bps", _list(cfg.entry_distances_bps))
    x = x.withColumn("entry_price", floor_to_tick(c("order_fair_price") * (1.0 - c("entry_distance_bps") / 10_000.0), c("tick_size")))
    return x.withColumn("fill_end_key", c("event_anchor_key") + cfg.fill_window_ms)


def touches(placed: DataFrame, frames: DataFrame, cfg: WhatIfConfig = WhatIfConfig()) -> DataFrame:
    """First touch before the anchor (half-open) and first touch from the anchor to the window end (closed)."""
    c = F.col
    price = c("interval_vwap") if cfg.fill_model == "interval_upper_bound" else c("LastPrice")
    hit = (price < c("entry_price")) if cfg.fill_model == "strict_visible" else (price <= c("entry_price"))
    traded = frames.filter(c("is_tradable_session") & (c("delta_volume") > 0)).select(*K, c("market_time_key").alias("at"), "LastPrice", "interval_vwap")
    rows = range_join(placed.filter(c("entry_price") > 0), traded, K, "order_time_key", "fill_end_key", "at", extra=hit)
    before = c("at") < c("event_anchor_key")
    found = rows.groupBy(*ORDER).agg(F.min(F.when(before, c("at"))).alias("pre_touch_key"), F.min(F.when(~before, c("at"))).alias("fill_key"))
    return placed.join(found, ORDER, "left")


def _executable(rows: DataFrame, frames: DataFrame, contract: str, at: str, side: str, name: str, cfg: WhatIfConfig) -> DataFrame:
    """Adds the executable price of ``contract`` at key ``at`` (null when stale, closed or not positive)."""
    c = F.col
    quotes = frames.select("trade_date", "commodity", c("contract").alias(contract) if contract != "contract" else c("contract"),
                           c("market_time_key").alias("_qk"), c("is_tradable_session").alias("_open"), c(side).alias("_px"))
    found = asof_join(rows, quotes, ["trade_date", "commodity", contract], at, "_qk", cfg.quote_age_ms, "_q")
    good = c("_q._open") & (c("_q._px") > 0)
    return found.withColumns({name: F.when(good, c("_q._px")), f"{name}_key": F.when(good, c("_q._qk"))}).drop("_q")


def unhedged_mae(rows: DataFrame, frames: DataFrame, cfg: WhatIfConfig = WhatIfConfig()) -> DataFrame:
    """Worst bid between fill and hedge, including the quote in force at the hedge, as bps and money."""
    c = F.col
    x = _executable(rows, frames, "contract", "hedge_requested_key", "BidPrice1", "_end_bid", cfg)
    bids = frames.filter(c("BidPrice1") > 0).select(*K, c("market_time_key").alias("at"), c("BidPrice1").alias("_bid"))
    low = range_join(x.filter(c("fill_key").isNotNull()).select(*TRADE, "fill_key", "hedge_requested_key"), bids, K,
                     "fill_key", "hedge_requested_key", "at").groupBy(*TRADE).agg(F.min("_bid").alias("_low"))
    x = x.join(low, TRADE, "left")
    worst = F.least(c("_low"), c("_end_bid")) - cfg.slippage_ticks * c("tick_size")
    return x.withColumns({"unhedged_mae_bps": (worst - c("entry_price")) / c("entry_price") * 10_000,
                          "unhedged_worst_mark_pnl": (worst - c("entry_price")) * c("multiplier") * cfg.target_lots}).drop("_low", "_end_bid", "_end_bid_key")


def hedged_worst_mark(rows: DataFrame, frames: DataFrame, cfg: WhatIfConfig = WhatIfConfig()) -> DataFrame:
    """Lowest two-leg mark over the target's keys between hedge and exit, both ends included."""
    c = F.col
    legs = rows.filter(c("hedge_entry_price").isNotNull() & c("exit_requested_key").isNotNull())
    base = legs.select(*TRADE, "reference_contract", "entry_price", "hedge_entry_price", "tick_size", "multiplier", "hedge_requested_key", "exit_requested_key")
    keys = frames.select(*K, c("market_time_key").alias("mark_key"))
    inside = range_join(base, keys, K, "hedge_requested_key", "exit_requested_key", "mark_key")
    ends = base.withColumn("mark_key", F.explode(F.array("hedge_requested_key", "exit_requested_key")))
    marks = inside.unionByName(ends.select(*inside.columns)).distinct()
    priced = _executable(_executable(marks, frames, "contract", "mark_key", "BidPrice1", "_t", cfg), frames, "reference_contract", "mark_key", "AskPrice1", "_h", cfg)
    slip = cfg.slippage_ticks * c("tick_size")
    pnl = (c("_t") - slip - c("entry_price")) * c("multiplier") * cfg.target_lots + (c("hedge_entry_price") - c("_h") - slip) * c("multiplier") * cfg.hedge_lots
    worst = priced.groupBy(*TRADE).agg(F.min(pnl).alias("hedged_worst_mark_pnl"))
    return rows.join(worst, TRADE, "left")


def outcomes(events: DataFrame, frames: DataFrame, cfg: WhatIfConfig = WhatIfConfig(), ticks: TickConfig = TickConfig()) -> DataFrame:
    """One row per downward event and scenario with prices, P&L, risk and status.

    Statuses are tried in a fixed order: the anchor's frame, a reliable price, the target's tick size and multiplier, the
    entry, touches and fills, the hedge's contract and metadata, its quotes, capital and risk.
    """
    c = F.col
    # Each step is written: the next one plans over a plain table, not over all joins before it.
    anchors = frames.select(*K, c("market_time_key").alias("event_anchor_key"), F.lit(True).alias("anchor_found"))
    down = materialize(events.filter(c("event_direction") == "down"))
    found = materialize(down.select(*EVENT).join(anchors, EVENT, "left").select(*EVENT, F.coalesce("anchor_found", F.lit(False)).alias("anchor_found")))
    listed = frames.groupBy(*K).agg(F.max("tick_size").alias("_tick"), F.max("contract_multiplier").alias("_multiplier"))
    hedges = listed.select("trade_date", "commodity", c("contract").alias("reference_contract"), F.lit(True).alias("hedge_listed"), (c("_tick").isNotNull() & c("_multiplier").isNotNull()).alias("hedge_described"))
    x = materialize(touches(materialize(orders(placement_fairs(down, frames, cfg, ticks), cfg)), frames, cfg))
    x = x.withColumn("hedge_delay_seconds", _list(cfg.hedge_delays_seconds)).withColumn("exit_delay_seconds", _list(cfg.exit_delays_seconds))
    later = lambda s: (c("fill_key") + F.rint(c(s) * 1000)).cast("bigint")
    x = x.filter(c("exit_delay_seconds") >= c("hedge_delay_seconds")).withColumns({
        "reference_contract": F.get("valid_peers", F.lit(cfg.hedge_reference_index)),
        "hedge_requested_key": later("hedge_delay_seconds"), "exit_requested_key": later("exit_delay_seconds"),
    }).drop("valid_peers")
    slip = cfg.slippage_ticks * c("tick_size")
    x = _executable(x, frames, "reference_contract", "hedge_requested_key", "BidPrice1", "_hb", cfg)
    x = _executable(x, frames, "contract", "exit_requested_key", "BidPrice1", "_tb", cfg)
    x = _executable(x, frames, "reference_contract", "exit_requested_key", "AskPrice1", "_ha", cfg)
    positive = lambda e: F.when(e > 0, e)
    x = x.withColumns({"hedge_entry_price": positive(c("_hb") - slip), "target_exit_price": positive(c("_tb") - slip), "hedge_exit_price": c("_ha") + slip})
    x = materialize(unhedged_mae(materialize(x), frames, cfg))
    x = materialize(hedged_worst_mark(x, frames, cfg))
    x = x.join(found, EVENT, "left").join(hedges, ["trade_date", "commodity", "reference_contract"], "left")
    size_t, size_h = c("multiplier") * cfg.target_lots, c("multiplier") * cfg.hedge_lots
    commission = 2.0 * (cfg.target_lots + cfg.hedge_lots) * _of_commodity(cfg.commissions, cfg.commission_per_lot)
    x = x.withColumns({"target_pnl": (c("target_exit_price") - c("entry_price")) * size_t,
                       "hedge_pnl": (c("hedge_entry_price") - c("hedge_exit_price")) * size_h})
    x = x.withColumns({
        "net_pnl": c("target_pnl") + c("hedge_pnl") - commission,
        "observed_worst_net_pnl": F.least("unhedged_worst_mark_pnl", "hedged_worst_mark_pnl") - commission,
        "gross_margin": (c("entry_price") * size_t + c("hedge_entry_price") * size_h) * _of_commodity(cfg.margin_rates, cfg.margin_rate),
    })
    capital = c("gross_margin") <= cfg.account_equity * cfg.max_margin_ratio
    risk = F.coalesce(c("observed_worst_net_pnl") >= -cfg.max_single_trade_loss, F.lit(False))
    status = (
        F.when(~F.coalesce("anchor_found", F.lit(False)), "anchor_not_found").when(c("order_fair_price").isNull(), "order_fair_missing")
        .when(c("tick_size").isNull() | c("multiplier").isNull(), "target_metadata_missing").when(c("entry_price") <= 0, "entry_price_invalid")
        .when(c("pre_touch_key").isNotNull(), "pre_event_touch").when(c("fill_key").isNull(), "no_fill")
        .when(c("hedge_listed").isNull(), "reference_contract_missing").when(~c("hedge_described"), "hedge_metadata_missing").when(c("hedge_entry_price").isNull(), "hedge_quote_missing")
        .when(c("target_exit_price").isNull(), "target_exit_quote_missing").when(c("hedge_exit_price").isNull(), "hedge_exit_quote_missing")
        .when(~capital, "capital_rejected").when(~risk, "risk_rejected").otherwise("event_fill"))
    settled = c("status").isin("capital_rejected", "risk_rejected", "event_fill")
    x = x.withColumn("status", status).withColumn("model_settled", settled)
    money = ["target_pnl", "hedge_pnl", "net_pnl", "observed_worst_net_pnl", "gross_margin", "hedged_worst_mark_pnl"]
    return x.withColumns({"strategy_eligible": c("status") == "event_fill", "fill_model": F.lit(cfg.fill_model)}).withColumns(
        {m: F.when(c("model_settled"), c(m)) for m in money}).drop("_hb", "_hb_key", "_tb", "_tb_key", "_ha", "_ha_key", "anchor_found", "hedge_listed", "hedge_described")


GROUP = ["fill_model", "commodity", "contract", "order_age_seconds", "entry_distance_bps", "hedge_delay_seconds", "exit_delay_seconds"]


def summary(trades: DataFrame) -> DataFrame:
    """Per contract and scenario: status counts, rates among clean orders, sums and tail statistics."""
    c = F.col
    n = lambda s: F.count_if(c("status") == s)
    base = trades.groupBy(*GROUP).agg(
        F.countDistinct("trade_date", "event_anchor_key").alias("candidate_event_count"), F.count(F.lit(1)).alias("_rows"),
        n("pre_event_touch").alias("pre_event_touch_count"), n("no_fill").alias("no_fill_count"),
        F.count_if(c("status").contains("quote_missing")).alias("quote_failure_count"), F.count_if(c("model_settled")).alias("model_settled_count"),
        n("capital_rejected").alias("capital_rejected_count"), n("risk_rejected").alias("risk_rejected_count"),
        F.count_if(c("strategy_eligible")).alias("strategy_eligible_count"),
        F.coalesce(F.sum(F.when(c("model_settled"), c("net_pnl"))), F.lit(0.0)).alias("settled_net_pnl"),
        F.coalesce(F.sum(F.when(c("strategy_eligible"), c("net_pnl"))), F.lit(0.0)).alias("eligible_net_pnl"),
        F.count_if(c("strategy_eligible") & (c("net_pnl") > 0)).alias("_wins"),
        F.min(F.when(c("model_settled"), c("unhedged_mae_bps"))).alias("unhedged_mae_bps_min"),
        F.min(F.when(c("model_settled"), c("observed_worst_net_pnl"))).alias("observed_worst_net_pnl_min"))
    metrics = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), c(m).alias("v")) for m in ("gross_margin", "unhedged_mae_bps", "observed_worst_net_pnl")]))
    long = trades.filter("model_settled").select(*GROUP, metrics.alias("x")).select(*GROUP, "x.m", "x.v")
    q = exact_quantiles(long, [*GROUP, "m"], "v", {"p10": 0.1, "p50": 0.5})
    pick = lambda m, p: F.max(F.when(c("m") == m, c(p)))
    tails = q.groupBy(*GROUP).agg(pick("gross_margin", "p50").alias("median_gross_margin"), pick("unhedged_mae_bps", "p10").alias("unhedged_mae_bps_p10"),
                                  pick("observed_worst_net_pnl", "p10").alias("observed_worst_net_pnl_p10"))
    clean = c("_rows") - c("pre_event_touch_count")
    return base.join(tails, GROUP, "left").withColumns({
        "pre_event_touch_rate": c("pre_event_touch_count") / c("_rows"),
        "model_fill_rate_among_clean_orders": F.try_divide(c("model_settled_count"), clean),
        "strategy_eligible_rate_among_clean_orders": F.try_divide(c("strategy_eligible_count"), clean),
        "eligible_win_rate": F.try_divide(c("_wins"), c("strategy_eligible_count")),
    }).drop("_rows", "_wins")

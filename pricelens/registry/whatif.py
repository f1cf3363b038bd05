"""What-if outcomes, replay-log summaries and their reference SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..config import WhatIfConfig
from ..plans import logs as G, ticks as T, whatif as W
from ..sources.driver_tables import BARS_SQL, SNAPSHOTS_SQL, daily_bars, table
from . import ticks as TR
from .daily import r6

CFG = WhatIfConfig(commissions=(("PURCHASE", 4.0),), margin_rates=(("VIEW", 0.12),))
SHAPES = [{"W_pct": 0.4, "D_pct": 0.6, "S_pct": 0.2}, {"W_pct": 0.8, "D_pct": 1.2, "S_pct": 0.4}]
LATENCIES = [{"cancel_ack_latency_ms": 500, "new_order_ack_latency_ms": 500}, {"cancel_ack_latency_ms": 1000, "new_order_ack_latency_ms": 750}]


def _trades(spark, d):
    f, m, ev = TR._chain(spark, d)
    return W.outcomes(ev, f, CFG, TR.CFG)


def order_log(spark, d):
    e = table(spark, d, "events")
    i = F.col("event_id")
    return e.select(
        F.date_format("ts", "yyyyMMdd").alias("trade_date"), F.upper("event_type").alias("contract"), i.alias("order_seq"),
        (F.unix_millis(F.col("ts").cast("timestamp")) % 86_400_000).alias("market_time_key"),
        F.element_at(F.array(F.lit("submit"), F.lit("cancel_requested"), F.lit("ack")), (i % 3 + 1).cast("int")).alias("event"),
        F.element_at(F.array(F.lit("hedge_sell"), F.lit("target_buy"), F.lit("target_sell")), (F.floor(i / 2) % 3 + 1).cast("int")).alias("role"))


def transition_log(spark, d):
    """Every state change of the replay: one in four events changes the quoting state."""
    e = table(spark, d, "events").filter("value < 15")
    i = F.col("event_id")
    return e.select(
        F.date_format("ts", "yyyyMMdd").alias("trade_date"), F.upper("event_type").alias("contract"),
        (F.unix_millis(F.col("ts").cast("timestamp")) % 86_400_000).alias("market_time_key"),
        F.element_at(F.array(F.lit("QUOTING"), F.lit("PAUSED")), (i % 2 + 1).cast("int")).alias("to_state"),
        F.element_at(F.array(F.lit("start"), F.lit("last_price_down_confirmed"), F.lit("spread")), (i % 3 + 1).cast("int")).alias("reason"))


def trade_log(spark, d):
    """Fills: the large events, entered at the event and closed after four hours."""
    e = table(spark, d, "events").filter("value > 120")
    i, key = F.col("event_id"), F.unix_millis(F.col("ts").cast("timestamp")) % 86_400_000
    return e.select(
        i.alias("trade_id"), F.date_format("ts", "yyyyMMdd").alias("trade_date"), F.upper("event_type").alias("contract"),
        key.alias("entry_key"), (key + 14_400_000).alias("exit_key"), (F.col("value") - 160).alias("net_pnl"), (F.col("value") * 20).alias("gross_margin"),
        F.element_at(F.array(F.lit("closed"), F.lit("hedge_failure_exit"), F.lit("unclosed_end_of_day"), F.lit("capital_limit_exit")), (i % 4 + 1).cast("int")).alias("status"),
        F.upper("event_type").alias("target_contract"), F.when(i % 5 == 0, "fill_during_replace").otherwise("resting").alias("fill_context"),
        F.when(F.col("value") > 200, "detector_event_fill").otherwise("normal_move_fill").alias("event_label"))


def _daily_results(spark, d):
    t = table(spark, d, "orders")
    return t.groupBy(F.concat(F.lit("S"), (F.col("o_custkey") % 5).cast("string")).alias("scenario_id"), F.col("o_orderpriority").alias("instrument"),
                     F.date_format("o_orderdate", "yyyyMMdd").alias("trade_date")).agg(
        F.count(F.lit(1)).alias("fill_count"), F.count_if(F.col("o_orderstatus") == "F").alias("event_fills"),
        F.count_if(F.col("o_orderstatus") == "O").alias("normal_fills"), F.count_if(F.col("o_totalprice") > 400000).alias("hedge_failures"),
        F.sum(F.col("o_totalprice") - 250000).alias("net_pnl"), F.count(F.lit(1)).alias("peak_actions"), (F.max("o_totalprice") < 30000).alias("skipped"))


def _asof_state(spark, d):
    rows = order_log(spark, d).select("trade_date", "contract", "order_seq", "market_time_key")
    tr = transition_log(spark, d).groupBy("trade_date", "contract", F.col("market_time_key").alias("transition_key")).agg(F.max("to_state").alias("to_state"))
    return G.quote_state_rows(rows, tr, ["trade_date", "contract"], 7_200_000).select("order_seq", F.col("state.to_state").alias("to_state"))


def _labels(spark, d):
    f = TR.frames(spark, d).select("trade_date", "contract", "market_time_key", "snapshot_seq_end", "LastPrice")
    fills = f.select("trade_date", "contract", F.col("snapshot_seq_end").alias("fill_id"), F.col("market_time_key").alias("fill_key"))
    ev = f.filter("LastPrice < 996 or LastPrice > 1016").select("trade_date", "contract", F.col("snapshot_seq_end").alias("anchor_seq"))
    return G.label_fills(fills, ev, f, 2000).select("trade_date", "contract", "fill_id", "event_label")


def _frames_for_evidence(spark, d):
    f = TR.frames(spark, d)
    side = F.when(F.col("snapshot_seq_end") % 2 == 0, "buy").otherwise("sell")
    limit = F.round(F.col("LastPrice") + (F.col("snapshot_seq_end") % 5 - 2) * 0.1, 2)
    return f.select("snapshot_seq_end", F.array_join(G.fill_evidence(side, limit, F.lit(4)), "+").alias("evidence"),
                    F.array_join(G.fill_evidence(side, limit, F.lit(4), strict=True), "+").alias("strict_evidence"))


def _band_columns(spark, d):
    f = TR.frames(spark, d)
    direction = F.when(F.col("snapshot_seq_end") % 2 == 0, "BUY").otherwise("SELL")
    price, effective = G.directional_price(F.col("mid_price"), direction, F.lit(0.0013), F.col("tick_size"))
    return f.select("snapshot_seq_end", F.round(price + 1e-9, 6).alias("quote_price"),
                    G.in_band(effective, F.lit(0.0013), F.lit(0.00131)).alias("in_band"),
                    (effective * F.col("mid_price") > 20.0 * (F.col("AskPrice1") - F.col("BidPrice1"))).alias("spread_ok"),
                    G.grid_ticks(F.col("LastPrice"), F.col("tick_size"), 0.4).cast("bigint").alias("width_ticks"),
                    G.quote_covers_spread(G.grid_ticks(F.col("LastPrice"), F.col("tick_size"), 0.4), G.grid_ticks(F.col("LastPrice"), F.col("tick_size"), 0.6),
                                          F.col("BidPrice1"), F.col("AskPrice1"), F.col("tick_size"), 20.0).alias("covers_spread"))


OUT_COLS = ["order_fair_price", "entry_price", "hedge_entry_price", "target_exit_price", "hedge_exit_price", "unhedged_mae_bps", "net_pnl", "hedged_worst_mark_pnl", "gross_margin"]
TKEY = ["trade_date", "contract", "event_anchor_key", "order_age_seconds", "entry_distance_bps", "hedge_delay_seconds", "exit_delay_seconds"]

def _reference_rows(spark, d):
    """Each contract's references are the next two in the alphabet, the first of them its hedge."""
    names = ["CLICK", "ERROR", "PURCHASE", "SIGNUP", "VIEW"]
    pairs = [(names[i], names[(i + k) % 5], True, k == 1) for i in range(5) for k in (1, 2)]
    references = spark.createDataFrame(pairs, "contract string, reference string, is_fair_reference boolean, is_hedge boolean")
    quotes = order_log(spark, d).groupBy("trade_date", "contract", "market_time_key").agg(F.max("order_seq").cast("double").alias("LastPrice"), F.lit(0.0).alias("BidPrice1"), F.lit(0.0).alias("AskPrice1"))
    trades = trade_log(spark, d).withColumn("hedge_key", F.col("entry_key") + 60_000)
    return G.reference_context(trades, quotes, references, 600_000).select("trade_id", "reference", "roles", "market_time_key", "LastPrice", "phases")


QUERIES = {
    "joi_27_reference_context": _reference_rows,
    "joi_19_scenarios": lambda s, d: W.scenarios(TR._chain(s, d)[2].filter("event_direction = 'down'").select("trade_date", "contract", "event_anchor_key"), CFG),
    "joi_20_grid_scenarios": lambda s, d: G.scenario_grid(TR.raw_rows(s, d).select("trade_date", "contract").distinct(), SHAPES, LATENCIES),
    "joi_07_placement_fair": lambda s, d: (lambda f, m, ev: W.placement_fairs(ev.filter("event_direction = 'down'"), f, CFG, TR.CFG).select(
        "trade_date", "contract", "event_anchor_key", "order_age_seconds", "order_fair_key", "order_fair_reason", *r6("order_fair_price")))(*TR._chain(s, d)),
    "joi_21_limit_touches": lambda s, d: (lambda f, m, ev: W.touches(W.orders(W.placement_fairs(ev.filter("event_direction = 'down'"), f, CFG, TR.CFG), CFG), f, CFG).select(
        "trade_date", "contract", "event_anchor_key", "order_age_seconds", "entry_distance_bps", *r6("entry_price"), "pre_touch_key", "fill_key"))(*TR._chain(s, d)),
    "joi_08_executable_quotes": lambda s, d: _trades(s, d).filter("fill_key is not null").select(*TKEY, *r6("hedge_entry_price", "target_exit_price", "hedge_exit_price")),
    "win_24_unhedged_mae": lambda s, d: _trades(s, d).filter("fill_key is not null").select(*TKEY, *r6("unhedged_mae_bps", "unhedged_worst_mark_pnl")),
    "win_25_hedged_worst_mark": lambda s, d: _trades(s, d).filter("model_settled").select(*TKEY, *r6("hedged_worst_mark_pnl")),
    "rul_15_outcomes": lambda s, d: _trades(s, d).select(*TKEY, "status", *r6("net_pnl", "observed_worst_net_pnl", "gross_margin")),
    "agg_21_whatif_summary": lambda s, d: W.summary(_trades(s, d)).select(
        *W.GROUP, "candidate_event_count", "pre_event_touch_count", "no_fill_count", "model_settled_count", "risk_rejected_count", "strategy_eligible_count",
        *r6("settled_net_pnl", "eligible_net_pnl", "eligible_win_rate", "median_gross_margin", "unhedged_mae_bps_p10", "observed_worst_net_pnl_min", "model_fill_rate_among_clean_orders")),
    "win_28_peak_actions": lambda s, d: G.peak_actions(order_log(s, d), ["trade_date"]),
    "agg_22_replay_summary": lambda s, d: G.replay_summary(trade_log(s, d), order_log(s, d), transition_log(s, d)).select(
        "scope", "day", "target_contract", "fill_count", "detector_event_fill_count", "normal_move_fill_count", "fill_during_replace_count", "closed_count", "hedge_failure_count", "capital_limit_exit_count", "order_action_count", "peak_order_actions_per_minute",
        "reprice_count", "pause_count", *r6("net_pnl", "win_rate", "worst_net_pnl", "max_gross_margin", "hedge_failure_rate")),
    "agg_23_scenario_summary": lambda s, d: G.scenario_summary(_daily_results(s, d), 100, 20, 0.51, 0.2, 400000.0, 5).select(
        "scenario_id", "instrument", "active_days", "fill_count", "skipped_day_count", "selection_reason", "eligible", F.round("net_pnl", 2).alias("net_pnl"), F.round("daily_net_std", 2).alias("daily_net_std")),
    "agg_24_main_contract_ranking": lambda s, d: G.main_contract_ranking(daily_bars(s, d)).select("commodity", F.date_format("trade_date", "yyyy-MM-dd").alias("trade_date"), "ranking"),
    "joi_22_fill_labels": _labels,
    "joi_26_quote_state": _asof_state,
    "joi_27_trade_context": lambda s, d: G.trade_context(trade_log(s, d), order_log(s, d).groupBy("trade_date", "contract", "market_time_key").agg(
        F.max("order_seq").cast("double").alias("LastPrice"), F.lit(0.0).alias("BidPrice1"), F.lit(0.0).alias("AskPrice1")), 600_000).select("trade_id", "market_time_key", "phases"),
    "joi_28_trade_flow": lambda s, d: G.trade_flow(trade_log(s, d), order_log(s, d), transition_log(s, d), 600_000).select("trade_id", "market_time_key", "priority", "kind", "detail"),
    "prj_26_fill_evidence": _frames_for_evidence,
    "prj_27_spread_guard": lambda s, d: _band_columns(s, d).select("snapshot_seq_end", "quote_price", "spread_ok", "width_ticks", "covers_spread"),
    "prj_28_distance_band": lambda s, d: _band_columns(s, d).select("snapshot_seq_end", "in_band"),
    "win_29_slot_samples": lambda s, d: G.slot_samples(TR.frames(s, d), ["trade_date", "contract"], 5000).select("trade_date", "contract", "slot", "market_time_key", "snapshot_seq_end", "display_time", *r6("BidPrice1", "mid_price")),
    "win_33_alternate_deltas": lambda s, d: T.alternate_deltas(TR.frames(s, d), TR.CFG).select("trade_date", "contract", "market_time_key", "delta_volume"),
}

ORD = TR.EVENTS + """,
dn as (select trade_date, commodity, contract, ak, pl from ev where dir = 'down'),
rq as (select dn.*, age, ak - cast(age * 1000 as bigint) as ok from dn, (select unnest([5.0::double, 20.0::double]) as age)),
pf as (select rq.*, m.mk as fk0, m.fp as fp0, m.rel as rel0, m.tn as tn0, (select count(*) from fr w where w.trade_date = rq.trade_date and w.contract = rq.contract and w.mk between m.mk - 300000 and m.mk - 10000) as nw from rq asof left join mk_ m on rq.trade_date = m.trade_date and rq.contract = m.contract and rq.ok >= m.mk),
pl_ as (select * exclude (fk0, fp0, rel0, tn0, nw), case when ok - fk0 <= 3000 then fk0 end as fk, case when ok - fk0 <= 3000 and rel0 and fp0 > 0 then fp0 end as fair,
   case when ok - fk0 <= 3000 then (case when nw < 20 then 'target_baseline_too_short' when tn0 < 20 then 'target_spread_baseline_missing' when fp0 is null then 'insufficient_peers' when not rel0 then 'fair_uncertainty_exceeded' else '' end)
     else 'target_snapshot_stale' end as why from pf),
od as (select pl_.*, dist, round(floor(fair * (1.0::double - dist / 10000.0::double) / 0.02::double + 1e-9::double) * 0.02::double, 10) as ep from pl_, (select unnest([10.0::double, 25.0::double]) as dist)),
tc as (select o.trade_date, o.contract, o.ak, o.age, o.dist, min(f.mk) filter (where f.mk < o.ak) as pre, min(f.mk) filter (where f.mk >= o.ak) as fl
   from od o join fr f on o.trade_date = f.trade_date and o.contract = f.contract and f.mk between o.ok and o.ak + 3000 and f.tradable and f.dv > 0 and f.lp <= o.ep group by all),
o2 as (select od.*, pre, fl from od left join tc using (trade_date, contract, ak, age, dist)),
sc as (select hd, xd from (select unnest([1.0::double, 3.0::double]) as hd), (select unnest([2.0::double, 8.0::double]) as xd) where xd >= hd),
o3 as (select o2.*, hd, xd, pl[1] as ref, fl + cast(hd * 1000 as bigint) as hk, fl + cast(xd * 1000 as bigint) as xk from o2, sc),
q1 as (select o3.*, f.mk as a_k, case when f.tradable then f.bid end as a_p from o3 asof left join fr f on o3.trade_date = f.trade_date and o3.ref = f.contract and o3.hk >= f.mk),
q2 as (select q1.*, f.mk as b_k, case when f.tradable then f.bid end as b_p from q1 asof left join fr f on q1.trade_date = f.trade_date and q1.contract = f.contract and q1.xk >= f.mk),
q3 as (select q2.*, f.mk as c_k, case when f.tradable then f.ask end as c_p from q2 asof left join fr f on q2.trade_date = f.trade_date and q2.ref = f.contract and q2.xk >= f.mk),
q4 as (select q3.*, f.mk as d_k, case when f.tradable then f.bid end as d_p from q3 asof left join fr f on q3.trade_date = f.trade_date and q3.contract = f.contract and q3.hk >= f.mk),
q5 as (select *, case when hk - a_k <= 3000 and a_p > 0 and a_p - 0.02::double > 0 then a_p - 0.02::double end as he, case when xk - b_k <= 3000 and b_p > 0 then b_p - 0.02::double end as te,
   case when xk - c_k <= 3000 and c_p > 0 then c_p + 0.02::double end as hx, case when hk - d_k <= 3000 and d_p > 0 then d_p end as eb from q4),
lw as (select q.trade_date, q.contract, q.ak, q.age, q.dist, q.hd, q.xd, min(f.bid) as low from q5 q join fr f on q.trade_date = f.trade_date and q.contract = f.contract
   and f.mk between q.fl and q.hk and f.bid > 0 group by all),
q6 as (select q5.*, (least(low, eb) - 0.02::double - ep) / ep * 10000 as mae, (least(low, eb) - 0.02::double - ep) * 10 as uw from q5 left join lw using (trade_date, contract, ak, age, dist, hd, xd)),
mks as (select distinct q.trade_date, q.contract, q.ak, q.age, q.dist, q.hd, q.xd, q.ref, q.ep, q.he, k.mk as mkey from q6 q join (
   select trade_date, contract, mk from fr) k on q.trade_date = k.trade_date and q.contract = k.contract and k.mk between q.hk and q.xk where q.he is not null
   union select trade_date, contract, ak, age, dist, hd, xd, ref, ep, he, unnest([hk, xk]) from q6 where he is not null),
w1 as (select mks.*, f.mk as tk_, case when f.tradable then f.bid end as tb from mks asof left join fr f on mks.trade_date = f.trade_date and mks.contract = f.contract and mks.mkey >= f.mk),
w2 as (select w1.*, f.mk as hk_, case when f.tradable then f.ask end as hb from w1 asof left join fr f on w1.trade_date = f.trade_date and w1.ref = f.contract and w1.mkey >= f.mk),
hw as (select trade_date, contract, ak, age, dist, hd, xd, min((tb - 0.02::double - ep) * 10 + (he - hb - 0.02::double) * 10) as hworst from w2
   where mkey - tk_ <= 3000 and tb > 0 and mkey - hk_ <= 3000 and hb > 0 group by all),
q7 as (select q6.*, hworst, (te - ep) * 10 + (he - hx) * 10 - cost as net, least(uw, hworst) - cost as own, (ep * 10 + he * 10) * case when commodity = 'VIEW' then 0.12::double else 0.1::double end as marg
   from (select *, case when commodity = 'PURCHASE' then 16.0::double else 12.0::double end as cost from q6) q6 left join hw using (trade_date, contract, ak, age, dist, hd, xd)),
tr as (select *, case when fair is null then 'order_fair_missing' when ep <= 0 then 'entry_price_invalid' when pre is not null then 'pre_event_touch' when fl is null then 'no_fill'
   when ref is null then 'reference_contract_missing' when he is null then 'hedge_quote_missing' when te is null then 'target_exit_quote_missing' when hx is null then 'hedge_exit_quote_missing'
   when marg > 50000 then 'capital_rejected' when coalesce(own, -1e18) < -60 then 'risk_rejected' else 'event_fill' end as status from q7),
trs as (select *, status in ('capital_rejected', 'risk_rejected', 'event_fill') as settled from tr)"""
QT = "trade_date, contract, ak as event_anchor_key, age as order_age_seconds, dist as entry_distance_bps, hd as hedge_delay_seconds, xd as exit_delay_seconds"
LOGS = """with ol as (select strftime(ts, '%Y%m%d') as trade_date, upper(event_type) as contract, event_id as order_seq, epoch_us(ts) // 1000 % 86400000 as k,
   list_extract(['submit', 'cancel_requested', 'ack'], cast(event_id % 3 + 1 as int)) as event, event_id // 2 % 3 > 0 as for_target from events),
tl as (select strftime(ts, '%Y%m%d') as trade_date, upper(event_type) as contract, epoch_us(ts) // 1000 % 86400000 as k, list_extract(['QUOTING', 'PAUSED'], cast(event_id % 2 + 1 as int)) as to_state,
   list_extract(['start', 'last_price_down_confirmed', 'spread'], cast(event_id % 3 + 1 as int)) as reason from events where value < 15),
td as (select event_id as trade_id, strftime(ts, '%Y%m%d') as trade_date, upper(event_type) as contract, epoch_us(ts) // 1000 % 86400000 as entry_key, value - 160 as net_pnl, value * 20 as gross_margin,
   list_extract(['closed', 'hedge_failure_exit', 'unclosed_end_of_day', 'capital_limit_exit'], cast(event_id % 4 + 1 as int)) as status, event_id % 5 = 0 as replacing, value > 200 as det from events where value > 120)"""
SCOPED = LOGS + """,
sol as (select 'overall' as scope, 'ALL' as day, * from ol union all select 'day', trade_date, * from ol),
stl as (select 'overall' as scope, 'ALL' as day, * from tl union all select 'day', trade_date, * from tl),
std as (select 'overall' as scope, 'ALL' as day, * from td union all select 'day', trade_date, * from td),
pk as (select scope, day, max(n) as peak from (select scope, day, count(*) over (partition by scope, day order by k range between 60000 preceding and current row) as n from sol where event in ('submit', 'cancel_requested')) group by 1, 2)"""

ORACLE = {
    "joi_27_reference_context": LOGS + """, nm as (select unnest(['CLICK', 'ERROR', 'PURCHASE', 'SIGNUP', 'VIEW']) as contract, unnest(['ERROR', 'PURCHASE', 'SIGNUP', 'VIEW', 'CLICK']) as r1, unnest(['PURCHASE', 'SIGNUP', 'VIEW', 'CLICK', 'ERROR']) as r2),
   rf as (select contract, r1 as reference, 'fair_reference+hedge' as roles from nm union all select contract, r2, 'fair_reference' from nm),
   qt as (select trade_date, contract, k, cast(max(order_seq) as double) as lp from ol group by 1, 2, 3),
   x as (select td.trade_id, rf.reference, roles, qt.k, lp, entry_key, entry_key + 60000 as hedge_key, entry_key + 14400000 as exit_key from td join rf on td.contract = rf.contract
      join qt on qt.trade_date = td.trade_date and qt.contract = rf.reference and qt.k between entry_key - 600000 and entry_key + 14400000 + 600000),
   y as (select *, max(k) filter (where k <= entry_key) over w as a, max(k) filter (where k <= hedge_key) over w as b, max(k) filter (where k <= exit_key) over w as c from x window w as (partition by trade_id, reference))
   select trade_id, reference, roles, k as market_time_key, lp as "LastPrice", concat_ws('+', case when k = a then 'entry' end, case when k = b then 'hedge' end, case when k = c then 'exit' end) as phases from y""",
    "joi_19_scenarios": ORD + " select trade_date, contract, ak as event_anchor_key, age as order_age_seconds, dist as entry_distance_bps, hd as hedge_delay_seconds, xd as exit_delay_seconds from dn, (select unnest([5.0::double, 20.0::double]) as age), (select unnest([10.0::double, 25.0::double]) as dist), sc",
    "joi_20_grid_scenarios": "with " + SNAPSHOTS_SQL + """, q as (select * from (values (1, 0.4::double, 0.6::double, 0.2::double), (2, 0.8::double, 1.2::double, 0.4::double)) t(q, w, dd, s)), l as (select * from (values (1, 500, 500), (2, 1000, 750)) t(l, c, n))
   select 'Q0' || q || '-L0' || l as scenario_id, w as "W_pct", dd as "D_pct", s as "S_pct", c as cancel_ack_latency_ms, n as new_order_ack_latency_ms, trade_date, contract from q, l, (select distinct trade_day as trade_date, contract from snap)""",
    "joi_07_placement_fair": ORD + " select trade_date, contract, ak as event_anchor_key, age as order_age_seconds, fk as order_fair_key, why as order_fair_reason, round(fair + 1e-9::double, 6) as order_fair_price from pl_",
    "joi_21_limit_touches": ORD + " select trade_date, contract, ak as event_anchor_key, age as order_age_seconds, dist as entry_distance_bps, round(ep + 1e-9::double, 6) as entry_price, pre as pre_touch_key, fl as fill_key from o2",
    "joi_08_executable_quotes": ORD + f" select {QT}, round(he + 1e-9::double, 6) as hedge_entry_price, round(te + 1e-9::double, 6) as target_exit_price, round(hx + 1e-9::double, 6) as hedge_exit_price from trs where fl is not null",
    "win_24_unhedged_mae": ORD + f" select {QT}, round(mae + 1e-9::double, 6) as unhedged_mae_bps, round(uw + 1e-9::double, 6) as unhedged_worst_mark_pnl from trs where fl is not null",
    "win_25_hedged_worst_mark": ORD + f" select {QT}, round(hworst + 1e-9::double, 6) as hedged_worst_mark_pnl from trs where settled",
    "rul_15_outcomes": ORD + f" select {QT}, status, round(case when settled then net end + 1e-9::double, 6) as net_pnl, round(case when settled then own end + 1e-9::double, 6) as observed_worst_net_pnl, round(case when settled then marg end + 1e-9::double, 6) as gross_margin from trs",
    "agg_21_whatif_summary": ORD + f""" select '{CFG.fill_model}' as fill_model, commodity, contract, age as order_age_seconds, dist as entry_distance_bps, hd as hedge_delay_seconds, xd as exit_delay_seconds, count(distinct (trade_date, ak)) as candidate_event_count,
   count_if(status = 'pre_event_touch') as pre_event_touch_count, count_if(status = 'no_fill') as no_fill_count, count_if(settled) as model_settled_count, count_if(status = 'risk_rejected') as risk_rejected_count,
   count_if(status = 'event_fill') as strategy_eligible_count, round(coalesce(sum(net) filter (where settled), 0) + 1e-9::double, 6) as settled_net_pnl, round(coalesce(sum(net) filter (where status = 'event_fill'), 0) + 1e-9::double, 6) as eligible_net_pnl,
   round(count_if(status = 'event_fill' and net > 0) / nullif(count_if(status = 'event_fill'), 0)::double + 1e-9::double, 6) as eligible_win_rate, round(median(marg) filter (where settled) + 1e-9::double, 6) as median_gross_margin,
   round(quantile_cont(mae, 0.1) filter (where settled) + 1e-9::double, 6) as unhedged_mae_bps_p10, round(min(own) filter (where settled) + 1e-9::double, 6) as observed_worst_net_pnl_min,
   round(count_if(settled) / nullif(count(*) - count_if(status = 'pre_event_touch'), 0)::double + 1e-9::double, 6) as model_fill_rate_among_clean_orders from trs group by 1, 2, 3, 4, 5, 6, 7""",
    "win_28_peak_actions": SCOPED + " select day as trade_date, peak as peak_order_actions_per_minute from pk where scope = 'day'",
    "agg_22_replay_summary": SCOPED + """, t as (select scope, day, count(*) as fc, count_if(det) as dc, count_if(status <> 'unclosed_end_of_day') as cc, count_if(status = 'hedge_failure_exit') as hc, sum(net_pnl) as net, count_if(not det) as nc, count_if(replacing) as rpl, count_if(status = 'capital_limit_exit') as cl, arg_min(contract, (entry_key, trade_id)) as traded,
   avg(case when net_pnl > 0 then 1.0::double else 0 end) as wr, min(net_pnl) as wn, max(gross_margin) as mg from std group by 1, 2),
   o as (select scope, day, count_if(event in ('submit', 'cancel_requested')) as oc, arg_min(contract, (k, order_seq)) filter (where for_target) as quoted from sol group by 1, 2),
   s as (select scope, day, count_if(reason = 'last_price_down_confirmed') as rc, count_if(to_state = 'PAUSED' and reason <> 'start') as pc from stl group by 1, 2)
   select o.scope, o.day, coalesce(traded, quoted, '') as target_contract, coalesce(nc, 0) as normal_move_fill_count, coalesce(rpl, 0) as fill_during_replace_count, coalesce(cl, 0) as capital_limit_exit_count, coalesce(fc, 0) as fill_count, coalesce(dc, 0) as detector_event_fill_count, coalesce(cc, 0) as closed_count, coalesce(hc, 0) as hedge_failure_count, oc as order_action_count,
   coalesce(peak, 0) as peak_order_actions_per_minute, coalesce(rc, 0) as reprice_count, coalesce(pc, 0) as pause_count, round(coalesce(net, 0) + 1e-9::double, 6) as net_pnl, round(wr + 1e-9::double, 6) as win_rate,
   round(wn + 1e-9::double, 6) as worst_net_pnl, round(mg + 1e-9::double, 6) as max_gross_margin, round(hc / nullif(fc, 0)::double + 1e-9::double, 6) as hedge_failure_rate
   from o left join t using (scope, day) left join pk using (scope, day) left join s using (scope, day)""",
    "agg_23_scenario_summary": """with dl as (select 'S' || (o_custkey % 5) as scenario_id, o_orderpriority as instrument, strftime(o_orderdate, '%Y%m%d') as trade_date, count(*) as fc, count_if(o_orderstatus = 'F') as ef,
   count_if(o_orderstatus = 'O') as nf, count_if(o_totalprice > 400000) as hf, sum(o_totalprice - 250000) as net, count(*) as pa, max(o_totalprice) < 30000 as skipped from orders group by 1, 2, 3),
   g as (select scenario_id, instrument, count_if(not skipped) as active_days, cast(coalesce(sum(fc) filter (where not skipped), 0) as bigint) as fill_count, sum(ef) filter (where not skipped) as ef, sum(nf) filter (where not skipped) as nf,
   sum(hf) filter (where not skipped) as hf, sum(net) filter (where not skipped) as net, min(net) filter (where not skipped) as wd, stddev_pop(net) filter (where not skipped) as sd, max(pa) filter (where not skipped) as pk, count_if(skipped) as skipped_day_count from dl group by 1, 2),
   h as (select *, list_filter([case when fill_count < 100 then 'insufficient_fills' end, case when ef < 20 then 'insufficient_detector_event_fills' end, case when nf / fill_count > 0.51 then 'normal_move_fill_rate_too_high' end,
   case when hf / fill_count > 0.2 then 'hedge_failure_rate_too_high' end, case when wd < -400000 then 'daily_loss_too_high' end, case when pk > 5 then 'order_action_limit_exceeded' end, case when net <= 0 and fill_count > 0 then 'net_pnl_not_positive' end], lambda x: x is not null) as rs from g)
   select scenario_id, instrument, active_days, fill_count, skipped_day_count, case when len(rs) = 0 then 'eligible' else array_to_string(rs, ';') end as selection_reason, len(rs) = 0 as eligible, round(net, 2) as net_pnl, round(sd, 2) as daily_net_std from h""",
    "agg_24_main_contract_ranking": "with " + BARS_SQL + ", r as (select *, row_number() over (partition by commodity, trade_date order by volume desc, contract) as k from bars) select commodity, strftime(trade_date, '%Y-%m-%d') as trade_date, string_agg(contract, '>' order by k) as ranking from r where k <= 5 group by 1, 2",
    "joi_22_fill_labels": TR.FRAMES + """, e as (select trade_date, contract, mk from fr where lp < 996 or lp > 1016), fl as (select trade_date, contract, seq1 as fill_id, mk from fr)
   select trade_date, contract, fill_id, case when exists (select 1 from e where e.trade_date = fl.trade_date and e.contract = fl.contract and abs(e.mk - fl.mk) <= 2000) then 'detector_event_fill' else 'normal_move_fill' end as event_label from fl""",
    "joi_26_quote_state": LOGS + """, t as (select trade_date, contract, k, max(to_state) as to_state from tl group by 1, 2, 3), j as (select ol.order_seq, ol.k, t.k as tk, t.to_state from ol asof left join t on ol.trade_date = t.trade_date and ol.contract = t.contract and ol.k >= t.k)
   select order_seq, case when k - tk <= 7200000 then to_state end as to_state from j""",
    "joi_27_trade_context": LOGS + """, f as (select distinct trade_date, contract, k from ol), r as (select td.trade_id, f.k, entry_key, entry_key + 14400000 as exit_key from td join f on td.trade_date = f.trade_date and td.contract = f.contract and f.k between entry_key - 600000 and entry_key + 15000000),
   z as (select *, max(case when k <= entry_key then k end) over (partition by trade_id) as ke, max(case when k <= exit_key then k end) over (partition by trade_id) as kx from r)
   select trade_id, k as market_time_key, concat_ws('+', case when k = ke then 'entry' end, case when k = kx then 'exit' end) as phases from z""",
    "joi_28_trade_flow": LOGS + """ select trade_id, k as market_time_key, 0::bigint as priority, 'transition' as kind, to_state as detail from td join tl using (trade_date, contract) where k between entry_key - 600000 and entry_key + 15000000
   union all select trade_id, k, 1, 'order', event from td join ol using (trade_date, contract) where k between entry_key - 600000 and entry_key + 15000000""",
    "prj_26_fill_evidence": TR.FRAMES + """, z as (select *, seq1 % 2 = 0 as buy, round(lp + (seq1 % 5 - 2) * 0.1::double, 2) as lim, case when seq1 % 2 = 0 then ask else bid end as bp, case when seq1 % 2 = 0 then 1 + seq1 % 8 else 1 + seq1 % 9 end as bv from fr),
   y as (select *, coalesce(case when buy then lp <= lim else lp >= lim end, false) as r1, coalesce(case when buy then vwap <= lim else vwap >= lim end, false) as r2, coalesce(case when buy then bp <= lim else bp >= lim end, false) as r3, tradable and bid > 0 and ask >= bid as book from z)
   select seq1 as snapshot_seq_end, concat_ws('+', case when dv > 0 and r1 then 'last_trade' end, case when dv > 0 and r2 then 'interval_vwap' end, case when book and bv >= 4 and r3 then 'top_of_book' end, case when book and bv < 4 and r3 then 'partial_unknown' end) as evidence,
   case when dv > 0 and case when buy then lp < lim else lp > lim end then 'last_trade' else '' end as strict_evidence from y""",
    "prj_27_spread_guard": TR.FRAMES + """, z as (select *, seq1 % 2 = 0 as buy from fr), y as (select *, round(case when buy then floor(mid * (1 - 0.0013::double) / tick + 1e-12::double) else ceil(mid * (1 + 0.0013::double) / tick - 1e-12::double) end * tick, 10) as px from z)
   select seq1 as snapshot_seq_end, round(px + 1e-9::double, 6) as quote_price, case when buy then (mid - px) / mid else (px - mid) / mid end * mid > 20.0::double * (ask - bid) as spread_ok, cast(greatest(1, ceil(lp * 0.4::double / 100.0::double / tick - 1e-12::double)) as bigint) as width_ticks,
   coalesce(tick > 0 and bid > 0 and ask >= bid and greatest(1, ceil(lp * 0.4::double / 100.0::double / tick - 1e-12::double)) + greatest(1, ceil(lp * 0.6::double / 100.0::double / tick - 1e-12::double)) > (ask - bid) / tick * 20.0::double, false) as covers_spread from y""",
    "prj_28_distance_band": TR.FRAMES + """, z as (select *, seq1 % 2 = 0 as buy from fr), y as (select *, round(case when buy then floor(mid * (1 - 0.0013::double) / tick + 1e-12::double) else ceil(mid * (1 + 0.0013::double) / tick - 1e-12::double) end * tick, 10) as px from z)
   select seq1 as snapshot_seq_end, case when buy then (mid - px) / mid else (px - mid) / mid end between 0.0013::double - 1e-12::double and 0.00131::double + 1e-12::double as in_band from y""",
    "win_29_slot_samples": TR.FRAMES + " select trade_date, contract, mk // 5000 as slot, mk as market_time_key, seq1 as snapshot_seq_end, disp as display_time, round(bid + 1e-9::double, 6) as \"BidPrice1\", round(mid + 1e-9::double, 6) as mid_price from fr qualify row_number() over (partition by trade_date, contract, mk // 5000 order by mk) = 1",
    "win_33_alternate_deltas": TR.FRAMES + " select trade_date, contract, mk as market_time_key, case when mk - pk <= 3000 and vol > pv then vol - pv end as delta_volume from fr",
}

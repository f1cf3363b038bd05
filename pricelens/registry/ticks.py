"""Snapshot-detector queries and their reference SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..config import TickConfig
from ..functions import arrays, clock, quotes
from ..operators.asof import asof_join
from ..plans import ticks as P
from ..session import materialize
from ..sources.driver_tables import SNAPSHOTS_SQL, profiles, snapshots
from .daily import q6, r6

# The driver's snapshots are sparser than a real feed, so the noise history needs fewer samples.
CFG = TickConfig(noise_min_samples=20, noise_min_span_ms=60_000)
KID = ["trade_date", "contract", "market_time_key"]


def raw_rows(spark, d):
    return snapshots(spark, d).withColumnRenamed("trade_day", "trade_date")


def day_bounds(spark, d):
    """Daily low, high and previous settlement per contract-day; one contract in six has a foreign settlement."""
    level = (F.col("UpperLimitPrice") + F.col("LowerLimitPrice")) / 2.0
    settle = F.max(level) * F.when(F.col("contract").endswith("06"), 1.01).otherwise(1.0)
    return raw_rows(spark, d).groupBy("trade_date", "contract").agg(
        F.min(F.when(F.col("BidPrice1") > 0, F.col("BidPrice1"))).alias("low"), F.max("AskPrice1").alias("high"),
        settle.alias("pre_settle"))


def frames(spark, d):
    raw = raw_rows(spark, d)
    return P.prepare(raw, profiles(spark), CFG, day_bounds(spark, d), CFG.chunk_ms)


def enriched(spark, d):
    return P.attach_reference(materialize(frames(spark, d)), CFG)


def marked(spark, d):
    return P.mark(enriched(spark, d), CFG)


def _chain(spark, d):
    """Frames and marked frames feed several results, so they are written once."""
    raw = raw_rows(spark, d)
    width = CFG.chunk_ms
    f = P.prepare(raw, profiles(spark), CFG, day_bounds(spark, d), width)
    f = materialize(f)
    m = materialize(P.mark(P.attach_reference(f, CFG), CFG))
    return f, m, P.merge(P.candidates(m), m, CFG, width)


def events(spark, d):
    f, m, ev = _chain(spark, d)
    return P.finalize(P.recovery(ev, m, f, CFG))


def _asof_quotes(spark, d):
    f = frames(spark, d).filter("validation_status = 'validated'")
    pairs = P.reference_contracts(P.contract_volumes(f), CFG)
    left = f.select(*P.K, F.col("market_time_key").alias("at_key")).join(pairs, P.K)
    right = f.select("trade_date", "commodity", F.col("contract").alias("peer"), "market_time_key", "mid_price", "quote_valid")
    out = asof_join(left, right, ["trade_date", "commodity", "peer"], "at_key", "market_time_key", CFG.reference_age_ms, "q")
    return out.groupBy("trade_date", "contract", "peer").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("q.market_time_key").alias("n_matched"),
        F.count_if(F.col("q.quote_valid")).alias("n_valid"),
        F.sum(F.col("at_key") - F.col("q.market_time_key")).cast("bigint").alias("total_age_ms"))


def _clock_columns(spark, d):
    from ..sources.driver_tables import table
    ev = table(spark, d, "events").select("event_id", F.date_format("ts", "HH:mm:ss").alias("t"),
                                          (F.unix_millis(F.col("ts").cast("timestamp")) % 1000).alias("ms"))
    return clock.with_clock(ev, "clock", F.col("t"), F.col("ms")).select(
        "event_id", clock.session_state(F.col("t")).alias("session_state"), clock.is_tradable(F.col("t")).alias("is_tradable"),
        clock.is_open_protected(F.col("t")).alias("is_open_protected"),
        clock.cycle_key(F.col("clock")).alias("market_time_key"),
        clock.display_time(F.col("t"), F.col("ms")).alias("display_time"))


def _event_id():
    return ["trade_date", "contract", "event_direction", "event_anchor_key"]


FRAMES = "with " + SNAPSHOTS_SQL + """,
t0 as (select trade_day as trade_date, *, (cast(substr(update_time, 1, 2) as bigint) * 3600 + cast(substr(update_time, 4, 2) as bigint) * 60
   + cast(substr(update_time, 7, 2) as bigint)) * 1000 + update_ms as ck from snap),
t1 as (select *, case when ck >= 75600000 then ck - 75600000 else ck + 10800000 end as mk from t0),
t2 as (select *, coalesce(turnover < lag(turnover) over (partition by trade_date, contract order by mk, snapshot_seq), false) as drp from t1),
t3 as (select trade_date, commodity, contract, mk, arg_max(update_time, snapshot_seq) as ut, arg_max(update_ms, snapshot_seq) as um,
   arg_max(last_price, snapshot_seq) as lp, arg_max(bid, snapshot_seq) as bid, arg_max(ask, snapshot_seq) as ask,
   arg_max(volume, snapshot_seq) as vol, arg_max(turnover, snapshot_seq) as tov, arg_max(average_price, snapshot_seq) as avgp,
   max(upper_limit) as ul, max(lower_limit) as ll, min(snapshot_seq) as seq0, max(snapshot_seq) as seq1, bool_or(drp) as desync,
   count(*) as raw_rows from t2 group by 1, 2, 3, 4),
t4 as (select *, commodity <> 'SIGNUP' as ok_prof, case when commodity <> 'SIGNUP' then 0.02::double end as tick,
   (ut >= '09:00:00' and ut < '10:15:00') or (ut >= '10:30:00' and ut < '11:30:00') or (ut >= '13:30:00' and ut < '15:00:00') or ut >= '21:00:00' or ut < '02:30:00' as tradable,
   (ut >= '09:00:00' and ut < '09:01:00') or (ut >= '10:30:00' and ut < '10:31:00') or (ut >= '13:30:00' and ut < '13:31:00') or (ut >= '21:00:00' and ut < '21:01:00') as prot, ut || '.' || lpad(cast(um as varchar), 3, '0') as disp,
   case when bid > 0 and ask > 0 and ask >= bid then (bid + ask) / 2.0::double end as mid,
   lag(mk) over w as pk, lag(vol) over w as pv, lag(tov) over w as pt, lag(ut) over w as pu
   from t3 window w as (partition by trade_date, contract order by mk)),
t5 as (select *, mk - pk as gap_ms, case when mid is not null then ask - bid end / tick as spread,
   coalesce(tradable and mid > 0 and not (ul > 0 and mid >= ul - 2.0::double * tick) and not (ll > 0 and mid <= ll + 2.0::double * tick), false) as qv,
   coalesce(mk - pk <= 3000 and tradable and not prot and vol - pv > 0 and tov - pt > 0 and ((pu >= '09:00:00' and pu < '10:15:00') or (pu >= '10:30:00' and pu < '11:30:00')
     or (pu >= '13:30:00' and pu < '15:00:00') or pu >= '21:00:00' or pu < '02:30:00'), false) as usable from t4),
t6 as (select *, case when usable then cast(vol - pv as double) end as dv, case when usable and not desync then tov - pt end as dt,
   coalesce(ok_prof and avgp > 0 and vol > 0 and abs(tov / vol - avgp) <= 0.5, false) as avg_ok from t5),
bnd as (select trade_day as trade_date, contract, min(case when bid > 0 then bid end) as low, max(ask) as high,
   max((upper_limit + lower_limit) / 2.0::double) * case when contract like '%06' then 1.01::double else 1.0::double end as pre_settle
   from snap group by 1, 2),
lim as (select trade_date, contract, median(ul) as u, median(ll) as l, max(tick) as tk from t6 group by 1, 2),
band as (select lim.trade_date, lim.contract, low - 3.0::double * coalesce(tk, 0) as blo, high + 3.0::double * coalesce(tk, 0) as bhi
   from lim join bnd using (trade_date, contract) where abs((u + l) / 2.0::double - pre_settle) / pre_settle <= 0.005::double),
t7 as (select t6.*, blo, bhi, case when avg_ok and dt > 0 and dv > 0 then dt / dv / 10 end as v0 from t6 left join band using (trade_date, contract)),
t8 as (select *, coalesce(case when blo is not null then v0 < blo or v0 > bhi else ul > 0 and ll > 0 and (v0 < ll or v0 > ul) end, false) as outb from t7),
fr as (select *, case when not outb then v0 end as vwap, case when desync then 'turnover_counter_desync'
   when outb and blo is not null then 'vwap_beyond_daily' when outb then 'vwap_beyond_limit' end as qflag from t8),
vols as (select trade_date, commodity, contract, max(vol) as day_volume, bool_and(ok_prof) as okp from fr group by 1, 2, 3),
pool as (select * from (select *, count(*) over (partition by trade_date, commodity) as n from vols) where n >= 4 and okp),
refs as (select * from (select a.trade_date, a.commodity, a.contract, b.contract as peer, row_number() over (
   partition by a.trade_date, a.contract order by b.day_volume desc, b.contract) as rk
   from vols a join vols b on a.trade_date = b.trade_date and a.commodity = b.commodity and a.contract <> b.contract) where rk <= 5)"""
REFERENCE = FRAMES + """,
tg as (select fr.*, quantile_cont(spread, 0.95) filter (where qv) over b + 1 as tlim, count(*) filter (where qv and spread is not null) over b as tn
   from fr semi join pool using (trade_date, contract)
   window b as (partition by trade_date, contract order by mk range between 300000 preceding and 10000 preceding)),
tp as (select tg.trade_date, tg.commodity, tg.contract, tg.mk, tg.mid, tg.spread, tg.qv, tg.tlim, tg.tn, r.peer, r.rk
   from tg join refs r on tg.trade_date = r.trade_date and tg.contract = r.contract),
al0 as (select tp.*, f.mk as fk, f.mid as fmid, f.spread as fsp, f.qv as fqv from tp asof left join fr f
   on tp.trade_date = f.trade_date and tp.peer = f.contract and tp.mk >= f.mk),
al as (select * exclude (fk, fmid, fsp, fqv), coalesce(mk - fk <= 3000 and fqv, false) as pok,
   case when mk - fk <= 3000 and fqv then fk end as ak, case when mk - fk <= 3000 and fqv then fmid end as amid,
   case when mk - fk <= 3000 and fqv then fsp end as asp from al0),
al2 as (select *, quantile_cont(asp, 0.95) filter (where pok) over b + 1 as plim, count(asp) filter (where pok) over b as pn from al
   window b as (partition by trade_date, contract, peer order by mk range between 300000 preceding and 10000 preceding)),
bs as (select a.trade_date, a.contract, a.mk, a.peer, a.rk, a.amid, median(b.mid - b.amid) as basis, count(*) as k, max(b.ak) - min(b.ak) as sp
   from al2 a join al b on a.trade_date = b.trade_date and a.contract = b.contract and a.peer = b.peer
     and b.mk between a.mk - 300000 and a.mk - 10000
   where a.tn >= 20 and a.pn >= 20 and a.pok and a.amid > 0 and a.asp <= a.plim
     and b.qv and b.pok and b.spread <= a.tlim and b.asp <= a.plim and b.mid - b.amid is not null
   group by all having count(*) >= 20 and max(b.ak) - min(b.ak) >= 60000),
fp0 as (select trade_date, contract, mk, count(*) as np, min(rk) <= 3 as top3, median(amid + basis) as fp,
   string_agg(peer, ',' order by rk) as peers, list(peer order by rk) as pl, list(basis order by rk) as bl from bs group by 1, 2, 3),
fp1 as (select trade_date, contract, mk, 1.4826::double * median(abs(amid + basis - fp)) / 0.02::double as unc from bs join fp0 using (trade_date, contract, mk) group by 1, 2, 3),
pr as (select tg.*, coalesce(np, 0) as np, coalesce(peers, '') as peers, pl, bl,
   case when np >= 2 and top3 then fp end as fp, case when np >= 2 and top3 then unc end as unc,
   coalesce(np >= 2 and top3 and unc <= 10, false) as rel
   from tg left join fp0 using (trade_date, contract, mk) left join fp1 using (trade_date, contract, mk)),
ns0 as (select *, case when dv > 0 and rel and fp > 0 and lp > 0 then (fp - lp) / tick end as ln,
   case when dv > 0 and rel and fp > 0 and vwap > 0 then (fp - vwap) / tick end as vn from pr),
ns1 as (select *, greatest(ln, vn) as dn from ns0),
ns2 as (select *, count(ln) over b as nl, (max(mk) over b - min(mk) over b) / 1000.0::double as spn, median(ln) over b as lm, median(vn) over b as vm,
   median(dn) over b as dm from ns1 window b as (partition by trade_date, contract order by mk range between 300000 preceding and 10000 preceding)),
mad as (select a.trade_date, a.contract, a.mk, 1.4826::double * median(abs(b.ln - a.lm)) as ls, 1.4826::double * median(abs(b.vn - a.vm)) as vs,
   1.4826::double * median(abs(b.dn - a.dm)) as ds from ns2 a join ns1 b on a.trade_date = b.trade_date and a.contract = b.contract
   and b.mk between a.mk - 300000 and a.mk - 10000 group by 1, 2, 3),
ns3 as (select ns2.*, ls, vs, ds, coalesce(nl >= 20 and spn >= 60, false) as nrel from ns2 left join mad using (trade_date, contract, mk)),
en as (select *, case when nrel then greatest(20.0::double, coalesce(case when fp > 0 then fp * 5.0::double / 10000 / tick end, 0), lm + 8.0::double * ls) end as lthr,
   case when nrel then greatest(20.0::double, coalesce(case when fp > 0 then fp * 5.0::double / 10000 / tick end, 0), coalesce(vm, 0) + 8.0::double * coalesce(vs, 0)) end as vthr,
   case when fp is null and tn >= 20 then 'insufficient_peers' when fp is not null and not rel then 'fair_uncertainty_exceeded'
     when not nrel then 'insufficient_noise_history' end as blocked from ns3)"""
MARKED = REFERENCE + """,
m1 as (select *, case when fp > 0 and lp > 0 then (fp - lp) / tick end as ld, case when fp > 0 and vwap > 0 then (fp - vwap) / tick end as vd,
   bool_and(coalesce(tradable and dv > 0 and dt > 0, false)) over a as allg, max(mk) over a as reach, sum(dv) over a as sv, sum(dt) over a as st,
   last_value(disp) over a as etime
   from en window a as (partition by trade_date, contract order by mk range between current row and 1000 following)),
m2 as (select *, allg and reach = mk + 1000 as conf, case when allg and reach = mk + 1000 then st / sv / 10 end as cvw,
   case when not allg then 'counter_sync_unconfirmed' when reach <> mk + 1000 then 'confirmation_incomplete' end as cblock,
   coalesce(median(case when dv > 0 then greatest(coalesce(ld, 0), coalesce(vd, 0)) end) over p, 0) as pre_d,
   coalesce(median(case when dv > 0 then greatest(coalesce(-ld, 0), coalesce(-vd, 0)) end) over p, 0) as pre_u,
   coalesce(tradable and not (ll > 0 and lp <= ll) and not (ul > 0 and lp >= ul) and dv > 0 and rel and nrel and not prot, false) as elig
   from m1 window p as (partition by trade_date, contract order by mk range between 3000 preceding and 1 preceding)),
m3 as (select *, elig and (coalesce(vd >= vthr, false) or coalesce(-vd >= vthr, false)) as asks, coalesce(gap_ms <= 3000, true) as onset_ok from m2),
m4 as (select *, case when asks then cvw end as cv1, (fp - case when asks then cvw end) / tick as cd,
   coalesce(elig and ld >= lthr, false) as vis_d, coalesce(elig and -ld >= lthr, false) as vis_u from m3),
m5 as (select *, coalesce(asks and vd >= vthr and cd >= vthr, false) as int_d, coalesce(asks and -vd >= vthr and -cd >= vthr, false) as int_u from m4),
m6 as (select *, greatest(case when vis_d then ld end, case when int_d then cd end) as dep_d,
   greatest(case when vis_u then -ld end, case when int_u then -cd end) as dep_u from m5),
m7 as (select *, greatest(0, dep_d - greatest(0, pre_d)) as on_d, greatest(0, dep_u - greatest(0, pre_u)) as on_u,
   greatest(8.0::double, 5.0::double * coalesce(ds, 1.0)) as onmin from m6),
mk_ as (select *, coalesce(onset_ok and dep_d is not null and on_d >= onmin, false) as cand_d, coalesce(onset_ok and dep_u is not null and on_u >= onmin, false) as cand_u,
   list_sort(list_distinct(list_filter([qflag, case when asks then cblock end,
     case when asks and conf and ((coalesce(vd >= vthr, false) and not int_d) or (coalesce(-vd >= vthr, false) and not int_u)) then 'counter_lag_suspect' end,
     case when (vis_d or vis_u or int_d or int_u) and not onset_ok then 'onset_data_gap' end], lambda x: x is not null))) as dq from m7),
cands as (select *, 'down' as dir, dep_d as depth, on_d as onset, vis_d as vis, int_d as intv from mk_ where cand_d
   union all select *, 'up', dep_u, on_u, vis_u, int_u from mk_ where cand_u)"""
EVENTS = MARKED + """,
g1 as (select *, case when mk - lag(mk) over (partition by trade_date, contract, dir order by mk) <= 3000 then 0 else 1 end as st from cands),
g2 as (select *, sum(st) over (partition by trade_date, contract, dir order by mk rows between unbounded preceding and current row) as isl from g1),
g3 as (select *, row_number() over (partition by trade_date, contract, dir, isl order by depth desc, mk) as rk0, min(mk) over g as k0, max(mk) over g as k1,
   bool_or(vis) over g as any_vis, bool_or(intv) over g as any_int from g2 window g as (partition by trade_date, contract, dir, isl)),
evr as (select *, mk as ak from g3 where rk0 = 1),
evv as (select e.trade_date, e.contract, e.dir, e.ak, sum(f.dv) as evol from evr e join fr f on e.trade_date = f.trade_date and e.contract = f.contract
   and f.mk between e.k0 and e.k1 and f.dv > 0 group by all),
ev as (select evr.*, coalesce(evol, 0) as event_volume from evr left join evv using (trade_date, contract, dir, ak)),
rw as (select e.trade_date, e.commodity, e.contract, e.dir, e.ak, e.pl, e.bl, e.any_vis, e.any_int, e.lthr as thl, e.vthr as thv, m.mk, m.gap_ms, m.lp, m.dv, m.bid, m.ask,
   m.conf, m.cvw from ev e join mk_ m on e.trade_date = m.trade_date and e.contract = m.contract and m.mk > e.ak and m.mk <= e.ak + 10000),
lg as (select trade_date, contract, dir, ak, mk, unnest(pl) as peer, unnest(bl) as basis from rw),
lg2 as (select lg.*, f.mk as fk, f.mid as fmid, f.qv as fqv from lg asof left join fr f on lg.trade_date = f.trade_date and lg.peer = f.contract and lg.mk >= f.mk),
rf as (select trade_date, contract, dir, ak, mk, median(fmid + basis) as rfp from lg2 where mk - fk <= 3000 and fqv group by all having count(*) >= 2),
rr as (select rw.*, rfp, (mk - ak) / 1000.0::double as el, case when dir = 'down' then 1 else -1 end as sg from rw left join rf using (trade_date, contract, dir, ak, mk)),
re as (select trade_date, contract, dir, ak, bool_or(coalesce(gap_ms > 3000, false)) or count(rfp) = 0 as cut,
   min(case when any_vis and dv > 0 and lp > 0 and sg * (rfp - lp) / 0.02::double < thl then el end) as vis_s,
   min(case when any_int and conf and sg * (rfp - cvw) / 0.02::double < thv then el + 1 end) as int_s,
   min(case when case when dir = 'down' then bid else ask end > 0 and sg * (rfp - case when dir = 'down' then bid else ask end) / 0.02::double < thl then el end) as quo_s
   from rr group by all),
rec as (select ev.*, coalesce(cut, true) as trunc, case when not cut then vis_s end as vs_, case when not cut then int_s end as is_, case when not cut then quo_s end as qs_
   from ev left join re using (trade_date, contract, dir, ak)),
fin as (select *, case when trunc then 'truncated'
     when (not any_vis or coalesce(vs_ <= 3, false)) and (not any_int or coalesce(is_ <= 3, false)) then 'trade_recovered_3s'
     when qs_ <= 3 then 'quote_only_recovered_3s'
     when (not any_vis or coalesce(vs_ <= 10, false)) and (not any_int or coalesce(is_ <= 10, false)) then 'trade_recovered_10s'
     when qs_ <= 10 then 'quote_only_recovered_10s' else 'persistent_10s' end as label,
   contract || '|' || disp || case when dir = 'up' then '|up' else '' end as event_id from rec)"""
QK = "trade_date, contract, mk as market_time_key"
QE = "trade_date, contract, dir as event_direction, ak as event_anchor_key"

QUERIES = {
    "prj_09_session_state": lambda s, d: _clock_columns(s, d).select("event_id", "session_state", "is_tradable"),
    "prj_10_cycle_key": lambda s, d: _clock_columns(s, d).select("event_id", "market_time_key"),
    "prj_11_display_time": lambda s, d: _clock_columns(s, d).select("event_id", "display_time"),
    "prj_12_open_protected": lambda s, d: _clock_columns(s, d).select("event_id", "is_open_protected"),
    "win_06_collapse_same_key": lambda s, d: frames(s, d).select(*KID, "snapshot_seq_start", "snapshot_seq_end", "raw_rows", *r6("LastPrice")),
    "win_07_turnover_desync": lambda s, d: frames(s, d).select(*KID, "frame_turnover_desync"),
    "prj_13_mid_spread": lambda s, d: frames(s, d).select(*KID, *r6("mid_price", "spread_ticks")),
    "prj_14_quote_valid": lambda s, d: frames(s, d).filter("validation_status = 'validated'").select(*KID, "quote_valid"),
    "joi_24_profile_join": lambda s, d: frames(s, d).groupBy("commodity", "validation_status").agg(
        F.count(F.lit(1)).alias("n_frames"), F.max("tick_size").alias("tick_size")),
    "win_08_guarded_deltas": lambda s, d: frames(s, d).select(*KID, *r6("delta_volume", "delta_turnover")),
    "prj_18_average_price_check": lambda s, d: frames(s, d).select(*KID, "avg_trade_price_enabled"),
    "prj_19_interval_vwap": lambda s, d: frames(s, d).select(*KID, *r6("interval_vwap")),
    "prj_20_vwap_band": lambda s, d: frames(s, d).select(*KID, "quality_flag"),
    "src_08_daily_bounds": lambda s, d: day_bounds(s, d).select("trade_date", "contract", *r6("low", "high", "pre_settle")),
    "top_02_reference_contracts": lambda s, d: P.reference_contracts(P.contract_volumes(frames(s, d)), CFG).select(
        "trade_date", "contract", "peer", F.col("peer_rank").cast("bigint").alias("peer_rank")),
    "rul_13_target_pool": lambda s, d: P.eligible_pool(P.contract_volumes(frames(s, d)), CFG).select(
        "trade_date", "contract", F.col("pool_size").cast("bigint").alias("pool_size")),
    "joi_06_peer_asof": _asof_quotes,
    "agg_06_fair_price": lambda s, d: enriched(s, d).select(
        *KID, *r6("fair_price", "fair_uncertainty_ticks"), "fair_price_reliable", "valid_peer_count",
        F.array_join("valid_peers", ",").alias("peer_contracts")),
    "win_10_peer_basis": lambda s, d: enriched(s, d).select(
        *KID, F.posexplode(F.arrays_zip("valid_peers", "peer_bases"))).select(
        *KID, F.col("col.valid_peers").alias("peer"), F.round(F.col("col.peer_bases") + 1e-9, 6).alias("basis")),
    "win_11_noise_history": lambda s, d: enriched(s, d).select(
        *KID, "noise_sample_count", "noise_history_reliable", *r6(
            "noise_time_span_seconds", "last_noise_median", "last_noise_robust_sigma", "vwap_noise_median",
            "vwap_noise_robust_sigma", "execution_depth_robust_sigma")),
    "win_12_thresholds": lambda s, d: enriched(s, d).select(*KID, *r6("last_threshold_ticks", "vwap_threshold_ticks")),
    "rul_10_reference_gate": lambda s, d: enriched(s, d).select(*KID, "reference_blocked_reason"),
    "win_13_confirmation": lambda s, d: marked(s, d).select(*KID, "confirmed", *r6("confirmed_vwap"), "confirmation_block"),
    "win_14_onset": lambda s, d: marked(s, d).select(*KID, "onset_ok", *r6("pre_depth_down", "pre_depth_up")),
    "prj_15_directional_depths": lambda s, d: marked(s, d).select(*KID, *r6("last_down_ticks", "last_up_ticks", "vwap_down_ticks", "vwap_up_ticks")),
    "prj_21_quality_flags": lambda s, d: marked(s, d).select(*KID, F.array_join("data_quality_flags", ",").alias("data_quality_flags")),
    "rul_11_candidate_trigger": lambda s, d: marked(s, d).select(
        *KID, *r6("candidate_down_depth", "candidate_up_depth", "onset_down_ticks", "onset_up_ticks")).filter(
        "candidate_down_depth is not null or candidate_up_depth is not null"),
    "set_02_direction_split": lambda s, d: P.candidates(marked(s, d)).select(
        *KID, "event_direction", *r6("candidate_execution_depth"), F.array_join("trigger_reasons", ",").alias("trigger_reasons")),
    "win_15_event_merge": lambda s, d: _chain(s, d)[2].select(
        *_event_id(), "event_start_key", "event_end_key", *r6("candidate_execution_depth")),
    "joi_10_event_volume": lambda s, d: _chain(s, d)[2].select(*_event_id(), *r6("event_volume")),
    "win_16_reason_union": lambda s, d: _chain(s, d)[2].select(*_event_id(), F.array_join("trigger_reasons", ",").alias("trigger_reasons")),
    "joi_09_recovery_fair": lambda s, d: (lambda f, m, ev: P.recovery_fair(
        ev.select(*P.EVENT_KEY, (F.col("event_anchor_key") + 2000).alias("at_key"), "valid_peers", "peer_bases"), f, CFG).select(
        *_event_id(), *r6("recovery_fair_price")))(*_chain(s, d)),
    "win_23_channel_recovery": lambda s, d: events(s, d).select(
        *_event_id(), "recovery_truncated", *r6("visible_recovered_seconds", "interval_recovered_seconds", "quote_recovered_seconds", "ask_recovered_seconds")),
    "rul_12_recovery_label": lambda s, d: events(s, d).select(*_event_id(), "recovery_label"),
    "prj_31_event_fields": lambda s, d: events(s, d).select(
        "trade_date", "event_id", *r6("event_depth_ticks", "event_depth_bps", "last_down_bps", "vwap_up_bps", "notional_shortfall", "notional_excess"), "peer_contracts"),
    "joi_11_anchor_lookup": lambda s, d: (lambda f, m, ev: ev.select(
        "trade_date", "commodity", "contract", "event_direction", F.col("event_anchor_key").alias("market_time_key")).join(
        f.select(*P.K, "market_time_key", "display_time", "LastPrice"), [*P.K, "market_time_key"]).select(
        "trade_date", "contract", "event_direction", "market_time_key", "display_time", *r6("LastPrice")))(*_chain(s, d)),
    "joi_12_replay_target": lambda s, d: (lambda f, m, ev: P.replay_target(P.finalize(ev), m, CFG).select(
        "trade_date", "event_id", "market_time_key", "is_candidate_anchor", *r6("fair_price")))(*_chain(s, d)),
    "joi_12_replay_peers": lambda s, d: (lambda f, m, ev: P.replay_peers(P.finalize(ev), f, CFG).select(
        "trade_date", "event_id", "contract", "market_time_key", "is_reference_anchor"))(*_chain(s, d)),
    "joi_13_nearest_peer": lambda s, d: (lambda f, m, ev: P.nearest_peer_frame(P.finalize(ev), f, CFG).select(
        "trade_date", "event_id", "contract", F.col("near.market_time_key").alias("near_key")))(*_chain(s, d)),
    "agg_12_diagnostics": lambda s, d: (lambda f, m, ev: P.diagnostics(f, m, ev).drop("commodity"))(*_chain(s, d)),
}

ORACLE = {
    "prj_09_session_state": """with e as (select event_id, strftime(ts, '%H:%M:%S') as t from events)
   select event_id, case when (t >= '09:00:00' and t < '10:15:00') or (t >= '10:30:00' and t < '11:30:00') or (t >= '13:30:00' and t < '15:00:00') then 'continuous_trading'
   when t >= '21:00:00' or t < '02:30:00' then 'night_trading' when (t >= '08:55:00' and t < '09:00:00') or (t >= '20:55:00' and t < '21:00:00') then 'pre_open_snapshot'
   when t < '09:00:00' then 'closed_break' when t >= '10:15:00' and t < '10:30:00' then 'intermission' when t >= '11:30:00' and t < '13:30:00' then 'lunch'
   when t >= '15:00:00' and t < '21:00:00' then 'closed_break' else 'off_session' end as session_state,
   (t >= '09:00:00' and t < '10:15:00') or (t >= '10:30:00' and t < '11:30:00') or (t >= '13:30:00' and t < '15:00:00') or t >= '21:00:00' or t < '02:30:00' as is_tradable from e""",
    "prj_10_cycle_key": "select event_id, case when m >= 75600000 then m - 75600000 else m + 10800000 end as market_time_key from (select event_id, (epoch_us(ts) // 1000) % 86400000 as m from events)",
    "prj_11_display_time": "select event_id, strftime(ts, '%H:%M:%S') || '.' || lpad(cast((epoch_us(ts) // 1000) % 1000 as varchar), 3, '0') as display_time from events",
    "prj_12_open_protected": "select event_id, (s between 32400 and 32459) or (s between 37800 and 37859) or (s between 48600 and 48659) or (s between 75600 and 75659) as is_open_protected from (select event_id, (epoch_us(ts) // 1000) % 86400000 // 1000 as s from events)",
    "win_06_collapse_same_key": FRAMES + f" select {QK}, seq0 as snapshot_seq_start, seq1 as snapshot_seq_end, raw_rows, round(lp + 1e-9::double, 6) as \"LastPrice\" from fr",
    "win_07_turnover_desync": FRAMES + f" select {QK}, desync as frame_turnover_desync from fr",
    "prj_13_mid_spread": FRAMES + f" select {QK}, round(mid + 1e-9::double, 6) as mid_price, round(spread + 1e-9::double, 6) as spread_ticks from fr",
    "prj_14_quote_valid": FRAMES + f" select {QK}, qv as quote_valid from fr where ok_prof",
    "joi_24_profile_join": FRAMES + " select commodity, case when ok_prof then 'validated' else 'unvalidated_commodity' end as validation_status, count(*) as n_frames, max(tick) as tick_size from fr group by 1, 2",
    "win_08_guarded_deltas": FRAMES + f" select {QK}, round(dv + 1e-9::double, 6) as delta_volume, round(dt + 1e-9::double, 6) as delta_turnover from fr",
    "prj_18_average_price_check": FRAMES + f" select {QK}, avg_ok as avg_trade_price_enabled from fr",
    "prj_19_interval_vwap": FRAMES + f" select {QK}, round(vwap + 1e-9::double, 6) as interval_vwap from fr",
    "prj_20_vwap_band": FRAMES + f" select {QK}, qflag as quality_flag from fr",
    "src_08_daily_bounds": FRAMES + f" select trade_date, contract, {q6('low', 'high', 'pre_settle')} from bnd",
    "top_02_reference_contracts": FRAMES + " select trade_date, contract, peer, rk as peer_rank from refs",
    "rul_13_target_pool": FRAMES + " select trade_date, contract, n as pool_size from pool",
    "joi_06_peer_asof": FRAMES + """, l as (select f.trade_date, f.contract, f.mk, r.peer from fr f join refs r on f.trade_date = r.trade_date and f.contract = r.contract where f.ok_prof),
   j as (select l.*, f.mk as fk, f.qv from l asof left join fr f on l.trade_date = f.trade_date and l.peer = f.contract and l.mk >= f.mk)
   select trade_date, contract, peer, count(*) as n_rows, count_if(mk - fk <= 3000) as n_matched, count_if(mk - fk <= 3000 and qv) as n_valid,
   cast(sum(mk - fk) filter (where mk - fk <= 3000) as bigint) as total_age_ms from j group by all""",
    "agg_06_fair_price": REFERENCE + f" select {QK}, round(fp + 1e-9::double, 6) as fair_price, round(unc + 1e-9::double, 6) as fair_uncertainty_ticks, rel as fair_price_reliable, np as valid_peer_count, peers as peer_contracts from en",
    "win_10_peer_basis": REFERENCE + f" select trade_date, contract, mk as market_time_key, peer, round(basis + 1e-9::double, 6) as basis from bs",
    "win_11_noise_history": REFERENCE + f" select {QK}, nl as noise_sample_count, nrel as noise_history_reliable, round(coalesce(spn, 0) + 1e-9::double, 6) as noise_time_span_seconds, " + ", ".join(
        f"round(case when nrel then {e} end + 1e-9::double, 6) as {n}" for e, n in (("lm", "last_noise_median"), ("ls", "last_noise_robust_sigma"),
        ("coalesce(vm, 0)", "vwap_noise_median"), ("coalesce(vs, 0)", "vwap_noise_robust_sigma"), ("coalesce(ds, 0)", "execution_depth_robust_sigma"))) + " from en",
    "win_12_thresholds": REFERENCE + f" select {QK}, round(lthr + 1e-9::double, 6) as last_threshold_ticks, round(vthr + 1e-9::double, 6) as vwap_threshold_ticks from en",
    "rul_10_reference_gate": REFERENCE + f" select {QK}, blocked as reference_blocked_reason from en",
    "win_13_confirmation": MARKED + f" select {QK}, conf as confirmed, round(cvw + 1e-9::double, 6) as confirmed_vwap, cblock as confirmation_block from mk_",
    "win_14_onset": MARKED + f" select {QK}, onset_ok, round(pre_d + 1e-9::double, 6) as pre_depth_down, round(pre_u + 1e-9::double, 6) as pre_depth_up from mk_",
    "prj_15_directional_depths": MARKED + f" select {QK}, round(ld + 1e-9::double, 6) as last_down_ticks, round(-ld + 1e-9::double, 6) as last_up_ticks, round(vd + 1e-9::double, 6) as vwap_down_ticks, round(-vd + 1e-9::double, 6) as vwap_up_ticks from mk_",
    "prj_21_quality_flags": MARKED + f" select {QK}, array_to_string(dq, ',') as data_quality_flags from mk_",
    "rul_11_candidate_trigger": MARKED + f" select {QK}, round(case when cand_d then dep_d end + 1e-9::double, 6) as candidate_down_depth, round(case when cand_u then dep_u end + 1e-9::double, 6) as candidate_up_depth, round(case when cand_d then on_d end + 1e-9::double, 6) as onset_down_ticks, round(case when cand_u then on_u end + 1e-9::double, 6) as onset_up_ticks from mk_ where cand_d or cand_u",
    "set_02_direction_split": MARKED + f" select {QK}, dir as event_direction, round(depth + 1e-9::double, 6) as candidate_execution_depth, concat_ws(',', case when vis then 'visible_execution_' || case when dir = 'down' then 'drop' else 'spike' end end, case when intv then 'interval_execution_' || case when dir = 'down' then 'drop' else 'spike' end end) as trigger_reasons from cands",
    "win_15_event_merge": EVENTS + f" select {QE}, k0 as event_start_key, k1 as event_end_key, round(depth + 1e-9::double, 6) as candidate_execution_depth from ev",
    "joi_10_event_volume": EVENTS + f" select {QE}, round(event_volume + 1e-9::double, 6) as event_volume from ev",
    "win_16_reason_union": EVENTS + f" select {QE}, concat_ws(',', case when any_vis then 'visible_execution_' || case when dir = 'down' then 'drop' else 'spike' end end, case when any_int then 'interval_execution_' || case when dir = 'down' then 'drop' else 'spike' end end) as trigger_reasons from ev",
    "joi_09_recovery_fair": EVENTS + f""", l as (select trade_date, contract, dir, ak, ak + 2000 as mk, unnest(pl) as peer, unnest(bl) as basis from ev),
   j as (select l.*, f.mk as fk, f.mid as fmid, f.qv as fqv from l asof left join fr f on l.trade_date = f.trade_date and l.peer = f.contract and l.mk >= f.mk)
   select {QE}, round(median(fmid + basis) + 1e-9::double, 6) as recovery_fair_price from j where mk - fk <= 3000 and fqv group by trade_date, contract, dir, ak having count(*) >= 2""",
    "win_23_channel_recovery": EVENTS + f" select {QE}, trunc as recovery_truncated, round(vs_ + 1e-9::double, 6) as visible_recovered_seconds, round(is_ + 1e-9::double, 6) as interval_recovered_seconds, round(case when dir = 'down' then qs_ end + 1e-9::double, 6) as quote_recovered_seconds, round(case when dir = 'up' then qs_ end + 1e-9::double, 6) as ask_recovered_seconds from fin",
    "rul_12_recovery_label": EVENTS + f" select {QE}, label as recovery_label from fin",
    "prj_31_event_fields": EVENTS + """ select trade_date, event_id, round(depth + 1e-9::double, 6) as event_depth_ticks, round(depth * tick / fp * 10000 + 1e-9::double, 6) as event_depth_bps,
   round(ld * tick / fp * 10000 + 1e-9::double, 6) as last_down_bps, round(-vd * tick / fp * 10000 + 1e-9::double, 6) as vwap_up_bps,
   round(coalesce(case when dir = 'down' and fp > vwap then (fp - vwap) * dv * 10 end, 0) + 1e-9::double, 6) as notional_shortfall,
   round(coalesce(case when dir = 'up' and vwap > fp then (vwap - fp) * dv * 10 end, 0) + 1e-9::double, 6) as notional_excess, peers as peer_contracts from fin""",
    "joi_11_anchor_lookup": EVENTS + " select trade_date, contract, dir as event_direction, ak as market_time_key, disp as display_time, round(lp + 1e-9::double, 6) as \"LastPrice\" from ev",
    "joi_12_replay_target": EVENTS + """ select e.trade_date, e.event_id, m.mk as market_time_key, m.mk = e.ak as is_candidate_anchor, round(m.fp + 1e-9::double, 6) as fair_price
   from fin e join mk_ m on e.trade_date = m.trade_date and e.contract = m.contract and m.mk between e.ak - 10000 and e.ak + 10000""",
    "joi_12_replay_peers": EVENTS + """, lp_ as (select trade_date, event_id, ak, unnest(pl) as peer from fin)
   select e.trade_date, e.event_id, e.peer as contract, f.mk as market_time_key, row_number() over (partition by e.trade_date, e.event_id, e.peer order by abs(f.mk - e.ak), f.mk) = 1 as is_reference_anchor
   from lp_ e join fr f on e.trade_date = f.trade_date and e.peer = f.contract and f.mk between e.ak - 10000 and e.ak + 10000""",
    "joi_13_nearest_peer": EVENTS + """, lp_ as (select trade_date, event_id, ak, unnest(pl) as peer from fin)
   select e.trade_date, e.event_id, e.peer as contract, arg_min(f.mk, abs(f.mk - e.ak) * 1000000000 + f.mk) as near_key
   from lp_ e left join fr f on e.trade_date = f.trade_date and e.peer = f.contract and f.mk between e.ak - 10000 and e.ak + 10000 group by 1, 2, 3""",
    "agg_12_diagnostics": EVENTS + """, b as (select trade_date, contract, case when bool_and(ok_prof) then 'validated' else 'unvalidated_commodity' end as validation_status,
   cast(sum(raw_rows) as bigint) as raw_rows, count(*) as merged_rows, count_if(tradable) as tradable_rows, count_if(not tradable) as session_blocked_rows,
   count_if(not ok_prof) as metadata_blocked_rows, arg_max(vol, mk) as day_total_volume from fr group by 1, 2),
   c as (select trade_date, contract, count_if(blocked = 'insufficient_peers') as peer_blocked_rows, count_if(blocked = 'fair_uncertainty_exceeded') as fair_blocked_rows,
   count_if(blocked = 'insufficient_noise_history') as noise_blocked_rows, count_if(list_contains(dq, 'counter_sync_unconfirmed')) as counter_unconfirmed_rows,
   count_if(list_contains(dq, 'counter_lag_suspect')) as counter_lag_rows from mk_ group by 1, 2),
   g as (select trade_date, contract, count(*) as candidate_events from ev group by 1, 2)
   select b.*, coalesce(peer_blocked_rows, 0) as peer_blocked_rows, coalesce(fair_blocked_rows, 0) as fair_blocked_rows, coalesce(noise_blocked_rows, 0) as noise_blocked_rows,
   coalesce(counter_unconfirmed_rows, 0) as counter_unconfirmed_rows, coalesce(counter_lag_rows, 0) as counter_lag_rows, coalesce(candidate_events, 0) as candidate_events
   from b left join c using (trade_date, contract) left join g using (trade_date, contract)""",
}

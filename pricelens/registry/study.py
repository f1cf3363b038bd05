"""Deviation-study queries and their reference SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..config import StudyConfig
from ..operators.asof import forward_join
from ..plans import study as P
from ..sources.driver_tables import SNAPSHOTS_SQL, snapshots
from .daily import q6, r6

CFG = StudyConfig(chunk_rows=500)


def raw_rows(spark, d):
    """Snapshots with a few unusable clocks and volumes, in row order."""
    s = snapshots(spark, d)
    seq = F.col("snapshot_seq")
    return s.select(
        F.col("trade_day").alias("trade_date"), "TradingDay", F.col("contract").alias("InstrumentID"), "commodity",
        seq.alias("row_order"), F.when(seq % 307 == 0, "bad").otherwise(F.col("UpdateTime")).alias("UpdateTime"),
        "UpdateMillisec", F.when(seq % 401 == 0, F.lit(None)).otherwise(F.col("LastPrice")).alias("LastPrice"),
        F.when(seq % 211 == 0, F.lit(-1)).otherwise(F.col("Volume")).cast("bigint").alias("Volume"),
        "BidPrice1", "AskPrice1", "BidVolume1", "AskVolume1",
    )


def prepared(spark, d):
    rows, chunk = P.row_chunks(raw_rows(spark, d), CFG)
    return P.prepare(rows, CFG, chunk)


def _events(spark, d):
    rows, chunk = P.row_chunks(raw_rows(spark, d), CFG)
    return P.prepared_events(rows, CFG, chunk)


def details(spark, d):
    p, _, ev = _events(spark, d)
    return P.event_details(p, ev, CFG)


def _all(spark, d):
    rows, chunk = P.row_chunks(raw_rows(spark, d), CFG)
    return P.analyze(rows, CFG, chunk)


def _day(spark, d):
    p, cands, ev = _events(spark, d)
    return P.day_summary(p, cands, P.event_details(p, ev, CFG), CFG)


def _forward(spark, d):
    """First valid mid one second after every large deviation."""
    p, _, ev = _events(spark, d)
    left = ev.filter(F.abs(F.col("threshold") - 0.0025) < 1e-9).filter("mode = 'raw'").select(
        "trade_date", "InstrumentID", "segment_id", "row_order", (F.col("ts_ms") + 1000).alias("at_ms"))
    right = p.filter("mid is not null and ts_ms is not null").select(
        "trade_date", "InstrumentID", "segment_id", "ts_ms", F.col("row_order").alias("m_row"), "mid")
    out = forward_join(left, right, ["trade_date", "InstrumentID", "segment_id"], "at_ms", "ts_ms", 1000, "m", tie="m_row")
    return out.select("trade_date", "InstrumentID", "row_order", F.col("m.m_row").alias("sample_row"),
                      F.round(F.col("m.mid") + 1e-9, 6).alias("mid_after"))


PREP = "with " + SNAPSHOTS_SQL + """,
raw as (select trade_day as trade_date, trading_day as "TradingDay", contract as "InstrumentID", commodity,
   snapshot_seq as row_order, case when snapshot_seq % 307 = 0 then 'bad' else update_time end as ut, update_ms as um,
   case when snapshot_seq % 401 = 0 then null else last_price end as lp,
   case when snapshot_seq % 211 = 0 then -1 else volume end as vol, bid, ask from snap),
a0 as (select *, case when ut = 'bad' then null else (cast(substr(ut, 1, 2) as bigint) * 3600
     + cast(substr(ut, 4, 2) as bigint) * 60 + cast(substr(ut, 7, 2) as bigint)) * 1000 + um end as clock,
   vol >= 0 as valid_volume, (bid > 0 and ask > 0 and bid <= ask) as valid_bbo,
   coalesce(lp > 0 and lp < 1e9, false) as valid_last from raw),
a1 as (select *, clock is not null as valid_time, case when valid_bbo then (bid + ask) / 2.0::double end as mid,
   case when valid_bbo then ask - bid end as spread,
   lag(row_order) over w as p_row, lag(clock) over w as p_clock, lag(vol) over w as p_vol, lag(valid_volume) over w as p_valid
   from a0 window w as (partition by trade_date, "InstrumentID" order by row_order)),
a2 as (select *, case when clock < p_clock and p_clock >= 64800000 and clock < 21600000 then 1 else 0 end as rolled,
   coalesce(valid_volume and p_valid and vol - p_vol < 0, false) as volume_reset from a1),
a3 as (select *, clock - p_clock + rolled * 86400000 as dt_ms from a2),
a4 as (select *, coalesce(p_row is null or not valid_time or p_clock is null or not valid_volume or not p_valid or dt_ms < 0
   or dt_ms > 300000 or volume_reset, true) as segment_start from a3),
a5 as (select *, sum(case when segment_start then 1 else 0 end) over w as segment_id,
   clock + 86400000 * sum(rolled) over w as ts_ms,
   case when not segment_start and valid_volume then vol - p_vol end as delta_volume
   from a4 window w as (partition by trade_date, "InstrumentID" order by row_order rows between unbounded preceding and current row)),
prep as (select *, last_value(mid ignore nulls) over (partition by trade_date, "InstrumentID", segment_id order by row_order
     rows between unbounded preceding and 1 preceding) as prev_mid,
   coalesce(delta_volume > 0, false) as has_new_trade,
   case when valid_bbo and valid_last and delta_volume > 0 then (lp - mid) / mid end as deviation,
   coalesce(valid_bbo and valid_last and delta_volume > 0 and lp < bid, false) as out_down,
   coalesce(valid_bbo and valid_last and delta_volume > 0 and lp > ask, false) as out_up from a5)"""
CAND = PREP + """,
ths as (select unnest([0.0025::double, 0.005::double, 0.0075::double, 0.01::double, 0.0125::double, 0.015::double,
   0.02::double, 0.025::double, 0.03::double]) as t),
modes as (select unnest(['raw', 'strict']) as mode),
cand as (select p.*, t as threshold, t * 100 as threshold_pct, mode, abs(deviation) as abs_dev,
   case when deviation < 0 then 'down' else 'up' end as side
   from prep p join ths on abs(deviation) >= t join modes
     on mode = 'raw' or (case when deviation < 0 then out_down else out_up end)),
c1 as (select *, lag(segment_id) over w as ps, lag(ts_ms) over w as pt from cand
   window w as (partition by trade_date, "InstrumentID", threshold_pct, side, mode order by row_order)),
c2 as (select *, sum(case when ps is distinct from segment_id or ts_ms - pt > 5000 or ts_ms - pt < 0 then 1 else 0 end)
   over (partition by trade_date, "InstrumentID", threshold_pct, side, mode order by row_order
     rows between unbounded preceding and current row) as island from c1),
c3 as (select *, row_number() over (partition by trade_date, "InstrumentID", threshold_pct, side, mode, island
     order by abs_dev desc, row_order) as rk,
   count(*) over g as cluster_candidate_rows, min(row_order) over g as event_start_row_order,
   max(row_order) over g as event_end_row_order from c2
   window g as (partition by trade_date, "InstrumentID", threshold_pct, side, mode, island)),
events1 as (select * from c3 where rk = 1)"""
DETAIL = CAND + """,
anc as (select distinct trade_date, "InstrumentID", segment_id, row_order, ts_ms from events1),
pth as (select a.trade_date, a."InstrumentID", a.row_order,
   max(p.mid) filter (where p.ts_ms - a.ts_ms <= 5000) as path_max, min(p.mid) filter (where p.ts_ms - a.ts_ms <= 5000) as path_min,
   max(p.ts_ms - a.ts_ms) filter (where p.ts_ms - a.ts_ms <= 5000) as covered,
   arg_min(p.mid, p.row_order) filter (where p.ts_ms - a.ts_ms between 1000 and 2000) as m1,
   arg_min(p.ts_ms, p.row_order) filter (where p.ts_ms - a.ts_ms between 1000 and 2000) as t1,
   arg_min(p.mid, p.row_order) filter (where p.ts_ms - a.ts_ms between 3000 and 4000) as m3,
   arg_min(p.mid, p.row_order) filter (where p.ts_ms - a.ts_ms between 5000 and 6000) as m5
   from anc a join prep p on a.trade_date = p.trade_date and a."InstrumentID" = p."InstrumentID" and a.segment_id = p.segment_id
     and p.row_order > a.row_order and p.ts_ms between a.ts_ms and a.ts_ms + 6000 and p.mid is not null group by 1, 2, 3),
d1 as (select e.*, pth.* exclude (trade_date, "InstrumentID", row_order),
   case when side = 'down' then mid * (1 - threshold) else mid * (1 + threshold) end as fill
   from events1 e left join pth using (trade_date, "InstrumentID", row_order)),
d2 as (select *, case when side = 'down' then prev_mid - fill else fill - prev_mid end as den from d1),
det as (select *, case when den > 0 then (case when side = 'down' then m1 - fill else fill - m1 end) / den end as r1,
   case when den > 0 then (case when side = 'down' then m3 - fill else fill - m3 end) / den end as r3,
   case when den > 0 then (case when side = 'down' then m5 - fill else fill - m5 end) / den end as r5,
   case when path_max is not null then greatest(0, case when side = 'down' then path_max - fill else fill - path_min end / fill) * 100 end as mfe_pct,
   case when path_max is not null then greatest(0, case when side = 'down' then fill - path_min else path_max - fill end / fill) * 100 end as mae_pct,
   coalesce(covered >= 5000, false) as complete from d2)"""
METRICS = """count(*) as independent_events, count(*) filter (where complete) as mfe_mae_complete_n,
   count(r1) as recovery_valid_n_1s, count(*) - count(r3) as recovery_missing_n_3s,
   round(avg(case when r1 is not null then case when r1 >= 0.5 then 1.0::double else 0 end end) + 1e-9::double, 6) as recovery50_1s_rate,
   round(avg(case when r5 is not null then case when r5 >= 1.0 then 1.0::double else 0 end end) + 1e-9::double, 6) as recovery100_5s_rate,
   round(median(r1) + 1e-9::double, 6) as recovery_ratio_1s_median, round(median(r5) + 1e-9::double, 6) as recovery_ratio_5s_median,
   round(avg(mfe_pct) filter (where complete) + 1e-9::double, 6) as mfe_mean_pct,
   round(median(mae_pct) filter (where complete) + 1e-9::double, 6) as mae_median_pct,
   round(quantile_cont(mae_pct, 0.95) filter (where complete) + 1e-9::double, 6) as mae_p95_pct"""
SPINE = DETAIL + """,
spine as (select trade_date, "InstrumentID", count(deviation) as deviation_records, t * 100 as threshold_pct, s as side, mode
   from prep, ths, (select unnest(['down', 'up']) as s), modes group by trade_date, "InstrumentID", t, s, mode),
cr as (select trade_date, "InstrumentID", threshold_pct, side, mode, count(*) as candidate_rows from cand group by all)"""
KEYQ = 'trade_date, "InstrumentID"'
MCOLS = ["independent_events", "mfe_mae_complete_n", "recovery_valid_n_1s", "recovery_missing_n_3s"]
MROUND = ["recovery50_1s_rate", "recovery100_5s_rate", "recovery_ratio_1s_median", "recovery_ratio_5s_median",
          "mfe_mean_pct", "mae_median_pct", "mae_p95_pct"]


def _combo():
    return [F.round("threshold_pct", 6).alias("threshold_pct"), "side", "mode"]


CQ = "round(threshold_pct, 6) as threshold_pct, side, mode"

QUERIES = {
    "prj_17_parse_clock": lambda s, d: prepared(s, d).select("row_order", "clock", "valid_time"),
    "prj_16_finite_price": lambda s, d: prepared(s, d).select("row_order", "valid_volume", "valid_bbo", "valid_last"),
    "win_17_midnight_rollover": lambda s, d: prepared(s, d).select("row_order", "ts_ms"),
    "win_18_segments": lambda s, d: prepared(s, d).select("row_order", F.col("segment_id").cast("bigint").alias("segment_id"), "volume_reset"),
    "win_19_previous_mid": lambda s, d: prepared(s, d).select("row_order", *r6("prev_mid")),
    "prj_22_deviation": lambda s, d: prepared(s, d).select("row_order", F.col("delta_volume").cast("double").alias("delta_volume"),
                                                           *r6("deviation"), "outside_bbo_down", "outside_bbo_up"),
    "rul_14_candidates": lambda s, d: P.candidates(prepared(s, d)).select("row_order", *_combo()),
    "win_20_event_clusters": lambda s, d: _events(s, d)[2].select(
        "trade_date", "InstrumentID", *_combo(), "row_order", "event_start_row_order", "event_end_row_order",
        F.col("cluster_candidate_rows").cast("bigint").alias("cluster_candidate_rows")),
    "joi_14_forward_asof": _forward,
    "win_21_excursions": lambda s, d: details(s, d).select(
        "trade_date", "InstrumentID", *_combo(), "row_order", *r6("mfe_pct", "mae_pct"), "mfe_mae_window_complete",
        *r6("mfe_mae_covered_seconds")),
    "win_22_recovery_ratios": lambda s, d: details(s, d).select(
        "trade_date", "InstrumentID", *_combo(), "row_order", *r6("mid_after_1s", "sample_delay_after_1s", "recovery_ratio_1s", "recovery_ratio_3s", "recovery_ratio_5s"),
        "recovery50_1s", "recovery80_3s", "recovery100_5s"),
    "joi_15_event_windows": lambda s, d: (lambda p, _, ev: P.event_windows(p, ev, CFG).select(
        "window_id", "row_order", *r6("ts_seconds_from_event", "mid"), "is_representative"))(*_events(s, d)),
    "agg_07_distributions": lambda s, d: P.distributions(prepared(s, d)).select(
        "scope", "InstrumentID", "trade_date", "new_trade_records",
        *r6("q90_pct", "q95_pct", "q99_pct", "q99_5_pct", "q99_9_pct", "q99_99_pct", "max_pct")),
    "agg_08_quality": lambda s, d: P.quality(prepared(s, d)),
    "agg_09_day_summary": lambda s, d: _day(s, d).select(
        "trade_date", "InstrumentID", *_combo(), "effective_day", "deviation_records", "candidate_rows", *MCOLS, *r6(*MROUND)),
    "agg_10_overall_summary": lambda s, d: P.contract_summary(*_events(s, d), CFG).select(
        "InstrumentID", *_combo(), "active_days", "candidate_rows", "deviation_records", *MCOLS, *r6(*MROUND, "events_per_day")),
    "agg_11_manifest": lambda s, d: (lambda p, _, ev: P.manifest(
        raw_rows(s, d).select("trade_date", "InstrumentID").distinct().withColumn("status", F.lit("selected")), P.quality(p), ev))(*_events(s, d)),
}

ORACLE = {
    "prj_17_parse_clock": PREP + " select row_order, clock, valid_time from prep",
    "prj_16_finite_price": PREP + " select row_order, valid_volume, valid_bbo, valid_last from prep",
    "win_17_midnight_rollover": PREP + " select row_order, cast(ts_ms as bigint) as ts_ms from prep",
    "win_18_segments": PREP + " select row_order, cast(segment_id as bigint) as segment_id, volume_reset from prep",
    "win_19_previous_mid": PREP + f" select row_order, {q6('prev_mid')} from prep",
    "prj_22_deviation": PREP + f" select row_order, cast(delta_volume as double) as delta_volume, {q6('deviation')}, out_down as outside_bbo_down, out_up as outside_bbo_up from prep",
    "rul_14_candidates": CAND + f" select row_order, {CQ} from cand",
    "win_20_event_clusters": CAND + f" select {KEYQ}, {CQ}, row_order, event_start_row_order, event_end_row_order, cluster_candidate_rows from events1",
    "joi_14_forward_asof": DETAIL + ",\nf1 as (select * from events1 where threshold = 0.0025::double and mode = 'raw') " + f"""
   select f.trade_date, f."InstrumentID", f.row_order, arg_min(p.row_order, p.row_order) as sample_row,
   round(arg_min(p.mid, p.row_order) + 1e-9::double, 6) as mid_after from f1 f left join prep p
   on f.trade_date = p.trade_date and f."InstrumentID" = p."InstrumentID" and f.segment_id = p.segment_id
   and p.mid is not null and p.ts_ms between f.ts_ms + 1000 and f.ts_ms + 2000 group by all""",
    "win_21_excursions": DETAIL + f" select {KEYQ}, {CQ}, row_order, {q6('mfe_pct', 'mae_pct')}, complete as mfe_mae_window_complete, round(coalesce(covered / 1000.0::double, 0) + 1e-9::double, 6) as mfe_mae_covered_seconds from det",
    "win_22_recovery_ratios": DETAIL + f""" select {KEYQ}, {CQ}, row_order, round(m1 + 1e-9::double, 6) as mid_after_1s,
   round((t1 - ts_ms - 1000) / 1000.0::double + 1e-9::double, 6) as sample_delay_after_1s, round(r1 + 1e-9::double, 6) as recovery_ratio_1s,
   round(r3 + 1e-9::double, 6) as recovery_ratio_3s, round(r5 + 1e-9::double, 6) as recovery_ratio_5s,
   r1 >= 0.5 as "recovery50_1s", r3 >= 0.8 as "recovery80_3s", r5 >= 1.0 as "recovery100_5s" from det""",
    "joi_15_event_windows": DETAIL + """ select a."InstrumentID" || '_' || a.trade_date || '_' || a.row_order as window_id, p.row_order,
   round((p.ts_ms - a.ts_ms) / 1000.0::double + 1e-9::double, 6) as ts_seconds_from_event, round(p.mid + 1e-9::double, 6) as mid,
   p.row_order = a.row_order as is_representative from anc a join prep p on a.trade_date = p.trade_date
   and a."InstrumentID" = p."InstrumentID" and a.segment_id = p.segment_id and p.ts_ms between a.ts_ms - 30000 and a.ts_ms + 5000""",
    "agg_07_distributions": PREP + """ select 'contract_day' as scope, "InstrumentID", cast(trade_date as varchar) as trade_date, count(*) as new_trade_records,
   """ + ", ".join(f"round(quantile_cont(abs(deviation) * 100, {q}) + 1e-9::double, 6) as {n}" for n, q in (
        ("q90_pct", 0.9), ("q95_pct", 0.95), ("q99_pct", 0.99), ("q99_5_pct", 0.995), ("q99_9_pct", 0.999), ("q99_99_pct", 0.9999), ("max_pct", 1.0))) + """
   from prep where deviation is not null group by all union all select 'contract_all', "InstrumentID", '', count(*), """ + ", ".join(
        f"round(quantile_cont(abs(deviation) * 100, {q}) + 1e-9::double, 6)" for q in (0.9, 0.95, 0.99, 0.995, 0.999, 0.9999, 1.0)) + """
   from prep where deviation is not null group by "InstrumentID" """,
    "agg_08_quality": PREP + f""" select {KEYQ}, count(*) as rows, count_if(valid_time) as valid_time_rows, count_if(not valid_time) as invalid_time_rows,
   count_if(valid_volume) as valid_volume_rows, count_if(not valid_volume) as invalid_volume_rows, count_if(valid_bbo) as valid_bbo_rows,
   count_if(not valid_bbo) as invalid_bbo_rows, count_if(not valid_last) as invalid_last_rows, count_if(has_new_trade) as new_trade_records,
   count(deviation) as deviation_records, count_if(volume_reset) as volume_reset_rows, count_if(segment_start) - 1 as time_break_rows
   from prep group by all""",
    "agg_09_day_summary": SPINE + f""", met as (select {KEYQ}, threshold_pct, side, mode, {METRICS} from det group by all)
   select {KEYQ}, {CQ}, cast(case when deviation_records > 0 then 1 else 0 end as bigint) as effective_day, deviation_records,
   coalesce(candidate_rows, 0) as candidate_rows, {', '.join(f'coalesce({c}, 0) as {c}' for c in MCOLS)}, {', '.join(MROUND)}
   from spine left join cr using ({KEYQ}, threshold_pct, side, mode) left join met using ({KEYQ}, threshold_pct, side, mode)""",
    "agg_10_overall_summary": SPINE + f""", met as (select "InstrumentID", threshold_pct, side, mode, {METRICS} from det group by all),
   tot as (select "InstrumentID", threshold_pct, side, mode, count_if(deviation_records > 0) as active_days,
     cast(sum(coalesce(candidate_rows, 0)) as bigint) as candidate_rows, cast(sum(deviation_records) as bigint) as deviation_records
     from spine left join cr using ({KEYQ}, threshold_pct, side, mode) group by all)
   select "InstrumentID", {CQ}, active_days, candidate_rows, deviation_records, {', '.join(f'coalesce({c}, 0) as {c}' for c in MCOLS)},
   {', '.join(MROUND)}, round(case when active_days > 0 then coalesce(independent_events, 0) / active_days::double end + 1e-9::double, 6) as events_per_day
   from tot left join met using ("InstrumentID", threshold_pct, side, mode)""",
    "agg_11_manifest": DETAIL + """ select n as discovered_source_count, n as selected_source_count, 0::bigint as duplicate_source_count,
   0::bigint as error_source_count, (select count(*) from (select 1 from prep group by trade_date, "InstrumentID" having count(deviation) > 0)) as valid_contract_days,
   (select count(*) from det) as event_count, 'ok' as status from (select count(*) as n from (select distinct trade_date, "InstrumentID" from raw))""",
}

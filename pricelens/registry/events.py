"""Event-table, distance, profile and legacy queries and their reference SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, quotes
from ..plans import events as P, legacy as L, ticks as T
from ..session import materialize
from ..sources.driver_tables import EVENT_ROWS_SQL, daily_bars, event_rows, snapshots, table
from . import study as S, ticks as TR
from .daily import BARS0, BARS_SQL, q6, r6, _bars

YEARS = [2023, 2024]


def ev(spark, d):
    return P.load_directions(event_rows(spark, d))


def boundary(spark, d):
    """Verdicts for the large events, plus one key per large event that has no source event."""
    big = event_rows(spark, d).filter("notional_shortfall > 1500")
    keep = F.when(F.col("notional_shortfall") > 2500, "exclude").otherwise("review")
    known = big.select("trade_date", "event_id", keep.alias("verdict"))
    return known.unionByName(big.filter("notional_shortfall > 4000").select(
        "trade_date", F.concat("event_id", F.lit("x")).alias("event_id"), F.lit("exclude").alias("verdict")))


def blocked_days(spark, d):
    """Commodity-days whose average shortfall is unusually high."""
    return event_rows(spark, d).groupBy("trade_date", "commodity").agg(F.avg("notional_shortfall").alias("a")).filter(
        "a > 520").select("trade_date", "commodity")


def _statuses(spark, d):
    return P.calendar_status(ev(spark, d), "20231225", "20240205")


def _scenario_scores(spark, d):
    from ..plans.logs import best_scenarios
    e = event_rows(spark, d).select(
        "commodity", "contract", (F.col("anchor_seq") % 6).alias("scenario_id"), F.col("event_depth_bps"), "notional_shortfall", "valid_peer_count")
    g = e.groupBy("commodity", "contract", "scenario_id").agg(
        (F.max("notional_shortfall") > 3000).alias("passed"), F.avg("valid_peer_count").alias("normal_rate"),
        F.avg(F.when(F.col("event_depth_bps") > 20, 1.0).otherwise(0.0)).alias("failure_rate"),
        F.sum("notional_shortfall").alias("net_pnl"), F.count(F.lit(1)).alias("actions"))
    return best_scenarios(g, ["commodity", "contract"])


def _distances(spark, d):
    p = materialize(S.prepared(spark, d))
    det = S.P.event_details(p, S.P.cluster(S.P.candidates(p)))
    uniq = P.unique_events(det)
    safe = P.safe_distances(P.forward_excursions(p, 5), 5, "q99", 8.0)
    days = uniq.agg(F.countDistinct("trade_date").cast("double").alias("observed_days"))
    return P.evaluate_distances(safe, uniq, days, max_follow=0.5, min_isolation=0.1), safe, uniq


def _references(spark, d):
    """Three references per target: the most traded other contracts of the commodity over the whole history."""
    from pyspark.sql import Window
    v = daily_bars(spark, d).groupBy("commodity", "contract").agg(F.sum("volume").alias("v"))
    lead = Window.partitionBy("commodity").orderBy(F.col("v").desc(), "contract")
    top = v.withColumn("r", F.row_number().over(lead)).filter("r <= 4").select("commodity", F.col("contract").alias("reference"), "r")
    own = Window.partitionBy("target").orderBy("r")
    return v.select("commodity", F.col("contract").alias("target")).join(top, "commodity").filter("target <> reference").withColumn(
        "k", F.row_number().over(own)).filter("k <= 3").select("target", "reference")


def _legacy(spark, d):
    return L.reference_differences(daily_bars(spark, d), _references(spark, d))


def _orders_days(spark, d):
    return table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyyMMdd").alias("trade_date"))


ER = "with " + EVENT_ROWS_SQL
BOUND = ER + """,
big as (select * from er where notional_shortfall > 1500),
bd as (select trade_date, event_id, case when notional_shortfall > 2500 then 'exclude' else 'review' end as verdict from big
   union all select trade_date, event_id || 'x', 'exclude' from big where notional_shortfall > 4000)"""
ELIG = """event_direction = 'down' and data_quality = 'normal' and boundary_verdict = 'keep' and recovery_label in ('trade_recovered_3s', 'quote_only_recovered_3s')
   and valid_peer_count >= 2 and fair_uncertainty_ticks <= 10 and event_depth_ticks > 0 and event_depth_bps > 0 and event_depth_bps < 10000 and trim(depth_source) <> ''"""
RE = ER + ", re as (select *, unnest(string_split(trigger_reasons, ',')) as reason from er)"
UNIQ = S.DETAIL + """,
un0 as (select *, row_number() over (partition by trade_date, "InstrumentID", side, row_order order by threshold_pct) as rr from det where mode = 'raw'),
un as (select *, case when side = 'down' then 'BUY' else 'SELL' end as direction,
   case when m5 is not null then greatest(0, case when side = 'down' then (mid - m5) / mid else (m5 - mid) / mid end) / (abs_dev * 100 / 100.0::double) end as follow_ratio from un0 where rr = 1),
pv as (select trade_date, "InstrumentID", segment_id, ts_ms, mid from prep where mid is not null and ts_ms is not null),
ex0 as (select *, max(mid) over w as hi, min(mid) over w as lo from pv window w as (partition by trade_date, "InstrumentID", segment_id order by ts_ms range between current row and 5000 following)),
ex as (select "InstrumentID", 'SELL' as direction, (hi - mid) / mid as e from ex0 union all select "InstrumentID", 'BUY', (mid - lo) / mid from ex0),
exq as (select "InstrumentID", direction, count(*) as n, quantile_cont(e, 0.9) as q90, quantile_cont(e, 0.95) as q95, quantile_cont(e, 0.99) as q99 from ex group by 1, 2),
safe as (select "InstrumentID", direction, q99 * 8.0::double as sd from exq),
grid as (select *, g * 0.0005::double as dd from safe, (select unnest(range(0, 21)) as g) where g >= ceil((sd - 1e-12) / 0.0005::double)),
evl0 as (select grid."InstrumentID", grid.direction, round(dd, 10) as candidate_distance, sd, count(un.row_order) as event_count, count(follow_ratio) as fv,
   count(case when follow_ratio <= 0.5 then 1 end) as iso from grid left join un on grid."InstrumentID" = un."InstrumentID" and grid.direction = un.direction
   and abs_dev >= dd - 1e-12 group by 1, 2, 3, 4),
evl as (select *, iso / nullif(fv, 0)::double as isolation_rate, iso * 20.0::double / (select count(distinct trade_date) from un) as monthly_opportunity from evl0),
evl2 as (select *, coalesce(event_count >= 3 and isolation_rate >= 0.1 and monthly_opportunity >= 1.0, false) as qualified from evl),
chosen as (select safe."InstrumentID", safe.direction, min(candidate_distance) filter (where qualified) as td from safe left join evl2 using ("InstrumentID", direction) group by 1, 2)"""
LEG = "with " + BARS_SQL + """,
v as (select commodity, contract, sum(volume) as v from bars group by 1, 2),
top4 as (select * from (select commodity, contract as reference, row_number() over (partition by commodity order by v desc, contract) as r from v) where r <= 4),
refp as (select target, reference from (select v.contract as target, reference, row_number() over (partition by v.contract order by r) as k
   from v join top4 on v.commodity = top4.commodity and v.contract <> reference) where k <= 3),
df as (select t.contract as target, p.reference, t.trade_date, t.low as t_low, t.high as t_high, t.volume as t_volume,
   coalesce(t.low - r.low, 0) as low_diff, coalesce(t.high - r.high, 0) as high_diff from bars t join refp p on t.contract = p.target
   left join bars r on r.contract = p.reference and r.trade_date = t.trade_date),
df2 as (select *, avg(high_diff) over w as hm, avg(low_diff) over w as lm, t_high - t_low as amp, avg(t_high - t_low) over w as am from df
   window w as (partition by target, reference order by trade_date rows between 19 preceding and current row)),
df3 as (select *, coalesce(hm <> 0 and abs((high_diff - hm) / nullif(hm, 0)) > 1.0 and abs(high_diff) > 0.02::double * t_low, false) as hx,
   coalesce(lm <> 0 and abs((low_diff - lm) / nullif(lm, 0)) > 1.0 and abs(low_diff) > 0.02::double * t_low, false) as lx from df2),
df4 as (select *, case when hx then '与' || reference || '最高值差异异常 (比率: ' || printf('%.2f', round(abs((high_diff - hm) / nullif(hm, 0)) * 100 + 1e-9::double, 2)) || '%, 绝对差异: ' || printf('%.2f', round(abs(high_diff) + 1e-9::double, 2)) || ')' end as hw,
   case when lx then '与' || reference || '最低值差异异常 (比率: ' || printf('%.2f', round(abs((low_diff - lm) / nullif(lm, 0)) * 100 + 1e-9::double, 2)) || '%, 绝对差异: ' || printf('%.2f', round(abs(low_diff) + 1e-9::double, 2)) || ')' end as lw from df3),
lg as (select target, trade_date, count_if(hx) as high_hits, count_if(lx) as low_hits, max(t_volume) as volume, bool_or(am > 0 and amp / am > 2.0) as amplitude_flag, max(amp) as amp, max(am) as am,
   array_to_string(list_sort(list_filter(flatten(list([hw, lw])), lambda x: x is not null)), '; ') as words from df4 group by 1, 2)"""
RANGE = ER + """, runs as (select distinct trade_date, commodity, cast(right(trade_date, 2) as int) + length(commodity) as n from er where cast(right(trade_date, 2) as int) % 9 <> 0),
rs as (select *, case when n % 11 = 0 then 'failed' when n % 7 = 0 then 'running' else 'success_with_events' end as status, case when n % 11 = 0 then 'error in ' || commodity end as error from runs),
rg as (select trade_date, count_if(status = 'success_with_events') as hits, count_if(status = 'failed') as failed, count_if(status = 'running') as open, arg_min(error, commodity) filter (where error is not null) as error from rs group by 1),
fe as (select trade_date, count(*) as events, string_agg(distinct commodity, ',' order by commodity) as hc from er group by 1),
sp as (select strftime(unnest(range(timestamp '2023-12-25', timestamp '2024-02-06', interval 1 day)), '%Y%m%d') as trade_date),
rj as (select sp.trade_date, case when cast(right(sp.trade_date, 2) as int) % 10 = 0 and events is not null then 'missing_day' when hits is null then 'missing_output' when failed > 0 then 'failed' when open > 0 then 'incomplete' else 'complete' end as status,
   events, hits, failed, hc, error from sp left join rg using (trade_date) left join fe using (trade_date)),
rd as (select trade_date, status, case when status like 'missing%' then 0 else events end as events, case when status like 'missing%' then 0 else hits end as hits, case when status like 'missing%' then 0 else failed end as failed,
   case when status like 'missing%' then '' else hc end as hit_commodities, case when status not like 'missing%' then error end as error from rj)"""
TDATE = "strftime(trade_date, '%Y-%m-%d') as trade_date"


def _range_days(spark, d):
    """Runs of the event days: every eleventh commodity-day failed, every seventh still runs; some days have no input or no run."""
    day = F.dayofmonth(F.to_date("trade_date", "yyyyMMdd"))
    n = day + F.length("commodity")
    runs = ev(spark, d).select("trade_date", "commodity").distinct().filter(day % 9 != 0)
    runs = runs.select("trade_date", "commodity", F.when(n % 11 == 0, "failed").when(n % 7 == 0, "running").otherwise("success_with_events").alias("status"),
                       F.when(n % 11 == 0, F.concat(F.lit("error in "), "commodity")).otherwise("").alias("error"))
    absent = ev(spark, d).select("trade_date").distinct().filter(day % 10 == 0)
    return P.range_days(ev(spark, d), runs, absent, "20231225", "20240205")


def _research(spark, d):
    """Depths of each contract's events; candidates are their quantiles, every fourth contract isn't ready, every fifth has none."""
    e, k = ev(spark, d), F.substring("target_contract", -1, 1).cast("int") + F.length("target_contract")
    depths = e.groupBy(F.col("contract").alias("target_contract")).agg(F.percentile("event_depth_ticks", [0.5, 0.7, 0.85, 0.9]).alias("q"))
    up = lambda x: F.greatest(F.lit(1), F.ceil(x - 1e-12)).cast("bigint")
    cand = depths.select("target_contract", F.posexplode("q").alias("i", "t")).filter("i < 3").withColumn("total_touch_ticks", up(F.col("t")))
    cand = cand.withColumn("W", up(F.col("total_touch_ticks") * 0.4)).select("target_contract", F.element_at(F.array(F.lit("P50"), F.lit("P70"), F.lit("P85")), F.col("i") + 1).alias("source_quantile"), F.lit(0.4).alias("width_ratio"),
                                                                           F.lit("W_x_0.50").alias("step_mode"), "total_touch_ticks", "W", (F.col("total_touch_ticks") - F.col("W")).alias("D"), up(F.col("W") * 0.5).alias("S"))
    stats = depths.filter(k % 5 != 0).select("target_contract", F.when(k % 4 == 0, "too_few").otherwise("research_candidate_ready").alias("candidate_status"), F.col("q")[3].alias("confirmed_depth_p90_ticks"))
    return P.research_shapes(cand, stats, depths)


def _td():
    return F.date_format("trade_date", "yyyy-MM-dd").alias("trade_date")


QUERIES = {
    "src_09_event_directions": lambda s, d: ev(s, d).select("event_id", "event_direction"),
    "joi_16_annotation": lambda s, d: P.annotate(ev(s, d), boundary(s, d)).select("trade_date", "event_id", "verdict"),
    "joi_17_annotation_checks": lambda s, d: P.annotation_checks(ev(s, d), boundary(s, d)),
    "joi_18_exclusions": lambda s, d: P.split_exclusions(ev(s, d), blocked_days(s, d)).select("event_id", "exclusion_reason"),
    "prj_24_direction_words": lambda s, d: ev(s, d).select("event_id", codes.direction_buy_sell(F.col("raw_direction")).alias("direction")),
    "prj_29_shape_eligibility": lambda s, d: ev(s, d).filter(P.eligible_for_shapes()).select("event_id"),
    "agg_20_parameter_shapes": lambda s, d: P.parameter_shapes(ev(s, d)).select(
        "commodity", "target_contract", *r6("T_pct", "W_pct", "D_pct", "S_pct")),
    "prj_30_legacy_depth": lambda s, d: P.legacy_depth(ev(s, d), F.lit(0.02)).select(
        "event_id", *r6("derived_depth_ticks", "derived_depth_bps"), "derived_source", "derived_channels"),
    "prj_32_label_translation": lambda s, d: ev(s, d).select("event_id", codes.translate(
        F.col("recovery_label"), {"persistent_10s": "持续", "truncated": "截断"}).alias("label")),
    "agg_13_batch_stats": lambda s, d: P.batch_stats(ev(s, d)).select(
        "commodity", "event_count", "contract_count", "first_time", "last_time", "down_count", "up_count", *r6("max_down_ticks"), "reasons"),
    "agg_14_status_counts": lambda s, d: P.status_counts(_statuses(s, d)),
    "agg_15_range_rollup": lambda s, d: P.range_rollup(ev(s, d)),
    "rul_17_day_status": _statuses,
    "agg_16_month_rollup": lambda s, d: P.month_rollup(ev(s, d)).select(
        "month", "commodity", "event_count", F.round(F.col("notional") + 1e-9, 3).alias("notional"), *r6("share_pct")),
    "top_05_largest_shortfalls": lambda s, d: P.largest_shortfalls(ev(s, d)).select("event_id", *r6("notional_shortfall")),
    "top_05_most_common": lambda s, d: P.ranked_values(ev(s, d), "contract"),
    "agg_15_range_days": lambda s, d: _range_days(s, d),
    "rul_17_range_counts": lambda s, d: P.range_counts(_range_days(s, d)),
    "agg_16_month_days": lambda s, d: P.month_days(ev(s, d)).select("month", "trade_date", "event_count", "commodity_count", *r6("events_per_day")),
    "agg_25_commodity_years": lambda s, d: P.commodity_years(ev(s, d)),
    "agg_26_year_totals": lambda s, d: P.year_totals(_orders_days(s, d)).select("year", "event_count", *r6("share_pct", "change_pct")),
    "agg_26_leading_commodities": lambda s, d: P.leading_commodities(ev(s, d), YEARS, 3).select("place", "commodity", "y2023", "y2024", "total"),
    "agg_29_pass_flags": lambda s, d: _distances(s, d)[0].select("InstrumentID", "direction", *r6("candidate_distance"), "pass_safe_distance", "pass_min_events", "pass_isolation_rate", "pass_monthly_opportunity", "qualified"),
    "rul_18_research_shapes": lambda s, d: _research(s, d),
    "top_07_event_order_limit": lambda s, d: P.ordered_events(ev(s, d), 100).select("trade_date", "event_time", "event_id"),
    "top_08_hit_commodities": lambda s, d: P.hit_commodities(ev(s, d)),
    "set_01_schema_union": lambda s, d: ev(s, d).select("trade_date", "event_id", "recovery_label").unionByName(
        boundary(s, d), allowMissingColumns=True).groupBy("recovery_label", "verdict").agg(F.count(F.lit(1)).alias("n_rows")),
    "set_03_runnable_commodities": lambda s, d: TR.frames(s, d).filter("validation_status = 'validated'").select("commodity").intersect(
        ev(s, d).select("commodity")),
    "set_04_missing_contracts": lambda s, d: ev(s, d).select("contract").subtract(
        ev(s, d).filter("notional_shortfall > 4500").select("contract")),
    "set_05_missing_days": lambda s, d: P.calendar_status(_orders_days(s, d).withColumn("commodity", F.lit("X")), "19950101", "20011231").filter(
        "status = 'missing'").select("trade_date"),
    "agg_25_month_calendar": lambda s, d: P.month_calendar(ev(s, d), 2023, 2024),
    "agg_26_year_pivot": lambda s, d: P.year_pivot(ev(s, d), YEARS).select("commodity", "y2023", "y2024", "total", *r6("share_pct", "change_pct")),
    "top_06_best_scenario": lambda s, d: _scenario_scores(s, d).select("commodity", "contract", "scenario_id"),
    "win_31_forward_excursions": lambda s, d: P.forward_excursions(S.prepared(s, d), 5).select("InstrumentID", "direction", "n", *r6("q90", "q95", "q99")),
    "win_32_unique_events": lambda s, d: P.unique_events(S.details(s, d)).select("trade_date", "InstrumentID", "side", "row_order", *r6("threshold_pct")),
    "win_30_follow_ratio": lambda s, d: P.unique_events(S.details(s, d)).select("trade_date", "InstrumentID", "side", "row_order", "direction", *r6("follow_ratio")),
    "agg_30_safe_distance": lambda s, d: P.safe_distances(P.forward_excursions(S.prepared(s, d), 5), 5, "q99", 8.0).select("InstrumentID", "direction", *r6("safe_distance")),
    "agg_31_observed_days": lambda s, d: S.details(s, d).agg(F.countDistinct("trade_date").alias("observed_days")),
    "joi_25_distance_counts": lambda s, d: _distances(s, d)[0].select("InstrumentID", "direction", *r6("candidate_distance"), "event_count", "isolated_count"),
    "agg_29_distance_choice": lambda s, d: (lambda e, safe, u: P.choose_distances(e, safe).select(
        "InstrumentID", "direction", *r6("safe_distance", "target_distance", "min_distance", "max_distance"), "status"))(*_distances(s, d)),
    "src_11_distance_rules": lambda s, d: (lambda e, safe, u: P.distance_violations(P.choose_distances(e, safe, 1.2)).select(
        "InstrumentID", "direction", "violation"))(*_distances(s, d)),
    "agg_17_multiplier": lambda s, d: P.infer_multiplier(TR.frames(s, d)),
    "agg_18_tick_size": lambda s, d: P.infer_tick_size(snapshots(s, d)),
    "agg_19_most_active": lambda s, d: P.most_active(T.contract_volumes(TR.frames(s, d))),
    "prj_03_contract_code": lambda s, d: table(s, d, "customer").select(
        "c_custkey", codes.normalize_contract(F.concat(F.lit("ap"), (F.col("c_custkey") % 1900 + 100).cast("string"))).alias("code")),
    "prj_25_tick_grid": lambda s, d: snapshots(s, d).select(
        "snapshot_seq", *[F.round(e + 1e-9, 6).alias(n) for n, e in (
            ("floor_px", quotes.floor_to_tick(F.col("Turnover") / 7e3, F.lit(0.05))), ("round_px", quotes.round_to_tick(F.col("LastPrice"), F.lit(0.05))))]),
    "joi_23_reference_differences": lambda s, d: _legacy(s, d).select("target", "reference", _td(), *r6("low_diff", "high_diff")),
    "win_27_trailing_means": lambda s, d: L.detect(_legacy(s, d), 1.0, 20, 2.0, 20.0).select("target", _td(), "high_hits", "low_hits", "amplitude_flag"),
    "rul_16_legacy_flags": lambda s, d: L.detect(_legacy(s, d), 1.0, 20, 2.0, 20.0).select("target", _td(), "is_flagged", "anomaly_reasons"),
    "win_26_moving_averages": lambda s, d: L.moving_averages(daily_bars(s, d), (5, 20)).select("contract", _td(), *r6("ma_5", "ma_5_diff", "ma_20", "ma_20_diff_pct")),
}

ORACLE = {
    "src_09_event_directions": ER + " select event_id, event_direction from er",
    "joi_16_annotation": BOUND + " select er.trade_date, er.event_id, coalesce(verdict, 'keep') as verdict from er left join bd using (trade_date, event_id)",
    "joi_17_annotation_checks": BOUND + """ select 'duplicate_source_keys' as check, (select count(*) from (select 1 from er group by trade_date, event_id having count(*) > 1)) as n
   union all select 'duplicate_boundary_keys', (select count(*) from (select 1 from bd group by trade_date, event_id having count(*) > 1))
   union all select 'unknown_boundary_keys', (select count(*) from bd anti join er using (trade_date, event_id))""",
    "joi_18_exclusions": ER + """, bl as (select trade_date, commodity from er group by 1, 2 having avg(notional_shortfall) > 520)
   select event_id, case when event_direction = 'up' then 'unsupported_event_direction_up' when bl.commodity is not null then 'quality_exclusion' end as exclusion_reason
   from er left join bl using (trade_date, commodity)""",
    "prj_24_direction_words": ER + " select event_id, case when trim(lower(raw_direction)) in ('buy', 'down', 'long') then 'BUY' when trim(lower(raw_direction)) in ('sell', 'up', 'short') then 'SELL' end as direction from er",
    "prj_29_shape_eligibility": ER + f" select event_id from er where {ELIG}",
    "agg_20_parameter_shapes": ER + f""", q as (select commodity, contract, unnest([quantile_cont(event_depth_bps / 100.0::double, 0.7), quantile_cont(event_depth_bps / 100.0::double, 0.85)]) as t
   from er where {ELIG} group by 1, 2 having count(*) >= 4) select distinct commodity, contract as target_contract, round(t + 1e-9::double, 6) as "T_pct", round(t * 0.4::double + 1e-9::double, 6) as "W_pct",
   round(t - t * 0.4::double + 1e-9::double, 6) as "D_pct", round(t * 0.4::double * 0.5 + 1e-9::double, 6) as "S_pct" from q where t - t * 0.4::double > 0""",
    "prj_30_legacy_depth": ER + """, z as (select *, case when last_down_ticks >= last_threshold_ticks and last_down_ticks > 0 then last_down_ticks end as vis,
   case when vwap_down_ticks >= vwap_threshold_ticks and combined_vwap_down_ticks >= vwap_threshold_ticks and combined_vwap_down_ticks > 0 then combined_vwap_down_ticks end as itv from er where event_direction = 'down')
   select event_id, round(greatest(vis, itv) + 1e-9::double, 6) as derived_depth_ticks, round(greatest(vis, itv) * 0.02::double / fair_price * 10000 + 1e-9::double, 6) as derived_depth_bps,
   case when greatest(vis, itv) is null then 'legacy_depth_unverifiable' else 'legacy_components_derived' end as derived_source,
   concat_ws('+', case when vis is not null then 'visible' end, case when itv is not null then 'interval' end) as derived_channels from z""",
    "prj_32_label_translation": ER + " select event_id, case recovery_label when 'persistent_10s' then '持续' when 'truncated' then '截断' else recovery_label end as label from er",
    "agg_13_batch_stats": RE + """ select commodity, count(distinct anchor_seq) as event_count, count(distinct contract) as contract_count, min(event_time) as first_time, max(event_time) as last_time,
   count(distinct case when event_direction = 'down' then anchor_seq end) as down_count, count(distinct case when event_direction = 'up' then anchor_seq end) as up_count,
   round(greatest(max(last_down_ticks), max(vwap_down_ticks)) + 1e-9::double, 6) as max_down_ticks, string_agg(distinct reason, ',' order by reason) as reasons from re group by 1""",
    "agg_14_status_counts": ER + """, sp as (select strftime(unnest(range(timestamp '2023-12-25', timestamp '2024-02-06', interval 1 day)), '%Y%m%d') as trade_date)
   select count(*) as total, count_if(trade_date in (select trade_date from er)) as finished, count_if(trade_date not in (select trade_date from er)) as missing from sp""",
    "agg_15_range_rollup": RE + """, b as (select commodity, count(*) as event_count, count(distinct trade_date) as day_count, count(distinct contract) as contract_count from er group by 1),
   r as (select commodity, reason, row_number() over (partition by commodity order by count(*) desc, reason) as k from re group by 1, 2),
   l as (select commodity, recovery_label, row_number() over (partition by commodity order by count(*) desc, recovery_label) as k from er group by 1, 2)
   select b.*, r.reason as top_reason, l.recovery_label as top_recovery_label from b join r on b.commodity = r.commodity and r.k = 1 join l on b.commodity = l.commodity and l.k = 1""",
    "rul_17_day_status": ER + """, sp as (select strftime(unnest(range(timestamp '2023-12-25', timestamp '2024-02-06', interval 1 day)), '%Y%m%d') as trade_date),
   c as (select trade_date, count(*) as n, count(distinct commodity) as k from er group by 1)
   select sp.trade_date, coalesce(n, 0) as event_count, coalesce(k, 0) as commodity_count, case when n is null then 'missing' else 'finished' end as status from sp left join c using (trade_date)""",
    "agg_16_month_rollup": ER + """, m as (select substr(trade_date, 1, 6) as month, commodity, count(*) as event_count, sum(notional_shortfall) as n from er group by 1, 2)
   select month, commodity, event_count, round(n + 1e-9::double, 3) as notional, round(event_count * 100.0::double / sum(event_count) over (partition by month) + 1e-9::double, 6) as share_pct from m""",
    "top_05_largest_shortfalls": ER + " select event_id, round(notional_shortfall + 1e-9::double, 6) as notional_shortfall from er order by er.notional_shortfall desc, event_id limit 10",
    "top_05_most_common": ER + " select contract, event_count, row_number() over (order by event_count desc, contract) as place from (select contract, count(*) as event_count from er group by 1)",
    "agg_15_range_days": RANGE + " select * from rd",
    "rul_17_range_counts": RANGE + """ select count(*) as total_days, count_if(status = 'complete') as completed_days, count_if(status = 'failed') as failed_days, count_if(status = 'missing_day') as missing_days,
   count_if(status = 'missing_output') as missing_output_days, count_if(status = 'incomplete') as incomplete_days, cast(sum(events) as bigint) as event_count from rd""",
    "agg_16_month_days": ER + """, m as (select substr(trade_date, 1, 6) as month, trade_date, count(*) as event_count, count(distinct commodity) as commodity_count from er group by 1, 2)
   select *, round(avg(event_count) over (partition by month) + 1e-9::double, 6) as events_per_day from m""",
    "agg_25_commodity_years": ER + """ select commodity, cast(substr(trade_date, 1, 4) as int) as year, count(*) as event_count, count(distinct trade_date) as day_count, count(distinct contract) as contract_count from er
   group by grouping sets ((commodity, cast(substr(trade_date, 1, 4) as int)), (commodity))""",
    "agg_26_year_totals": """with y as (select year(cast(o_orderdate as date)) as year, count(*) as event_count from orders group by 1)
   select y.year, y.event_count, round(y.event_count * 100.0::double / sum(y.event_count) over () + 1e-9::double, 6) as share_pct, round((y.event_count - b.event_count) * 100.0::double / b.event_count + 1e-9::double, 6) as change_pct
   from y left join y b on b.year = y.year - 1""",
    "agg_26_leading_commodities": ER + """, p as (select commodity, count_if(substr(trade_date, 1, 4) = '2023') as y2023, count_if(substr(trade_date, 1, 4) = '2024') as y2024 from er group by 1)
   select row_number() over (order by y2023 + y2024 desc, commodity) as place, commodity, y2023, y2024, y2023 + y2024 as total from p qualify place <= 3""",
    "agg_29_pass_flags": UNIQ + """ select "InstrumentID", direction, round(candidate_distance + 1e-9::double, 6) as candidate_distance, true as pass_safe_distance, event_count >= 3 as pass_min_events,
   coalesce(isolation_rate >= 0.1, false) as pass_isolation_rate, coalesce(monthly_opportunity >= 1.0, false) as pass_monthly_opportunity, qualified from evl2""",
    "rul_18_research_shapes": ER + """, dp as (select contract, quantile_cont(event_depth_ticks, [0.5, 0.7, 0.85, 0.9]) as q, cast(right(contract, 1) as int) + length(contract) as k from er group by 1),
   st as (select *, case when k % 5 = 0 then null when k % 4 = 0 then 'too_few' else 'research_candidate_ready' end as status from dp),
   sh as (select contract, status, unnest(['P50', 'P70', 'P85', 'P90']) as sq, greatest(1, ceil(unnest(q) - 1e-12::double))::bigint as t from st where status = 'research_candidate_ready'),
   sw as (select *, greatest(1, ceil(t * 0.4::double - 1e-12::double))::bigint as w from sh)
   select contract as target_contract, status as candidate_status, sq as source_quantile, t as total_touch_ticks, w as "W", t - w as "D", greatest(1, ceil(w * 0.5::double - 1e-12::double))::bigint as "S",
      case when sq = 'P90' then 'P90_tail' else 'P50_P70_P85' end as replay_group, case when sq = 'P90' then 'tail_depth_candidate' end as risk_label, 'prepared' as replay_status from sw
   union all select contract, status, null, null, null, null, null, null, null, case when status is null then 'skipped_missing_statistics' else 'skipped_not_ready' end from st where status is distinct from 'research_candidate_ready'""",
    "top_07_event_order_limit": ER + " select trade_date, event_time, event_id from er where event_direction = 'down' order by trade_date, event_time, event_id limit 100",
    "top_08_hit_commodities": ER + " select commodity, count(*) as event_count from er group by 1",
    "set_01_schema_union": BOUND + " select recovery_label, verdict, count(*) as n_rows from (select recovery_label, null as verdict from er union all select null, verdict from bd) group by 1, 2",
    "set_03_runnable_commodities": ER + " select distinct commodity from er where commodity <> 'SIGNUP'",
    "set_04_missing_contracts": ER + " select contract from er except select contract from er where notional_shortfall > 4500",
    "set_05_missing_days": "select strftime(dd, '%Y%m%d') as trade_date from (select unnest(range(timestamp '1995-01-01', timestamp '2002-01-01', interval 1 day)) as dd) where cast(dd as date) not in (select cast(o_orderdate as date) from orders)",
    "agg_25_month_calendar": ER + """, sp as (select strftime(unnest(range(timestamp '2023-01-01', timestamp '2025-01-01', interval 1 month)), '%Y%m') as month),
   c as (select substr(trade_date, 1, 6) as month, count(*) as n, string_agg(distinct contract, ',' order by contract) as cs, string_agg(distinct trade_date, ',' order by trade_date) as ds, count(distinct trade_date) as dc from er group by 1)
   select sp.month, coalesce(n, 0) as event_count, coalesce(cs, '') as contracts, coalesce(ds, '') as dates, coalesce(dc, 0) as day_count from sp left join c using (month)""",
    "agg_26_year_pivot": ER + """, p as (select commodity, count_if(substr(trade_date, 1, 4) = '2023') as y2023, count_if(substr(trade_date, 1, 4) = '2024') as y2024 from er group by 1)
   select *, y2023 + y2024 as total, round(y2024 * 100.0::double / nullif(sum(y2024) over (), 0) + 1e-9::double, 6) as share_pct,
   round((y2024 - y2023) * 100.0::double / nullif(y2023, 0) + 1e-9::double, 6) as change_pct from p""",
    "top_06_best_scenario": ER + """, g as (select commodity, contract, anchor_seq % 6 as scenario_id, max(notional_shortfall) > 3000 as passed, avg(valid_peer_count) as nr,
   avg(case when event_depth_bps > 20 then 1.0::double else 0 end) as fr, sum(notional_shortfall) as pnl, count(*) as actions from er group by 1, 2, 3)
   select commodity, contract, scenario_id from (select *, row_number() over (partition by commodity, contract order by passed desc, nr, fr, pnl desc, actions, scenario_id) as k from g) where k = 1""",
    "win_31_forward_excursions": UNIQ + f' select "InstrumentID", direction, n, {q6("q90", "q95", "q99")} from exq',
    "win_32_unique_events": UNIQ + ' select trade_date, "InstrumentID", side, row_order, round(threshold_pct + 1e-9::double, 6) as threshold_pct from un',
    "win_30_follow_ratio": UNIQ + ' select trade_date, "InstrumentID", side, row_order, direction, round(follow_ratio + 1e-9::double, 6) as follow_ratio from un',
    "agg_30_safe_distance": UNIQ + ' select "InstrumentID", direction, round(sd + 1e-9::double, 6) as safe_distance from safe',
    "agg_31_observed_days": UNIQ + " select count(distinct trade_date) as observed_days from det",
    "joi_25_distance_counts": UNIQ + ' select "InstrumentID", direction, round(candidate_distance + 1e-9::double, 6) as candidate_distance, event_count, iso as isolated_count from evl',
    "agg_29_distance_choice": UNIQ + ' select safe."InstrumentID", safe.direction, round(sd + 1e-9::double, 6) as safe_distance, round(td + 1e-9::double, 6) as target_distance, round(td * (1 - 0.2::double) + 1e-9::double, 6) as min_distance, round(td * (1 + 0.2::double) + 1e-9::double, 6) as max_distance, case when td is null then \'NO_QUALIFIED_DISTANCE\' else \'QUALIFIED\' end as status from safe join chosen using ("InstrumentID", direction)',
    "src_11_distance_rules": UNIQ + ' select "InstrumentID", direction, \'band\' as violation from chosen where td is not null',
    "agg_17_multiplier": TR.FRAMES + " select commodity, count(*) as n_rows, cast(round_even(median(dt / dv / lp), 0) as bigint) as multiplier from fr where dt > 0 and dv > 0 and lp > 0 group by 1 having count(*) >= 10",
    "agg_19_most_active": TR.FRAMES + " select trade_date, commodity, contract from (select *, row_number() over (partition by trade_date, commodity order by day_volume desc, contract) as k from vols) where k = 1",
    "agg_18_tick_size": "with " + TR.SNAPSHOTS_SQL + """, p as (select distinct commodity, cast(round_even(unnest([bid, ask, last_price]) * 1e8, 0) as bigint) as g from snap),
   p2 as (select * from p where g > 0), gp as (select commodity, g - lag(g) over (partition by commodity order by g) as dg from p2)
   select commodity, round(list_reduce(list(dg), lambda a, b: gcd(a, b)) / 1e8::double, 5) as tick_size from gp where dg is not null group by 1""",
    "prj_03_contract_code": "select c_custkey, case when length(x) = 3 then 'AP2' || x else 'AP' || x end as code from (select c_custkey, cast(c_custkey % 1900 + 100 as varchar) as x from customer)",
    "prj_25_tick_grid": "with " + TR.SNAPSHOTS_SQL + """ select snapshot_seq, round(floor(turnover / 7e3::double / 0.05::double + 1e-9::double) * 0.05::double + 1e-9::double, 6) as floor_px,
   round(round_even(last_price / 0.05::double, 0) * 0.05::double + 1e-9::double, 6) as round_px from snap""",
    "joi_23_reference_differences": LEG + f" select target, reference, {TDATE}, {q6('low_diff', 'high_diff')} from df",
    "win_27_trailing_means": LEG + f" select target, {TDATE}, high_hits, low_hits, amplitude_flag from lg",
    "rul_16_legacy_flags": LEG + f" select target, {TDATE}, high_hits + low_hits > 0 and volume > 20 as is_flagged, case when high_hits + low_hits > 0 and volume > 20 then concat_ws('; ', words, case when amplitude_flag then '振幅异常 (当前振幅: ' || printf('%.2f', round(amp + 1e-9::double, 2)) || ', 历史平均: ' || printf('%.2f', round(am + 1e-9::double, 2)) || ', 倍数: ' || printf('%.2f', round(amp / am + 1e-9::double, 2)) || ')' end) end as anomaly_reasons from lg",
    "win_26_moving_averages": "with " + BARS_SQL + f""", m as (select *, case when count(*) over a >= 5 then avg(close) over a end as m5, case when count(*) over b >= 20 then avg(close) over b end as m20 from bars
   window a as (partition by contract order by trade_date rows between 4 preceding and current row), b as (partition by contract order by trade_date rows between 19 preceding and current row))
   select contract, {TDATE}, round(coalesce(m5, 0) + 1e-9::double, 6) as ma_5, round(coalesce(close - m5, 0) + 1e-9::double, 6) as ma_5_diff, round(coalesce(m20, 0) + 1e-9::double, 6) as ma_20,
   round(coalesce((close - m20) / m20 * 100, 0) + 1e-9::double, 6) as ma_20_diff_pct from m""",
}

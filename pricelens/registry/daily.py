"""Daily-screen queries and their reference SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import codes
from ..plans import daily as P
from ..sources.driver_tables import BARS_SQL, daily_bars

START, END = "1996-06-03", "2001-06-04"


def r6(*names: str):
    """Six decimals; the nudge sends exact ties the same way whatever the rounding rule of the engine."""
    return [F.round(F.col(n) + F.lit(1e-9), 6).alias(n) for n in names]


def q6(*names: str) -> str:
    return ", ".join(f"round({n} + 1e-9::double, 6) as {n}" for n in names)


def _date():
    return F.date_format("trade_date", "yyyy-MM-dd").alias("trade_date")


QDATE = "strftime(trade_date, '%Y-%m-%d') as trade_date"


def _bars(spark, d):
    return P.with_previous_close(daily_bars(spark, d))


def _status(spark, d):
    return P.assign_status(P.attach_references(P.with_lifetime(_bars(spark, d))), None)


def _peers(spark, d):
    return P.same_day_peers(_status(spark, d))


def _scored(spark, d):
    return P.score(P.history_metrics(_peers(spark, d)))


def _samples(spark, d):
    return P.result_samples(_scored(spark, d), START, END)


BARS0 = "with " + BARS_SQL + """,
barp as (select *, lag(close) over (partition by commodity, contract order by trade_date) as pre_close from bars)"""
REFS = BARS0 + """,
refs as (select *, first_value(contract) over (partition by commodity, trade_date order by volume desc, contract)
           as main_reference_contract from barp),
mains as (select distinct commodity, trade_date, main_reference_contract as m from refs),
changes as (select commodity, trade_date, m is distinct from lag(m) over (partition by commodity order by trade_date)
           as main_reference_changed_today from mains),
refs2 as (select r.*, c.main_reference_changed_today from refs r join changes c using (commodity, trade_date))"""
STATUS = REFS + """,
meta as (select commodity, contract, min(trade_date) as listed_date, max(trade_date) as last_trade_date
         from barp group by all),
s1 as (select r.*, m.listed_date, m.last_trade_date,
   count(trade_date) over h as observed_history_count,
   coalesce(sum(case when volume > 0 then 1 else 0 end) over h, 0) as recent_active_days
   from refs2 r join meta m using (commodity, contract)
   window h as (partition by commodity, contract order by trade_date rows between 20 preceding and 1 preceding)),
s2 as (select *, case
   when open is null or high is null or low is null or close is null or pre_close is null or high < low or open < low
     or open > high or close < low or close > high or pre_close <= 0 or volume < 0 then 'invalid_basic_data'
   when volume = 0 then 'invalid_low_liquidity'
   when observed_history_count >= 10 and recent_active_days < 10 then 'invalid_low_liquidity'
   when date_diff('day', listed_date, trade_date) < 10 or date_diff('day', trade_date, last_trade_date) < 10
     then 'invalid_lifecycle_edge'
   else 'valid' end as own from s1),
s3 as (select *, coalesce(sum(case when own = 'valid' then 1 else 0 end) over (partition by commodity, contract
   order by trade_date rows between unbounded preceding and 1 preceding), 0) as prior_valid_count from s2),
s4 as (select *, case when own = 'valid' and prior_valid_count < 10 then 'invalid_insufficient_history' else own end
   as settled from s3),
s5 as (select a.*, b.settled as main_status,
   sum(case when a.settled = 'valid' then 1 else 0 end) over (partition by a.commodity, a.trade_date) as analyzable_count
   from s4 a left join s4 b on a.commodity = b.commodity and a.trade_date = b.trade_date
     and a.main_reference_contract = b.contract),
status as (select *, case when settled = 'valid' and (main_status is distinct from 'valid' or analyzable_count < 2)
   then 'invalid_insufficient_peer' else settled end as sample_status from s5)"""
PEERS = STATUS + """,
act as (select * from (select *, row_number() over (partition by commodity, trade_date order by volume desc, contract)
   as rn from status where sample_status = 'valid' and volume > 0) where rn <= 5),
pm as (select s.commodity, s.contract, s.trade_date, count(a.contract) as active_peer_count,
   median(a.high) as peer_high_median, median(a.low) as peer_low_median,
   median(cast(a.volume as double)) as peer_volume_median,
   median((a.high - a.low) / nullif(a.close, 0)) as peer_range_median
   from status s left join act a on s.commodity = a.commodity and s.trade_date = a.trade_date and s.contract <> a.contract
   group by 1, 2, 3),
p1 as (select s.*, pm.* exclude (commodity, contract, trade_date),
   (high - low) / nullif(close, 0) as range_pct,
   greatest(abs(high - close), abs(low - close)) / nullif(close, 0) as extreme_pct,
   case when active_peer_count > 0 then greatest(greatest(0, (high - peer_high_median) / close),
     greatest(0, (peer_low_median - low) / close)) end as raw_structure_residual
   from status s join pm using (commodity, contract, trade_date)),
p2 as (select *, case when peer_range_median > 0 then greatest(0, raw_structure_residual - peer_range_median) end
   as excess_structure_residual from p1),
p3 as (select *, case when peer_range_median > 0 then excess_structure_residual / peer_range_median end
   as normalized_structure_residual from p2),
loo as (select a.commodity, a.contract, a.trade_date, median(b.normalized_structure_residual) as om
   from p3 a join p3 b on a.commodity = b.commodity and a.trade_date = b.trade_date and a.contract <> b.contract
   group by 1, 2, 3),
peers as (select p3.*, normalized_structure_residual - om as raw_uniqueness_gap,
   case when normalized_structure_residual - om is not null then greatest(0, normalized_structure_residual - om) end
   as uniqueness_gap from p3 left join loo using (commodity, contract, trade_date))"""


def _hist_sql() -> str:
    parts, joins = [], []
    spec = [("range", "range_pct", "sample_status = 'valid'"), ("extreme", "extreme_pct", "sample_status = 'valid'"),
            ("structure", "normalized_structure_residual", "sample_status = 'valid' and active_peer_count >= 2"),
            ("uniqueness", "uniqueness_gap", "sample_status = 'valid' and active_peer_count >= 2")]
    for name, col, cond in spec:
        cols = ", ".join(
            f"case when count({col}) over w >= 10 then quantile_cont({col}, {q}) over w end as {name}_q{n}"
            for n, q in (("90", 0.9), ("95", 0.95), ("99", 0.99)))
        parts.append(f"h_{name} as (select commodity, contract, trade_date, {cols} from peers where {cond} and {col} is not null "
                     "window w as (partition by commodity, contract order by trade_date rows between 20 preceding and 1 preceding))")
        joins.append(f"left join h_{name} using (commodity, contract, trade_date)")
    for name, col, cond in (("rolling_median_volume", "cast(volume as double)", "sample_status = 'valid'"),
                            ("rolling_median_active_peer_count", "cast(active_peer_count as double)",
                             "sample_status = 'valid' and active_peer_count >= 2")):
        parts.append(f"h_{name} as (select commodity, contract, trade_date, case when count(*) over w >= 10 then "
                     f"quantile_cont({col}, 0.5) over w end as {name} from peers where {cond} "
                     "window w as (partition by commodity, contract order by trade_date rows between 20 preceding and 1 preceding))")
        joins.append(f"left join h_{name} using (commodity, contract, trade_date)")
    return ",\n".join(parts) + ",\nhist0 as (select * from peers " + " ".join(joins) + """),
hist as (select *, sample_status = 'valid' and active_peer_count >= 1 and active_peer_count <
     greatest(2, coalesce(rolling_median_active_peer_count, 2) - 1) as peer_comparability_weak_flag,
   coalesce(sample_status = 'valid' and volume < 0.2 * rolling_median_volume and volume < 0.3 * peer_volume_median, false)
     as target_liquidity_weak_flag from hist0)"""


HIST = PEERS + ",\n" + _hist_sql()


def _steps(value, prefix, points, fallbacks=None):
    arms = []
    for i in (2, 1, 0):
        q = f"{prefix}_q{('90', '95', '99')[i]}"
        cond = f"({q} > 0 and {value} >= {q})"
        if fallbacks:
            cond = f"({cond} or (not coalesce({q} > 0, false) and {value} >= {fallbacks[i]}))"
        arms.append(f"when {cond} then {points[i]}")
    return "case " + " ".join(arms) + " else 0.0 end"


SCORE = HIST + f""",
sc1 as (select *, {_steps('range_pct', 'range', ('4.0', '8.0', '12.0'))} as "A1_score",
  {_steps('extreme_pct', 'extreme', ('3.0', '5.0', '8.0'))} as "A2_score",
  {_steps('normalized_structure_residual', 'structure', ('12.0', '24.0', '40.0'), (0.25, 0.5, 1.0))} as "C1_score",
  {_steps('uniqueness_gap', 'uniqueness', ('5.0', '10.0', '20.0'), (0.25, 0.5, 1.0))} as "C2_score",
  (sample_status <> 'valid' or active_peer_count <= 0) as inv,
  (peer_comparability_weak_flag or target_liquidity_weak_flag) as weak from hist),
sc2 as (select *, case when inv then 0.0 else least("A1_score" + "A2_score", 20.0) end as "A_score",
  case when inv then 0.0 else least("C1_score" + "C2_score", 60.0) end as "C_score",
  case when inv then -20.0 when weak or active_peer_count = 1 then -10.0 when active_peer_count = 2 then -5.0 else 0.0 end
    as "E_score" from sc1),
sc3 as (select *, case when inv then 0.0 else greatest(0.0, least(100.0, "A_score" + "C_score" + "E_score")) end
   as candidate_score from sc2),
scored as (select *, case when inv or candidate_score < 30 then 'none' when candidate_score >= 65 and "C_score" < 35 then 'medium'
   when "C_score" < 20 then 'low' when candidate_score >= 65 then 'high' when candidate_score >= 50 then 'medium' else 'low' end
   as candidate_level from sc3),
samples as (select *, commodity || '|' || contract || '|' || strftime(trade_date, '%Y-%m-%d') as detail_id,
   case when "A_score" >= 8 or "C_score" >= 20 or peer_comparability_weak_flag or target_liquidity_weak_flag
     or active_peer_count <= 1 or sample_status <> 'valid' then concat_ws('；',
     case when "A_score" >= 8 then '振幅异常' end, case when "C_score" >= 20 then '结构失真' end,
     case when peer_comparability_weak_flag then '可比合约不足' end,
     case when target_liquidity_weak_flag then '目标合约流动性偏弱' end,
     case when active_peer_count = 1 then '仅1个活跃可比合约' end, case when active_peer_count = 0 then '无活跃可比合约' end,
     case when sample_status <> 'valid' then '样本状态=' || case sample_status
       when 'invalid_basic_data' then '基础数据无效' when 'invalid_low_liquidity' then '低流动性无效'
       when 'invalid_lifecycle_edge' then '生命周期边界无效' when 'invalid_insufficient_history' then '历史样本不足'
       else '对照不足' end end) else '无明显触发项' end as trigger_reasons
   from scored where trade_date between date '{START}' and date '{END}'),
suspects as (select * from samples where candidate_level <> 'none'
   and (peer_volume_median is null or volume >= 0.1 * peer_volume_median)),
excess as (select * from (
   select 'high' as metric, (high - peer_high_median) / nullif(peer_high_median, 0) * 100 as excess_pct
     from suspects where contains(trigger_reasons, '振幅异常')
   union all select 'low', (peer_low_median - low) / nullif(peer_low_median, 0) * 100
     from suspects where contains(trigger_reasons, '振幅异常')
   union all select 'range', (range_pct - peer_range_median) / nullif(peer_range_median, 0) * 100
     from suspects where contains(trigger_reasons, '振幅异常')) where excess_pct > 0),
gaps as (select commodity, cast(abs((cast(substr(contract, 3, 2) as int) * 12 + cast(substr(contract, 5, 2) as int))
   - (cast(substr(main_reference_contract, 3, 2) as int) * 12 + cast(substr(main_reference_contract, 5, 2) as int))) as bigint)
   as gap_months from suspects)"""

def _id():
    return ["commodity", "contract", _date()]


QID = f"commodity, contract, {QDATE}"


def _top_rank(spark, d):
    df = P.active_ranked(_status(spark, d)).filter("is_active")
    return df.select(*_id(), F.col("volume"))


def _status_counts(spark, d):
    return _status(spark, d).groupBy("sample_status").agg(F.count(F.lit(1)).alias("n_rows"))


def _structure_summary(spark, d):
    """Entry query: bars -> references -> status -> peers -> residual summary per commodity."""
    return _peers(spark, d).groupBy("commodity").agg(
        F.count(F.lit(1)).alias("sample_count"), F.countDistinct("contract").alias("contract_count"),
        F.count_if(F.col("sample_status") == "valid").alias("valid_count"),
        F.round(F.max("raw_structure_residual"), 6).alias("max_raw_structure_residual"),
        F.round(F.avg("active_peer_count"), 6).alias("avg_active_peer_count"),
    )


QUERIES = {
    "src_02_contract_bounds": lambda s, d: P.contract_bounds(daily_bars(s, d)).select(
        "commodity", "contract", F.date_format("listed_date", "yyyy-MM-dd").alias("listed_date"),
        F.date_format("last_trade_date", "yyyy-MM-dd").alias("last_trade_date")),
    "prj_05_previous_close": lambda s, d: _bars(s, d).select(*_id(), *r6("close", "pre_close")),
    "prj_07_contract_meta": lambda s, d: P.contract_meta(_bars(s, d), P.contract_bounds(_bars(s, d))).select(
        "commodity", "contract", "delivery_month", F.datediff("last_trade_date", "listed_date").cast("bigint").alias("span_days")),
    "prj_08_range_extreme": lambda s, d: _peers(s, d).select(*_id(), *r6("range_pct", "extreme_pct")),
    "top_03_main_reference": lambda s, d: P.attach_references(_bars(s, d)).select(*_id(), "main_reference_contract"),
    "win_01_main_changed": lambda s, d: P.reference_changes(P.attach_references(_bars(s, d))).select(
        "commodity", _date(), "main_reference_changed_today"),
    "win_02_recent_activity": lambda s, d: _status(s, d).select(
        *_id(), F.col("observed_history_count").cast("bigint").alias("observed_history_count"),
        F.col("recent_active_days").cast("bigint").alias("recent_active_days")),
    "win_03_prior_valid_count": lambda s, d: _status(s, d).select(
        *_id(), F.col("prior_valid_count").cast("bigint").alias("prior_valid_count")),
    "rul_01_sample_status": lambda s, d: _status(s, d).select(*_id(), "sample_status"),
    "agg_03_analyzable_count": lambda s, d: _status(s, d).select(
        "commodity", _date(), F.col("analyzable_count").cast("bigint").alias("analyzable_count")).distinct(),
    "joi_03_main_reference_status": _status_counts,
    "top_01_active_contracts": _top_rank,
    "agg_04_peer_medians": lambda s, d: _peers(s, d).select(
        *_id(), F.col("active_peer_count").cast("bigint").alias("active_peer_count"),
        *r6("peer_high_median", "peer_low_median", "peer_volume_median", "peer_range_median")),
    "rul_02_structure_residual": lambda s, d: _peers(s, d).select(
        *_id(), *r6("raw_structure_residual", "excess_structure_residual", "normalized_structure_residual")),
    "rul_03_uniqueness_gap": lambda s, d: _peers(s, d).select(*_id(), *r6("raw_uniqueness_gap", "uniqueness_gap")),
    "win_04_rolling_quantiles": lambda s, d: P.history_metrics(_peers(s, d)).select(*_id(), *r6(*[
        f"{n}_{q}" for n in ("range", "extreme", "structure", "uniqueness") for q in ("q90", "q95", "q99")])),
    "win_05_rolling_medians": lambda s, d: P.history_metrics(_peers(s, d)).select(
        *_id(), *r6("rolling_median_volume", "rolling_median_active_peer_count"),
        "peer_comparability_weak_flag", "target_liquidity_weak_flag"),
    "rul_04_a_score": lambda s, d: _scored(s, d).select(*_id(), *r6("A1_score", "A2_score", "A_score")),
    "rul_05_c_score": lambda s, d: _scored(s, d).select(*_id(), *r6("C1_score", "C2_score", "C_score")),
    "rul_06_e_score": lambda s, d: _scored(s, d).select(*_id(), *r6("E_score")),
    "rul_07_candidate_level": lambda s, d: _scored(s, d).select(*_id(), *r6("candidate_score"), "candidate_level"),
    "rul_08_suspicious_dates": lambda s, d: P.suspicious(_samples(s, d)).select(
        "detail_id", *r6("candidate_score"), "candidate_level", "main_reference_contract"),
    "rul_09_trigger_reasons": lambda s, d: _samples(s, d).select("detail_id", "trigger_reasons"),
    "agg_01_commodity_summary": lambda s, d: P.commodity_summary(P.suspicious(_samples(s, d))).select(
        "commodity", "candidate_count", "contract_count", *r6("max_candidate_score")),
    "agg_02_overview": lambda s, d: P.overview(_samples(s, d)),
    "top_04_peer_display": lambda s, d: P.peer_display(_samples(s, d)).select(
        "detail_id", F.explode("peer_rows").alias("p")).select(
        "detail_id", F.col("p.contract").alias("peer_contract"), F.col("p.is_target").alias("is_target")),
    "snk_03_report_payload": lambda s, d: P.report_payload(_samples(s, d)).select(
        "detail_id",
        F.get_json_object("payload", "$.candidate_level").alias("candidate_level"),
        F.size(F.from_json(F.get_json_object("payload", "$.peer_rows"), "array<struct<contract:string>>")).cast("bigint").alias("n_peer_rows")),
    "agg_27_amplitude_excess": lambda s, d: P.amplitude_summary(
        P.amplitude_excess(P.suspicious(_samples(s, d)))).select("metric", "n_rows", *r6("p50", "p90", "max_pct")),
    "agg_27_amplitude_histogram": lambda s, d: P.amplitude_histogram(P.amplitude_excess(P.suspicious(_samples(s, d)))),
    "agg_28_contract_gap": lambda s, d: P.contract_gap_summary(P.contract_gaps(P.suspicious(_samples(s, d)))).select(
        "scope", "n_rows", *r6("p50", "p90"), "max_gap"),
    "agg_28_contract_gap_histogram": lambda s, d: P.contract_gap_histogram(P.contract_gaps(P.suspicious(_samples(s, d)))),
    "daily_structure_summary": _structure_summary,
}

ORACLE = {
    "src_02_contract_bounds": "with " + BARS_SQL + " select commodity, contract, strftime(min(trade_date), '%Y-%m-%d') as listed_date, strftime(max(trade_date), '%Y-%m-%d') as last_trade_date from bars group by 1, 2",
    "prj_05_previous_close": BARS0 + f" select {QID}, {q6('close', 'pre_close')} from barp",
    "prj_07_contract_meta": BARS0 + " select commodity, contract, regexp_extract(contract, '(\\d{3,4})$', 1) as delivery_month, date_diff('day', min(trade_date), max(trade_date)) as span_days from barp group by commodity, contract",
    "prj_08_range_extreme": BARS0 + f" select {QID}, round((high - low) / nullif(close, 0) + 1e-9::double, 6) as range_pct, round(greatest(abs(high - close), abs(low - close)) / nullif(close, 0) + 1e-9::double, 6) as extreme_pct from barp",
    "top_03_main_reference": REFS + f" select {QID}, main_reference_contract from refs2",
    "win_01_main_changed": REFS + f" select commodity, {QDATE}, main_reference_changed_today from changes",
    "win_02_recent_activity": STATUS + f" select {QID}, cast(observed_history_count as bigint) as observed_history_count, cast(recent_active_days as bigint) as recent_active_days from status",
    "win_03_prior_valid_count": STATUS + f" select {QID}, cast(prior_valid_count as bigint) as prior_valid_count from status",
    "rul_01_sample_status": STATUS + f" select {QID}, sample_status from status",
    "agg_03_analyzable_count": STATUS + f" select distinct commodity, {QDATE}, cast(analyzable_count as bigint) as analyzable_count from status",
    "joi_03_main_reference_status": STATUS + " select sample_status, count(*) as n_rows from status group by 1",
    "top_01_active_contracts": PEERS + f" select {QID}, volume from act",
    "agg_04_peer_medians": PEERS + f" select {QID}, active_peer_count, {q6('peer_high_median', 'peer_low_median', 'peer_volume_median', 'peer_range_median')} from peers",
    "rul_02_structure_residual": PEERS + f" select {QID}, {q6('raw_structure_residual', 'excess_structure_residual', 'normalized_structure_residual')} from peers",
    "rul_03_uniqueness_gap": PEERS + f" select {QID}, {q6('raw_uniqueness_gap', 'uniqueness_gap')} from peers",
    "win_04_rolling_quantiles": HIST + f" select {QID}, " + q6(*[f"{n}_{q}" for n in ("range", "extreme", "structure", "uniqueness") for q in ("q90", "q95", "q99")]) + " from hist",
    "win_05_rolling_medians": HIST + f" select {QID}, {q6('rolling_median_volume', 'rolling_median_active_peer_count')}, peer_comparability_weak_flag, target_liquidity_weak_flag from hist",
    "rul_04_a_score": SCORE + f' select {QID}, cast("A1_score" as double) as "A1_score", cast("A2_score" as double) as "A2_score", cast("A_score" as double) as "A_score" from scored',
    "rul_05_c_score": SCORE + f' select {QID}, cast("C1_score" as double) as "C1_score", cast("C2_score" as double) as "C2_score", cast("C_score" as double) as "C_score" from scored',
    "rul_06_e_score": SCORE + f' select {QID}, cast("E_score" as double) as "E_score" from scored',
    "rul_07_candidate_level": SCORE + f" select {QID}, cast(candidate_score as double) as candidate_score, candidate_level from scored",
    "rul_08_suspicious_dates": SCORE + " select detail_id, cast(candidate_score as double) as candidate_score, candidate_level, main_reference_contract from suspects",
    "rul_09_trigger_reasons": SCORE + " select detail_id, trigger_reasons from samples",
    "agg_01_commodity_summary": SCORE + " select commodity, count(*) as candidate_count, count(distinct contract) as contract_count, cast(max(candidate_score) as double) as max_candidate_score from suspects group by 1",
    "agg_02_overview": SCORE + " select (select count(*) from suspects) as candidate_count, (select count(*) from samples where sample_status <> 'valid') as invalid_sample_count",
    "top_04_peer_display": SCORE + """,
a5 as (select * from (select *, row_number() over (partition by commodity, trade_date order by volume desc, contract) as rk
   from samples where sample_status = 'valid' and volume > 0) where rk <= 5)
select s.detail_id, a.contract as peer_contract, a.contract = s.contract as is_target from samples s
   join a5 a on s.commodity = a.commodity and s.trade_date = a.trade_date
union all select s.detail_id, s.contract, true from samples s where not exists (select 1 from a5 a where
   a.commodity = s.commodity and a.trade_date = s.trade_date and a.contract = s.contract)""",
    "snk_03_report_payload": SCORE + """,
a5 as (select * from (select *, row_number() over (partition by commodity, trade_date order by volume desc, contract) as rk
   from samples where sample_status = 'valid' and volume > 0) where rk <= 5)
select s.detail_id, any_value(s.candidate_level) as candidate_level,
   count(a.contract) + case when count(case when a.contract = s.contract then 1 end) = 0 then 1 else 0 end as n_peer_rows
   from samples s left join a5 a on s.commodity = a.commodity and s.trade_date = a.trade_date group by 1""",
    "agg_27_amplitude_excess": SCORE + " select metric, count(*) as n_rows, round(quantile_cont(excess_pct, 0.5) + 1e-9::double, 6) as p50, round(quantile_cont(excess_pct, 0.9) + 1e-9::double, 6) as p90, round(max(excess_pct) + 1e-9::double, 6) as max_pct from excess group by 1",
    "agg_27_amplitude_histogram": SCORE + " select metric, cast(floor(excess_pct / 5) * 5 as bigint) as bucket_start, count(*) as n_rows from excess group by 1, 2",
    "agg_28_contract_gap": SCORE + """ select scope, count(*) as n_rows, round(quantile_cont(cast(gap_months as double), 0.5) + 1e-9::double, 6) as p50,
   round(quantile_cont(cast(gap_months as double), 0.9) + 1e-9::double, 6) as p90, max(gap_months) as max_gap from (
   select commodity as scope, gap_months from gaps union all select 'all', gap_months from gaps) group by 1""",
    "agg_28_contract_gap_histogram": SCORE + """ select scope, gap_months, count(*) as n_rows from (
   select commodity as scope, gap_months from gaps union all select 'all', gap_months from gaps) group by 1, 2""",
    "daily_structure_summary": PEERS + """ select commodity, count(*) as sample_count, count(distinct contract) as contract_count,
   count(*) filter (where sample_status = 'valid') as valid_count, round(max(raw_structure_residual), 6) as max_raw_structure_residual,
   round(avg(active_peer_count), 6) as avg_active_peer_count from peers group by 1""",
}

"""Readers, digests, caches and table sets over files that are written from the driver tables, with their reference SQL."""
from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import DailyConfig, StudyConfig
from ..functions.codes import file_contract_info
from ..plans import daily as P, study as S
from ..session import ensure_checkpoint_dir, materialize
from ..sources import archives, files, sinks, store
from ..plans.events import load_directions
from ..sources.driver_tables import BARS_SQL, EVENT_ROWS_SQL, SNAPSHOTS_SQL, daily_bars, event_rows, snapshots
from .daily import SCORE, _samples, q6, r6
from .study import SPINE, _all as study_results

# Column of the files that the reader leaves out; its text tells UTF-8 from GB18030.
HEADER = "TradingDay,InstrumentID,UpdateTime,UpdateMillisec,LastPrice,Volume,BidPrice1,备注"


def folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/pricelens-src-{uuid.uuid4().hex}"


def contract_files(spark: SparkSession, d: str) -> DataFrame:
    """date, contract, k (a number that deals out places and encodings) and the CSV text of each contract-day."""
    rows = snapshots(spark, d).select(
        F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), F.col("trade_day").cast("int")), "yyyyMMdd").alias("date"), "contract", "snapshot_seq",
        (F.col("trade_day") * 6 + F.substring("contract", -1, 1).cast("bigint") + F.length("commodity")).alias("k"),
        F.concat_ws(",", F.col("trade_day").cast("string"), "contract", "UpdateTime", F.col("UpdateMillisec").cast("string"), F.col("LastPrice").cast("string"),
                    F.col("Volume").cast("string"), F.col("BidPrice1").cast("string"), F.lit("备注")).alias("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("snapshot_seq", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("date", "contract", "k").agg(F.concat(F.lit(HEADER + "\n"), joined, F.lit("\n")).alias("text"))


def _placed(contents: DataFrame, path, member, encoding=None, tail=None) -> DataFrame:
    text = lambda x: F.lit(None).cast("string") if x is None else x
    return contents.select(path.alias("path"), text(member).alias("member"), "text", text(encoding).alias("encoding"), (F.lit(None) if tail is None else tail).cast("binary").alias("tail"))


def tree(spark: SparkSession, d: str) -> str:
    """All contract-days in month archives, half of them in day archives too, a third as files; one continuous series a day."""
    c, root = contract_files(spark, d), folder(spark)
    name = F.concat("contract", F.lit("_"), "date", F.lit(".csv"))
    month = F.substring("date", 1, 6)
    monthly = _placed(c, F.concat(month, F.lit(".zip")), F.concat("date", F.lit("/"), name))
    other = _placed(c.where(F.col("contract").endswith("1")), F.concat(month, F.lit(".zip")), F.concat(F.lit("主力连续_"), "contract", F.lit("_"), "date", F.lit(".csv")))
    day = _placed(c.where("k % 2 = 0"), F.concat(month, F.lit("/"), "date", F.lit(".zip")), name)
    plain = _placed(c.where("k % 3 = 0"), F.concat(F.lit("csv/"), name), None)
    archives.write_files(monthly.union(other).union(day).union(plain), root)
    return root


def _archive_rows(spark, d):
    c, root = contract_files(spark, d), folder(spark)
    archives.write_files(_placed(c, F.concat(F.substring("date", 1, 6), F.lit(".zip")), F.concat("date", F.lit("/"), "contract", F.lit("_"), "date", F.lit(".csv"))), root)
    return files.read_snapshot_archives(spark, root).select("source_file", "trade_date", "contract", "parse_status", "snapshot_seq", "TradingDay", "UpdateTime", "UpdateMillisec", "LastPrice", "Volume", "BidPrice1")


def _discovered(spark, d):
    root = tree(spark, d)
    return files.discover_sources(spark, root).select(F.regexp_replace("label", r"^.*pricelens-src-[0-9a-f]{32}/", "").alias("label"), "contract", "trade_date", F.col("priority").cast("bigint").alias("priority"), "status")


def _located(spark, d):
    root = tree(spark, d)
    dates = contract_files(spark, d).select("date").union(spark.createDataFrame([("20990101",)], "date string")).withColumnRenamed("date", "trade_date")
    found = files.locate_day(archives.listing(spark, root), root, dates)
    return found.select("trade_date", F.regexp_replace("source", r"^.*pricelens-src-[0-9a-f]{32}/", "").alias("source"))


def _encoded(spark, d):
    """Quarters of the files in UTF-8, marked UTF-8, GB18030, and with bytes that neither can have."""
    c, root = contract_files(spark, d), folder(spark)
    encoding = F.element_at(F.array(F.lit("utf-8"), F.lit("utf-8-sig"), F.lit("gb18030"), F.lit("utf-8")), (F.col("k") % 4 + 1).cast("int"))
    name = F.concat("contract", F.lit("_"), "date", F.lit(".csv"))
    archives.write_files(_placed(c, name, None, encoding, F.when(F.col("k") % 4 == 3, F.unhex(F.lit("FFFF0A")))), root)
    rows, bad = files.read_snapshot_sources(spark, root)
    probed = archives.probe(archives.sources(spark, root)).select(F.element_at(F.split("path", "/"), -1).alias("source_file"), "encoding", "status")
    read = rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("Volume").alias("volume"), F.round(F.sum("LastPrice"), 2).alias("last_price"))
    read = read.unionByName(bad.select("source_file", F.lit(0).cast("bigint").alias("n_rows")), allowMissingColumns=True)
    return probed.join(read, "source_file", "left")


def _file_digests(spark, d):
    root = tree(spark, d)
    found = archives.file_digests(archives.sources(spark, root))
    return found.select(F.concat_ws("::", F.regexp_replace("path", r"^.*pricelens-src-[0-9a-f]{32}/", ""), "member").alias("label"), "bytes", "sha256")


def _bars_raw(spark, d):
    """Vendor rows with mixed code and date forms, unusable dates and prices, and repeated days."""
    k, i = F.col("k"), F.col("i")
    bars = daily_bars(spark, d).withColumn("k", F.floor(F.datediff("trade_date", F.lit("1992-01-06").cast("date")) / 7))
    bars = bars.withColumn("i", F.explode(F.when(k % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    code = F.when(k % 11 == 0, F.concat("commodity", F.lit(".DCE"))).when(k % 3 == 0, F.concat(F.lower("contract"), F.lit(".DCE"))).when(k % 3 == 1, F.concat("contract", F.lit(".x"))).otherwise(F.col("contract"))
    date = F.when(k % 13 == 0, "n/a").when(k % 2 == 0, F.date_format("trade_date", "yyyyMMdd")).otherwise(F.date_format("trade_date", "yyyy-MM-dd"))
    cut = lambda c: (F.floor(F.col(c) * 1000.0) / 1000.0).cast("string")  # one rule in both engines
    text = lambda c: cut(c).alias(c)
    none = F.lit(None).cast("string")
    return bars.select(code.alias("code"), date.alias("date"), text("open"), text("high"), text("low"), F.when(k % 7 == 0, "bad").otherwise(cut("close")).alias("close"),
                       F.when(k % 4 == 0, cut("low")).otherwise(none).alias("pre_close"), F.when(k % 4 == 1, cut("high")).otherwise(none).alias("pre_settle"),
                       (F.col("volume") + i).cast("string").alias("vol"), i.alias("_row"))


def _standardized(spark, d):
    wanted = files.normalize_symbols(" ax, BX,,bx,CX ")
    return P.standardize_bars(_bars_raw(spark, d), wanted, ["_row"]).select("commodity", "contract", F.date_format("trade_date", "yyyy-MM-dd").alias("trade_date"), *r6("open", "close", "pre_close"), F.col("volume").cast("bigint").alias("volume"))


def _history_bounds(spark, d):
    return P.contract_bounds(P.traded_days(_bars_raw(spark, d), ["AX", "BX", "CX"])).select("commodity", "contract", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("listed_date", "last_trade_date")])


def _contract_meta(spark, d):
    bars = daily_bars(spark, d)
    meta = P.contract_meta(bars, P.contract_bounds(bars.where("commodity <> 'EX'")))
    days = lambda a, b: F.datediff(a, b).cast("bigint")
    return bars.join(meta, ["commodity", "contract"], "left").select("commodity", "contract", F.date_format("trade_date", "yyyy-MM-dd").alias("trade_date"), "delivery_month",
                                                                        days("trade_date", "listed_date").alias("days_listed"), days("last_trade_date", "trade_date").alias("days_left"))


def _file_names(spark, d):
    """Names of contract files in every form that is met: upper and lower case, three digits, continuous, suffixed, foreign."""
    c = contract_files(spark, d).select("date", "contract", "k")
    letters, digits = F.regexp_extract("contract", "^([A-Z]+)", 1), F.regexp_extract("contract", r"(\d+)$", 1)
    forms = [F.concat("contract", F.lit("_"), "date", F.lit(".csv")), F.concat(F.lower("contract"), F.lit("_"), "date", F.lit(".CSV")), F.concat(letters, F.substring(digits, 2, 3), F.lit("_"), "date", F.lit(".csv")),
             F.concat(letters, F.lit("主力连续_"), "date", F.lit(".csv")), F.concat("contract", F.lit("_"), "date", F.lit("1.csv")), F.concat(F.lit("x-"), "contract", F.lit(".csv"))]
    name = F.element_at(F.array(*forms), (F.col("k") % 6 + 1).cast("int"))
    return c.select(name.alias("file_name")).withColumn("i", file_contract_info(F.col("file_name"))).select("file_name", "i.*")


def _filtered(spark, d):
    rows = snapshots(spark, d).select("snapshot_seq", F.when(F.col("snapshot_seq") % 2 == 0, F.concat(F.regexp_extract("contract", "^([A-Z]+)", 1), F.substring("contract", -3, 3))).otherwise(F.lower("contract")).alias("instrument"))
    return rows.select("snapshot_seq", "instrument", files.matches(F.col("instrument"), ["click", "View"]).alias("by_commodity"), files.matches(F.col("instrument"), None, ["CLICK402", "view2403"]).alias("by_contract"))


def _screen_set(spark, d):
    """Two sets published one after the other; the second is read back, the first is retired."""
    place, samples = folder(spark), materialize(_samples(spark, d))
    sinks.publish(P.result_tables(samples.limit(0)), place)
    sinks.publish(P.result_tables(samples), place)
    sinks.retire(spark, place)
    tables = sinks.current_tables(spark, place)
    suspects = tables["suspicious_dates"].select("detail_id", F.lit("suspicious_dates").alias("table"), F.round("candidate_score", 6).alias("value"))
    invalid = tables["invalid_samples"].select("detail_id", F.lit("invalid_samples").alias("table"), F.lit(None).cast("double").alias("value"))
    summary = tables["commodity_summary"].select(F.col("commodity").alias("detail_id"), F.lit("commodity_summary").alias("table"), F.col("candidate_count").cast("double").alias("value"))
    payload = tables["summary"].select("detail_id", F.lit("summary").alias("table"), F.get_json_object("payload", "$.candidate_score").cast("double").alias("value"))
    return suspects.union(invalid).union(summary).union(payload.withColumn("value", F.round("value", 6)))


def _study_set(spark, d):
    """Rows of each study table by the manifest and as read back from CSV, and how many of the fixed columns hold values."""
    cfg, place = StudyConfig(), folder(spark)
    tables = S.output_tables(study_results(spark, d), cfg)
    manifest = sinks.publish(tables, place, sinks.study_columns(cfg.horizons, cfg.excursion_seconds), "csv")
    named = spark.createDataFrame([(n, t["rows"], len(t["columns"])) for n, t in manifest["tables"].items()], "table string, manifest_rows bigint, n_columns bigint")
    back = [df.agg(F.lit(n).alias("table"), F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("deviation_records") if n not in ("event_details", "deviation_distribution") else
                   F.col("new_trade_records") if n == "deviation_distribution" else F.col("cluster_candidate_rows")).cast("bigint").alias("total")) for n, df in sinks.current_tables(spark, place).items()]
    return named.join(reduce(DataFrame.unionByName, back), "table")


def _cached_frames(spark, d):
    """A result asked for four times: missing, there, there with its folder lost half-way, and there under another configuration."""
    root, place = tree(spark, d), folder(spark)
    digest = store.content_digest(spark, root, "*.zip").first()
    days = lambda: snapshots(spark, d).groupBy("commodity").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("Volume").alias("volume"))
    key = lambda active: sinks.cache_key(DailyConfig(active_limit=active), digest["signature"], day="all")
    out = []

    def ask(step, active):
        frame, hit = sinks.cached(spark, place, key(active), days, required=("n_rows", "volume"))
        out.append(frame.select(F.lit(step).alias("step"), F.lit(hit).alias("hit"), "commodity", "n_rows", "volume"))

    ask("first", 1)
    ask("again", 1)
    kept = store.read_text(spark, f"{place}/keys/{key(1)}")
    store.remove(spark, f"{place}/keys/{key(1)}")  # what a writer leaves that dies before its pointer
    ask("after a dead writer", 1)
    assert store.read_text(spark, f"{place}/keys/{key(1)}") != kept
    ask("other configuration", 2)
    return reduce(DataFrame.unionByName, out)


def _result_digests(spark, d):
    """The digest of the same rows in three orders and partitionings, and of the rows with one repeated."""
    rows = contract_files(spark, d).select("date", "contract", "k", "text")
    forms = {"as read": rows, "sorted": rows.orderBy("text"), "spread": rows.repartition(7, "k"), "one repeated": rows.union(rows.where("k = 6"))}
    return reduce(DataFrame.unionByName, [archives.result_digest(df, df.columns).withColumn("form", F.lit(n)) for n, df in forms.items()])


def _event_tables(spark, d):
    """Event tables of day folders, some with their columns in another order and one more."""
    rows, place = load_directions(event_rows(spark, d)), folder(spark)
    fields = {"交易日": "trade_date", "品种": "commodity", "合约": "contract", "事件编号": "event_id", "触发原因": "trigger_reasons", "异常方向": "raw_direction"}
    even = F.pmod(F.col("trade_date").cast("int"), F.lit(2)) == 0
    line = lambda names: F.to_csv(F.struct(*[F.col(fields.get(n, n)).alias(n) for n in names]))
    one, two = list(fields), [*reversed(fields), "recovery_label"]
    text = rows.groupBy("trade_date").agg(F.array_join(F.collect_list(F.when(even, line(one)).otherwise(line(two))), "\n").alias("body"))
    text = text.withColumn("text", F.concat(F.when(even, F.lit(",".join(one))).otherwise(F.lit(",".join(two))), F.lit("\n"), "body", F.lit("\n")))
    archives.write_files(_placed(text, F.concat("trade_date", F.lit("-par/events.csv")), None, F.when(even, "utf-8-sig").otherwise("utf-8")), place)
    got = files.read_event_tables(spark, place).withColumnRenamed("event_direction", "raw_direction").withColumnRenamed("display_trade_date", "trade_date")
    return load_directions(got).select("batch_date", "trade_date", "commodity", "contract", "event_id", "trigger_reasons", "event_direction", "recovery_label")


def _event_sheet(spark, d):
    """The event table under its fixed headers, written and read back by name."""
    place = folder(spark)
    sheet = sinks.event_table(event_rows(spark, d).withColumn("event_direction", F.trim(F.lower("raw_direction"))))
    sinks.publish({"events": sheet}, place, fmt="csv")
    back = sinks.current_tables(spark, place)["events"]
    return back.select(F.col("事件编号").alias("event_id"), F.col("触发原因").alias("reasons"), F.round(F.col("事件确认深度_跳").cast("double"), 6).alias("depth"), F.lit(len(back.columns)).cast("bigint").alias("n_columns"))


def _vendor_bars(spark, d):
    """Bars under Chinese vendor headers with numbers as text, some unusable."""
    k = F.floor(F.datediff("trade_date", F.lit("1992-01-06").cast("date")) / 7)
    text = lambda c: (F.floor(F.col(c) * 1000.0) / 1000.0).cast("string")
    raw = daily_bars(spark, d).select(F.date_format("trade_date", "yyyy-MM-dd").alias("日期"), text("open").alias("开盘价"), text("high").alias("最高"), F.when(k % 7 == 0, "--").otherwise(text("low")).alias("最低价"),
                                      text("close").alias("收盘"), F.col("volume").cast("string").alias("成交量"))
    return files.normalize_bar_columns(raw).groupBy("date").agg(F.count("low").alias("n_low"), F.round(F.max("high"), 3).alias("high"), F.round(F.min("high_low"), 3).alias("high_low"), F.sum("volume").cast("bigint").alias("volume"))


QUERIES = {
    "src_10_event_tables": _event_tables,
    "src_12_vendor_bars": _vendor_bars,
    "snk_02_event_sheet": _event_sheet,
    "snk_01_screen_set": _screen_set,
    "snk_04_study_set": _study_set,
    "snk_06_keyed_cache": _cached_frames,
    "fun_08_result_digest": _result_digests,
    "src_01_history_bounds": _history_bounds,
    "src_03_archive_rows": _archive_rows,
    "src_04_day_sources": _located,
    "src_05_file_names": _file_names,
    "src_06_source_discovery": _discovered,
    "src_07_encodings": _encoded,
    "fun_08_file_digests": _file_digests,
    "prj_04_standardized_bars": _standardized,
    "prj_23_instrument_filter": _filtered,
    "joi_02_contract_meta": _contract_meta,
}

FILES_SQL = "with " + SNAPSHOTS_SQL + f""",
sl as (select strftime(date '2026-01-01' + cast(trade_day as int), '%Y%m%d') as date, contract, trade_day, snapshot_seq, trade_day * 6 + cast(right(contract, 1) as bigint) + length(commodity) as k,
   update_time, update_ms, last_price, volume, bid, concat_ws(',', trade_day, contract, update_time, update_ms, last_price, volume, bid, '备注') as line from snap),
cf as (select date, contract, k, '{HEADER}' || chr(10) || string_agg(line, chr(10) order by snapshot_seq) || chr(10) as text, count(*) as n_rows, sum(volume) as volume, sum(last_price) as last_price from sl group by 1, 2, 3),
places as (select left(date, 6) || '.zip::' || date || '/' || contract || '_' || date || '.csv' as label, 2 as priority, * from cf
   union all select left(date, 6) || '/' || date || '.zip::' || contract || '_' || date || '.csv', 1, * from cf where k % 2 = 0
   union all select 'csv/' || contract || '_' || date || '.csv', 0, * from cf where k % 3 = 0)"""

def CUT(c: str) -> str:
    return f"floor({c} * 1000.0::double) / 1000.0::double"


RAW_SQL = "with " + BARS_SQL + f""",
rk as (select *, date_diff('day', date '1992-01-06', trade_date) // 7 as k from bars),
ri as (select *, unnest(case when k % 5 = 0 then [0, 1] else [0] end) as i from rk),
raw as (select commodity, contract, case when k % 13 <> 0 then trade_date end as trade_date, i, k % 11 = 0 as bad_code, {CUT('open')} as open, {CUT('high')} as high, {CUT('low')} as low,
   case when k % 7 <> 0 then {CUT('close')} end as close, case when k % 4 = 0 then {CUT('low')} when k % 4 = 1 then {CUT('high')} end as given, volume + i as volume from ri),
mine as (select * from raw where not bad_code and commodity in ('AX', 'BX', 'CX'))"""

HEX4 = " || '|' || ".join(f"cast(sum(cast(('0x' || substr(h, {1 + 15 * k}, 15)) as bigint)) as varchar)" for k in range(4))
ORACLE = {
    "src_10_event_tables": "with " + EVENT_ROWS_SQL + """ select trade_date as batch_date, trade_date, commodity, contract, event_id, trigger_reasons, event_direction, case when cast(trade_date as int) % 2 = 1 then recovery_label end as recovery_label from er""",
    "src_12_vendor_bars": "with " + BARS_SQL + f""", r as (select *, {CUT('high')} as h, case when (date_diff('day', date '1992-01-06', trade_date) // 7) % 7 <> 0 then {CUT('low')} end as l from bars)
   select strftime(trade_date, '%Y-%m-%d') as date, count(l) as n_low, round(max(h), 3) as high, round(min(h - l), 3) as high_low, cast(sum(volume) as bigint) as volume from r group by 1""",
    "snk_02_event_sheet": "with " + EVENT_ROWS_SQL + " select event_id, trigger_reasons as reasons, round(event_depth_ticks, 6) as depth, 52 as n_columns from er",
    "snk_01_screen_set": SCORE + """ select detail_id, 'suspicious_dates' as "table", round(cast(candidate_score as double), 6) as value from suspects
   union all select detail_id, 'invalid_samples', null from samples where sample_status <> 'valid'
   union all select commodity, 'commodity_summary', cast(count(*) as double) from suspects group by 1
   union all select detail_id, 'summary', round(cast(candidate_score as double), 6) from samples""",
    "snk_04_study_set": SPINE + """, rows as (
   select 'threshold_summary_by_day' as t, count(*) as n, cast(sum(deviation_records) as bigint) as total, 44 as k from spine
   union all select 'threshold_summary', count(*), cast(sum(dr) as bigint), 44 from (select sum(deviation_records) as dr from spine group by "InstrumentID", threshold_pct, side, mode)
   union all select 'event_details', count(*), cast(sum(cluster_candidate_rows) as bigint), 57 from det
   union all select 'deviation_distribution', count(*), cast(sum(n) as bigint), 11 from (select count(*) as n from prep where deviation is not null group by trade_date, "InstrumentID"
      union all select count(*) from prep where deviation is not null group by "InstrumentID")
   union all select 'data_quality', count(*), cast(sum(n) as bigint), 19 from (select count(deviation) as n from prep group by trade_date, "InstrumentID"))
   select t as "table", n as manifest_rows, k as n_columns, n as n_rows, total from rows""",
    "snk_06_keyed_cache": "with " + SNAPSHOTS_SQL + """ select step, step = 'again' as hit, commodity, n_rows, volume from (select commodity, count(*) as n_rows, cast(sum(volume) as bigint) as volume from snap group by 1),
   (select unnest(['first', 'again', 'after a dead writer', 'other configuration']) as step)""",
    "fun_08_result_digest": FILES_SQL + f""", hashed as (select k, sha256(concat_ws('|', length(contract) || ':' || contract, length(date) || ':' || date, length(cast(k as varchar)) || ':' || k, length(text) || ':' || text)) as h from cf),
   once as (select count(*) as n_rows, sha256({HEX4}) as signature from hashed),
   twice as (select count(*) as n_rows, sha256({HEX4}) as signature from (select h from hashed union all select h from hashed where k = 6))
   select form, n_rows, signature from once, (select unnest(['as read', 'sorted', 'spread']) as form) union all select 'one repeated', * from twice""",
    "src_01_history_bounds": RAW_SQL + " select commodity, contract, strftime(min(trade_date), '%Y-%m-%d') as listed_date, strftime(max(trade_date), '%Y-%m-%d') as last_trade_date from mine where trade_date is not null group by 1, 2",
    "src_03_archive_rows": FILES_SQL + """ select contract || '_' || date || '.csv' as source_file, date as trade_date, contract, 'ok' as parse_status, row_number() over (partition by date, contract order by snapshot_seq) - 1 as snapshot_seq,
   cast(trade_day as varchar) as "TradingDay", update_time as "UpdateTime", update_ms as "UpdateMillisec", last_price as "LastPrice", volume as "Volume", bid as "BidPrice1" from sl""",
    "src_04_day_sources": FILES_SQL + """ select date as trade_date, case when bool_or(k % 2 = 0) then left(date, 6) || '/' || date || '.zip' else left(date, 6) || '.zip' end as source from cf group by 1
   union all select '20990101', null""",
    "src_05_file_names": FILES_SQL + """, f as (select date, contract, regexp_extract(contract, '^([A-Z]+)', 1) as letters, right(contract, 3) as three, k % 6 as form from cf)
   select case form when 0 then contract || '_' || date || '.csv' when 1 then lower(contract) || '_' || date || '.CSV' when 2 then letters || three || '_' || date || '.csv' when 3 then letters || '主力连续_' || date || '.csv'
      when 4 then contract || '_' || date || '1.csv' else 'x-' || contract || '.csv' end as file_name, case when form not in (3, 5) then letters end as commodity, case when form in (0, 1, 4) then contract when form = 2 then letters || three end as contract,
      case form when 3 then 'continuous_alias' when 5 then 'unknown_format' else 'ok' end as parse_status, case when form < 4 then date end as trade_date from f""",
    "src_06_source_discovery": FILES_SQL + """ select label, contract, date as trade_date, cast(priority as bigint) as priority,
   case when row_number() over (partition by date, contract order by priority, label) = 1 then 'selected' else 'duplicate' end as status from places""",
    "src_07_encodings": FILES_SQL + """ select contract || '_' || date || '.csv' as source_file, case k % 4 when 2 then 'gb18030' when 3 then null else 'utf-8-sig' end as encoding, case when k % 4 = 3 then 'undecodable' else 'ok' end as status,
   case when k % 4 = 3 then 0 else n_rows end as n_rows, case when k % 4 <> 3 then cast(volume as bigint) end as volume, case when k % 4 <> 3 then round(last_price, 2) end as last_price from cf""",
    "fun_08_file_digests": FILES_SQL + """ select label, octet_length(encode(text)) as bytes, sha256(text) as sha256 from places
   union all select left(date, 6) || '.zip::主力连续_' || contract || '_' || date || '.csv', octet_length(encode(text)), sha256(text) from cf where contract like '%1'""",
    "prj_04_standardized_bars": RAW_SQL + f""", kept as (select * from mine where trade_date is not null and close is not null),
   prev as (select *, coalesce(given, lag(close) over (partition by commodity, contract order by trade_date, i)) as pre_close, row_number() over (partition by commodity, contract, trade_date order by i desc) as rn from kept)
   select commodity, contract, strftime(trade_date, '%Y-%m-%d') as trade_date, {q6('open', 'close', 'pre_close')}, cast(volume as bigint) as volume from prev where rn = 1""",
    "prj_23_instrument_filter": "with " + SNAPSHOTS_SQL + """, x as (select snapshot_seq, commodity, contract, case when snapshot_seq % 2 = 0 then commodity || right(contract, 3) else lower(contract) end as instrument from snap)
   select snapshot_seq, instrument, commodity in ('CLICK', 'VIEW') as by_commodity, contract in ('CLICK2402', 'VIEW2403') as by_contract from x""",
    "joi_02_contract_meta": "with " + BARS_SQL + """, b as (select commodity, contract, min(trade_date) as lo, max(trade_date) as hi from bars where commodity <> 'EX' group by 1, 2)
   select commodity, contract, strftime(trade_date, '%Y-%m-%d') as trade_date, right(contract, 4) as delivery_month, date_diff('day', lo, trade_date) as days_listed, date_diff('day', trade_date, hi) as days_left
   from bars left join b using (commodity, contract)""",
}

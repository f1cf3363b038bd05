"""Market-data views over the driver tables: weekly contract bars and top-of-book snapshots."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SNAPSHOT_EPOCH_MS = 1_704_067_200_000
# Clocks that the commodity-days start at, so that their six minutes meet midnight, an open, a break and a close:
# 23:57:00, 08:57:30, 10:12:00 and 02:27:00.
CLOCK_STARTS_MS = (86_220_000, 32_250_000, 36_720_000, 8_820_000)
USERS_PER_DAY = 75


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region = commodity, nation = contract, week = trade date, unit price = traded price."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.to_date(F.date_trunc("week", "l_shipdate")).alias("trade_date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), F.col("l_quantity").alias("qty"),
    )
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select(
        "n_nationkey",
        F.concat(F.chr(F.lit(65) + F.col("n_regionkey")), F.lit("X")).alias("commodity"),
        F.format_string(
            "%sX%d%02d", F.chr(F.lit(65) + F.col("n_regionkey")),
            (F.lit(24) + F.floor(F.col("n_nationkey") / 12)).cast("int"),
            (F.col("n_nationkey") % 12 + 1).cast("int"),
        ).alias("contract"),
    )
    traded = li.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(
        nation, F.col("s_nationkey") == F.col("n_nationkey")
    )
    total = F.sum("qty").cast("bigint")
    return traded.groupBy("commodity", "contract", "trade_date").agg(
        F.min("px").alias("low"), F.max("px").alias("high"), F.avg("px").alias("close"),
        ((F.min("px") + F.max("px")) / 2).alias("open"),
        F.when(total % 17 == 0, F.lit(0)).otherwise(total).cast("bigint").alias("volume"),
    )


def cents(price: Column) -> Column:
    """A price in whole hundredths by its binary value, as the SQL's ``round(x, 2)`` has it; Spark's goes by the shortest decimal."""
    return F.round(price * 100.0, 0) / 100.0


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event stream as top-of-book snapshots. A pure projection of ``events``: no shuffle, prunes to five columns.

    75 users form one trade day, so a larger table means more contract-days of the same density.
    """
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    eid = F.col("event_id")
    cno = F.col("cno")
    ms = F.col("ms")
    base = ev.select(
        eid, "value",
        F.floor(F.col("user_id") / USERS_PER_DAY).cast("bigint").alias("trade_day"),
        F.upper("event_type").alias("commodity"),
        (F.col("user_id") % 6).alias("cno"),
        (F.floor((F.unix_millis(F.col("ts").cast("timestamp")) - SNAPSHOT_EPOCH_MS) / F.lit(720_000.0)) * 100)
        .cast("bigint").alias("ms"),
    )
    start = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in CLOCK_STARTS_MS]), (F.pmod(F.col("trade_day") + F.length("commodity"), F.lit(len(CLOCK_STARTS_MS))) + 1).cast("int"))
    clock = F.pmod(start + ms, F.lit(86_400_000))
    mid = F.lit(1000.0) + F.lit(2.0) * cno + (F.floor(ms / 15_000) % 9) * F.lit(0.1) + (eid % 7) * F.lit(0.02)
    half = F.lit(0.02) * (F.lit(1) + eid % 3)
    wobble = ((eid % 11) - 5) * F.lit(0.05) + F.when(eid % 97 == 0, F.lit(40.0)).otherwise(F.lit(0.0))
    level = F.lit(1000.0) + F.lit(2.0) * cno
    step1 = base.withColumns({
        "clock": clock, "mid0": mid, "half": half, "level": level,
        "Volume": (F.floor(eid / 40) * 5).cast("bigint"),
        "wobble": wobble,
    })
    spike = F.col("value") / F.lit(50.0)
    last = (
        F.when((F.col("value") > 150.0) & (eid % 2 == 0), F.col("mid0") - spike)
        .when(F.col("value") > 150.0, F.col("mid0") + spike)
        .otherwise(F.col("mid0") + F.col("half") * ((eid % 5) - 2) / F.lit(2.0))
    )
    turnover = F.lit(10.0) * (F.col("Volume") * F.col("level") + F.col("wobble"))
    sec = F.floor(F.col("clock") / 1000)
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    return step1.select(
        "trade_day", F.col("trade_day").cast("string").alias("TradingDay"), "commodity",
        F.concat(F.col("commodity"), F.lit("240"), (cno + 1).cast("string")).alias("contract"),
        eid.alias("snapshot_seq"),
        F.concat_ws(":", two(F.floor(sec / 3600)), two(F.floor(sec / 60) % 60), two(sec % 60)).alias("UpdateTime"),
        (F.col("clock") % 1000).cast("int").alias("UpdateMillisec"),
        cents(last).alias("LastPrice"),
        F.when(eid % 101 == 0, F.lit(0.0)).otherwise(cents(F.col("mid0") - F.col("half"))).alias("BidPrice1"),
        cents(F.col("mid0") + F.col("half")).alias("AskPrice1"),
        "Volume", turnover.alias("Turnover"),
        F.when((eid % 53 == 0) | (F.col("Volume") == 0), F.lit(0.0))
        .otherwise(turnover / F.col("Volume")).alias("AveragePrice"),
        (F.col("level") * 1.1).alias("UpperLimitPrice"), (F.col("level") * 0.9).alias("LowerLimitPrice"),
        (1 + eid % 9).cast("bigint").alias("BidVolume1"), (1 + eid % 8).cast("bigint").alias("AskVolume1"),
        (F.lit(100.0) + eid % 50).alias("OpenInterest"),
    )


def profiles(spark: SparkSession) -> DataFrame:
    """Commodity profile dimension used with the snapshot view; one commodity is left without a profile."""
    rows = [("CLICK", 0.02, 10, "validated"), ("ERROR", 0.02, 10, "validated"),
            ("PURCHASE", 0.02, 10, "validated"), ("VIEW", 0.02, 10, "validated")]
    return spark.createDataFrame(
        rows, "commodity string, tick_size double, contract_multiplier int, validation_status string"
    )


BARS_SQL = """
li as (
  select chr(cast(65 + n_regionkey as integer)) || 'X' as commodity,
         chr(cast(65 + n_regionkey as integer)) || 'X' || cast(24 + n_nationkey // 12 as varchar)
           || lpad(cast(n_nationkey % 12 + 1 as varchar), 2, '0') as contract,
         cast(date_trunc('week', l_shipdate) as date) as trade_date,
         l_extendedprice / l_quantity as px, l_quantity as qty
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey),
bars as (
  select commodity, contract, trade_date, min(px) as low, max(px) as high, avg(px) as close,
         (min(px) + max(px)) / 2 as open,
         case when cast(sum(qty) as bigint) % 17 = 0 then 0 else cast(sum(qty) as bigint) end as volume
  from li group by commodity, contract, trade_date)"""

SNAPSHOTS_SQL = f"""
ev0 as (
  select event_id as eid, value, user_id // 75 as trade_day, upper(event_type) as commodity, user_id % 6 as cno,
         cast(floor((epoch_us(ts) // 1000 - 1704067200000) / 720000.0::double) * 100 as bigint) as ms
  from events),
ev1 as (
  select *, (list_extract({list(CLOCK_STARTS_MS)}, cast((trade_day + length(commodity)) % 4 + 1 as int)) + ms) % 86400000 as clock,
         1000.0::double + 2.0::double * cno + ((ms // 15000) % 9) * 0.1::double + (eid % 7) * 0.02::double as mid0,
         0.02::double * (1 + eid % 3) as half, 1000.0::double + 2.0::double * cno as level,
         (eid // 40) * 5 as volume,
         ((eid % 11) - 5) * 0.05::double + case when eid % 97 = 0 then 40.0::double else 0.0::double end as wobble
  from ev0),
ev2 as (select *, 10.0::double * (volume * level + wobble) as turnover from ev1),
snap as (
  select trade_day, cast(trade_day as varchar) as trading_day, commodity,
         commodity || '24' || lpad(cast(cno + 1 as varchar), 2, '0') as contract, eid as snapshot_seq,
         lpad(cast(clock // 3600000 as varchar), 2, '0') || ':' || lpad(cast((clock // 60000) % 60 as varchar), 2, '0')
           || ':' || lpad(cast((clock // 1000) % 60 as varchar), 2, '0') as update_time,
         clock % 1000 as update_ms,
         round(case when value > 150.0 and eid % 2 = 0 then mid0 - value / 50.0::double
                    when value > 150.0 then mid0 + value / 50.0::double
                    else mid0 + half * ((eid % 5) - 2) / 2.0::double end, 2) as last_price,
         case when eid % 101 = 0 then 0.0::double else round(mid0 - half, 2) end as bid,
         round(mid0 + half, 2) as ask, volume, turnover,
         case when eid % 53 = 0 or volume = 0 then 0.0::double else turnover / volume end as average_price,
         level * 1.1::double as upper_limit, level * 0.9::double as lower_limit,
         1 + eid % 9 as bid_volume, 1 + eid % 8 as ask_volume, 100.0::double + eid % 50 as open_interest
  from ev2)"""


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream in the shape of a finished event table (inputs of roll-ups and parameter tables)."""
    c, i = F.col, F.col("event_id")
    ev = table(spark, sf_dir, "events")
    pick = lambda n, *words: F.element_at(F.array(*[F.lit(w) for w in words]), (F.floor(i / n) % len(words) + 1).cast("int"))
    return ev.select(
        i.alias("anchor_seq"), F.date_format("ts", "yyyyMMdd").alias("trade_date"), F.upper("event_type").alias("commodity"),
        F.concat(F.upper("event_type"), F.lit("240"), (c("user_id") % 6 + 1).cast("string")).alias("contract"),
        F.date_format("ts", "HH:mm:ss").alias("event_time"),
        F.concat_ws("|", F.upper("event_type"), i.cast("string")).alias("event_id"),
        pick(1, "down", " UP ", "", "Down").alias("raw_direction"),
        pick(2, "visible_execution_drop", "interval_execution_drop", "visible_execution_drop,interval_execution_drop").alias("trigger_reasons"),
        pick(3, "trade_recovered_3s", "quote_only_recovered_3s", "persistent_10s", "truncated").alias("recovery_label"),
        pick(5, "normal", "normal", "suspect").alias("data_quality"), pick(7, "keep", "keep", "exclude").alias("boundary_verdict"),
        pick(11, "detector_event_depth", "detector_event_depth", " ").alias("depth_source"),
        (i % 5).alias("valid_peer_count"), (i % 13).cast("double").alias("fair_uncertainty_ticks"),
        (c("value") * 10).alias("notional_shortfall"), (c("value") / 2).alias("event_depth_ticks"),
        (c("value") / 4).alias("event_depth_bps"), (F.lit(1000.0) + i % 50).alias("fair_price"),
        (c("value") / 2).alias("last_down_ticks"), (c("value") / 3).alias("vwap_down_ticks"),
        (c("value") / 4 - 5).alias("combined_vwap_down_ticks"), F.lit(30.0).alias("last_threshold_ticks"),
        F.lit(15.0).alias("vwap_threshold_ticks"),
    )


def _pick_sql(n: int, *words: str) -> str:
    return "list_extract([" + ", ".join(f"'{w}'" for w in words) + f"], cast(events.event_id // {n} % {len(words)} + 1 as int))"


EVENT_ROWS_SQL = f"""
er as (select event_id as anchor_seq, strftime(ts, '%Y%m%d') as trade_date, upper(event_type) as commodity,
   upper(event_type) || '240' || cast(user_id % 6 + 1 as varchar) as contract, strftime(ts, '%H:%M:%S') as event_time,
   upper(event_type) || '|' || event_id as event_id, {_pick_sql(1, 'down', ' UP ', '', 'Down')} as raw_direction,
   {_pick_sql(2, 'visible_execution_drop', 'interval_execution_drop', 'visible_execution_drop,interval_execution_drop')} as trigger_reasons,
   {_pick_sql(3, 'trade_recovered_3s', 'quote_only_recovered_3s', 'persistent_10s', 'truncated')} as recovery_label,
   {_pick_sql(5, 'normal', 'normal', 'suspect')} as data_quality, {_pick_sql(7, 'keep', 'keep', 'exclude')} as boundary_verdict,
   {_pick_sql(11, 'detector_event_depth', 'detector_event_depth', ' ')} as depth_source, events.event_id % 5 as valid_peer_count,
   cast(events.event_id % 13 as double) as fair_uncertainty_ticks, value * 10 as notional_shortfall, value / 2 as event_depth_ticks,
   value / 4 as event_depth_bps, 1000.0::double + events.event_id % 50 as fair_price, value / 2 as last_down_ticks, value / 3 as vwap_down_ticks,
   value / 4 - 5 as combined_vwap_down_ticks, 30.0::double as last_threshold_ticks, 15.0::double as vwap_threshold_ticks,
   case when trim(lower(list_extract(['down', ' UP ', '', 'Down'], cast(events.event_id % 4 + 1 as int)))) = 'up' then 'up' else 'down' end as event_direction
   from events)"""

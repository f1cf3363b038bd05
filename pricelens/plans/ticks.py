"""Snapshot detector: frames -> references -> fair price and noise -> candidates -> events -> recovery.

Self stages run on (contract-day, time chunk); the peer stage on (commodity-day, time chunk), where each contract's rows
lie once and serve it and those it is a peer of. A chunk never holds more than one frame per millisecond, so task size is bounded
however much one contract trades.
"""
from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..config import TickConfig
from ..functions.arrays import flags, ordered_subset
from ..functions.clock import cycle_key, display_time, is_open_protected, is_tradable, session_state, with_clock
from ..functions.codes import normalize_contract
from ..functions.quotes import bps, mid_price, quote_valid, trade_eligible
from ..operators.asof import asof_join, nearest_join
from ..operators.baseline import reference_metrics
from ..operators.chunked import CHUNK, CORE, chunk_of, drop_halo, gap_islands, halo_chunks, ordered_state
from ..operators.rangejoin import range_join
from ..session import dimension, materialize

K = ["trade_date", "commodity", "contract"]
REASON_ORDER = ("visible_execution_drop", "interval_execution_drop", "visible_execution_spike", "interval_execution_spike")


def with_keys(raw: DataFrame) -> DataFrame:
    timed = with_clock(raw, "_clock", F.col("UpdateTime"), F.col("UpdateMillisec"))
    return timed.withColumn("market_time_key", cycle_key(F.col("_clock"))).drop("_clock")


def collapse(raw: DataFrame) -> DataFrame:
    """One frame per (contract-day, key): the last row wins, the sequence range is kept.

    ``drop_inside`` marks a fall of cumulative turnover between rows of the same key; the comparison with the
    previous frame is made later, at frame level, so no raw-level ordering of a whole contract-day is needed.
    """
    cell = Window.partitionBy(*K, "market_time_key").orderBy("snapshot_seq")
    upto = cell.rowsBetween(Window.unboundedPreceding, 0)
    payload = [c for c in raw.columns if c not in (*K, "market_time_key", "snapshot_seq")]
    rows = raw.withColumns({"_drop": F.coalesce(F.col("Turnover") < F.lag("Turnover").over(cell), F.lit(False)), "_last": F.lead(F.lit(1)).over(cell).isNull()})
    # The last row has seen its whole cell, so one sort serves the order and the totals.
    return rows.withColumns({
        "snapshot_seq_start": F.min("snapshot_seq").over(upto), "first_turnover": F.first("Turnover").over(upto),
        "drop_inside": F.bool_or("_drop").over(upto), "raw_rows": F.count(F.lit(1)).over(upto),
    }).filter("_last").select(*K, "market_time_key", "snapshot_seq_start", F.col("snapshot_seq").alias("snapshot_seq_end"), "first_turnover",
                              "drop_inside", "raw_rows", *payload)


def prepare(raw: DataFrame, profiles: DataFrame, cfg: TickConfig = TickConfig(), bounds: DataFrame | None = None,
            width: int | None = None) -> DataFrame:
    """Frames with sessions, guards, quotes, deltas, interval VWAP and its band check.

    ``profiles`` is the commodity dimension (one row per commodity). ``bounds`` is one row per contract-day:
    trade_date, contract (normalised), low, high, pre_settle.

    Collapsed frames are written once: the previous row, the day's limits and the frames themselves all come from them.
    """
    c = F.col
    f = materialize(collapse(with_keys(raw))).join(dimension(profiles), "commodity", "left").withColumns({
        "validation_status": F.coalesce("validation_status", F.lit("unvalidated_commodity")),
        "session_state": session_state(c("UpdateTime")), "is_tradable_session": is_tradable(c("UpdateTime")),
        "is_open_protected": is_open_protected(c("UpdateTime"), cfg.open_guard_seconds),
        "display_time": display_time(c("UpdateTime"), c("UpdateMillisec")),
        "mid_price": mid_price(c("BidPrice1"), c("AskPrice1")),
    })
    collapsed = f
    f = f.withColumn(CHUNK, chunk_of("market_time_key", width or cfg.chunk_ms))
    f = ordered_state(f, K, ["market_time_key"], CHUNK, previous={
        "_pk": c("market_time_key"), "_pv": c("Volume"), "_pt": c("Turnover"), "_ps": c("is_tradable_session"),
    }).drop(CHUNK)
    f = f.withColumns({
        "gap_ms": c("market_time_key") - c("_pk"),
        "spread_ticks": F.when(c("mid_price").isNotNull(), c("AskPrice1") - c("BidPrice1")) / c("tick_size"),
        "frame_turnover_desync": c("drop_inside") | F.coalesce(c("first_turnover") < c("_pt"), F.lit(False)),
        "_dv": (c("Volume") - c("_pv")).cast("double"), "_dt": c("Turnover") - c("_pt"),
    })
    f = f.withColumn("quote_valid", quote_valid(
        c("is_tradable_session"), c("BidPrice1"), c("AskPrice1"), c("mid_price"), c("UpperLimitPrice"),
        c("LowerLimitPrice"), c("tick_size"), cfg.limit_buffer_ticks))
    usable = F.coalesce(
        c("is_tradable_session") & c("_ps") & (c("gap_ms") <= cfg.max_gap_ms) & ~c("is_open_protected")
        & (c("_dv") > 0) & (c("_dt").isNull() | (c("_dt") > 0)), F.lit(False))
    f = f.withColumns({
        "delta_volume": F.when(usable, c("_dv")),
        "delta_turnover": F.when(usable & ~c("frame_turnover_desync"), c("_dt")),
        "avg_trade_price_enabled": F.coalesce(
            c("contract_multiplier").isNotNull() & (c("AveragePrice") > 0) & (c("Volume") > 0)
            & (F.abs(F.try_divide(c("Turnover"), c("Volume")) - c("AveragePrice")) <= 0.5), F.lit(False)),
    })
    raw_vwap = F.when(c("avg_trade_price_enabled") & (c("delta_turnover") > 0) & (c("delta_volume") > 0),
                      c("delta_turnover") / c("delta_volume") / c("contract_multiplier"))
    f = f.withColumn("_vwap", raw_vwap)
    if bounds is not None:
        f = _with_daily_band(f, collapsed, bounds, cfg)
    else:
        f = f.withColumns({"_band_low": F.lit(None).cast("double"), "_band_high": F.lit(None).cast("double")})
    limits_set = (c("UpperLimitPrice") > 0) & (c("LowerLimitPrice") > 0)
    daily = c("_band_low").isNotNull()
    outside = F.coalesce(F.when(daily, (c("_vwap") < c("_band_low")) | (c("_vwap") > c("_band_high"))).otherwise(
        limits_set & ((c("_vwap") < c("LowerLimitPrice")) | (c("_vwap") > c("UpperLimitPrice")))), F.lit(False))
    f = f.withColumns({
        "interval_vwap": F.when(~outside, c("_vwap")),
        "quality_flag": F.when(c("frame_turnover_desync"), "turnover_counter_desync")
        .when(outside & daily, "vwap_beyond_daily").when(outside, "vwap_beyond_limit"),
    })
    return f.drop("_pk", "_pv", "_pt", "_ps", "_dv", "_dt", "_vwap", "_band_low", "_band_high", "first_turnover", "drop_inside")


def _with_daily_band(f: DataFrame, collapsed: DataFrame, bounds: DataFrame, cfg: TickConfig) -> DataFrame:
    """Daily price band where the limit midpoint agrees with the previous settlement; limits come from the frames as collapsed."""
    c = F.col
    # Price limits are constants of a contract-day, so the distinct values behind these medians are few.
    both = (c("UpperLimitPrice") > 0) & (c("LowerLimitPrice") > 0)
    centre = collapsed.groupBy(*K).agg(
        F.percentile(F.when(both, c("UpperLimitPrice")), 0.5).alias("_u"),
        F.percentile(F.when(both, c("LowerLimitPrice")), 0.5).alias("_l"), F.max("tick_size").alias("_tick"),
    ).withColumn("_code", normalize_contract(c("contract")))
    b = bounds.select(c("trade_date"), c("contract").alias("_code"), "low", "high", "pre_settle")
    same_day = F.abs((c("_u") + c("_l")) / 2.0 - c("pre_settle")) / c("pre_settle") <= cfg.same_day_tolerance
    slack = cfg.daily_tolerance_ticks * F.coalesce(c("_tick"), F.lit(0.0))
    band = centre.join(b, ["trade_date", "_code"]).filter(
        (c("low") > 0) & (c("high") > 0) & (c("pre_settle") > 0) & same_day
    ).select(*K, (c("low") - slack).alias("_band_low"), (c("high") + slack).alias("_band_high"))
    return f.join(band, K, "left")


def contract_volumes(frames: DataFrame) -> DataFrame:
    return frames.groupBy(*K).agg(F.max("Volume").alias("day_volume"), F.max("validation_status").alias("validation_status"))


def reference_contracts(volumes: DataFrame, cfg: TickConfig = TickConfig()) -> DataFrame:
    """(target, peer, rank): the most traded other contracts of the commodity-day.

    Only the leading ``peer_limit + 1`` contracts can be anybody's peer, so a target meets that short list and
    never the whole commodity.
    """
    day = ["trade_date", "commodity"]
    lead = Window.partitionBy(*day).orderBy(F.col("day_volume").desc(), "contract")
    ranked = volumes.withColumn("_r", F.row_number().over(lead)).filter(F.col("_r") <= cfg.peer_limit + 1)
    short = ranked.select(*day, F.col("contract").alias("peer"), F.col("_r").alias("_lead"))
    own = Window.partitionBy(*K).orderBy("_lead")
    return volumes.select(*K).join(short, day).filter(F.col("contract") != F.col("peer")).withColumn(
        "peer_rank", F.row_number().over(own)
    ).filter(F.col("peer_rank") <= cfg.peer_limit).select(*K, "peer", "peer_rank")


def eligible_pool(volumes: DataFrame, cfg: TickConfig = TickConfig()) -> DataFrame:
    """Targets of validated commodities that list enough contracts that day."""
    pool = Window.partitionBy("trade_date", "commodity")
    return volumes.withColumn("pool_size", F.count(F.lit(1)).over(pool)).filter(
        (F.col("pool_size") >= cfg.min_pool) & (F.col("validation_status") == "validated"))


FRAME_COLUMNS = [
    *K, "market_time_key", "snapshot_seq_start", "snapshot_seq_end", "TradingDay", "display_time", "LastPrice",
    "Volume", "Turnover", "BidPrice1", "AskPrice1", "UpperLimitPrice", "LowerLimitPrice", "tick_size",
    "contract_multiplier", "is_tradable_session", "is_open_protected", "mid_price", "spread_ticks", "quote_valid",
    "gap_ms", "delta_volume", "delta_turnover", "interval_vwap", "quality_flag",
]


def attach_reference(frames: DataFrame, cfg: TickConfig = TickConfig()) -> DataFrame:
    """Fair price, noise statistics and thresholds for every frame of the eligible targets."""
    c = F.col
    volumes = contract_volumes(frames)
    targets = eligible_pool(volumes, cfg).select(*K)
    ranked = reference_contracts(volumes, cfg).groupBy(*K).agg(F.array_sort(F.collect_list(F.struct("peer_rank", "peer"))).alias("_p"))
    roles = targets.join(ranked, K, "left").select(*K, F.coalesce(F.transform("_p", lambda p: p["peer"]), F.array().cast("array<string>")).alias("_peers"))
    pools = targets.select("trade_date", "commodity").distinct()
    rows = frames.select(*FRAME_COLUMNS).join(pools, ["trade_date", "commodity"], "left_semi").join(roles, K, "left")
    own = halo_chunks(rows, "market_time_key", cfg.reference_chunk_ms, back=2 * cfg.baseline_ms + cfg.reference_age_ms)
    fields = [f for f in own.schema.fields if f.name not in (CHUNK, CORE, "_peers")]
    extra = [("fair_price", "double"), ("fair_uncertainty_ticks", "double"), ("fair_price_reliable", "boolean"),
             ("valid_peer_count", "bigint"), ("valid_peers", "array<string>"), ("peer_bases", "array<double>"),
             ("fair_gate_open", "boolean"), ("noise_sample_count", "bigint"), ("noise_time_span_seconds", "double"),
             ("noise_history_reliable", "boolean"), ("last_noise_median", "double"), ("vwap_noise_median", "double"),
             ("last_noise_robust_sigma", "double"), ("vwap_noise_robust_sigma", "double"),
             ("execution_depth_robust_sigma", "double")]
    columns = [(f.name, f.dataType.simpleString()) for f in fields] + extra
    schema = ", ".join(f"`{name}` {kind}" for name, kind in columns)
    names = [name for name, _ in columns]
    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    def per_chunk(table):
        if not pc.any(table["_core"]).as_py():
            return empty
        return reference_metrics(table, cfg).select(names).cast(empty.schema)

    keys = ["trade_date", "commodity", CHUNK]
    # An explicit partition count keeps this CPU-bound stage from being coalesced by its small byte size.
    n = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    enriched = own.repartition(n, *keys).groupBy(*keys).applyInArrow(per_chunk, schema)
    return thresholds(enriched, cfg)


def thresholds(enriched: DataFrame, cfg: TickConfig = TickConfig()) -> DataFrame:
    c = F.col
    floor_ticks = F.when(c("fair_price") > 0, c("fair_price") * cfg.min_depth_bps / 10000 / c("tick_size")).otherwise(F.lit(0.0))
    level = lambda least, m, s: F.when(c("noise_history_reliable"), F.greatest(
        F.lit(least), floor_ticks, c(m) + cfg.noise_k * c(s)))
    first_block = (
        F.when(c("fair_price").isNull() & c("fair_gate_open"), "insufficient_peers")
        .when(c("fair_price").isNotNull() & ~c("fair_price_reliable"), "fair_uncertainty_exceeded")
        .when(~c("noise_history_reliable"), "insufficient_noise_history")
    )
    return enriched.withColumns({
        "last_threshold_ticks": level(cfg.min_last_ticks, "last_noise_median", "last_noise_robust_sigma"),
        "vwap_threshold_ticks": level(cfg.min_vwap_ticks, "vwap_noise_median", "vwap_noise_robust_sigma"),
        "reference_blocked_reason": first_block,
    })


def confirmation(frames: DataFrame, cfg: TickConfig = TickConfig()) -> DataFrame:
    """Adds the one-second confirmation window of every frame; expects halo chunks."""
    c = F.col
    ahead = Window.partitionBy(*K, CHUNK).orderBy("market_time_key").rangeBetween(0, cfg.confirm_ms)
    good = F.coalesce(c("is_tradable_session") & (c("delta_volume") > 0) & (c("delta_turnover") > 0), F.lit(False))
    f = frames.withColumn("_good", good).withColumns({
        "_all_good": F.min("_good").over(ahead), "_reach": F.max("market_time_key").over(ahead),
        "_sum_v": F.sum("delta_volume").over(ahead), "_sum_t": F.sum("delta_turnover").over(ahead),
        "_end_time": F.last("display_time").over(ahead),
    })
    complete = c("_all_good") & (c("_reach") == c("market_time_key") + cfg.confirm_ms)
    return f.withColumns({
        "confirmed": complete,
        "confirmed_vwap": F.when(complete, c("_sum_t") / c("_sum_v") / c("contract_multiplier")),
        "confirmation_end_key": F.when(complete, c("_reach")),
        "confirmation_end_time": F.when(complete, c("_end_time")),
        "confirmation_block": F.when(~c("_all_good"), "counter_sync_unconfirmed").when(~complete, "confirmation_incomplete"),
    }).drop("_good", "_all_good", "_reach", "_sum_v", "_sum_t", "_end_time")


def mark(enriched: DataFrame, cfg: TickConfig = TickConfig()) -> DataFrame:
    """Directional depths, confirmation, onset and trigger reasons for every frame."""
    c = F.col
    tick, fair = c("tick_size"), c("fair_price")
    priced = lambda p: F.when((fair > 0) & (c(p) > 0), (fair - c(p)) / tick)
    m = enriched.withColumns({"last_down_ticks": priced("LastPrice"), "vwap_down_ticks": priced("interval_vwap")})
    m = m.withColumns({"last_up_ticks": -c("last_down_ticks"), "vwap_up_ticks": -c("vwap_down_ticks")})
    m = confirmation(halo_chunks(m, "market_time_key", cfg.chunk_ms, cfg.onset_ms, cfg.confirm_ms), cfg)
    past = Window.partitionBy(*K, CHUNK).orderBy("market_time_key").rangeBetween(-cfg.onset_ms, -1)
    zero = F.lit(0.0)
    pre = lambda d: F.coalesce(F.percentile(F.when(c("delta_volume") > 0, F.greatest(
        F.coalesce(c(f"last_{d}_ticks"), zero), F.coalesce(c(f"vwap_{d}_ticks"), zero))), 0.5).over(past), zero)
    m = drop_halo(m.withColumns({"pre_depth_down": pre("down"), "pre_depth_up": pre("up")}))
    eligible = F.coalesce(
        trade_eligible(c("is_tradable_session"), c("LastPrice"), c("UpperLimitPrice"), c("LowerLimitPrice"))
        & (c("delta_volume") > 0) & c("fair_price_reliable") & c("noise_history_reliable") & ~c("is_open_protected"), F.lit(False))
    over = lambda d: F.coalesce(c(f"vwap_{d}_ticks") >= c("vwap_threshold_ticks"), F.lit(False))
    m = m.withColumns({
        "_eligible": eligible, "_asks": eligible & (over("down") | over("up")),
        "onset_ok": c("gap_ms").isNull() | (c("gap_ms") <= cfg.max_gap_ms),
    })
    m = m.withColumns({
        "combined_vwap_1s": F.when(c("_asks"), c("confirmed_vwap")),
        "interval_confirmation_end_key": F.when(c("_asks"), c("confirmation_end_key")),
        "interval_confirmation_end_time": F.when(c("_asks"), c("confirmation_end_time")),
    })
    m = m.withColumn("combined_vwap_down_ticks", (fair - c("combined_vwap_1s")) / tick)
    m = m.withColumn("combined_vwap_up_ticks", (c("combined_vwap_1s") - fair) / tick)
    hit = lambda d: F.coalesce(c("_asks") & (c(f"vwap_{d}_ticks") >= c("vwap_threshold_ticks"))
                               & (c(f"combined_vwap_{d}_ticks") >= c("vwap_threshold_ticks")), F.lit(False))
    seen = lambda d: F.coalesce(c("_eligible") & (c(f"last_{d}_ticks") >= c("last_threshold_ticks")), F.lit(False))
    m = m.withColumns({f"_{k}_{d}": e(d) for d in ("down", "up") for k, e in (("int", hit), ("vis", seen))})
    for d in ("down", "up"):
        depth = F.greatest(F.when(c(f"_vis_{d}"), c(f"last_{d}_ticks")), F.when(c(f"_int_{d}"), c(f"combined_vwap_{d}_ticks")))
        m = m.withColumn(f"_depth_{d}", depth).withColumn(
            f"_onset_{d}", F.greatest(zero, c(f"_depth_{d}") - F.greatest(zero, c(f"pre_depth_{d}"))))
        enough = c("onset_ok") & (c(f"_onset_{d}") >= F.greatest(
            F.lit(cfg.onset_min_ticks), cfg.onset_k * F.coalesce(c("execution_depth_robust_sigma"), F.lit(1.0))))
        word = "drop" if d == "down" else "spike"
        m = m.withColumns({
            f"candidate_{d}_depth": F.when(enough, c(f"_depth_{d}")), f"onset_{d}_ticks": F.when(enough, c(f"_onset_{d}")),
            f"{d}_reasons": F.when(F.coalesce(enough, F.lit(False)), F.array_compact(F.array(
                F.when(c(f"_vis_{d}"), f"visible_execution_{word}"), F.when(c(f"_int_{d}"), f"interval_execution_{word}"))))
            .otherwise(F.array().cast("array<string>")),
        })
    unheld = lambda d: over(d) & ~c(f"_int_{d}")
    triggered = c("_vis_down") | c("_vis_up") | c("_int_down") | c("_int_up")
    m = m.withColumn("data_quality_flags", F.array_sort(F.array_distinct(F.array_compact(F.concat(
        F.array("quality_flag", F.when(c("_asks"), c("confirmation_block"))),
        flags((c("_asks") & c("confirmed") & (unheld("down") | unheld("up")), "counter_lag_suspect"),
              (triggered & ~c("onset_ok"), "onset_data_gap")))))))
    return m.drop("_eligible", "_asks", *[f"_{k}_{d}" for k in ("int", "vis", "depth", "onset") for d in ("down", "up")])


def candidates(marked: DataFrame) -> DataFrame:
    """A frame can be a candidate in both directions."""
    c = F.col
    side = lambda d: F.struct(
        F.lit(d).alias("event_direction"), c(f"candidate_{d}_depth").alias("candidate_execution_depth"),
        c(f"onset_{d}_ticks").alias("onset_ticks"), c(f"{d}_reasons").alias("trigger_reasons"))
    return marked.filter(c("candidate_down_depth").isNotNull() | c("candidate_up_depth").isNotNull()).withColumn(
        "_s", F.explode(F.filter(F.array(side("down"), side("up")), lambda s: s["candidate_execution_depth"].isNotNull()))
    ).select("*", "_s.*").drop("_s")


EVENT_FIELDS = [
    "TradingDay", "display_time", "snapshot_seq_start", "snapshot_seq_end", "candidate_execution_depth", "fair_price",
    "fair_uncertainty_ticks", "valid_peer_count", "valid_peers", "peer_bases", "last_threshold_ticks",
    "vwap_threshold_ticks", "last_down_ticks", "last_up_ticks", "vwap_down_ticks", "vwap_up_ticks", "combined_vwap_1s",
    "combined_vwap_down_ticks", "combined_vwap_up_ticks", "interval_confirmation_end_key",
    "interval_confirmation_end_time", "onset_ticks", "noise_sample_count", "noise_time_span_seconds", "LastPrice",
    "interval_vwap", "delta_volume", "delta_turnover", "tick_size", "contract_multiplier", "data_quality_flags",
]


def merge(cands: DataFrame, marked: DataFrame, cfg: TickConfig = TickConfig(), width: int | None = None) -> DataFrame:
    """Candidates of one direction within both the merge window and the data gap limit become one event."""
    c = F.col
    key = "market_time_key"
    numbered = gap_islands(cands, [*K, "event_direction"], key, min(cfg.merge_ms, cfg.max_gap_ms), chunk_width=width or cfg.chunk_ms)
    grouped = numbered.groupBy(*K, "event_direction", "island").agg(
        F.max_by(F.struct(key, *EVENT_FIELDS), F.struct("candidate_execution_depth", -c(key))).alias("a"),
        F.min(key).alias("event_start_key"), F.max(key).alias("event_end_key"),
        F.array_distinct(F.flatten(F.collect_set("trigger_reasons"))).alias("_reasons"),
    )
    events = grouped.select(
        *K, "event_direction", "event_start_key", "event_end_key", c(f"a.{key}").alias("event_anchor_key"),
        ordered_subset(c("_reasons"), REASON_ORDER).alias("trigger_reasons"), *[c(f"a.{n}").alias(n) for n in EVENT_FIELDS],
    )
    volume = event_volumes(events, marked)
    return events.join(volume, [*K, "event_direction", "event_anchor_key"], "left").withColumn(
        "event_volume", F.coalesce("event_volume", F.lit(0.0)))


def event_volumes(events: DataFrame, frames: DataFrame) -> DataFrame:
    """Traded volume of the frames inside [event_start_key, event_end_key]."""
    spans = events.select(*K, "event_direction", "event_anchor_key", "event_start_key", "event_end_key")
    traded = frames.filter(F.col("delta_volume") > 0).select(*K, F.col("market_time_key").alias("_at"), F.col("delta_volume").alias("_dv"))
    return range_join(spans, traded, K, "event_start_key", "event_end_key", "_at").groupBy(
        *K, "event_direction", "event_anchor_key").agg(F.sum("_dv").alias("event_volume"))


def recovery_fair(rows: DataFrame, frames: DataFrame, cfg: TickConfig = TickConfig()) -> DataFrame:
    """Median of peer mid + basis frozen at the anchor. ``rows``: row_id columns, at_key, valid_peers, peer_bases."""
    c = F.col
    ids = [x for x in rows.columns if x not in ("valid_peers", "peer_bases")]
    legs = rows.select(*ids, F.explode(F.arrays_zip("valid_peers", "peer_bases")).alias("_p")).select(
        *ids, c("_p.valid_peers").alias("peer"), c("_p.peer_bases").alias("_basis"))
    quotes = frames.select("trade_date", "commodity", c("contract").alias("peer"), c("market_time_key").alias("pk"),
                           "mid_price", "quote_valid")
    found = asof_join(legs, quotes, ["trade_date", "commodity", "peer"], "at_key", "pk", cfg.reference_age_ms, "q", cfg.chunk_ms)
    return found.filter(c("q.quote_valid")).groupBy(*ids).agg(
        F.percentile(c("q.mid_price") + c("_basis"), 0.5).alias("recovery_fair_price"), F.count(F.lit(1)).alias("_n")
    ).filter(c("_n") >= cfg.min_peers).drop("_n")


EVENT_KEY = [*K, "event_direction", "event_anchor_key"]


def recovery(events: DataFrame, marked: DataFrame, frames: DataFrame, cfg: TickConfig = TickConfig()) -> DataFrame:
    """Earliest return of each triggered channel inside the frozen threshold within ten seconds."""
    c = F.col
    spans = events.select(
        *EVENT_KEY, "valid_peers", "peer_bases", "trigger_reasons", "last_threshold_ticks", "vwap_threshold_ticks",
        (c("event_anchor_key") + 1).alias("_from"), (c("event_anchor_key") + cfg.recovery_ms).alias("_until"))
    after = marked.select(*K, c("market_time_key").alias("at_key"), "gap_ms", "LastPrice", "delta_volume", "BidPrice1",
                          "AskPrice1", "confirmed", "confirmed_vwap", "confirmation_end_key", "tick_size")
    rows = range_join(spans, after, K, "_from", "_until", "at_key")
    fair = recovery_fair(rows.select(*EVENT_KEY, "at_key", "valid_peers", "peer_bases"), frames, cfg)
    rows = rows.join(fair, [*EVENT_KEY, "at_key"], "left")
    down = c("event_direction") == "down"
    sign = F.when(down, 1.0).otherwise(-1.0)
    left = lambda price: sign * (c("recovery_fair_price") - price) / c("tick_size")
    quote = F.when(down, c("BidPrice1")).otherwise(c("AskPrice1"))
    elapsed = (c("at_key") - c("event_anchor_key")) / 1000.0
    visible = F.array_contains("trigger_reasons", "visible_execution_drop") | F.array_contains("trigger_reasons", "visible_execution_spike")
    interval = F.array_contains("trigger_reasons", "interval_execution_drop") | F.array_contains("trigger_reasons", "interval_execution_spike")
    per_event = rows.groupBy(*EVENT_KEY).agg(
        F.bool_or(F.coalesce(c("gap_ms") > cfg.max_gap_ms, F.lit(False))).alias("_broken"),
        F.count("recovery_fair_price").alias("_fairs"),
        F.min(F.when(visible & (c("delta_volume") > 0) & (c("LastPrice") > 0)
                     & (left(c("LastPrice")) < c("last_threshold_ticks")), elapsed)).alias("_vis"),
        F.min(F.when(interval & c("confirmed") & (left(c("confirmed_vwap")) < c("vwap_threshold_ticks")),
                     (c("confirmation_end_key") - c("event_anchor_key")) / 1000.0)).alias("_int"),
        F.min(F.when((quote > 0) & (left(quote) < c("last_threshold_ticks")), elapsed)).alias("_quote"),
    )
    x = events.join(per_event, EVENT_KEY, "left")
    cut = F.coalesce(c("_broken") | (c("_fairs") == 0), F.lit(True))
    kept = lambda e: F.when(~c("recovery_truncated"), e)
    x = x.withColumn("recovery_truncated", cut).withColumns({
        "visible_recovered_seconds": kept(c("_vis")), "interval_recovered_seconds": kept(c("_int")),
        "quote_recovered_seconds": kept(F.when(down, c("_quote"))), "ask_recovered_seconds": kept(F.when(~down, c("_quote"))),
    })
    label = classify_recovery(visible, interval, c("visible_recovered_seconds"), c("interval_recovered_seconds"),
                              F.coalesce("quote_recovered_seconds", "ask_recovered_seconds"))
    return x.withColumn("recovery_label", F.when(c("recovery_truncated"), "truncated").otherwise(label)).drop(
        "_broken", "_fairs", "_vis", "_int", "_quote")


def classify_recovery(visible: Column, interval: Column, vis_sec: Column, int_sec: Column, quote_sec: Column) -> Column:
    by = lambda limit: (~visible | F.coalesce(vis_sec <= limit, F.lit(False))) & (~interval | F.coalesce(int_sec <= limit, F.lit(False)))
    return (
        F.when(by(3), "trade_recovered_3s").when(quote_sec <= 3, "quote_only_recovered_3s")
        .when(by(10), "trade_recovered_10s").when(quote_sec <= 10, "quote_only_recovered_10s").otherwise("persistent_10s")
    )


def finalize(events: DataFrame) -> DataFrame:
    c = F.col
    tick, fair, vwap = c("tick_size"), c("fair_price"), c("interval_vwap")
    size = c("delta_volume") * c("contract_multiplier")
    return events.withColumns({
        "event_id": F.concat_ws("|", "contract", "display_time", F.when(c("event_direction") == "up", "up")),
        "event_anchor_time": c("display_time"), "event_depth_ticks": c("candidate_execution_depth"),
        "event_depth_bps": bps(c("candidate_execution_depth"), tick, fair), "depth_source": F.lit("detector_event_depth"),
        **{f"{ch}_{d}_bps": bps(c(f"{ch}_{d}_ticks"), tick, fair) for ch in ("last", "vwap") for d in ("down", "up")},
        "notional_shortfall": F.coalesce(F.when((c("event_direction") == "down") & (fair > vwap), (fair - vwap) * size), F.lit(0.0)),
        "notional_excess": F.coalesce(F.when((c("event_direction") == "up") & (vwap > fair), (vwap - fair) * size), F.lit(0.0)),
        "peer_contracts": F.array_join("valid_peers", ","),
    })


def alternate_deltas(frames: DataFrame, cfg: TickConfig = TickConfig(), width: int | None = None) -> DataFrame:
    """Volume traded since the frame before: positive, and within the gap limit; else null."""
    c = F.col
    x = frames.select(*K, "market_time_key", "Volume").withColumn(CHUNK, chunk_of("market_time_key", width or cfg.chunk_ms))
    x = ordered_state(x, K, ["market_time_key"], CHUNK, previous={"_pk": c("market_time_key"), "_pv": c("Volume")}).drop(CHUNK)
    traded = (c("market_time_key") - c("_pk") <= cfg.max_gap_ms) & (c("Volume") > c("_pv"))
    return x.select(*K, "market_time_key", F.when(traded, c("Volume") - c("_pv")).alias("delta_volume"))


def detect(frames: DataFrame, cfg: TickConfig = TickConfig(), width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(marked frames, finished events)."""
    marked = mark(attach_reference(frames, cfg), cfg)
    events = merge(candidates(marked), marked, cfg, width)
    return marked, finalize(recovery(events, marked, frames, cfg))


def diagnostics(frames: DataFrame, marked: DataFrame, events: DataFrame) -> DataFrame:
    """Per contract-day row counts by blocking reason; counter flags are counted on the marked frames."""
    c = F.col
    base = frames.groupBy(*K).agg(
        F.max("validation_status").alias("validation_status"), F.sum("raw_rows").alias("raw_rows"),
        F.count(F.lit(1)).alias("merged_rows"), F.count_if(c("is_tradable_session")).alias("tradable_rows"),
        F.count_if(~c("is_tradable_session")).alias("session_blocked_rows"),
        F.count_if(c("validation_status") != "validated").alias("metadata_blocked_rows"),
        F.max_by("Volume", "market_time_key").alias("day_total_volume"),
    )
    reason = lambda r: F.count_if(c("reference_blocked_reason") == r)
    flag = lambda r: F.count_if(F.array_contains("data_quality_flags", r))
    blocked = marked.groupBy(*K).agg(
        reason("insufficient_peers").alias("peer_blocked_rows"), reason("fair_uncertainty_exceeded").alias("fair_blocked_rows"),
        reason("insufficient_noise_history").alias("noise_blocked_rows"),
        flag("counter_sync_unconfirmed").alias("counter_unconfirmed_rows"), flag("counter_lag_suspect").alias("counter_lag_rows"))
    found = events.groupBy(*K).agg(F.count(F.lit(1)).alias("candidate_events"))
    out = base.join(blocked, K, "left").join(found, K, "left")
    fill = ["peer_blocked_rows", "fair_blocked_rows", "noise_blocked_rows", "counter_unconfirmed_rows", "counter_lag_rows", "candidate_events"]
    return out.withColumns({n: F.coalesce(c(n), F.lit(0)).cast("bigint") for n in fill})


def replay_target(events: DataFrame, marked: DataFrame, cfg: TickConfig = TickConfig()) -> DataFrame:
    """Frames of the target around each anchor, the anchor flagged."""
    c = F.col
    spans = events.select(*K, "event_id", "event_anchor_key", (c("event_anchor_key") - cfg.replay_ms).alias("_from"),
                          (c("event_anchor_key") + cfg.replay_ms).alias("_until"))
    rows = marked.select(*K, "market_time_key", "display_time", "LastPrice", "Volume", "Turnover", "BidPrice1", "AskPrice1",
                         "delta_volume", "interval_vwap", "fair_price", "last_down_ticks", "last_up_ticks")
    return range_join(spans, rows, K, "_from", "_until", "market_time_key").withColumn(
        "is_candidate_anchor", c("market_time_key") == c("event_anchor_key")).drop("_from", "_until")


def replay_peers(events: DataFrame, frames: DataFrame, cfg: TickConfig = TickConfig()) -> DataFrame:
    """Frames of every participating peer around each anchor; the frame nearest to the anchor is flagged."""
    c = F.col
    legs = events.select("trade_date", "commodity", c("contract").alias("target"), "event_id", "event_anchor_key",
                         (c("event_anchor_key") - cfg.replay_ms).alias("_from"), (c("event_anchor_key") + cfg.replay_ms).alias("_until"),
                         F.explode("valid_peers").alias("contract"))
    rows = frames.select(*K, "market_time_key", "display_time", "LastPrice", "BidPrice1", "AskPrice1", "delta_volume", "interval_vwap")
    near = Window.partitionBy("trade_date", "target", "event_id", "contract").orderBy(
        F.abs(c("market_time_key") - c("event_anchor_key")), "market_time_key")
    return range_join(legs, rows, K, "_from", "_until", "market_time_key").withColumn(
        "is_reference_anchor", F.row_number().over(near) == 1).drop("_from", "_until")


def nearest_peer_frame(events: DataFrame, frames: DataFrame, cfg: TickConfig = TickConfig()) -> DataFrame:
    legs = events.select("trade_date", "commodity", "event_id", "event_anchor_key", F.explode("valid_peers").alias("contract"))
    rows = frames.select(*K, "market_time_key", "mid_price")
    return nearest_join(legs, rows, K, "event_anchor_key", "market_time_key", cfg.replay_ms, "near", cfg.chunk_ms)

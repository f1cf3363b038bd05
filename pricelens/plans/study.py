"""Mid/last deviation study: prepared snapshots -> candidates -> events -> event metrics -> summaries.

Ordered steps run on (trade day, instrument, chunk); see ``operators.chunked``. Rows keep their file order in
``row_order``. Pass ``chunk=None`` only when the largest contract-day has been checked to fit one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import StudyConfig
from ..functions.clock import DAY_MS, display_time, with_clock
from ..operators.chunked import CHUNK, chunk_of, islands, ordered_state
from ..operators.quantiles import exact_quantiles
from ..operators.rangejoin import range_join
from ..session import materialize

KEYS = ["trade_date", "InstrumentID"]
COMBO = ["threshold_pct", "side", "mode"]
PRICE_MAX = 1_000_000_000.0


def finite_price(price: Column) -> Column:
    return F.coalesce(price.isNotNull() & ~F.isnan(price) & (price > 0) & (price < PRICE_MAX), F.lit(False))


def row_chunks(raw: DataFrame, cfg: StudyConfig = StudyConfig()) -> tuple[DataFrame, str]:
    """The rows and the name of their chunk column; a chunk is ``cfg.chunk_rows`` of a contract-day's row order."""
    return raw.withColumn(CHUNK, chunk_of("row_order", cfg.chunk_rows)), CHUNK


def prepare(raw: DataFrame, cfg: StudyConfig = StudyConfig(), chunk: str | None = None) -> DataFrame:
    c = F.col
    if chunk is None:
        raw, chunk = row_chunks(raw, cfg)
    both = finite_price(c("BidPrice1")) & finite_price(c("AskPrice1"))
    volume = c("Volume").cast("double")
    x = with_clock(raw, "clock", c("UpdateTime"), c("UpdateMillisec")).withColumns({
        "valid_volume": F.coalesce((volume >= 0) & (F.abs(volume - F.rint(volume)) <= 1e-8), F.lit(False)),
        "valid_bbo": both & F.coalesce(c("BidPrice1") <= c("AskPrice1"), F.lit(False)),
        "valid_last": finite_price(c("LastPrice")),
    })
    x = x.withColumns({
        "valid_time": c("clock").isNotNull(),
        "mid": F.when(c("valid_bbo"), (c("BidPrice1") + c("AskPrice1")) / 2.0),
        "spread": F.when(c("valid_bbo"), c("AskPrice1") - c("BidPrice1")),
    }).withColumn("spread_pct", F.when(c("mid") > 0, c("spread") / c("mid")))
    x = ordered_state(x, KEYS, ["row_order"], chunk, previous={
        "p_row": c("row_order"), "p_clock": c("clock"), "p_volume": volume, "p_valid": c("valid_volume"),
    })
    rolled = F.coalesce(
        (c("clock") < c("p_clock")) & (c("p_clock") >= 18 * 3_600_000) & (c("clock") < 6 * 3_600_000), F.lit(False)
    )
    x = x.withColumn("_rolled", F.when(rolled, 1).otherwise(0).cast("bigint"))
    x = x.withColumns({
        "dt_ms": c("clock") - c("p_clock") + c("_rolled") * DAY_MS,
        "_delta": volume - c("p_volume"),
    })
    x = x.withColumn("volume_reset", F.coalesce(c("valid_volume") & c("p_valid") & (c("_delta") < 0), F.lit(False)))
    start = (
        c("p_row").isNull() | ~c("valid_time") | c("p_clock").isNull() | ~c("valid_volume") | ~c("p_valid")
        | (c("dt_ms") < 0) | (c("dt_ms") > cfg.segment_gap_ms) | c("volume_reset")
    )
    x = x.withColumn("segment_start", F.coalesce(start, F.lit(True)))
    x = ordered_state(
        x, KEYS, ["row_order"], chunk,
        running={"segment_id": F.when(c("segment_start"), 1).otherwise(0).cast("bigint"), "_days": c("_rolled")},
        last_known={
            "_seen_mid": F.when(c("valid_bbo"), F.struct("row_order", "mid")),
            "_seen_start": F.when(c("segment_start"), c("row_order")),
        },
        clustered=True,
    )
    x = x.withColumns({
        "ts_ms": c("clock") + c("_days") * DAY_MS,
        "delta_volume": F.when(~c("segment_start") & c("valid_volume"), c("_delta")),
        # The last valid mid counts only when it was seen at or after the start of the current segment.
        "prev_mid": F.when(~c("segment_start") & (c("_seen_mid.row_order") >= c("_seen_start")), c("_seen_mid.mid")),
    })
    traded = c("valid_bbo") & c("valid_last") & c("has_new_trade") & (c("mid") > 0)
    return x.withColumn("has_new_trade", F.coalesce(c("delta_volume") > 0, F.lit(False))).withColumns({
        "deviation": F.when(traded, (c("LastPrice") - c("mid")) / c("mid")),
        "outside_bbo_down": traded & F.coalesce(c("LastPrice") < c("BidPrice1"), F.lit(False)),
        "outside_bbo_up": traded & F.coalesce(c("LastPrice") > c("AskPrice1"), F.lit(False)),
    }).drop("p_row", "p_clock", "p_volume", "p_valid", "_rolled", "_delta", "_days", "_seen_mid", "_seen_start")


def candidates(prepared: DataFrame, cfg: StudyConfig = StudyConfig()) -> DataFrame:
    """One row per (snapshot, threshold, mode) reached; the sign of the deviation fixes the side."""
    c = F.col
    size = F.abs(c("deviation"))
    down = c("deviation") < 0
    steps = F.filter(F.array(*[F.lit(t) for t in cfg.thresholds]), lambda t: size >= t)
    outside = F.when(down, c("outside_bbo_down")).otherwise(c("outside_bbo_up"))
    modes = F.when(outside, F.array(F.lit("raw"), F.lit("strict"))).otherwise(F.array(F.lit("raw")))
    return (
        prepared.filter(size >= min(cfg.thresholds))
        .withColumns({"side": F.when(down, "down").otherwise("up"), "abs_deviation": size})
        .withColumn("threshold", F.explode(steps)).withColumn("mode", F.explode(modes))
        .withColumn("threshold_pct", c("threshold") * 100)
    )


def cluster(cands: DataFrame, cfg: StudyConfig = StudyConfig(), chunk: str | None = None) -> DataFrame:
    """Candidates of one segment at most ``merge_ms`` apart form an event; its largest deviation represents it."""
    c = F.col
    gap = c("ts_ms") - c("_p_ts")
    fresh = ~c("segment_id").eqNullSafe(c("_p_seg")) | gap.isNull() | (gap > cfg.merge_ms) | (gap < 0)
    numbered = islands(cands, [*KEYS, *COMBO], ["row_order"], {"_p_seg": c("segment_id"), "_p_ts": c("ts_ms")},
                       fresh, "island", chunk)
    carried = ["threshold", "segment_id", "ts_ms", "row_order", "TradingDay", "UpdateTime", "UpdateMillisec", "mid",
               "prev_mid", "LastPrice", "BidPrice1", "AskPrice1", "spread", "spread_pct", "delta_volume", "deviation",
               "abs_deviation"]
    stamp = F.struct("ts_ms", "row_order", display_time(c("UpdateTime"), c("UpdateMillisec")).alias("at"))
    grouped = numbered.groupBy(*KEYS, *COMBO, "island").agg(
        F.max_by(F.struct(*carried), F.struct("abs_deviation", -c("row_order"))).alias("r"),
        F.min_by(stamp, "row_order").alias("a"), F.max_by(stamp, "row_order").alias("b"),
        F.count(F.lit(1)).alias("cluster_candidate_rows"),
    )
    return grouped.select(
        *KEYS, *COMBO, "r.*", "cluster_candidate_rows",
        c("a.ts_ms").alias("event_start_ts_ms"), c("b.ts_ms").alias("event_end_ts_ms"),
        c("a.row_order").alias("event_start_row_order"), c("b.row_order").alias("event_end_row_order"),
        c("a.at").alias("event_start_time"), c("b.at").alias("event_end_time"),
    )


def anchor_paths(prepared: DataFrame, events: DataFrame, cfg: StudyConfig = StudyConfig()) -> DataFrame:
    """Per distinct anchor row: the first mid at or after each horizon, and the extremes of the following path.

    Events of different thresholds share anchors, so anchors are de-duplicated before the interval join, and one
    join serves every horizon and the excursion window.
    """
    c = F.col
    longest = max(max(cfg.horizons) * 1000 + cfg.delay_tolerance_ms, cfg.excursion_seconds * 1000)
    anchors = events.select(*KEYS, "segment_id", c("row_order").alias("a_row"), c("ts_ms").alias("a_ts")).distinct()
    anchors = anchors.withColumn("_until", c("a_ts") + longest)
    points = prepared.filter(c("mid").isNotNull() & c("ts_ms").isNotNull()).select(
        *KEYS, "segment_id", "ts_ms", "row_order", "mid",
        display_time(c("UpdateTime"), c("UpdateMillisec")).alias("at"),
    )
    pairs = range_join(anchors, points, [*KEYS, "segment_id"], "a_ts", "_until", "ts_ms", extra=c("row_order") > c("a_row"))
    elapsed = c("ts_ms") - c("a_ts")
    path = elapsed <= cfg.excursion_seconds * 1000
    aggs = [
        F.max(F.when(path, c("mid"))).alias("path_max"), F.min(F.when(path, c("mid"))).alias("path_min"),
        F.max(F.when(path, elapsed)).alias("covered_ms"),
    ]
    for h in cfg.horizons:
        window = (elapsed >= h * 1000) & (elapsed <= h * 1000 + cfg.delay_tolerance_ms)
        aggs.append(F.min(F.when(window, F.struct("row_order", "mid", "ts_ms", "at"))).alias(f"s{h}"))
    return pairs.groupBy(*KEYS, "segment_id", "a_row").agg(*aggs).withColumnRenamed("a_row", "row_order")


def event_details(prepared: DataFrame, events: DataFrame, cfg: StudyConfig = StudyConfig()) -> DataFrame:
    c = F.col
    down = c("side") == "down"
    x = events.join(anchor_paths(prepared, events, cfg), [*KEYS, "segment_id", "row_order"], "left")
    x = x.withColumns({
        "window_id": F.concat_ws("_", "InstrumentID", c("trade_date").cast("string"), c("row_order").cast("string")),
        "event_id": F.sha2(F.concat_ws("|", c("trade_date").cast("string"), "InstrumentID", F.round(c("threshold_pct"), 6).cast("string"),
                                       "side", "mode", c("row_order").cast("string")), 256).substr(1, 16),
        "event_time": display_time(c("UpdateTime"), c("UpdateMillisec")),
        "event_mid": c("mid"), "anchor_mid": c("prev_mid"), "event_last": c("LastPrice"),
        "deviation_pct": c("deviation") * 100, "abs_deviation_pct": c("abs_deviation") * 100,
        "mid_move_pct": (c("mid") - c("prev_mid")) / F.nullif(c("prev_mid"), F.lit(0.0)) * 100,
        "sim_fill_price": F.when(down, c("mid") * (1 - c("threshold"))).otherwise(c("mid") * (1 + c("threshold"))),
    })
    fill = c("sim_fill_price")
    denominator = F.when(down, c("prev_mid") - fill).otherwise(fill - c("prev_mid"))
    for h in cfg.horizons:
        s = c(f"s{h}")
        moved = F.when(down, s["mid"] - fill).otherwise(fill - s["mid"])
        x = x.withColumns({
            f"mid_after_{h}s": s["mid"], f"sample_ts_after_{h}s": s["ts_ms"], f"sample_time_after_{h}s": s["at"],
            f"sample_delay_after_{h}s": (s["ts_ms"] - c("ts_ms") - h * 1000) / 1000.0,
            f"recovery_ratio_{h}s": F.when(denominator > 0, moved / denominator),
        })
        x = x.withColumns({f"recovery{lv}_{h}s": c(f"recovery_ratio_{h}s") >= lv / 100 for lv in (50, 80, 100)})
    best = F.when(down, c("path_max") - fill).otherwise(fill - c("path_min")) / fill
    worst = F.when(down, fill - c("path_min")).otherwise(c("path_max") - fill) / fill
    H = cfg.excursion_seconds
    seen = c("path_max").isNotNull() & (fill > 0)
    return x.withColumns({
        "mfe_pct": F.when(seen, F.greatest(F.lit(0.0), best) * 100),
        "mae_pct": F.when(seen, F.greatest(F.lit(0.0), worst) * 100),
        # Complete only when a row lies exactly at the end of the window.
        "mfe_mae_window_complete": F.coalesce(c("covered_ms") >= H * 1000, F.lit(False)),
        "mfe_mae_covered_seconds": F.coalesce(F.greatest(F.lit(0.0), c("covered_ms") / 1000.0), F.lit(0.0)),
    }).drop("path_max", "path_min", "covered_ms", *[f"s{h}" for h in cfg.horizons])


def event_windows(prepared: DataFrame, events: DataFrame, cfg: StudyConfig = StudyConfig()) -> DataFrame:
    """Replay rows around each distinct anchor, in the anchor's segment."""
    c = F.col
    anchors = events.select(*KEYS, "segment_id", c("row_order").alias("a_row"), c("ts_ms").alias("a_ts")).distinct()
    anchors = anchors.withColumns({
        "_from": c("a_ts") - cfg.window_before_ms, "_until": c("a_ts") + cfg.excursion_seconds * 1000,
        "window_id": F.concat_ws("_", "InstrumentID", c("trade_date").cast("string"), c("a_row").cast("string")),
    })
    points = prepared.filter(c("ts_ms").isNotNull()).select(
        *KEYS, "segment_id", "ts_ms", "row_order", "LastPrice", "mid", "BidPrice1", "AskPrice1", "Volume")
    rows = range_join(anchors, points, [*KEYS, "segment_id"], "_from", "_until", "ts_ms")
    return rows.select(
        "window_id", "row_order", ((c("ts_ms") - c("a_ts")) / 1000.0).alias("ts_seconds_from_event"),
        "LastPrice", "mid", "BidPrice1", "AskPrice1", "Volume", (c("row_order") == c("a_row")).alias("is_representative"),
    )


def distributions(prepared: DataFrame) -> DataFrame:
    """Quantiles of the absolute deviation per contract-day and per contract, in percent."""
    c = F.col
    probs = {"q90_pct": 0.9, "q95_pct": 0.95, "q99_pct": 0.99, "q99_5_pct": 0.995, "q99_9_pct": 0.999,
             "q99_99_pct": 0.9999, "max_pct": 1.0}
    scopes = F.explode(F.array(
        F.struct(F.lit("contract_day").alias("scope"), c("trade_date").cast("string").alias("day")),
        F.struct(F.lit("contract_all").alias("scope"), F.lit("").alias("day")),
    ))
    rows = prepared.filter(c("deviation").isNotNull()).select(
        "InstrumentID", (F.abs(c("deviation")) * 100).alias("_pct"), scopes.alias("s")
    ).select("InstrumentID", "_pct", "s.scope", c("s.day").alias("trade_date"))
    return exact_quantiles(rows, ["scope", "InstrumentID", "trade_date"], "_pct", probs).withColumnRenamed(
        "n", "new_trade_records")


def quality(prepared: DataFrame) -> DataFrame:
    n = lambda cond: F.count_if(cond)
    c = F.col
    return prepared.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("rows"), n(c("valid_time")).alias("valid_time_rows"),
        n(~c("valid_time")).alias("invalid_time_rows"), n(c("valid_volume")).alias("valid_volume_rows"),
        n(~c("valid_volume")).alias("invalid_volume_rows"), n(c("valid_bbo")).alias("valid_bbo_rows"),
        n(~c("valid_bbo")).alias("invalid_bbo_rows"), n(~c("valid_last")).alias("invalid_last_rows"),
        n(c("has_new_trade")).alias("new_trade_records"), n(c("deviation").isNotNull()).alias("deviation_records"),
        n(c("volume_reset")).alias("volume_reset_rows"), (n(c("segment_start")) - 1).alias("time_break_rows"),
    )


def _counts(cfg: StudyConfig) -> list[Column]:
    c = F.col
    out = [F.count("row_order").alias("independent_events"),
           F.count_if(c("mfe_mae_window_complete")).alias("mfe_mae_complete_n")]
    for h in cfg.horizons:
        out += [F.count(f"recovery_ratio_{h}s").alias(f"recovery_valid_n_{h}s"),
                (F.count("row_order") - F.count(f"recovery_ratio_{h}s")).alias(f"recovery_missing_n_{h}s")]
        for lv in (50, 80, 100):
            flag = c(f"recovery{lv}_{h}s")
            out += [F.avg(flag.cast("double")).alias(f"recovery{lv}_{h}s_rate"), F.count(flag).alias(f"recovery{lv}_{h}s_n")]
    done = c("mfe_mae_window_complete")
    out += [F.count(F.when(done, c("mfe_pct"))).alias("mfe_valid_n"), F.count(F.when(done, c("mae_pct"))).alias("mae_valid_n"),
            F.avg(F.when(done, c("mfe_pct"))).alias("mfe_mean_pct"), F.avg(F.when(done, c("mae_pct"))).alias("mae_mean_pct")]
    return out


def day_summary(prepared: DataFrame, cands: DataFrame, details: DataFrame, cfg: StudyConfig = StudyConfig()) -> DataFrame:
    """One row per contract-day and combination, also where nothing happened.

    Clusters are more than ``merge_ms`` apart, so a contract-day holds a bounded number of events and the plain
    ``percentile`` is safe at this level.
    """
    c = F.col
    done = c("mfe_mae_window_complete")
    medians = [F.percentile(f"recovery_ratio_{h}s", 0.5).alias(f"recovery_ratio_{h}s_median") for h in cfg.horizons] + [
        F.percentile(F.when(done, c("mfe_pct")), 0.5).alias("mfe_median_pct"),
        F.percentile(F.when(done, c("mae_pct")), 0.5).alias("mae_median_pct"),
        F.percentile(F.when(done, c("mae_pct")), 0.95).alias("mae_p95_pct"),
    ]
    metrics = details.groupBy(*KEYS, *COMBO).agg(*_counts(cfg), *medians)
    joined = day_counts(prepared, cands, cfg).join(metrics, [*KEYS, *COMBO], "left")
    zero = [x for x in joined.columns if x == "independent_events" or x.endswith("_n")
            or "_valid_n_" in x or "_missing_n_" in x]
    return joined.withColumns({x: F.coalesce(c(x), F.lit(0)).cast("bigint") for x in zero})


def day_counts(prepared: DataFrame, cands: DataFrame, cfg: StudyConfig = StudyConfig()) -> DataFrame:
    """Records and candidates per contract-day and combination."""
    rows = cands.groupBy(*KEYS, *COMBO).agg(F.count(F.lit(1)).alias("candidate_rows"))
    counted = combination_spine(prepared, cfg).join(rows, [*KEYS, *COMBO], "left")
    return counted.withColumn("candidate_rows", F.coalesce("candidate_rows", F.lit(0)).cast("bigint"))


def combination_spine(prepared: DataFrame, cfg: StudyConfig = StudyConfig()) -> DataFrame:
    """Every contract-day with every threshold, side and mode (a fixed list of 36, expanded inside the row)."""
    c = F.col
    days = prepared.groupBy(*KEYS).agg(F.count("deviation").alias("deviation_records")).withColumn(
        "effective_day", F.when(c("deviation_records") > 0, 1).otherwise(0).cast("bigint"))
    combos = F.array(*[
        F.struct((F.lit(t) * 100).alias("threshold_pct"), F.lit(s).alias("side"), F.lit(m).alias("mode"))
        for t in cfg.thresholds for s in ("down", "up") for m in ("raw", "strict")
    ])
    return days.withColumn("_c", F.explode(combos)).select(*KEYS, "deviation_records", "effective_day", "_c.*")


def overall_summary(days: DataFrame, details: DataFrame, cfg: StudyConfig = StudyConfig()) -> DataFrame:
    """Contract level, from day rows or their counts. Medians are not additive, so they come from the events again."""
    c = F.col
    keys = ["InstrumentID", *COMBO]
    totals = days.groupBy(*keys).agg(
        F.sum("effective_day").alias("active_days"), F.sum("candidate_rows").alias("candidate_rows"),
        F.sum("deviation_records").alias("deviation_records"),
    )
    counts = details.groupBy(*keys).agg(*_counts(cfg))
    done = c("mfe_mae_window_complete")
    values = F.array(
        *[F.struct(F.lit(f"recovery_ratio_{h}s").alias("m"), c(f"recovery_ratio_{h}s").alias("v")) for h in cfg.horizons],
        F.struct(F.lit("mfe").alias("m"), F.when(done, c("mfe_pct")).alias("v")),
        F.struct(F.lit("mae").alias("m"), F.when(done, c("mae_pct")).alias("v")),
    )
    long = details.select(*keys, F.explode(values).alias("x")).select(*keys, "x.m", "x.v")
    q = exact_quantiles(long, [*keys, "m"], "v", {"p50": 0.5, "p95": 0.95})
    pick = lambda m, p: F.max(F.when(c("m") == m, c(p)))
    medians = q.groupBy(*keys).agg(
        *[pick(f"recovery_ratio_{h}s", "p50").alias(f"recovery_ratio_{h}s_median") for h in cfg.horizons],
        pick("mfe", "p50").alias("mfe_median_pct"), pick("mae", "p50").alias("mae_median_pct"),
        pick("mae", "p95").alias("mae_p95_pct"),
    )
    out = totals.join(counts, keys, "left").join(medians, keys, "left")
    zero = [x for x in out.columns if x == "independent_events" or x.endswith("_n") or "_valid_n_" in x or "_missing_n_" in x]
    out = out.withColumns({x: F.coalesce(c(x), F.lit(0)).cast("bigint") for x in zero})
    return out.withColumn("events_per_day", F.when(c("active_days") > 0, c("independent_events") / c("active_days")))


def manifest(sources: DataFrame, quality_rows: DataFrame, details: DataFrame) -> DataFrame:
    """Run counters and status. ``sources`` has a ``status`` column: selected, duplicate or error."""
    c = F.col
    s = sources.agg(
        F.count_if(c("status") != "duplicate").alias("discovered_source_count"),
        F.count_if(c("status") == "selected").alias("selected_source_count"),
        F.count_if(c("status") == "duplicate").alias("duplicate_source_count"),
        F.count_if(c("status") == "error").alias("error_source_count"),
    )
    q = quality_rows.agg(F.count_if(c("deviation_records") > 0).alias("valid_contract_days"))
    e = details.agg(F.count(F.lit(1)).alias("event_count"))
    one = s.unionByName(q, allowMissingColumns=True).unionByName(e, allowMissingColumns=True)
    one = one.agg(*[F.max(n).alias(n) for n in one.columns])
    status = (
        F.when((c("discovered_source_count") == 0) | ((c("error_source_count") > 0) & (c("selected_source_count") == 0)), "failed")
        .when(c("error_source_count") > 0, "incomplete").otherwise("ok")
    )
    return one.withColumn("status", status)


def prepared_events(raw: DataFrame, cfg: StudyConfig = StudyConfig(), chunk: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prepared rows, candidates, events). Rows and events feed several branches each, so both are written once."""
    prepared = materialize(prepare(raw, cfg, chunk))
    cands = candidates(prepared, cfg)
    return prepared, cands, materialize(cluster(cands, cfg, chunk))


def contract_summary(prepared: DataFrame, cands: DataFrame, events: DataFrame, cfg: StudyConfig = StudyConfig()) -> DataFrame:
    """The contract-level summary by itself: the events' metrics are written once, without their other columns."""
    names = [f"recovery_ratio_{h}s" for h in cfg.horizons] + [f"recovery{lv}_{h}s" for h in cfg.horizons for lv in (50, 80, 100)]
    details = event_details(prepared, events, cfg).select(
        "InstrumentID", *COMBO, "row_order", *names, "mfe_pct", "mae_pct", "mfe_mae_window_complete")
    return overall_summary(day_counts(prepared, cands, cfg), materialize(details), cfg)


def analyze(raw: DataFrame, cfg: StudyConfig = StudyConfig(), chunk: str | None = None) -> dict[str, DataFrame]:
    """The five result tables plus the replay windows.

    Prepared rows, events and their details feed several results, so they are written once.
    """
    prepared, cands, events = prepared_events(raw, cfg, chunk)
    details = materialize(event_details(prepared, events, cfg))
    return {
        "event": details, "cluster": events, "day": day_summary(prepared, cands, details, cfg),
        "summary": overall_summary(day_counts(prepared, cands, cfg), details, cfg),
        "distribution": distributions(prepared), "quality": quality(prepared),
        "window": event_windows(prepared, events, cfg),
    }


def output_tables(results: dict[str, DataFrame], cfg: StudyConfig = StudyConfig()) -> dict[str, DataFrame]:
    """The five tables that are handed on, under their file names and with their file columns' names."""
    c, m = F.col, cfg.excursion_seconds
    rename = {"TradingDay": c("trade_date").cast("string"), "bid1": c("BidPrice1"), "ask1": c("AskPrice1"), f"mfe_{m}s_pct": c("mfe_pct"), f"mae_{m}s_pct": c("mae_pct"),
              "spread": c("AskPrice1") - c("BidPrice1"), "spread_pct": (c("AskPrice1") - c("BidPrice1")) / F.nullif(c("mid"), F.lit(0.0)) * 100}
    details = results["event"]
    return {
        "threshold_summary": results["summary"], "threshold_summary_by_day": results["day"],
        "event_details": details.withColumns({n: v for n, v in rename.items() if n not in details.columns}),
        "deviation_distribution": results["distribution"], "data_quality": results["quality"].withColumns({"status": F.lit("ok"), "message": F.lit("")}),
    }

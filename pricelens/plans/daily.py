"""Daily screen: bars -> references -> sample status -> peer and history metrics -> scores -> results.

Two clusterings are used, (commodity, trade_date) and (commodity, contract). Both groups are bounded by the
exchange calendar (listed contracts per day, trading days per contract), never by traded volume.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from ..config import DailyConfig
from ..functions.arrays import array_median
from ..functions.codes import STATUS_LABELS, code_body, commodity_of, delivery_month, is_contract_code, month_index, translate
from ..operators.quantiles import exact_quantiles

QUANTILES = {"q90": 0.90, "q95": 0.95, "q99": 0.99}


def _day():
    return Window.partitionBy("commodity", "trade_date")


def _history():
    return Window.partitionBy("commodity", "contract").orderBy("trade_date")


def _coded(raw: DataFrame, symbols: list[str]) -> DataFrame:
    """Rows of the wanted commodities' contracts, with contract, commodity and the parsed date."""
    body = code_body(F.col("code"))
    text_date = F.col("date").cast("string")
    parsed = F.coalesce(
        F.try_to_timestamp(text_date, F.lit("yyyyMMdd")), F.try_to_timestamp(text_date, F.lit("yyyy-MM-dd")),
        F.try_to_timestamp(text_date),
    )
    df = raw.withColumn("contract", body).withColumn("commodity", commodity_of(body)).filter(
        F.col("commodity").isin(*symbols) & is_contract_code(F.col("contract"))
    )
    return df.withColumn("trade_date", F.to_date(parsed))


def traded_days(raw: DataFrame, symbols: list[str]) -> DataFrame:
    """Every dated row of the wanted contracts, whatever its prices; reads code and date only."""
    return _coded(raw.select("code", "date"), symbols).select("commodity", "contract", "trade_date").dropna(subset=["trade_date"])


def standardize_bars(raw: DataFrame, symbols: list[str], sequence: list[str]) -> DataFrame:
    """Raw vendor rows to the nine fixed bar columns; ``sequence`` orders duplicate rows (last one wins)."""
    prices = ["open", "high", "low", "close", "pre_close", "pre_settle", "vol"]
    df = _coded(raw, symbols).withColumns(
        {c: F.nanvl(F.col(c).try_cast("double"), F.lit(None)) for c in prices}
    ).dropna(subset=["trade_date", "open", "high", "low", "close"])
    in_file_order = Window.partitionBy("commodity", "contract").orderBy("trade_date", *sequence)
    newest = Window.partitionBy("commodity", "contract", "trade_date").orderBy(*[F.col(c).desc() for c in sequence])
    return (
        df.withColumn("pre_close", F.coalesce("pre_close", "pre_settle", F.lag("close").over(in_file_order)))
        .withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") == 1)
        .select("trade_date", "commodity", "contract", "open", "high", "low", "close", "pre_close",
                F.col("vol").alias("volume"))
    )


def with_previous_close(bars: DataFrame) -> DataFrame:
    return bars.withColumn("pre_close", F.lag("close").over(_history()))


def contract_bounds(history: DataFrame) -> DataFrame:
    return history.groupBy("commodity", "contract").agg(
        F.min("trade_date").alias("listed_date"), F.max("trade_date").alias("last_trade_date")
    )


def contract_meta(bars: DataFrame, bounds: DataFrame) -> DataFrame:
    return bars.select("commodity", "contract").distinct().join(
        bounds, ["commodity", "contract"], "left"
    ).withColumn("delivery_month", delivery_month(F.col("contract")))


def with_lifetime(bars: DataFrame) -> DataFrame:
    """Listing bounds from the bars themselves, for inputs that hold the full history: no second scan, no join."""
    whole = Window.partitionBy("commodity", "contract")
    return bars.withColumns({
        "listed_date": F.min("trade_date").over(whole), "last_trade_date": F.max("trade_date").over(whole),
    })


def attach_references(bars: DataFrame) -> DataFrame:
    ranked = _day().orderBy(F.col("volume").desc_nulls_last(), "contract")
    return bars.withColumn("main_reference_contract", F.first("contract").over(ranked))


def reference_changes(referenced: DataFrame) -> DataFrame:
    """One row per commodity-day: its main contract and whether it differs from the previous day's."""
    by_day = Window.partitionBy("commodity").orderBy("trade_date")
    return referenced.groupBy("commodity", "trade_date").agg(
        F.max("main_reference_contract").alias("main_reference_contract")
    ).withColumn(
        "main_reference_changed_today",
        ~F.col("main_reference_contract").eqNullSafe(F.lag("main_reference_contract").over(by_day)),
    )


def _holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def assign_status(bars: DataFrame, meta: DataFrame | None, cfg: DailyConfig = DailyConfig()) -> DataFrame:
    """Waterfall of sample statuses; the last two rules look at statuses as they stood one rule earlier.

    ``meta`` supplies the listing bounds; None means the bars already carry them.
    """
    recent = _history().rowsBetween(-cfg.rolling_rows, -1)
    earlier = _history().rowsBetween(Window.unboundedPreceding, -1)
    c = F.col
    missing = c("open").isNull() | c("high").isNull() | c("low").isNull() | c("close").isNull() | c("pre_close").isNull()
    broken = (
        (c("high") < c("low")) | (c("open") < c("low")) | (c("open") > c("high")) | (c("close") < c("low"))
        | (c("close") > c("high")) | (c("pre_close") <= 0) | (c("volume") < 0)
    )
    df = bars if meta is None else bars.join(meta, ["commodity", "contract"], "left")
    df = df.withColumns({
        "observed_history_count": F.count("trade_date").over(recent),
        "recent_active_days": F.coalesce(F.sum(F.when(c("volume") > 0, 1).otherwise(0)).over(recent), F.lit(0)),
    })
    own = (
        F.when(missing | _holds(broken), "invalid_basic_data")
        .when(_holds(c("volume") == 0), "invalid_low_liquidity")
        .when((c("observed_history_count") >= cfg.min_samples) & (c("recent_active_days") < cfg.min_samples),
              "invalid_low_liquidity")
        .when(c("listed_date").isNull() | c("last_trade_date").isNull(), "invalid_insufficient_history")
        .when((F.datediff("trade_date", "listed_date") < cfg.edge_days)
              | (F.datediff("last_trade_date", "trade_date") < cfg.edge_days), "invalid_lifecycle_edge")
        .otherwise("valid")
    )
    df = df.withColumn("_own", own).withColumn(
        "prior_valid_count", F.coalesce(F.sum(F.when(c("_own") == "valid", 1).otherwise(0)).over(earlier), F.lit(0))
    )
    df = df.withColumn("_settled", F.when(
        (c("_own") == "valid") & (c("prior_valid_count") < cfg.min_samples), "invalid_insufficient_history"
    ).otherwise(c("_own")))
    df = df.withColumns({
        "main_reference_status": F.max(F.when(c("contract") == c("main_reference_contract"), c("_settled"))).over(_day()),
        "analyzable_count": F.sum(F.when(c("_settled") == "valid", 1).otherwise(0)).over(_day()),
    })
    weak_peer = (
        c("main_reference_contract").isNull() | ~c("main_reference_status").eqNullSafe("valid")
        | (c("analyzable_count") < 2)
    )
    return df.withColumn("sample_status", F.when(
        (c("_settled") == "valid") & weak_peer, "invalid_insufficient_peer"
    ).otherwise(c("_settled"))).drop("_own", "_settled", "main_reference_status")


def active_ranked(df: DataFrame, cfg: DailyConfig = DailyConfig()) -> DataFrame:
    """Adds ``is_active``: among the day's most traded valid contracts."""
    eligible = _holds((F.col("sample_status") == "valid") & (F.col("volume") > 0))
    order = _day().orderBy(F.col("_eligible").desc(), F.col("volume").desc_nulls_last(), "contract")
    return df.withColumn("_eligible", eligible).withColumn(
        "is_active", F.col("_eligible") & (F.row_number().over(order) <= cfg.active_limit)
    ).drop("_eligible")


def same_day_peers(df: DataFrame, cfg: DailyConfig = DailyConfig()) -> DataFrame:
    """Peer medians, structure residual and leave-one-out uniqueness gap.

    The active set (at most ``active_limit`` rows) rides along as an array, so no self-join is needed; the
    leave-one-out median comes from ranks and the few central values of the day, so no pairs are formed.
    """
    c = F.col
    df = active_ranked(df, cfg).withColumns({
        "range_pct": (c("high") - c("low")) / F.nullif(c("close"), F.lit(0.0)),
        "extreme_pct": F.greatest(F.abs(c("high") - c("close")), F.abs(c("low") - c("close")))
        / F.nullif(c("close"), F.lit(0.0)),
    })
    member = F.struct("contract", "high", "low", c("volume").cast("double").alias("volume"), "range_pct")
    df = df.withColumn("_active", F.collect_list(F.when(c("is_active"), member)).over(_day()))
    df = df.withColumn("_peers", F.filter("_active", lambda p: p["contract"] != c("contract")))
    df = df.withColumns({
        "active_contract_count": F.size("_active"),
        "active_peer_count": F.size("_peers"),
        "peer_high_median": array_median(c("_peers.high")),
        "peer_low_median": array_median(c("_peers.low")),
        "peer_volume_median": array_median(c("_peers.volume")),
        "peer_range_median": array_median(c("_peers.range_pct")),
    })
    upper = F.greatest(F.lit(0.0), (c("high") - c("peer_high_median")) / F.nullif(c("close"), F.lit(0.0)))
    lower = F.greatest(F.lit(0.0), (c("peer_low_median") - c("low")) / F.nullif(c("close"), F.lit(0.0)))
    usable = c("peer_range_median") > 0
    df = df.withColumn("raw_structure_residual", F.when(c("active_peer_count") > 0, F.greatest(upper, lower)))
    df = df.withColumn("excess_structure_residual", F.when(
        usable, F.greatest(F.lit(0.0), c("raw_structure_residual") - c("peer_range_median"))
    ))
    df = df.withColumn("normalized_structure_residual",
                       F.when(usable, c("excess_structure_residual") / c("peer_range_median")))
    return leave_one_out_gap(df, "normalized_structure_residual").drop("_active", "_peers")


def leave_one_out_gap(df: DataFrame, value: str) -> DataFrame:
    """value - median(value of the other contracts that day), and its positive part."""
    c = F.col
    order = _day().orderBy(c(value).asc_nulls_last(), "contract")
    df = df.withColumns({"_r": F.row_number().over(order), "_m": F.count(value).over(_day()) - 1})
    lo, hi = F.floor((c("_m") + 1) / 2), F.floor(c("_m") / 2) + 1
    df = df.withColumns({
        f"_v{i}": F.max(F.when(c("_r") == pos, c(value))).over(_day())
        for i, pos in enumerate((lo, lo + 1, hi, hi + 1))
    })
    others = (F.when(lo < c("_r"), c("_v0")).otherwise(c("_v1")) + F.when(hi < c("_r"), c("_v2")).otherwise(c("_v3"))) / 2
    df = df.withColumn("raw_uniqueness_gap", F.when(c(value).isNotNull() & (c("_m") > 0), c(value) - others))
    return df.withColumn("uniqueness_gap", F.when(
        c("raw_uniqueness_gap").isNotNull(), F.greatest(F.lit(0.0), c("raw_uniqueness_gap"))
    )).drop("_r", "_m", "_v0", "_v1", "_v2", "_v3")


def _rolling(metric: str, flag: str, cfg: DailyConfig, probs: list[float]) -> Column:
    """Quantiles of the previous eligible rows: ineligible rows fall into their own window partition."""
    w = Window.partitionBy("commodity", "contract", flag).orderBy("trade_date").rowsBetween(-cfg.rolling_rows, -1)
    enough = F.col(flag) & (F.count(metric).over(w) >= cfg.min_samples)
    return F.when(enough, F.percentile(metric, F.array(*[F.lit(p) for p in probs])).over(w))


def history_metrics(df: DataFrame, cfg: DailyConfig = DailyConfig()) -> DataFrame:
    c = F.col
    valid = c("sample_status") == "valid"
    structural = valid & (c("active_peer_count") >= 2)
    # One explicit clustering serves all five window partitions below.
    df = df.repartition("commodity", "contract").withColumns({
        "_f_own": valid & c("range_pct").isNotNull(),
        "_f_volume": valid & c("volume").isNotNull(),
        "_f_structure": structural & c("normalized_structure_residual").isNotNull(),
        "_f_unique": structural & c("uniqueness_gap").isNotNull(),
        "_f_peers": structural,
    })
    probs = list(QUANTILES.values())
    df = df.withColumns({
        "_range": _rolling("range_pct", "_f_own", cfg, probs),
        "_extreme": _rolling("extreme_pct", "_f_own", cfg, probs),
        "_structure": _rolling("normalized_structure_residual", "_f_structure", cfg, probs),
        "_uniqueness": _rolling("uniqueness_gap", "_f_unique", cfg, probs),
        "rolling_median_volume": _rolling("volume", "_f_volume", cfg, [0.5])[0],
        "rolling_median_active_peer_count": _rolling("active_peer_count", "_f_peers", cfg, [0.5])[0],
    })
    df = df.withColumns({
        f"{name}_{q}": c(f"_{name}")[i]
        for name in ("range", "extreme", "structure", "uniqueness") for i, q in enumerate(QUANTILES)
    })
    floor_ = F.greatest(F.lit(2.0), F.coalesce(c("rolling_median_active_peer_count"), F.lit(2.0)) - 1)
    return df.withColumns({
        "peer_comparability_weak_flag": valid & (c("active_peer_count") >= 1) & (c("active_peer_count") < floor_),
        "target_liquidity_weak_flag": _holds(
            valid & (c("volume") < 0.2 * c("rolling_median_volume")) & (c("volume") < 0.3 * c("peer_volume_median"))
        ),
    }).drop("_range", "_extreme", "_structure", "_uniqueness",
            "_f_own", "_f_volume", "_f_structure", "_f_unique", "_f_peers")


def _ladder(value: str, thresholds: list[str], points: list[float], fallbacks: list[float] | None = None) -> Column:
    """Points of the highest step reached; a null or non-positive threshold uses its fallback, if any."""
    out = F.lit(0.0)
    for i, (threshold, score) in enumerate(zip(thresholds, points)):
        t = F.col(threshold)
        reached = _holds((t > 0) & (F.col(value) >= t))
        if fallbacks:
            reached = reached | (~_holds(t > 0) & _holds(F.col(value) >= fallbacks[i]))
        out = F.when(reached, F.lit(score)).otherwise(out)
    return out


def score(df: DataFrame) -> DataFrame:
    c = F.col
    valid = c("sample_status") == "valid"
    names = lambda p: [f"{p}_{q}" for q in QUANTILES]
    weak = c("peer_comparability_weak_flag") | c("target_liquidity_weak_flag")
    invalid = ~valid | (c("active_peer_count") <= 0)
    df = df.withColumns({
        "A1_score": _ladder("range_pct", names("range"), [4.0, 8.0, 12.0]),
        "A2_score": _ladder("extreme_pct", names("extreme"), [3.0, 5.0, 8.0]),
        "C1_score": _ladder("normalized_structure_residual", names("structure"), [12.0, 24.0, 40.0], [0.25, 0.5, 1.0]),
        "C2_score": _ladder("uniqueness_gap", names("uniqueness"), [5.0, 10.0, 20.0], [0.25, 0.5, 1.0]),
    })
    penalty = (
        F.when(invalid, F.lit(-20.0)).when(weak | (c("active_peer_count") == 1), F.lit(-10.0))
        .when(c("active_peer_count") == 2, F.lit(-5.0)).otherwise(F.lit(0.0))
    )
    df = df.withColumns({
        "A_score": F.when(invalid, F.lit(0.0)).otherwise(F.least(c("A1_score") + c("A2_score"), F.lit(20.0))),
        "C_score": F.when(invalid, F.lit(0.0)).otherwise(F.least(c("C1_score") + c("C2_score"), F.lit(60.0))),
        "E_score": penalty,
    })
    total = F.greatest(F.lit(0.0), F.least(F.lit(100.0), c("A_score") + c("C_score") + c("E_score")))
    df = df.withColumn("candidate_score", F.when(invalid, F.lit(0.0)).otherwise(total))
    level = (
        F.when(invalid | (c("candidate_score") < 30), "none")
        .when((c("candidate_score") >= 65) & (c("C_score") < 35), "medium")
        .when(c("C_score") < 20, "low").when(c("candidate_score") >= 65, "high")
        .when(c("candidate_score") >= 50, "medium").otherwise("low")
    )
    return df.withColumn("candidate_level", level)


def screen(bars: DataFrame, meta: DataFrame | None, cfg: DailyConfig = DailyConfig()) -> DataFrame:
    """The whole chain from bars to scored contract-days."""
    return score(history_metrics(same_day_peers(assign_status(attach_references(bars), meta, cfg), cfg), cfg))


def trigger_reasons() -> Column:
    c = F.col
    parts = F.concat_ws(
        "；",
        F.when(c("A_score") >= 8, "振幅异常"), F.when(c("C_score") >= 20, "结构失真"),
        F.when(c("peer_comparability_weak_flag"), "可比合约不足"),
        F.when(c("target_liquidity_weak_flag"), "目标合约流动性偏弱"),
        F.when(c("active_peer_count") == 1, "仅1个活跃可比合约"),
        F.when(c("active_peer_count") == 0, "无活跃可比合约"),
        F.when(c("sample_status") != "valid", F.concat(F.lit("样本状态="), translate(c("sample_status"), STATUS_LABELS))),
    )
    return F.when(parts == "", "无明显触发项").otherwise(parts)


def result_samples(scored: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of the requested range (the look-back buffer is cut here, after scoring) with ids and reasons."""
    return scored.filter(F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).withColumns({
        "detail_id": F.concat_ws("|", "commodity", "contract", F.date_format("trade_date", "yyyy-MM-dd")),
        "trigger_reasons": trigger_reasons(),
    })


def suspicious(samples: DataFrame) -> DataFrame:
    return samples.filter(
        (F.col("candidate_level") != "none")
        & (F.col("peer_volume_median").isNull() | (F.col("volume") >= 0.1 * F.col("peer_volume_median")))
    )


def commodity_summary(suspects: DataFrame) -> DataFrame:
    return suspects.groupBy("commodity").agg(
        F.count("trade_date").alias("candidate_count"), F.countDistinct("contract").alias("contract_count"),
        F.max("candidate_score").alias("max_candidate_score"),
    ).orderBy(F.col("candidate_count").desc(), "commodity")


def overview(samples: DataFrame) -> DataFrame:
    is_suspect = (F.col("candidate_level") != "none") & (
        F.col("peer_volume_median").isNull() | (F.col("volume") >= 0.1 * F.col("peer_volume_median"))
    )
    return samples.agg(
        F.count_if(is_suspect).alias("candidate_count"),
        F.count_if(F.col("sample_status") != "valid").alias("invalid_sample_count"),
    )


PEER_DISPLAY = ["contract", "volume", "high", "low", "close", "range_pct", "raw_structure_residual",
                "normalized_structure_residual", "candidate_score", "candidate_level"]


def peer_display(samples: DataFrame, cfg: DailyConfig = DailyConfig()) -> DataFrame:
    """Each sample with its display rows: the day's active set, preceded by the sample itself when absent."""
    c = F.col
    order = _day().orderBy(c("_eligible").desc(), c("volume").desc_nulls_last(), "contract")
    ranked = samples.withColumn("_eligible", _holds((c("sample_status") == "valid") & (c("volume") > 0))).withColumn(
        "_rank", F.row_number().over(order)
    )
    active = c("_eligible") & (c("_rank") <= cfg.active_limit)
    row = F.struct(c("_rank").alias("rank"), *PEER_DISPLAY)
    with_set = ranked.withColumn("_set", F.array_sort(F.collect_list(F.when(active, row)).over(_day())))
    own = F.array(F.struct(F.lit(0).alias("rank"), *PEER_DISPLAY))
    shown = F.when(active, c("_set")).otherwise(F.concat(own, c("_set")))
    return with_set.withColumn("peer_rows", F.transform(shown, lambda p: F.struct(
        (p["contract"] == c("contract")).alias("is_target"), *[p[n].alias(n) for n in PEER_DISPLAY]
    ))).drop("_eligible", "_rank", "_set")


def finite(value: Column, kind: DataType) -> Column:
    """The value with every NaN or infinite number in it null, inside arrays and structs too; JSON knows neither."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: finite(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda k, v: finite(v, kind.valueType))
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[finite(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return value


def result_tables(samples: DataFrame) -> dict[str, DataFrame]:
    """The screen's tables under their file names."""
    suspects = suspicious(samples)
    return {"suspicious_dates": suspects, "commodity_summary": commodity_summary(suspects), "all_samples": samples,
            "invalid_samples": samples.filter(F.col("sample_status") != "valid"), "summary": report_payload(samples)}


def report_payload(samples: DataFrame) -> DataFrame:
    """One JSON document per sample; numbers that are not finite become null, nulls are kept."""
    shown = peer_display(samples)
    shown = shown.select(*[finite(F.col(f.name), f.dataType).alias(f.name) for f in shown.schema.fields])
    fields = [c for c in shown.columns if c not in ("listed_date", "last_trade_date")]
    return shown.select("detail_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("payload"))


def amplitude_excess(suspects: DataFrame) -> DataFrame:
    """Long table of positive high / low / range excess over the peers, in percent, of amplitude-flagged rows."""
    c = F.col
    rel = lambda a, b: (a - b) / F.nullif(b, F.lit(0.0)) * 100
    flagged = suspects.filter(c("trigger_reasons").contains("振幅异常"))
    metrics = F.array(
        F.struct(F.lit("high").alias("metric"), rel(c("high"), c("peer_high_median")).alias("excess_pct")),
        F.struct(F.lit("low").alias("metric"),
                 ((c("peer_low_median") - c("low")) / F.nullif(c("peer_low_median"), F.lit(0.0)) * 100).alias("excess_pct")),
        F.struct(F.lit("range").alias("metric"), rel(c("range_pct"), c("peer_range_median")).alias("excess_pct")),
    )
    return flagged.select(F.explode(metrics).alias("m")).select("m.*").filter(c("excess_pct") > 0)


def amplitude_summary(excess: DataFrame) -> DataFrame:
    stats = exact_quantiles(excess, ["metric"], "excess_pct", {"p50": 0.5, "p90": 0.9})
    peaks = excess.groupBy("metric").agg(F.max("excess_pct").alias("max_pct"))
    return stats.join(peaks, "metric").withColumnRenamed("n", "n_rows")


def amplitude_histogram(excess: DataFrame) -> DataFrame:
    return excess.groupBy("metric", (F.floor(F.col("excess_pct") / 5) * 5).alias("bucket_start")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def contract_gaps(suspects: DataFrame) -> DataFrame:
    gap = F.abs(month_index(F.col("contract")) - month_index(F.col("main_reference_contract")))
    return suspects.select("commodity", gap.cast("bigint").alias("gap_months")).filter(F.col("gap_months").isNotNull())


def _with_total(gaps: DataFrame) -> DataFrame:
    return gaps.withColumn("scope", F.explode(F.array(F.lit("all"), F.col("commodity"))))


def contract_gap_histogram(gaps: DataFrame) -> DataFrame:
    """Rows for each distance in months between a suspect and its main reference, for all and for each commodity."""
    return _with_total(gaps).groupBy("scope", "gap_months").agg(F.count(F.lit(1)).alias("n_rows"))


def contract_gap_summary(gaps: DataFrame) -> DataFrame:
    both = _with_total(gaps)
    stats = exact_quantiles(both, ["scope"], "gap_months", {"p50": 0.5, "p90": 0.9})
    return stats.join(both.groupBy("scope").agg(F.max("gap_months").alias("max_gap")), "scope").withColumnRenamed("n", "n_rows")

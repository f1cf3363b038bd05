"""Event tables: validation, annotation, exclusions, parameter shapes, distances and roll-ups."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.codes import direction_buy_sell, direction_down_up
from ..operators.chunked import drop_halo, halo_chunks
from ..operators.quantiles import exact_quantiles

EVENT_ID = ["trade_date", "event_id"]


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Adds the columns of a one-row aggregate to every row."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one").drop("_one")


def load_directions(events: DataFrame) -> DataFrame:
    """Adds ``event_direction`` (blank means down); any other word fails the job."""
    word = direction_down_up(F.col("raw_direction"))
    bad = F.concat(F.lit("unknown event direction: "), word)
    return events.withColumn("event_direction", F.when(word.isin("down", "up"), word).otherwise(F.raise_error(bad)))


def annotate(events: DataFrame, boundary: DataFrame) -> DataFrame:
    """Boundary verdict per event; events without one are kept."""
    verdicts = boundary.select(*EVENT_ID, F.col("verdict").alias("_v"))
    return events.join(verdicts, EVENT_ID, "left").withColumn("verdict", F.coalesce("_v", F.lit("keep"))).drop("_v")


def annotation_checks(events: DataFrame, boundary: DataFrame) -> DataFrame:
    """One row of counts that must be zero: repeated keys on either side and boundary keys without an event."""
    repeated = lambda df: df.groupBy(*EVENT_ID).count().filter("count > 1")
    part = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
    return part(repeated(events), "duplicate_source_keys").unionByName(part(repeated(boundary), "duplicate_boundary_keys")).unionByName(
        part(boundary.join(events, EVENT_ID, "left_anti"), "unknown_boundary_keys"))


def file_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Row-order-free signature: row count and the sum of row hashes."""
    h = F.xxhash64(*columns).cast("decimal(38,0)")
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h).cast("string").alias("signature"))


def split_exclusions(events: DataFrame, blocked: DataFrame) -> DataFrame:
    """All events with ``exclusion_reason``: upward ones first, then blocked (trade_date, commodity) pairs."""
    flag = blocked.select("trade_date", "commodity").distinct().withColumn("_blocked", F.lit(True))
    joined = events.join(flag, ["trade_date", "commodity"], "left")
    return joined.withColumn("exclusion_reason", F.when(F.col("event_direction") == "up", "unsupported_event_direction_up")
                             .when(F.col("_blocked"), "quality_exclusion")).drop("_blocked")


def eligible_for_shapes(max_uncertainty: float = 10.0, labels: tuple[str, ...] = ("trade_recovered_3s", "quote_only_recovered_3s")) -> Column:
    c = F.col
    return (
        (c("event_direction") == "down") & (c("data_quality") == "normal") & (c("boundary_verdict") == "keep")
        & c("recovery_label").isin(*labels) & (c("valid_peer_count") >= 2) & (c("fair_uncertainty_ticks") <= max_uncertainty)
        & (c("event_depth_ticks") > 0) & (c("event_depth_bps") > 0) & (c("event_depth_bps") < 10_000)
        & (F.trim(F.coalesce("depth_source", F.lit(""))) != "")
    )


def parameter_shapes(events: DataFrame, quantiles: tuple[float, ...] = (0.70, 0.85), width_ratios: tuple[float, ...] = (0.4,),
                     step_ratios: tuple[float, ...] = (0.5,), min_samples: int = 4) -> DataFrame:
    """Touch depth T, width W, offset D and step S per contract, in percent."""
    c = F.col
    depth = events.filter(eligible_for_shapes()).select("commodity", "contract", (c("event_depth_bps") / 100.0).alias("_d"))
    q = exact_quantiles(depth, ["commodity", "contract"], "_d", {f"t{i}": v for i, v in enumerate(quantiles)})
    each = lambda xs: F.explode(F.array(*[F.lit(float(x)) for x in xs]))
    rows = q.filter(c("n") >= min_samples).select(
        "commodity", c("contract").alias("target_contract"), F.explode(F.array(*[c(f"t{i}") for i in range(len(quantiles))])).alias("T_pct"))
    rows = rows.withColumn("_w", each(width_ratios)).withColumn("W_pct", c("T_pct") * c("_w"))
    rows = rows.withColumn("D_pct", c("T_pct") - c("W_pct")).filter(c("D_pct") > 0)
    rows = rows.withColumn("_s", each(step_ratios)).withColumn("S_pct", c("W_pct") * c("_s"))
    return rows.drop("_w", "_s").dropDuplicates()


def legacy_depth(events: DataFrame, tick_size: Column) -> DataFrame:
    """Depth re-derived from the anchor's own numbers; upward rows are dropped."""
    c = F.col
    vis = F.when((c("last_down_ticks") >= c("last_threshold_ticks")) & (c("last_down_ticks") > 0), c("last_down_ticks"))
    both = (c("vwap_down_ticks") >= c("vwap_threshold_ticks")) & (c("combined_vwap_down_ticks") >= c("vwap_threshold_ticks"))
    itv = F.when(both & (c("combined_vwap_down_ticks") > 0), c("combined_vwap_down_ticks"))
    return events.filter(c("event_direction") == "down").withColumn("derived_depth_ticks", F.greatest(vis, itv)).withColumns({
        "derived_source": F.when(c("derived_depth_ticks").isNull(), "legacy_depth_unverifiable").otherwise("legacy_components_derived"),
        "derived_channels": F.concat_ws("+", F.when(vis.isNotNull(), "visible"), F.when(itv.isNotNull(), "interval")),
        "derived_depth_bps": c("derived_depth_ticks") * tick_size / c("fair_price") * 10_000,
    })


def _reasons(events: DataFrame) -> DataFrame:
    return events.withColumn("reason", F.explode(F.split("trigger_reasons", ",")))


def batch_stats(events: DataFrame) -> DataFrame:
    """Per commodity: counts, first and last time, directions, largest excursion, distinct reasons."""
    c = F.col
    base = events.groupBy("commodity").agg(
        F.count(F.lit(1)).alias("event_count"), F.countDistinct("contract").alias("contract_count"),
        F.min("event_time").alias("first_time"), F.max("event_time").alias("last_time"),
        F.count_if(c("event_direction") == "down").alias("down_count"), F.count_if(c("event_direction") == "up").alias("up_count"),
        F.greatest(F.max("last_down_ticks"), F.max("vwap_down_ticks")).alias("max_down_ticks"),
    )
    words = _reasons(events).groupBy("commodity").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
    return base.join(words, "commodity").orderBy(c("event_count").desc(), "commodity")


def most_common(events: DataFrame, by: str, value: str) -> DataFrame:
    """Most frequent value per group; the alphabetically first on ties."""
    counts = events.groupBy(by, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(by).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(f"top_{value}"))


def ranked_values(events: DataFrame, value: str) -> DataFrame:
    """Every value with its rows and place, most frequent first, ties in alphabetical order."""
    counts = events.groupBy(value).agg(F.count(F.lit(1)).alias("event_count"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.col("event_count").desc(), value)))


def largest_shortfalls(events: DataFrame, n: int = 10) -> DataFrame:
    return events.orderBy(F.col("notional_shortfall").desc(), "event_id").limit(n)


def ordered_events(events: DataFrame, limit: int | None = None) -> DataFrame:
    """Downward events in the order in which they are replayed, all or the first ones."""
    rows = events.filter(F.col("event_direction") == "down").orderBy("trade_date", "event_time", "event_id")
    return rows.limit(limit) if limit else rows


def hit_commodities(events: DataFrame) -> DataFrame:
    return events.groupBy("commodity").agg(F.count(F.lit(1)).alias("event_count")).orderBy(F.col("event_count").desc(), "commodity")


def range_rollup(events: DataFrame) -> DataFrame:
    c = F.col
    base = events.groupBy("commodity").agg(
        F.count(F.lit(1)).alias("event_count"), F.countDistinct("trade_date").alias("day_count"),
        F.countDistinct("contract").alias("contract_count"))
    return base.join(most_common(_reasons(events), "commodity", "reason"), "commodity").join(
        most_common(events, "commodity", "recovery_label"), "commodity")


def calendar_status(events: DataFrame, first: str, last: str) -> DataFrame:
    """Every calendar day of the range with its event count and status; the spine is a bounded date sequence."""
    c = F.col
    spark = events.sparkSession
    spine = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first), "yyyyMMdd"), F.to_date(F.lit(last), "yyyyMMdd"))).alias("d")).select(
        F.date_format("d", "yyyyMMdd").alias("trade_date"))
    days = events.groupBy("trade_date").agg(F.count(F.lit(1)).alias("event_count"), F.countDistinct("commodity").alias("commodity_count"))
    return spine.join(days, "trade_date", "left").select(
        "trade_date", F.coalesce("event_count", F.lit(0)).cast("bigint").alias("event_count"),
        F.coalesce("commodity_count", F.lit(0)).cast("bigint").alias("commodity_count"),
        F.when(c("event_count").isNull(), "missing").otherwise("finished").alias("status"))


FINISHED = ("success_with_events", "success_no_events")


def range_days(events: DataFrame, statuses: DataFrame, absent_days: DataFrame, first: str, last: str) -> DataFrame:
    """Every calendar day of a range: status, events, hits, failed commodities, hit commodities and the first error.

    ``statuses``: trade_date, commodity, status, error of the batch runs; ``absent_days``: trade_date of days without input.
    A day is missing_day without input, missing_output without a run, failed when a commodity failed, incomplete when one
    has neither failed nor finished, else complete.
    """
    c = F.col
    spine = events.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first), "yyyyMMdd"), F.to_date(F.lit(last), "yyyyMMdd"))).alias("d")).select(F.date_format("d", "yyyyMMdd").alias("trade_date"))
    runs = statuses.groupBy("trade_date").agg(
        F.count_if(c("status") == "success_with_events").alias("hits"), F.count_if(c("status") == "failed").alias("failed"),
        F.count_if(~c("status").isin("failed", *FINISHED)).alias("_open"), F.min_by("error", F.when((c("status") == "failed") & (c("error") != ""), c("commodity"))).alias("error"))
    found = events.groupBy("trade_date").agg(F.count(F.lit(1)).alias("events"), F.array_join(F.sort_array(F.collect_set("commodity")), ",").alias("hit_commodities"))
    x = spine.join(absent_days.select("trade_date").distinct().withColumn("_absent", F.lit(True)), "trade_date", "left").join(runs, "trade_date", "left").join(found, "trade_date", "left")
    status = (F.when(c("_absent"), "missing_day").when(c("hits").isNull(), "missing_output").when(c("failed") > 0, "failed").when(c("_open") > 0, "incomplete").otherwise("complete"))
    ran = status.isin("failed", "incomplete", "complete")
    number = lambda n: F.coalesce(F.when(ran, c(n)), F.lit(0)).cast("bigint").alias(n)
    return x.select("trade_date", status.alias("status"), number("events"), number("hits"), number("failed"), F.coalesce(F.when(ran, c("hit_commodities")), F.lit("")).alias("hit_commodities"),
                    F.when(ran, c("error")).alias("error"))


def range_counts(days: DataFrame) -> DataFrame:
    """One row of totals over the days of a range."""
    n = lambda s: F.count_if(F.col("status") == s)
    return days.agg(F.count(F.lit(1)).alias("total_days"), n("complete").alias("completed_days"), n("failed").alias("failed_days"), n("missing_day").alias("missing_days"),
                    n("missing_output").alias("missing_output_days"), n("incomplete").alias("incomplete_days"), F.sum("events").alias("event_count"))


def month_days(events: DataFrame) -> DataFrame:
    """Per day: events, distinct commodities, and the month's average of events per day."""
    days = events.groupBy(F.substring("trade_date", 1, 6).alias("month"), "trade_date").agg(F.count(F.lit(1)).alias("event_count"), F.countDistinct("commodity").alias("commodity_count"))
    return days.withColumn("events_per_day", F.avg("event_count").over(Window.partitionBy("month")))


def month_rollup(events: DataFrame) -> DataFrame:
    c = F.col
    month = events.withColumn("month", F.substring("trade_date", 1, 6))
    rows = month.groupBy("month", "commodity").agg(F.count(F.lit(1)).alias("event_count"), F.sum("notional_shortfall").alias("notional"))
    whole = Window.partitionBy("month")
    return rows.withColumn("share_pct", c("event_count") * 100.0 / F.sum("event_count").over(whole))


def status_counts(statuses: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return statuses.agg(F.count(F.lit(1)).alias("total"), n("finished"), n("missing"))


def year_pivot(events: DataFrame, years: list[int]) -> DataFrame:
    """Commodity x year counts with totals, share of the last year and change against the year before."""
    c = F.col
    wide = events.withColumn("y", F.substring("trade_date", 1, 4).cast("int")).groupBy("commodity").pivot("y", years).count()
    named = wide.select("commodity", *[F.coalesce(c(str(y)), F.lit(0)).cast("bigint").alias(f"y{y}") for y in years])
    total = sum((c(f"y{y}") for y in years[1:]), c(f"y{years[0]}"))
    named = named.withColumn("total", total)
    grand = named.agg(*[F.sum(f"y{y}").alias(f"_g{y}") for y in years])
    last, prior = f"y{years[-1]}", f"y{years[-2]}"
    return with_scalars(named, grand).withColumns({
        "share_pct": F.try_divide(c(last) * 100.0, c(f"_g{years[-1]}")),
        "change_pct": F.try_divide((c(last) - c(prior)) * 100.0, c(prior)),
    }).drop(*[f"_g{y}" for y in years])


def year_totals(events: DataFrame) -> DataFrame:
    """Per year: events, share of all and change against the year before, in percent."""
    c = F.col
    years = events.groupBy(F.substring("trade_date", 1, 4).cast("int").alias("year")).agg(F.count(F.lit(1)).alias("event_count"))
    before = years.select((c("year") + 1).alias("year"), c("event_count").alias("_before"))
    total = years.agg(F.sum("event_count").alias("_all"))
    return with_scalars(years.join(before, "year", "left"), total).select(
        "year", "event_count", (c("event_count") * 100.0 / c("_all")).alias("share_pct"), ((c("event_count") - c("_before")) * 100.0 / c("_before")).alias("change_pct"))


def leading_commodities(events: DataFrame, years: list[int], top: int = 5) -> DataFrame:
    """The commodities with most events in the years, with their place and each year's count."""
    pivot = year_pivot(events, years)
    return pivot.withColumn("place", F.row_number().over(Window.orderBy(F.col("total").desc(), "commodity"))).filter(F.col("place") <= top)


def commodity_years(events: DataFrame) -> DataFrame:
    """Per commodity and year: events, days, contracts; the year null is the commodity's total."""
    rows = events.withColumn("year", F.substring("trade_date", 1, 4).cast("int"))
    return rows.rollup("commodity", "year").agg(F.count(F.lit(1)).alias("event_count"), F.countDistinct("trade_date").alias("day_count"), F.countDistinct("contract").alias("contract_count")).filter(F.col("commodity").isNotNull())


def month_calendar(events: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """All months of the years with count, sorted contracts and day count; empty months are kept."""
    spark = events.sparkSession
    spine = spark.range(1).select(F.explode(F.sequence(
        F.lit(f"{first_year}-01-01").cast("date"), F.lit(f"{last_year}-12-01").cast("date"), F.expr("interval 1 month"))).alias("d")
    ).select(F.date_format("d", "yyyyMM").alias("month"))
    rows = events.groupBy(F.substring("trade_date", 1, 6).alias("month")).agg(
        F.count(F.lit(1)).alias("event_count"), F.array_join(F.sort_array(F.collect_set("contract")), ",").alias("contracts"),
        F.array_join(F.sort_array(F.collect_set("trade_date")), ",").alias("dates"), F.countDistinct("trade_date").alias("day_count"))
    return spine.join(rows, "month", "left").select(
        "month", F.coalesce("event_count", F.lit(0)).cast("bigint").alias("event_count"),
        F.coalesce("contracts", F.lit("")).alias("contracts"), F.coalesce("dates", F.lit("")).alias("dates"), F.coalesce("day_count", F.lit(0)).cast("bigint").alias("day_count"))


# ---- distances -------------------------------------------------------------------------------------------

def unique_events(details: DataFrame, mode: str = "raw", horizon: int = 5) -> DataFrame:
    """One row per event identity (lowest threshold first) with direction and follow ratio."""
    c = F.col
    identity = Window.partitionBy("trade_date", "InstrumentID", "side", "row_order").orderBy("threshold_pct")
    x = details.filter(c("mode") == mode).withColumn("_r", F.row_number().over(identity)).filter(c("_r") == 1).drop("_r")
    x = x.withColumns({"direction": direction_buy_sell(c("side")), "abs_dev": c("abs_deviation_pct") / 100.0})
    after = c(f"mid_after_{horizon}s")
    move = F.when(c("direction") == "BUY", (c("event_mid") - after) / c("event_mid")).otherwise((after - c("event_mid")) / c("event_mid"))
    usable = after.isNotNull() & (c("event_mid") > 0) & (c("abs_dev") > 0)
    return x.withColumn("follow_ratio", F.when(usable, F.greatest(F.lit(0.0), move) / c("abs_dev")))


def forward_excursions(prepared: DataFrame, horizon_seconds: int, chunk_ms: int = 600_000) -> DataFrame:
    """Quantiles of the largest relative mid move within the horizon, per instrument and direction."""
    c = F.col
    rows = prepared.filter(c("mid").isNotNull() & c("ts_ms").isNotNull()).select("trade_date", "InstrumentID", "segment_id", "ts_ms", "mid")
    halo = halo_chunks(rows, "ts_ms", chunk_ms, ahead=horizon_seconds * 1000)
    w = Window.partitionBy("trade_date", "InstrumentID", "segment_id", "_chunk").orderBy("ts_ms").rangeBetween(0, horizon_seconds * 1000)
    reach = drop_halo(halo.withColumns({"_hi": F.max("mid").over(w), "_lo": F.min("mid").over(w)}))
    legs = F.explode(F.array(
        F.struct(F.lit("SELL").alias("direction"), ((c("_hi") - c("mid")) / c("mid")).alias("e")),
        F.struct(F.lit("BUY").alias("direction"), ((c("mid") - c("_lo")) / c("mid")).alias("e"))))
    long = reach.select("InstrumentID", legs.alias("l")).select("InstrumentID", "l.direction", "l.e")
    return exact_quantiles(long, ["InstrumentID", "direction"], "e", {"q90": 0.90, "q95": 0.95, "q99": 0.99}).withColumn(
        "horizon_seconds", F.lit(horizon_seconds))


def safe_distances(excursions: DataFrame, horizon: int, quantile: str = "q99", factor: float = 1.0) -> DataFrame:
    return excursions.filter(F.col("horizon_seconds") == horizon).select(
        "InstrumentID", "direction", (F.col(quantile) * factor).alias("safe_distance"))


def evaluate_distances(safe: DataFrame, events: DataFrame, observed_days: DataFrame, step: float = 0.0005, max_distance: float = 0.01,
                       max_follow: float = 0.3, min_events: int = 3, min_isolation: float = 0.5, min_monthly: float = 1.0,
                       month_days: float = 20.0) -> DataFrame:
    """Counts per candidate distance d of the events with deviation >= d.

    Events are counted once per grid step and summed from the far end, which replaces the inequality join of every
    distance with every event.
    """
    c = F.col
    pair = ["InstrumentID", "direction"]
    last = int(max_distance / step + 1e-9)
    hist = events.select(*pair, F.least(F.floor((c("abs_dev") + 1e-12) / step), F.lit(last)).alias("g"), "follow_ratio").groupBy(*pair, "g").agg(
        F.count(F.lit(1)).alias("n"), F.count("follow_ratio").alias("f"), F.count_if(c("follow_ratio") <= max_follow).alias("i"))
    first = F.ceil((c("safe_distance") - 1e-12) / step)
    spine = safe.filter(first <= last).select(*pair, "safe_distance", F.explode(F.sequence(first, F.lit(last).cast("bigint"))).alias("g"))
    marks = spine.select(*pair, "g", "safe_distance", *[F.lit(0).cast("bigint").alias(x) for x in ("n", "f", "i")]).unionByName(
        hist, allowMissingColumns=True).groupBy(*pair, "g").agg(F.max("safe_distance").alias("safe_distance"), *[F.sum(x).alias(x) for x in ("n", "f", "i")])
    far = Window.partitionBy(*pair).orderBy(c("g").desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = marks.withColumns({x: F.sum(x).over(far) for x in ("n", "f", "i")}).filter(c("safe_distance").isNotNull())
    # observed_days is a one-row aggregate.
    out = with_scalars(summed, observed_days).select(
        *pair, F.round(c("g") * step, 10).alias("candidate_distance"), "safe_distance", c("n").alias("event_count"),
        c("f").alias("follow_valid_count"), c("i").alias("isolated_count"), F.try_divide(c("i"), c("f")).alias("isolation_rate"),
        F.try_divide(c("i") * month_days, c("observed_days")).alias("monthly_opportunity"))
    holds = lambda x: F.coalesce(x, F.lit(False))
    out = out.withColumns({"pass_safe_distance": holds(c("candidate_distance") >= c("safe_distance") - 1e-12), "pass_min_events": holds(c("event_count") >= min_events),
                           "pass_isolation_rate": holds(c("isolation_rate") >= min_isolation), "pass_monthly_opportunity": holds(c("monthly_opportunity") >= min_monthly)})
    return out.withColumn("qualified", c("pass_safe_distance") & c("pass_min_events") & c("pass_isolation_rate") & c("pass_monthly_opportunity"))


def choose_distances(evaluation: DataFrame, safe: DataFrame, band: float = 0.2) -> DataFrame:
    c = F.col
    best = evaluation.filter("qualified").groupBy("InstrumentID", "direction").agg(F.min("candidate_distance").alias("target_distance"))
    return safe.join(best, ["InstrumentID", "direction"], "left").withColumns({
        "min_distance": c("target_distance") * (1 - band), "max_distance": c("target_distance") * (1 + band),
        "status": F.when(c("target_distance").isNull(), "NO_QUALIFIED_DISTANCE").otherwise("QUALIFIED")})


def distance_violations(parameters: DataFrame) -> DataFrame:
    """Rows of a distance-parameter table that break its rules, with the rule broken."""
    c = F.col
    seen = Window.partitionBy("InstrumentID", "direction")
    x = parameters.withColumn("_n", F.count(F.lit(1)).over(seen))
    rule = (
        F.when(c("_n") > 1, "duplicate").when(~c("status").isin("QUALIFIED", "NO_QUALIFIED_DISTANCE"), "status")
        .when((c("status") == "QUALIFIED") & ~((c("safe_distance") >= 0) & (c("safe_distance") <= c("target_distance"))), "safe_distance")
        .when((c("status") == "QUALIFIED") & ~((c("min_distance") > 0) & (c("min_distance") <= c("target_distance"))
                                               & (c("target_distance") <= c("max_distance")) & (c("max_distance") < 1)), "band"))
    return x.withColumn("violation", rule).filter(c("violation").isNotNull()).drop("_n")


# ---- profile inference -----------------------------------------------------------------------------------

def most_active(volumes: DataFrame) -> DataFrame:
    return volumes.groupBy("trade_date", "commodity").agg(
        F.min_by("contract", F.struct(-F.col("day_volume"), F.col("contract"))).alias("contract"))


def infer_multiplier(frames: DataFrame, min_rows: int = 10) -> DataFrame:
    """Rounded median of traded value per lot and price unit; expects delta columns from the frame preparation."""
    c = F.col
    ratio = c("delta_turnover") / c("delta_volume") / c("LastPrice")
    rows = frames.filter((c("delta_turnover") > 0) & (c("delta_volume") > 0) & (c("LastPrice") > 0)).select("commodity", ratio.alias("_r"))
    q = exact_quantiles(rows, ["commodity"], "_r", {"m": 0.5}).filter(c("n") >= min_rows)
    return q.select("commodity", c("n").alias("n_rows"), F.rint("m").cast("bigint").alias("multiplier")).filter(c("multiplier") >= 1)


def infer_tick_size(frames: DataFrame) -> DataFrame:
    """Greatest common divisor of the gaps between distinct prices, on an integer grid of 1e-8.

    Distinct prices of a commodity are first reduced per slice of the price range, so no task sees all of them at
    once: every slice contributes the gcd of its own gaps and its end points.
    """
    c = F.col
    price = F.explode(F.array("BidPrice1", "AskPrice1", "LastPrice"))
    grid = frames.select("commodity", price.alias("p")).filter((c("p") > 0) & (c("p") < 1e9)).select(
        "commodity", F.rint(c("p") * 1e8).cast("bigint").alias("g")).distinct()
    grid = grid.withColumn("_s", F.floor(c("g") / F.lit(5_000_000_000)))
    gaps = grid.withColumn("_d", c("g") - F.lag("g").over(Window.partitionBy("commodity", "_s").orderBy("g")))
    slices = gaps.groupBy("commodity", "_s").agg(F.collect_set("_d").alias("_ds"), F.min("g").alias("_a"), F.max("g").alias("_b"))
    link = slices.withColumn("_d", c("_a") - F.lag("_b").over(Window.partitionBy("commodity").orderBy("_s")))
    step = lambda a, b: F.when(b == 0, a).otherwise(a % b)
    def gcd(arr: Column) -> Column:
        # Euclid on a pair, folded over the values; 60 halvings cover every 63-bit pair.
        pair = lambda x, y: F.aggregate(F.sequence(F.lit(1), F.lit(90)), F.struct(x.alias("a"), y.alias("b")), lambda s, _: F.struct(
            F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, s["b"]).otherwise(s["a"] % s["b"]).alias("b")))["a"]
        return F.aggregate(arr, F.lit(0).cast("bigint"), lambda acc, x: pair(acc, x))
    per_slice = link.select("commodity", gcd(F.array_compact(F.concat("_ds", F.array("_d")))).alias("_g"))
    whole = per_slice.groupBy("commodity").agg(F.collect_set("_g").alias("_gs")).select("commodity", (gcd(c("_gs")) / 1e8).alias("tick_size"))
    return whole.filter(c("tick_size") >= 1e-4).withColumn("tick_size", F.round("tick_size", 5))


# ---- research shapes -------------------------------------------------------------------------------------

def research_shapes(candidates: DataFrame, statistics: DataFrame, instruments: DataFrame, quantiles: tuple[str, ...] = ("P50", "P70", "P85"), width_ratio: float = 0.4, step_ratio: float = 0.5) -> DataFrame:
    """Shapes to replay per instrument: the candidates of the three quantiles, and one from the depth's 90th percentile.

    ``candidates``: target_contract, source_quantile, width_ratio, step_mode, total_touch_ticks, W, D, S. ``statistics``:
    target_contract, candidate_status, confirmed_depth_p90_ticks. Instruments without statistics or not ready are skipped
    with their reason; one that is ready and lacks a quantile, or whose distance would be 0, fails the job.
    """
    c = F.col
    up = lambda x: F.greatest(F.lit(1), F.ceil(x - F.lit(1e-12))).cast("bigint")
    mine = instruments.select("target_contract").distinct().join(statistics.select("target_contract", "candidate_status", "confirmed_depth_p90_ticks"), "target_contract", "left")
    ready = c("candidate_status") == "research_candidate_ready"
    skipped = mine.filter(~F.coalesce(ready, F.lit(False))).select("target_contract", "candidate_status", F.when(c("candidate_status").isNull(), "skipped_missing_statistics").otherwise("skipped_not_ready").alias("replay_status"))
    able = mine.filter(ready)
    regular = candidates.filter(c("source_quantile").isin(*quantiles) & (c("width_ratio") == width_ratio) & (c("step_mode") == F.lit(f"W_x_{step_ratio:.2f}")))
    found = able.join(regular.select("target_contract", "source_quantile", "total_touch_ticks", "W", "D", "S"), "target_contract", "left")
    known = F.size(F.collect_set("source_quantile").over(Window.partitionBy("target_contract")))
    found = found.withColumn("source_quantile", F.when(known == len(quantiles), c("source_quantile")).otherwise(F.raise_error(F.concat(F.lit("quantiles missing: "), c("target_contract")))))
    depth = up(c("confirmed_depth_p90_ticks"))
    width = up(depth * width_ratio)
    distance = F.when(depth - width > 0, depth - width).otherwise(F.raise_error(F.concat(F.lit("no distance left: "), c("target_contract"))))
    tail = able.select("target_contract", "candidate_status", F.lit("P90").alias("source_quantile"), depth.alias("total_touch_ticks"), width.alias("W"), distance.alias("D"), up(width * step_ratio).alias("S"),
                       F.lit("P90_tail").alias("replay_group"), F.lit("tail_depth_candidate").alias("risk_label"))
    shaped = found.select("target_contract", "candidate_status", "source_quantile", "total_touch_ticks", "W", "D", "S", F.lit("_".join(quantiles)).alias("replay_group")).unionByName(tail, allowMissingColumns=True)
    return shaped.withColumn("replay_status", F.lit("prepared")).unionByName(skipped, allowMissingColumns=True)

"""Reference prices at requested instants only: an interval join of the instants with the frames before them.

The same rule as the trailing-window stage, for few instants: of each, only the frames of its own window are read, each
aligned with the target's peers by an as-of join. The limits of a window and the medians behind them are two dependent
percentiles; both run inside one partition of (instant, peer), which holds at most one window of frames.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..config import TickConfig
from ..functions.arrays import array_mad_sigma, array_median
from .asof import asof_join
from .rangejoin import range_join

K = ["trade_date", "commodity", "contract"]


def point_fairs(points: DataFrame, frames: DataFrame, references: DataFrame, cfg: TickConfig = TickConfig()) -> DataFrame:
    """Per distinct (contract-day, at_key) of ``points``: fair_price, fair_uncertainty_ticks, fair_reason.

    ``at_key`` is the key of one of the target's frames; ``references``: contract-day, peer, peer_rank. fair_reason is empty
    where the price is reliable; unreliable ones are kept with their reason.
    """
    c = F.col
    asked = points.select(*K, "at_key").distinct()
    windows = asked.withColumns({"_from": c("at_key") - cfg.baseline_ms, "_until": c("at_key") - cfg.exclude_recent_ms})
    own = frames.select(*K, "market_time_key", c("mid_price").alias("mid"), c("spread_ticks").alias("spread"), c("quote_valid").alias("valid"))
    inside = range_join(windows, own, K, "_from", "_until", "market_time_key").drop("_from", "_until").withColumn("now", F.lit(False))
    here = asked.withColumns({"market_time_key": c("at_key"), "mid": F.lit(None).cast("double"), "spread": F.lit(None).cast("double"), "valid": F.lit(False), "now": F.lit(True)})
    rows = inside.unionByName(here).join(references.select(*K, "peer", "peer_rank"), K)
    quotes = frames.select("trade_date", "commodity", c("contract").alias("peer"), c("market_time_key").alias("pk"), c("mid_price").alias("pmid"), c("spread_ticks").alias("pspread"), c("quote_valid").alias("pvalid"))
    rows = asof_join(rows, quotes, ["trade_date", "commodity", "peer"], "market_time_key", "pk", cfg.reference_age_ms, "q")
    fresh = F.coalesce(c("q.pvalid"), F.lit(False))
    rows = rows.select(*K, "at_key", "peer", "peer_rank", "mid", "spread", "valid", "now", *[F.when(fresh, c(f"q.{n}")).alias(n) for n in ("pk", "pmid", "pspread")])
    instant = Window.partitionBy(*K, "at_key", "peer")
    past = ~c("now")
    own_spread, peer_spread = F.when(past & c("valid"), c("spread")), F.when(past, c("pspread"))
    now = lambda n: F.max(F.when(c("now"), c(n))).over(instant)
    rows = rows.withColumns({"_n": F.count(F.when(past, 1)).over(instant), "_tn": F.count(own_spread).over(instant), "_pn": F.count(peer_spread).over(instant), "_tlim": F.percentile(own_spread, 0.95).over(instant) + 1,
                             "_plim": F.percentile(peer_spread, 0.95).over(instant) + 1, "_now_mid": now("pmid"), "_now_spread": now("pspread")})
    pair = past & c("valid") & (c("spread") <= c("_tlim")) & (c("pspread") <= c("_plim")) & (c("mid") - c("pmid")).isNotNull()
    diff = F.when(pair, c("mid") - c("pmid"))
    per_peer = rows.groupBy(*K, "at_key", "peer").agg(
        F.max("peer_rank").alias("rank"), F.max("_n").alias("n"), F.max("_tn").alias("tn"), F.max("_pn").alias("pn"), F.max("_now_mid").alias("now_mid"), F.max("_now_spread").alias("now_spread"),
        F.max("_plim").alias("plim"), F.count(diff).alias("pairs"), F.percentile(diff, 0.5).alias("basis"), (F.max(F.when(pair, c("pk"))) - F.min(F.when(pair, c("pk")))).alias("span"))
    good = ((c("tn") >= cfg.min_pairs) & (c("pn") >= cfg.min_pairs) & (c("now_mid") > 0) & (c("now_spread") <= c("plim")) & (c("pairs") >= cfg.min_pairs)
            & (c("span") >= cfg.min_pair_span_ms))
    per_point = per_peer.groupBy(*K, "at_key").agg(
        F.max("n").alias("n"), F.max("tn").alias("tn"), F.count_if(good).alias("valid_peer_count"), F.coalesce(F.bool_or(good & (c("rank") <= cfg.gate_peers)), F.lit(False)).alias("gate"),
        F.collect_list(F.when(good, c("now_mid") + c("basis"))).alias("fairs"))
    ticks = frames.groupBy(*K).agg(F.max("tick_size").alias("tick_size"))
    out = per_point.join(ticks, K).withColumns({"_fair": array_median(c("fairs")), "fair_uncertainty_ticks": array_mad_sigma(c("fairs")) / c("tick_size")})
    reason = (F.when(c("n") < cfg.min_pairs, "target_baseline_too_short").when(c("tn") < cfg.min_pairs, "target_spread_baseline_missing")
              .when((c("valid_peer_count") < cfg.min_peers) | ~c("gate"), "insufficient_peers").when(c("fair_uncertainty_ticks") > cfg.uncertainty_limit_ticks, "fair_uncertainty_exceeded").otherwise(""))
    return out.select(*K, "at_key", "valid_peer_count", reason.alias("fair_reason"), F.when(reason == "", c("_fair")).alias("fair_price"), "fair_uncertainty_ticks")

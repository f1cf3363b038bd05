"""Daily target-versus-reference detector and moving averages of the first generation."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def moving_averages(bars: DataFrame, sizes: tuple[int, ...] = (5, 10, 20, 60), column: str = "close") -> DataFrame:
    """Trailing average, difference and percent difference; zero until a full window exists."""
    c = F.col
    order = Window.partitionBy("contract").orderBy("trade_date")
    out = bars
    for n in sizes:
        w = order.rowsBetween(-(n - 1), 0)
        mean = F.when(F.count(column).over(w) >= n, F.avg(column).over(w))
        out = out.withColumn(f"_m{n}", mean)
    for n in sizes:
        m = c(f"_m{n}")
        out = out.withColumns({f"ma_{n}": F.coalesce(m, F.lit(0.0)), f"ma_{n}_diff": F.coalesce(c(column) - m, F.lit(0.0)),
                               f"ma_{n}_diff_pct": F.coalesce((c(column) - m) / m * 100, F.lit(0.0))})
    return out.drop(*[f"_m{n}" for n in sizes])


def reference_differences(bars: DataFrame, references: DataFrame) -> DataFrame:
    """High and low differences of each target day against each of its references; missing days give 0.

    ``references``: (target, reference) pairs, at most a handful per target.
    """
    c = F.col
    target = bars.select(c("contract").alias("target"), "trade_date", c("low").alias("t_low"), c("high").alias("t_high"), c("volume").alias("t_volume"))
    ref = bars.select(c("contract").alias("reference"), "trade_date", c("low").alias("r_low"), c("high").alias("r_high"))
    return target.join(references, "target").join(ref, ["reference", "trade_date"], "left").withColumns({
        "low_diff": F.coalesce(c("t_low") - c("r_low"), F.lit(0.0)), "high_diff": F.coalesce(c("t_high") - c("r_high"), F.lit(0.0))})


def detect(differences: DataFrame, difference_threshold: float = 0.1, window_size: int = 20, min_abs_pct: float = 0.0,
           volume_threshold: float = 0.0, amplitude_ratio: float = 2.0, require_amplitude: bool = False) -> DataFrame:
    """Flagged target days. The trailing means include the current day; the amplitude test is reported, and joins
    the decision only when ``require_amplitude`` is set."""
    c = F.col
    w = Window.partitionBy("target", "reference").orderBy("trade_date").rowsBetween(-(window_size - 1), 0)
    x = differences.withColumns({"high_mean": F.avg("high_diff").over(w), "low_mean": F.avg("low_diff").over(w),
                                 "amplitude": c("t_high") - c("t_low")}).withColumn("amplitude_mean", F.avg("amplitude").over(w))
    far = lambda d, m: F.coalesce((c(m) != 0) & (F.abs((c(d) - c(m)) / F.nullif(c(m), F.lit(0.0))) > difference_threshold)
                                  & (F.abs(c(d)) > min_abs_pct / 100 * c("t_low")), F.lit(False))
    # The texts of the reasons.
    number = lambda v: F.format_string("%.2f", F.round(v + 1e-9, 2))
    said = lambda side, d, m: F.concat(F.lit("与"), c("reference"), F.lit(f"{side}差异异常 (比率: "), number(F.abs((c(d) - c(m)) / F.nullif(c(m), F.lit(0.0))) * 100), F.lit("%, 绝对差异: "), number(F.abs(c(d))), F.lit(")"))
    per_day = x.withColumns({"_high": far("high_diff", "high_mean"), "_low": far("low_diff", "low_mean")}).groupBy("target", "trade_date").agg(
        F.count_if(c("_high")).alias("high_hits"), F.count_if(c("_low")).alias("low_hits"),
        F.array_sort(F.flatten(F.collect_list(F.array_compact(F.array(F.when(c("_high"), said("最高值", "high_diff", "high_mean")), F.when(c("_low"), said("最低值", "low_diff", "low_mean"))))))).alias("_words"),
        F.max("amplitude").alias("_amplitude"), F.max("amplitude_mean").alias("_usual"),
        F.max("t_volume").alias("volume"), F.bool_or((c("amplitude_mean") > 0) & (c("amplitude") / c("amplitude_mean") > amplitude_ratio)).alias("amplitude_flag"))
    flag = ((c("high_hits") + c("low_hits")) > 0) & (c("volume") > volume_threshold)
    wide = F.when(c("amplitude_flag"), F.concat(F.lit("振幅异常 (当前振幅: "), number(c("_amplitude")), F.lit(", 历史平均: "), number(c("_usual")), F.lit(", 倍数: "), number(c("_amplitude") / c("_usual")), F.lit(")")))
    per_day = per_day.withColumn("is_flagged", flag & c("amplitude_flag") if require_amplitude else flag)
    return per_day.withColumn("anomaly_reasons", F.when(c("is_flagged"), F.concat_ws("; ", F.array_join("_words", "; "), wide))).drop("_words", "_amplitude", "_usual")

"""Streaming forms of the study: events by inactivity gap, tumbling counters, incremental deltas."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Size of the quantile sketches, and the share of ranks that their quantiles stay within with 99 % confidence.
SKETCH_K, RANK_ERROR = 400, 0.01


def deviation_events(candidates: DataFrame, gap: str = "5 seconds", lateness: str = "10 seconds") -> DataFrame:
    """Candidates (contract, side, ts, deviation) merged into events; a gap equal to ``gap`` still merges."""
    size = F.abs(F.col("deviation"))
    return candidates.withWatermark("ts", lateness).groupBy("contract", "side", F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("candidate_rows"), F.max(size).alias("abs_deviation"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts")).drop("w")


def window_counters(rows: DataFrame, width: str = "1 minute", lateness: str = "10 seconds", accuracy: int = SKETCH_K) -> DataFrame:
    """Row counts and a quantile sketch of the absolute deviation per contract and tumbling window.

    Sketches merge, so windows roll up to any longer span later (``rolled_up``) without their rows.
    """
    return rows.withWatermark("ts", lateness).groupBy("contract", F.window("ts", width).alias("w")).agg(
        F.count(F.lit(1)).alias("rows"), F.count("deviation").alias("deviation_records"), F.max(F.abs("deviation")).alias("abs_max"),
        F.kll_sketch_agg_double(F.abs("deviation"), accuracy).alias("sketch")).select(
        "contract", F.col("w.start").alias("window_start"), "rows", "deviation_records", "abs_max", "sketch")


def rolled_up(counters: DataFrame, keys: list[str], quantiles: dict[str, float], accuracy: int = SKETCH_K) -> DataFrame:
    """Counts, maximum and quantiles per ``keys`` from window counters; a quantile's rank is within RANK_ERROR of the one asked for."""
    merged = counters.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.sum("deviation_records").alias("deviation_records"), F.max("abs_max").alias("abs_max"),
                                         F.kll_merge_agg_double("sketch", accuracy).alias("sketch"))
    picked = [F.when(F.col("deviation_records") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(q).cast("double"))).alias(n) for n, q in quantiles.items()]
    return merged.select(*keys, "rows", "deviation_records", "abs_max", *picked)


class DeltaState(StatefulProcessor):
    """Snapshots of one contract in event-time order: volume deltas, gaps and segments.

    Rows wait until the watermark has passed them, so those that come in any order within the lateness are taken in theirs,
    as one array each time. What is kept is the last row and the rows that wait; a contract that is silent for longer
    than the gap keeps nothing, for its next row starts a segment in any case.
    """

    #: The rows that wait stand in one value, as 64-bit integers, beside the key's timer: one call reads or writes both.
    WAITING = "timer bigint, rows binary"

    def __init__(self, gap_ms: int = 300_000):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts_ms bigint, volume bigint, segment_start bigint")
        self.waiting = handle.getValueState("waiting", self.WAITING)

    def _held(self) -> tuple[int | None, np.ndarray]:
        """The key's timer and its waiting rows: ts_ms, snapshot_seq, volume."""
        timer, rows = self.waiting.get() or (None, b"")
        return timer, np.frombuffer(bytes(rows), np.int64).reshape(-1, 3)

    def _taken(self, key, rows: np.ndarray, watermark: int, timer: int | None) -> Iterator[pd.DataFrame]:
        """Results of the rows up to the watermark; the others wait, and one timer is set for what comes next. ``timer`` is still set."""
        rows = rows[np.lexsort(rows.T[::-1])]
        ready = int(np.searchsorted(rows[:, 0], watermark, side="right"))
        known = self.last.get()
        if ready:
            at, seq, volume = rows[:ready].T
            before_at, before_volume = np.r_[known[0] if known else at[0], at[:-1]], np.r_[known[1] if known else volume[0], volume[:-1]]
            fresh = (at - before_at > self.gap_ms) | (volume < before_volume)
            fresh[0] |= known is None
            begins = np.where(fresh, at, 0)
            if known and not fresh[0]:
                begins[0] = known[2]
            segment = np.maximum.accumulate(begins)
            known = (int(at[-1]), int(volume[-1]), int(segment[-1]))
            self.last.update(known)
            inside = lambda x: pd.arrays.IntegerArray(x, fresh.copy())
            yield pd.DataFrame({"contract": key[0], "snapshot_seq": seq, "delta_volume": inside(volume - before_volume), "gap_ms": inside(at - before_at), "segment_start": segment})
        wanted = int(rows[-1, 0]) if len(rows) > ready else known[0] + self.gap_ms + 1
        self.waiting.update((wanted, rows[ready:].tobytes()))
        if timer != wanted:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(wanted)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timer, held = self._held()
        new = [np.stack([part[c].to_numpy(np.int64) for c in ("ts_ms", "snapshot_seq", "volume")], axis=1) for part in rows]
        yield from self._taken(key, np.concatenate([held, *new]), timerValues.getCurrentWatermarkInMs(), timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        timer, held = self._held()
        if len(held):
            yield from self._taken(key, held, watermark, None)
            return
        known = self.last.get()
        if known and known[0] + self.gap_ms < watermark:
            self.last.clear()
            self.waiting.clear()

    def close(self) -> None:
        pass


def incremental_deltas(rows: DataFrame, gap_ms: int = 300_000, lateness: str = "10 seconds") -> DataFrame:
    """contract, snapshot_seq, delta_volume, gap_ms, segment_start of rows with contract, ts, snapshot_seq, Volume.

    Needs the RocksDB state store. Rows later than ``lateness`` are dropped by the watermark; volumes that fall and gaps
    beyond ``gap_ms`` start a segment, named by the time of its first row, which has neither delta nor gap.
    """
    timed = rows.withWatermark("ts", lateness).select("contract", "ts", F.unix_millis("ts").alias("ts_ms"), "snapshot_seq", F.col("Volume").alias("volume"))
    return timed.groupBy("contract").transformWithStateInPandas(
        DeltaState(gap_ms), "contract string, snapshot_seq bigint, delta_volume bigint, gap_ms bigint, segment_start bigint", "Append", "EventTime")

"""Parameters of the analysis chains. Defaults are the fixed values of the domain model."""
from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DailyConfig:
    lookback_days: int = 45
    rolling_rows: int = 20
    min_samples: int = 10
    active_limit: int = 5
    edge_days: int = 10


@dataclass(frozen=True)
class TickConfig:
    max_gap_ms: int = 3_000
    confirm_ms: int = 1_000
    daily_tolerance_ticks: float = 3.0
    same_day_tolerance: float = 0.005
    open_guard_seconds: int = 60
    min_last_ticks: float = 20.0
    min_vwap_ticks: float = 20.0
    min_depth_bps: float = 5.0
    noise_k: float = 8.0
    uncertainty_limit_ticks: float = 10.0
    baseline_ms: int = 300_000
    exclude_recent_ms: int = 10_000
    reference_age_ms: int = 3_000
    min_peers: int = 2
    peer_limit: int = 5
    gate_peers: int = 3
    min_pairs: int = 20
    min_pair_span_ms: int = 60_000
    noise_min_samples: int = 100
    noise_min_span_ms: int = 120_000
    limit_buffer_ticks: float = 2.0
    onset_ms: int = 3_000
    onset_min_ticks: float = 8.0
    onset_k: float = 5.0
    merge_ms: int = 10_000
    recovery_short_ms: int = 3_000
    recovery_ms: int = 10_000
    min_pool: int = 4
    replay_ms: int = 10_000
    # Width of the time chunks that bound the size of one task; not part of the semantics.
    chunk_ms: int = 600_000
    # The same where a row's window reaches back minutes: wider chunks repeat fewer rows.
    reference_chunk_ms: int = 3_600_000


@dataclass(frozen=True)
class StudyConfig:
    thresholds: tuple[float, ...] = (0.0025, 0.005, 0.0075, 0.01, 0.0125, 0.015, 0.02, 0.025, 0.03)
    horizons: tuple[int, ...] = (1, 3, 5)
    merge_ms: int = 5_000
    segment_gap_ms: int = 300_000
    delay_tolerance_ms: int = 1_000
    excursion_seconds: int = 5
    window_before_ms: int = 30_000
    chunk_ms: int = 600_000
    # Rows of a contract-day that one task orders at once.
    chunk_rows: int = 50_000


@dataclass(frozen=True)
class WhatIfConfig:
    order_ages_seconds: tuple[float, ...] = (5.0, 20.0)
    entry_distances_bps: tuple[float, ...] = (10.0, 25.0)
    hedge_delays_seconds: tuple[float, ...] = (1.0, 3.0)
    exit_delays_seconds: tuple[float, ...] = (2.0, 8.0)
    fill_model: str = "visible_touch"
    fill_window_ms: int = 3_000
    quote_age_ms: int = 3_000
    hedge_reference_index: int = 0
    slippage_ticks: float = 1.0
    target_lots: int = 1
    hedge_lots: int = 1
    commission_per_lot: float = 3.0
    margin_rate: float = 0.1
    # (commodity, value) where a commodity has costs of its own.
    commissions: tuple[tuple[str, float], ...] = ()
    margin_rates: tuple[tuple[str, float], ...] = ()
    account_equity: float = 100_000.0
    max_margin_ratio: float = 0.5
    max_single_trade_loss: float = 60.0

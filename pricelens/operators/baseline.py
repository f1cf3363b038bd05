"""Trailing-window reference prices and noise statistics of a commodity's contracts inside one time chunk.

The limit used to filter a window (95th percentile of the spread, plus one tick) comes from the same window, and
deviations are taken from the window's own median, so no built-in frame aggregate expresses it. Spark partitions
and shuffles the rows by (trade day, commodity, chunk); the helpers below see one such bounded group, in which each
contract's rows lie once, as target and as peer of others, and work on blocks of windows as matrices.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view

from ..config import TickConfig

#: Rows and cells of a block of windows; rows in time order have windows of like sizes, so few cells stay empty.
BLOCK_ROWS, MATRIX_CELLS = 512, 2_000_000


def window_blocks(keys: np.ndarray, rows: np.ndarray, back: int, stop: int) -> Iterator[tuple]:
    """(rows, index matrix, membership mask) of the windows [key - back, key - stop], a bounded block at a time."""
    lo = np.searchsorted(keys, keys[rows] - back, side="left")
    hi = np.searchsorted(keys, keys[rows] - stop, side="right")
    width = int((hi - lo).max()) if len(rows) else 0
    if width <= 0:
        return
    step = max(1, MATRIX_CELLS // width)
    for i in range(0, len(rows), step):
        idx = lo[i:i + step, None] + np.arange(width)
        inside = idx < hi[i:i + step, None]
        yield slice(i, i + step), np.minimum(idx, len(keys) - 1), inside


def quantile_rows(values: np.ndarray, mask: np.ndarray, q: float) -> tuple[np.ndarray, np.ndarray]:
    """Row-wise masked counts and linear quantiles."""
    counts = mask.sum(axis=1)
    ordered = np.sort(np.where(mask, values, np.inf), axis=1)
    return counts, quantiles_of_sorted(ordered, counts, q)


def window_bounds(keys: np.ndarray, rows: np.ndarray, back: int, stop: int) -> Iterator[tuple]:
    """(rows, first positions, end positions) of the windows [key - back, key - stop], a bounded block at a time."""
    lo = np.searchsorted(keys, keys[rows] - back, side="left")
    hi = np.maximum(np.searchsorted(keys, keys[rows] - stop, side="right"), lo)
    i = 0
    while i < len(rows):
        n = min(BLOCK_ROWS, max(1, MATRIX_CELLS // max(1, int((hi - lo)[i:i + BLOCK_ROWS].max()))))
        yield slice(i, i + n), lo[i:i + n], hi[i:i + n]
        i += n


def window_values(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A row of values for each window, infinite beyond its end."""
    size = hi - lo
    width = max(1, int(size.max()))
    short = int(lo.max()) + width - len(values)
    out = sliding_window_view(np.append(values, np.full(short, np.inf)) if short > 0 else values, width)[lo]
    np.copyto(out, np.inf, where=np.arange(width) >= size[:, None])
    return out


def counts_in(mask: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    before = np.append(0, np.cumsum(mask))
    return before[hi] - before[lo]


def quantiles_of_sorted(ordered: np.ndarray, counts: np.ndarray, q: float) -> np.ndarray:
    """Row-wise linear quantiles of the leading ``counts`` values."""
    pos = np.maximum(counts - 1, 0) * q
    lo, hi = np.floor(pos).astype(int), np.ceil(pos).astype(int)
    row = np.arange(len(counts))
    a, b = ordered[row, lo], ordered[row, hi]
    with np.errstate(invalid="ignore"):
        out = a + (b - a) * (pos - lo)
    return np.where(counts > 0, np.where(lo == hi, a, out), np.nan)


def mads_of_sorted(ordered: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row-wise medians and 1.4826 x median absolute deviations; ``ordered`` is overwritten."""
    med = quantiles_of_sorted(ordered, counts, 0.5)
    np.abs(np.subtract(ordered, np.where(counts > 0, med, 0.0)[:, None], out=ordered), out=ordered)
    ordered.sort(axis=1)
    return med, 1.4826 * quantiles_of_sorted(ordered, counts, 0.5)


def mad_rows(values: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row-wise counts, medians and 1.4826 x median absolute deviations."""
    counts = mask.sum(axis=1)
    return counts, *mads_of_sorted(np.sort(np.where(mask, values, np.inf), axis=1), counts)


def spread_limits(values: np.ndarray, known: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Of each window: known values, their 95th percentile plus one tick, and whether any window has a known value beyond its own."""
    ordered = window_values(np.where(known, values, np.inf), lo, hi)
    ordered.sort(axis=1)
    counts = counts_in(known, lo, hi)
    limit = quantiles_of_sorted(ordered, counts, 0.95) + 1
    most = ordered[np.arange(len(counts)), np.maximum(counts - 1, 0)]
    return counts, limit, bool((most > limit)[counts > 0].any())


def floats(table: pa.Table, name: str) -> np.ndarray:
    return table[name].cast(pa.float64()).to_numpy()


def align_peers(whole: dict, spans: dict[str, tuple[int, int]], listed: dict[str, list[str]], age: int) -> list[dict]:
    """Per rank, at each target row: its peer's latest quote, kept only when fresh and valid. A target has ``listed`` peers by rank."""
    n, keys = len(whole["market_time_key"]), whole["market_time_key"]
    numbers = {code: i for i, code in enumerate(spans)}
    out = [{"code": np.zeros(n, np.int64), "ok": np.zeros(n, bool), "key": np.full(n, -1), "mid": np.full(n, np.nan), "spread": np.full(n, np.nan)}
           for _ in range(max(map(len, listed.values()), default=0))]
    for code, peers in listed.items():
        mine = slice(*spans[code])
        for slot, peer in zip(out, peers):
            if peer not in spans:
                continue
            lo, hi = spans[peer]
            at = np.searchsorted(keys[lo:hi], keys[mine], side="right") - 1 + lo
            safe = np.maximum(at, lo)
            ok = (at >= lo) & (keys[mine] - keys[safe] <= age) & whole["quote_valid"][safe]
            slot["code"][mine], slot["ok"][mine], slot["key"][mine] = numbers[peer], ok, np.where(ok, keys[safe], -1)
            slot["mid"][mine], slot["spread"][mine] = np.where(ok, whole["mid_price"][safe], np.nan), np.where(ok, whole["spread_ticks"][safe], np.nan)
    return out


def fair_prices(keys, mid, spread, valid, peers: list[dict], rows, cfg: TickConfig):
    """Fair price per peer (mid + median basis) at ``rows``; NaN where the peer does not qualify."""
    n, p = len(rows), len(peers)
    fair, basis = np.full((n, p), np.nan), np.full((n, p), np.nan)
    gated = np.zeros(n, dtype=bool)
    quoted = valid & np.isfinite(spread)
    for peer in peers:
        peer["quoted"] = peer["ok"] & np.isfinite(peer["spread"])
        peer["diff"] = mid - peer["mid"]
        peer["pair"] = quoted & peer["quoted"] & np.isfinite(peer["diff"])
        peer["pairs_at"] = np.append(np.flatnonzero(peer["pair"]), len(keys) - 1)
    for block, lo, hi in window_bounds(keys, rows, cfg.baseline_ms, cfg.exclude_recent_ms):
        count, limit, beyond = spread_limits(spread, quoted, lo, hi)
        enough = count >= cfg.min_pairs
        gated[block] = enough
        here = rows[block]
        wide = window_values(spread, lo, hi) > limit[:, None] if beyond else None
        for j, peer in enumerate(peers):
            pcount, plimit, peer_beyond = spread_limits(peer["spread"], peer["quoted"], lo, hi)
            now = peer["ok"][here] & (peer["mid"][here] > 0) & (peer["spread"][here] <= plimit)
            ordered = window_values(np.where(peer["pair"], peer["diff"], np.inf), lo, hi)
            if beyond or peer_beyond:
                # Pairs whose spread is beyond a limit of the window are none.
                if beyond:
                    ordered[wide] = np.inf
                if peer_beyond:
                    ordered[window_values(peer["spread"], lo, hi) > plimit[:, None]] = np.inf
                pairs = np.isfinite(ordered)
                k = pairs.sum(axis=1)
                first, final = lo + pairs.argmax(axis=1), lo + pairs.shape[1] - 1 - pairs[:, ::-1].argmax(axis=1)
            else:
                k = counts_in(peer["pair"], lo, hi)
                at = np.searchsorted(peer["pairs_at"][:-1], lo)
                first, final = peer["pairs_at"][at], peer["pairs_at"][at + np.maximum(k - 1, 0)]
            ordered.sort(axis=1)
            med = quantiles_of_sorted(ordered, k, 0.5)
            # The peer's keys rise with the target's, so the window's first and last pair span it.
            span = peer["key"][np.minimum(final, len(keys) - 1)] - peer["key"][np.minimum(first, len(keys) - 1)]
            good = enough & (pcount >= cfg.min_pairs) & now & (k >= cfg.min_pairs) & (span >= cfg.min_pair_span_ms)
            fair[block, j] = np.where(good, peer["mid"][here] + med, np.nan)
            basis[block, j] = np.where(good, med, np.nan)
    return fair, basis, gated


COLUMNS = ("mid_price", "spread_ticks", "tick_size", "LastPrice", "interval_vwap", "delta_volume")


def reference_metrics(table: pa.Table, cfg: TickConfig) -> pa.Table:
    """The chunk's own rows of a commodity's targets with fair-price and noise columns appended.

    ``_peers`` has a target's peers by rank; a row without it is there for others only.
    """
    t = table.sort_by([("contract", "ascending"), ("market_time_key", "ascending")])
    whole = {c: floats(t, c) for c in COLUMNS} | {"market_time_key": t["market_time_key"].to_numpy(), "quote_valid": t["quote_valid"].to_numpy().astype(bool),
                                                    "_core": t["_core"].to_numpy().astype(bool)}
    codes = t["contract"].combine_chunks().dictionary_encode()
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    at = codes.indices.to_numpy()
    cuts = np.flatnonzero(np.diff(at, prepend=-1))
    spans = {codes.dictionary[int(at[lo])].as_py(): (int(lo), int(hi)) for lo, hi in zip(cuts, [*cuts[1:], len(at)])}
    start = t["_chunk"][0].as_py() * cfg.reference_chunk_ms
    listed = {code: t["_peers"][lo].as_py() for code, (lo, hi) in spans.items() if whole["_core"][lo:hi].any()}
    listed = {code: peers for code, peers in listed.items() if peers is not None}
    core, columns = target_metrics(whole, spans, listed, start, cfg)
    out = t.drop_columns(["_chunk", "_core", "_peers"]).take(pa.array(core))
    for name, column in columns.items():
        out = out.append_column(name, column)
    return out


def target_metrics(t: dict, spans: dict[str, tuple[int, int]], listed: dict[str, list[str]], start: int, cfg: TickConfig) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Positions of the targets' own rows and their new columns; contracts lie one after another and are worked on together."""
    clock, mid, spread, valid = t["market_time_key"], t["mid_price"], t["spread_ticks"], t["quote_valid"]
    sizes = [hi - lo for lo, hi in spans.values()]
    tick = np.repeat([t["tick_size"][lo] for lo, _ in spans.values()], sizes)
    target = np.repeat([code in listed for code in spans], sizes)
    # Far enough apart that no window reaches the contract before.
    keys = clock + np.repeat(np.arange(len(sizes)) << 40, sizes)
    peers = align_peers(t, spans, listed, cfg.reference_age_ms)
    needed = np.flatnonzero(target & (clock >= start - cfg.baseline_ms))
    place = np.zeros(len(keys), np.int64)
    place[needed] = np.arange(len(needed))
    fair_i, basis, gated = fair_prices(keys, mid, spread, valid, peers, needed, cfg)
    have = np.isfinite(fair_i)
    with np.errstate(invalid="ignore"):
        count, fair, sigma = mad_rows(fair_i, have) if peers else (np.zeros(len(needed), int),) + (np.full(len(needed), np.nan),) * 2
    gate = have[:, :cfg.gate_peers].any(axis=1)
    priced = (count >= cfg.min_peers) & gate
    uncertainty = np.where(priced, sigma / tick[needed], np.nan)
    reliable_row = priced & (uncertainty <= cfg.uncertainty_limit_ticks)
    fair_all = np.full(len(keys), np.nan)
    fair_all[needed] = np.where(priced, fair, np.nan)
    reliable = np.zeros(len(keys), bool)
    reliable[needed] = reliable_row

    core = np.flatnonzero(target & t["_core"])
    in_needed = place[core]
    last, vwap, dv = t["LastPrice"], t["interval_vwap"], t["delta_volume"]
    base = (dv > 0) & reliable & (fair_all > 0)
    ok_last, ok_vwap = base & (last > 0), base & (vwap > 0)
    with np.errstate(invalid="ignore"):
        last_depth, vwap_depth = (fair_all - last) / tick, (fair_all - vwap) / tick
        depth = np.fmax(np.where(ok_last, last_depth, -np.inf), np.where(ok_vwap, vwap_depth, -np.inf))
    m = len(core)
    stats = {name: np.full(m, np.nan) for name in ("last_med", "last_sig", "vwap_med", "vwap_sig", "depth_sig")}
    n_last, span = np.zeros(m, np.int64), np.zeros(m)
    depths = [(np.where(ok, x, np.inf), ok) for x, ok in ((last_depth, ok_last), (vwap_depth, ok_vwap), (depth, ok_last | ok_vwap))]
    for block, lo, hi in window_bounds(keys, core, cfg.baseline_ms, cfg.exclude_recent_ms):
        found = []
        for x, ok in depths:
            ordered, counts = window_values(x, lo, hi), counts_in(ok, lo, hi)
            ordered.sort(axis=1)
            found.append((counts, *mads_of_sorted(ordered, counts)))
        n_last[block], stats["last_med"][block], stats["last_sig"][block] = found[0]
        nv, vm, vs = found[1]
        stats["vwap_med"][block], stats["vwap_sig"][block] = np.where(nv > 0, vm, 0.0), np.where(nv > 0, vs, 0.0)
        stats["depth_sig"][block] = found[2][2]
        span[block] = np.where(hi > lo, keys[np.maximum(hi - 1, 0)] - keys[np.minimum(lo, len(keys) - 1)], 0) / 1000.0
    noisy = (n_last >= cfg.noise_min_samples) & (span >= cfg.noise_min_span_ms / 1000.0)
    chosen = have[in_needed]
    named = np.stack([p["code"] for p in peers], axis=1)[core][chosen] if peers else np.zeros(0, np.int64)
    cuts = pa.array(np.append(0, chosen.sum(axis=1).cumsum()), pa.int32())
    number = lambda x: pa.array(x, pa.float64(), from_pandas=True)
    appended = {
        "fair_price": number(fair_all[core]), "fair_uncertainty_ticks": number(uncertainty[in_needed]),
        "fair_price_reliable": pa.array(reliable[core]), "valid_peer_count": pa.array(chosen.sum(axis=1), pa.int64()),
        "valid_peers": pa.ListArray.from_arrays(cuts, pa.array(list(spans), pa.string()).take(pa.array(named))),
        "peer_bases": pa.ListArray.from_arrays(cuts, pa.array(basis[in_needed][chosen], pa.float64())),
        "fair_gate_open": pa.array(gated[in_needed]), "noise_sample_count": pa.array(n_last, pa.int64()),
        "noise_time_span_seconds": number(span), "noise_history_reliable": pa.array(noisy),
    }
    for name, column in (("last_med", "last_noise_median"), ("last_sig", "last_noise_robust_sigma"), ("vwap_med", "vwap_noise_median"),
                         ("vwap_sig", "vwap_noise_robust_sigma"), ("depth_sig", "execution_depth_robust_sigma")):
        appended[column] = number(np.where(noisy, stats[name], np.nan))
    return core, appended

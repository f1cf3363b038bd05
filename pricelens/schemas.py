"""Fixed schemas and header maps of the files read and written."""
from __future__ import annotations

DAILY_FILE = ("code string, date string, pre_close double, pre_settle double, open double, high double, low double, "
              "close double, vol double")
SNAPSHOT_FILE = (
    "TradingDay string, InstrumentID string, UpdateTime string, UpdateMillisec int, LastPrice double, Volume bigint, "
    "BidPrice1 double, BidVolume1 bigint, AskPrice1 double, AskVolume1 bigint, AveragePrice double, Turnover double, "
    "OpenInterest double, UpperLimitPrice double, LowerLimitPrice double")

# Event table headers, in file order.
EVENT_HEADERS = {
    "detector_version": "检测器版本", "parameter_profile": "参数档", "validation_status": "验证状态", "event_id": "事件编号",
    "display_trade_date": "交易日", "event_anchor_time": "事件时间", "interval_confirmation_end_time": "区间均价确认结束时间",
    "commodity": "品种", "contract": "合约", "event_start_key": "事件开始序号", "event_anchor_start_key": "事件锚点开始序号",
    "event_anchor_end_key": "事件锚点结束序号", "event_end_key": "事件结束序号", "event_direction": "异常方向",
    "trigger_reasons": "触发原因", "fair_price": "合理价", "fair_uncertainty_ticks": "合理价不确定性_跳",
    "valid_peer_count": "有效参考合约数", "peer_contracts": "参考合约列表", "baseline_min_samples": "价差基线最少样本数",
    "noise_sample_count": "噪声样本数", "noise_time_span_seconds": "噪声覆盖秒数", "last_price_anchor": "最新成交价",
    "interval_vwap_anchor": "区间成交均价", "last_down_ticks": "末笔向下偏离_跳", "last_down_bps": "末笔向下偏离_基点",
    "last_up_ticks": "末笔向上偏离_跳", "last_up_bps": "末笔向上偏离_基点", "vwap_down_ticks": "区间均价向下偏离_跳",
    "vwap_down_bps": "区间均价向下偏离_基点", "vwap_up_ticks": "区间均价向上偏离_跳", "vwap_up_bps": "区间均价向上偏离_基点",
    "combined_vwap_1s": "一秒合并成交均价", "combined_vwap_down_ticks": "一秒合并均价向下偏离_跳",
    "combined_vwap_up_ticks": "一秒合并均价向上偏离_跳", "last_threshold_ticks": "末笔触发阈值_跳",
    "vwap_threshold_ticks": "区间均价触发阈值_跳", "onset_ticks": "突发偏离_跳", "event_depth_ticks": "事件确认深度_跳",
    "event_depth_bps": "事件确认深度_基点", "depth_source": "确认深度来源", "interval_delta_volume": "区间增量成交量",
    "interval_delta_turnover": "区间增量成交额", "event_volume": "事件成交量", "notional_shortfall": "名义成交额缺口",
    "notional_excess": "名义成交额超额", "recovery_label": "回归标签", "visible_recovered_seconds": "可见末笔恢复确认秒数",
    "interval_recovered_seconds": "区间均价恢复确认秒数", "quote_recovered_seconds": "买一恢复确认秒数",
    "ask_recovered_seconds": "卖一恢复确认秒数", "data_quality_flags": "数据质量标记",
}

# Vendor column names accepted for daily bars.
BAR_ALIASES = {
    "date": ("date", "日期", "trade_date", "time"), "open": ("open", "开盘", "开盘价"), "high": ("high", "最高", "最高价"),
    "low": ("low", "最低", "最低价"), "close": ("close", "收盘", "收盘价"), "volume": ("volume", "vol", "成交量"),
}

# Columns that each use of an event table asks for.
EVENT_REQUIRED = {
    "any": ("交易日", "品种", "合约"),
    "replay": ("交易日", "品种", "合约", "事件锚点结束序号"),
    "shapes": ("品种", "合约", "交易日", "事件编号", "突发偏离_跳", "事件确认深度_跳", "事件确认深度_基点", "确认深度来源", "回归标签", "可见末笔恢复确认秒数", "区间均价恢复确认秒数", "买一恢复确认秒数",
               "有效参考合约数", "合理价不确定性_跳", "数据质量标记", "日线边界判定", "日线边界规则或数据版本", "日线边界清单SHA256", "源事件CSV SHA256"),
}
# Columns that bind a table to its boundary list; the last two are SHA-256 digests.
EVENT_BINDING = ("日线边界规则或数据版本", "日线边界清单SHA256", "源事件CSV SHA256")

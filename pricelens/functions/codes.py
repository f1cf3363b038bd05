"""Contract codes, file names, directions and labels."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# File-name words that mark a continuous (non-deliverable) series.
CONTINUOUS_WORDS = ("主力连续", "当月连续", "下月连续", "当季连续", "下季连续", "隔季连续")

# Sample status labels shown to users.
STATUS_LABELS = {
    "valid": "有效样本",
    "invalid_basic_data": "基础数据无效",
    "invalid_low_liquidity": "低流动性无效",
    "invalid_lifecycle_edge": "生命周期边界无效",
    "invalid_insufficient_history": "历史样本不足",
    "invalid_insufficient_peer": "对照不足",
}


def code_body(code: Column) -> Column:
    return F.upper(F.split(code, r"\.")[0])


def commodity_of(body: Column) -> Column:
    letters = F.regexp_extract(body, r"^([A-Z]+)", 1)
    return F.when(letters != "", letters)


def is_contract_code(body: Column) -> Column:
    return body.rlike(r"^[A-Z]+\d{3,4}$")


def delivery_month(contract: Column) -> Column:
    digits = F.regexp_extract(contract, r"(\d{3,4})$", 1)
    return F.when(digits != "", digits)


def normalize_contract(code: Column) -> Column:
    """Upper case; a three-digit month gets the decade prefix 2."""
    up = F.upper(code)
    return F.when(
        up.rlike(r"^[A-Z]+\d{3}$"),
        F.concat(F.regexp_extract(up, r"^([A-Z]+)", 1), F.lit("2"), F.regexp_extract(up, r"(\d{3})$", 1)),
    ).otherwise(up)


def month_index(contract: Column) -> Column:
    """Months since an arbitrary origin from a four-digit yymm suffix; only differences are meaningful."""
    digits = F.regexp_extract(contract, r"(\d{4})$", 1)
    yy, mm = F.substring(digits, 1, 2).try_cast("int"), F.substring(digits, 3, 2).try_cast("int")
    return F.when((digits != "") & mm.between(1, 12), yy * 12 + mm - 1)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_trade_date(name: Column) -> Column:
    date = F.regexp_extract(name, r"(?i)_(\d{8})\.csv$", 1)
    return F.when(date != "", date)


def file_contract_info(file_name: Column, instrument_id: Column | None = None) -> Column:
    """Struct (commodity, contract, parse_status, trade_date) from a snapshot file name."""
    name = base_name(file_name)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    name_part = F.regexp_replace(stem, r"_[^_]*$", "")
    given = F.lit(None).cast("string") if instrument_id is None else F.nullif(instrument_id, F.lit(""))
    candidate = F.trim(F.coalesce(given, name_part))
    continuous = F.lit(False)
    for word in CONTINUOUS_WORDS:
        continuous = continuous | name_part.contains(word)
    ok = candidate.rlike(r"^[A-Za-z]+\d{3,4}$") & ~continuous
    return F.struct(
        F.when(ok, F.upper(F.regexp_extract(candidate, r"^([A-Za-z]+)", 1))).alias("commodity"),
        F.when(ok, F.upper(candidate)).alias("contract"),
        F.when(continuous, "continuous_alias").when(ok, "ok").otherwise("unknown_format").alias("parse_status"),
        file_trade_date(name).alias("trade_date"),
    )


def direction_down_up(value: Column) -> Column:
    """Blank or missing means down; other words are kept for validation."""
    return F.coalesce(F.nullif(F.lower(F.trim(value)), F.lit("")), F.lit("down"))


def direction_buy_sell(value: Column) -> Column:
    word = F.lower(F.trim(value))
    return F.when(word.isin("buy", "down", "long"), "BUY").when(word.isin("sell", "up", "short"), "SELL")


def translate(value: Column, labels: dict[str, str]) -> Column:
    """Label lookup that leaves unknown words unchanged."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), value)

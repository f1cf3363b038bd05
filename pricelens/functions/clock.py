"""Clock strings, trading-cycle keys and sessions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

DAY_MS = 86_400_000
CYCLE_START_MS = 75_600_000  # 21:00:00

# Day sessions, the night session and the session opens.
DAY_SESSIONS = (("09:00:00", "10:15:00"), ("10:30:00", "11:30:00"), ("13:30:00", "15:00:00"))
NIGHT_SESSION = ("21:00:00", "02:30:00")
SESSION_OPENS = ("09:00:00", "10:30:00", "13:30:00", "21:00:00")


def with_clock(df: DataFrame, out: str, text: Column, millis: Column | None = None) -> DataFrame:
    """Adds milliseconds since midnight of ``H:MM:SS[.fff]`` plus ``millis``; null when either part is invalid.

    The pieces are staged as columns so that the string is split once per row.
    """
    t = F.trim(text)
    p = lambda i: F.get("_pieces", F.lit(i))
    staged = df.withColumns({
        "_pieces": F.split(t, ":"), "_shaped": t.rlike(r"^\d{1,2}:\d{2}:\d{2}(\.\d+)?$"),
    }).withColumns({
        "_h": p(0).try_cast("int"), "_m": p(1).try_cast("int"), "_s": F.substring(p(2), 1, 2).try_cast("int"),
        "_f": F.rpad(F.substring(p(2), 4, 3), 3, "0").try_cast("int"),
    })
    ok = F.col("_shaped") & (F.col("_h") <= 23) & (F.col("_m") <= 59) & (F.col("_s") <= 59)
    clock = ((F.col("_h") * 3600 + F.col("_m") * 60 + F.col("_s")) * 1000 + F.coalesce("_f", F.lit(0))).cast("bigint")
    if millis is not None:
        extra = F.coalesce(millis, F.lit(0))
        ok, clock = ok & (extra >= 0) & (extra < 1000), clock + extra.cast("bigint")
    return staged.withColumn(out, F.when(ok, clock)).drop("_pieces", "_shaped", "_h", "_m", "_s", "_f")


def cycle_key(clock_ms: Column) -> Column:
    """Milliseconds inside the trading cycle that starts at 21:00."""
    return F.when(clock_ms >= CYCLE_START_MS, clock_ms - CYCLE_START_MS).otherwise(clock_ms + (DAY_MS - CYCLE_START_MS))


def display_time(text: Column, millis: Column) -> Column:
    return F.concat(F.coalesce(text, F.lit("")), F.lit("."), F.lpad(F.coalesce(millis, F.lit(0)).cast("int").cast("string"), 3, "0"))


def is_night(text: Column) -> Column:
    return (text >= NIGHT_SESSION[0]) | (text < NIGHT_SESSION[1])


def session_state(text: Column) -> Column:
    """The order of the arms matters: trading sessions first, then the named breaks."""
    day = F.lit(False)
    for start, end in DAY_SESSIONS:
        day = day | ((text >= start) & (text < end))
    inside = lambda a, b: (text >= a) & (text < b)
    return (
        F.when(day, "continuous_trading").when(is_night(text), "night_trading")
        .when(inside("08:55:00", "09:00:00") | inside("20:55:00", "21:00:00"), "pre_open_snapshot")
        .when(text < "09:00:00", "closed_break").when(inside("10:15:00", "10:30:00"), "intermission")
        .when(inside("11:30:00", "13:30:00"), "lunch").when(inside("15:00:00", NIGHT_SESSION[0]), "closed_break")
        .otherwise("off_session")
    )


def is_tradable(text: Column) -> Column:
    return session_state(text).isin("continuous_trading", "night_trading")


def is_open_protected(text: Column, guard_seconds: int = 60) -> Column:
    """Within the guard after a session open; ``HH:MM:SS`` compares in time order as text."""
    out = F.lit(False)
    for opening in SESSION_OPENS:
        h, m, s = (int(x) for x in opening.split(":"))
        until = h * 3600 + m * 60 + s + guard_seconds
        out = out | ((text >= opening) & (text < f"{until // 3600:02d}:{until // 60 % 60:02d}:{until % 60:02d}"))
    return out

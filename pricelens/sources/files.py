"""Readers for daily bar trees, snapshot CSV folders and archives, event tables; source discovery and choice."""
from __future__ import annotations

import csv
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.codes import CONTINUOUS_WORDS, base_name, file_contract_info, normalize_contract
from ..schemas import BAR_ALIASES, DAILY_FILE, EVENT_BINDING, EVENT_HEADERS, EVENT_REQUIRED, SNAPSHOT_FILE
from ..session import dimension, materialize
from . import archives

COLUMNS = archives.COLUMNS
SOURCE_COLUMNS = [c.split(" ")[0] for c in archives.SOURCE.split(", ")]


def normalize_symbols(symbols) -> list[str]:
    items = symbols.split(",") if isinstance(symbols, str) else list(symbols or [])
    out = list(dict.fromkeys(s for s in (str(x).strip().upper() for x in items) if s))
    if not out:
        raise ValueError("no symbols given")
    return out


def validate_range(start: str, end: str) -> tuple[datetime, datetime]:
    a, b = datetime.strptime(start, "%Y%m%d"), datetime.strptime(end, "%Y%m%d")
    if a > b:
        raise ValueError("start date after end date")
    return a, b


def daily_files(spark: SparkSession, root: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Rows of a ``{root}/{YYYY}/{YYYYMMDD}.parquet`` tree; a badly named file fails the job.

    The predicates on file name and path are metadata filters, so files outside the range are never opened.
    """
    name = F.col("_metadata.file_name")
    df = spark.read.schema(DAILY_FILE).option("recursiveFileLookup", "true").parquet(root).select(
        "*", name.alias("_file"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row"))
    if first and last:
        df = df.filter(F.substring(F.col("_file"), 1, 8).between(first, last))
    good = F.col("_file").rlike(r"^\d{8}\.parquet$") & F.col("_path").rlike(r"/\d{4}/[^/]+$")
    return df.withColumn("_file", F.when(good, F.col("_file")).otherwise(F.raise_error(F.concat(F.lit("bad daily file: "), F.col("_path")))))


def read_daily_bars(spark: SparkSession, root: str, symbols, start: str, end: str, lookback_days: int = 45) -> tuple[DataFrame, DataFrame]:
    """(bars of the range plus look-back, listing bounds over the whole history)."""
    from ..plans.daily import contract_bounds, standardize_bars, traded_days
    wanted = normalize_symbols(symbols)
    a, b = validate_range(start, end)
    first = (a - timedelta(days=lookback_days)).strftime("%Y%m%d")
    bars = standardize_bars(daily_files(spark, root, first, end), wanted, ["_file", "_row"])
    lo, hi = F.to_date(F.lit(first), "yyyyMMdd"), F.to_date(F.lit(end), "yyyyMMdd")
    return bars.filter(F.col("trade_date").between(lo, hi)), contract_bounds(traded_days(daily_files(spark, root), wanted))


def daily_bounds(files: DataFrame) -> DataFrame:
    """Low, high and first previous settlement per file day and normalised contract; undated codes and zero bars dropped."""
    c = F.col
    rows = files.filter(c("code").rlike(r"\d") & (c("low") > 0) & (c("high") > 0)).select(
        F.substring("_file", 1, 8).alias("trade_date"), normalize_contract(F.split("code", r"\.")[0]).alias("contract"), "low", "high", "pre_settle", "_row")
    return rows.groupBy("trade_date", "contract").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min_by("pre_settle", "_row").alias("pre_settle"))


# ---- snapshots -------------------------------------------------------------------------------------------

def _with_file_info(df: DataFrame) -> DataFrame:
    info = file_contract_info(F.col("source_file"), F.col("InstrumentID"))
    return df.withColumn("_i", info).select("*", "_i.*").drop("_i")


def read_snapshot_folder(spark: SparkSession, folder: str, encoding: str = "UTF-8") -> DataFrame:
    """Snapshot CSVs of one folder; ``snapshot_seq`` follows the row order of each file.

    A split starts at a byte offset that is a multiple of at least 4 MiB; inside a split rows are read in order.
    """
    block = F.floor(F.col("_metadata.file_block_start") / (4 << 20))
    seq = F.shiftleft(block.cast("bigint"), 33).bitwiseOR(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    df = spark.read.option("header", "true").option("encoding", encoding).schema(SNAPSHOT_FILE).csv(folder).select(
        "*", F.col("_metadata.file_name").alias("source_file"), seq.alias("snapshot_seq"))
    return _with_file_info(df)


def typed(rows: DataFrame) -> DataFrame:
    """Text rows of archives or sources with the snapshot types and what the file name tells."""
    columns = [c.strip().split(" ") for c in SNAPSHOT_FILE.split(",")]
    return _with_file_info(rows.select(*[F.col(n).try_cast(t).alias(n) for n, t in columns], "source_file", "source_path", "snapshot_seq"))


def read_snapshot_archives(spark: SparkSession, path: str, trade_date: str | None = None) -> DataFrame:
    """Rows of the CSV members of an archive, or of the archives in a folder; unreadable members are left out."""
    return typed(archives.read_archives(spark, path, trade_date).where(F.col("source_status") == archives.OK))


def discover_sources(spark: SparkSession, root: str) -> DataFrame:
    """Every source below a folder, files and members of archives, each ``selected`` or ``duplicate`` (see ``choose_sources``)."""
    c = F.col
    listed = archives.sources(spark, root)
    name = F.coalesce("member", "path")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    label = F.when(c("member").isNull(), c("path")).otherwise(F.concat("path", F.lit("::"), "member"))
    return choose_sources(listed.withColumns({"label": label, "file_name": F.element_at(F.split(name, "/"), -1), "archive_stem": stem,
                                              "source_type": F.when(c("path").rlike(r"(?i)\.zip$"), "zip").otherwise("csv")}))


def read_snapshot_sources(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the selected sources, quality rows of those that cannot be read): encodings fall back file by file."""
    chosen = materialize(discover_sources(spark, root))
    rows = materialize(archives.read_sources(chosen.where("status = 'selected'").drop("status").withColumnRenamed("source_status", "status").select(*SOURCE_COLUMNS)))
    bad = rows.where(F.col("source_status") != archives.OK).select("source_path", "source_file", F.col("source_status").alias("status"))
    return typed(rows.where(F.col("source_status") == archives.OK)), bad


def choose_sources(candidates: DataFrame) -> DataFrame:
    """One source per (normalised contract, date): CSV before daily archive before other archives, then by label.

    ``candidates``: label, file_name, source_type (csv or zip), archive_stem. Losers get status ``duplicate``; a ``status``
    that came along is kept as ``source_status``.
    """
    c = F.col
    if "status" in candidates.columns:
        candidates = candidates.withColumnRenamed("status", "source_status")
    info = file_contract_info(c("file_name"))
    x = candidates.withColumn("_i", info).select("*", "_i.contract", "_i.parse_status", c("_i.trade_date").alias("_d")).drop("_i")
    folder = F.regexp_extract(c("label"), r".*(?:/|::)(\d{8})(?:/|\.zip|$)", 1)
    x = x.withColumn("trade_date", F.coalesce("_d", F.nullif(folder, F.lit("")))).drop("_d").filter(c("parse_status") != "continuous_alias")
    x = x.withColumn("priority", F.when(c("source_type") == "csv", 0).when(c("archive_stem") == c("trade_date"), 1).otherwise(2))
    known = c("contract").isNotNull() & c("trade_date").isNotNull()
    key = F.when(known, F.concat_ws("|", normalize_contract(c("contract")), "trade_date")).otherwise(c("label"))
    w = Window.partitionBy("_key").orderBy("priority", "label")
    return x.withColumn("_key", key).withColumn("status", F.when(F.row_number().over(w) == 1, "selected").otherwise("duplicate")).drop("_key")


def locate_day(paths: DataFrame, root: str, dates: DataFrame | None = None) -> DataFrame:
    """Best source per trade date: day archive in the month folder, day folder in it, day archive, day folder.

    Dates asked for (``trade_date``) fall back to the archive of their month, in the year's folder or beside it, then to
    one with a longer name, if there is only one.
    """
    c = F.col
    rest = F.regexp_replace(c("path"), "^(file:)?/*" + root.removeprefix("file:").strip("/") + "/", "")
    x = paths.withColumn("_rest", rest)
    rest = c("_rest")
    rank = (F.when(rest.rlike(r"^\d{6}/\d{8}\.zip$"), 1).when(rest.rlike(r"^\d{6}/\d{8}/"), 2)
            .when(rest.rlike(r"^\d{8}\.zip$"), 3).when(rest.rlike(r"^\d{8}/"), 4))
    days = x.withColumns({"trade_date": F.regexp_extract(rest, r"(\d{8})(?:\.zip$|/)", 1), "rank": rank}).filter(c("rank").isNotNull())
    place = F.when(c("rank").isin(2, 4), F.regexp_replace(c("path"), "/[^/]+$", "")).otherwise(c("path"))
    best = days.groupBy("trade_date").agg(F.min_by(place, F.struct("rank", "path")).alias("source"))
    if dates is None:
        return best
    monthly = x.filter(rest.rlike(r"^(\d{4}/)?\d{6}[^/]*\.zip$")).withColumn("_month", F.regexp_extract(rest, r"(\d{6})[^/]*$", 1))
    rank = F.when(rest.rlike(r"^\d{4}/\d{6}\.zip$"), 1).when(rest.rlike(r"^\d{6}\.zip$"), 2).otherwise(3)
    months = monthly.withColumn("_rank", rank).filter((c("_rank") != 3) | ~rest.rlike(r"^\d{8}\.zip$")).groupBy("_month").agg(
        F.min("_rank").alias("_rank"), F.count_if(rank == 3).alias("_longer"), F.min_by("path", F.struct("_rank", "path")).alias("_archive"))
    months = months.filter((c("_rank") < 3) | (c("_longer") == 1)).select("_month", "_archive")
    wanted = dates.select("trade_date").distinct().withColumn("_month", F.substring("trade_date", 1, 6))
    return wanted.join(best, "trade_date", "left").join(months, "_month", "left").select("trade_date", F.coalesce("source", "_archive").alias("source"))


def matches(instrument: Column, commodities: list[str] | None = None, contracts: list[str] | None = None) -> Column:
    """Instrument filter by commodity or by contract, in raw or normalised form."""
    up = F.upper(F.trim(instrument))
    out = F.lit(True)
    if commodities:
        out = out & F.regexp_extract(up, r"^([A-Z]+)", 1).isin(*[x.upper() for x in commodities])
    if contracts:
        wanted = [F.upper(F.lit(x)) for x in contracts] + [normalize_contract(F.lit(x)) for x in contracts]
        out = out & (up.isin(*wanted) | normalize_contract(up).isin(*wanted))
    return out


# ---- event tables and legacy bars ------------------------------------------------------------------------

def _headers(batches):
    for batch in batches:
        for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            first = next(archives.blocks(archives.Source(path, size=length)), b"").split(b"\n", 1)[0]
            names = next(csv.reader([first.decode("utf-8-sig").rstrip("\r")]), [])
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([[n.strip() for n in names]], pa.list_(pa.string()))], names=["file", "names"])


def read_event_tables(spark: SparkSession, path: str, use: str = "any") -> DataFrame:
    """Event CSVs of one or many day folders with English column names and the batch date of their folder.

    Files may have different columns in any order: the first line of each names them, and all are united by name. A
    file that lacks a column which ``use`` asks for (EVENT_REQUIRED) fails the job. The driver sees the distinct headers only.
    """
    found = archives.listing(spark, path, "*.csv").mapInArrow(_headers, "file string, names array<string>")
    headers = materialize(found.withColumn("file", F.regexp_replace("file", "^file:/+", "file:/")))
    distinct = sorted(tuple(r.names) for r in headers.select("names").distinct().collect())
    if not distinct:
        raise ValueError(f"no event tables below {path}")
    for names in distinct:
        missing = set(EVENT_REQUIRED[use]) - set(names)
        if missing:
            where = headers.where(F.col("names") == F.array(*[F.lit(n) for n in names])).agg(F.min("file")).first()[0]
            raise ValueError(f"missing columns: {sorted(missing)} in {where}")
    wide = max(len(n) for n in distinct)
    cells = [f"_c{i}" for i in range(wide)]
    rows = spark.read.schema(", ".join(f"{c} string" for c in cells)).option("header", "true").option("enforceSchema", "true").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").csv(path)
    place = F.col("_metadata.file_path")
    rows = rows.select(F.array(*cells).alias("cells"), F.regexp_replace(place, "^file:/+", "file:/").alias("file"), F.regexp_extract(place, r"/(\d{8})[^/]*/", 1).alias("batch_date"))
    joined = rows.join(dimension(headers), "file")
    english = {header: name for name, header in EVENT_HEADERS.items()}
    columns = list(dict.fromkeys(n for names in distinct for n in names))
    value = lambda n: F.get("cells", (F.array_position("names", F.lit(n)) - 1).cast("int"))
    return joined.select(*[F.when(F.array_contains("names", n), value(n)).alias(english.get(n, n)) for n in columns], "batch_date")


def binding_violations(events: DataFrame) -> DataFrame:
    """column, problem of the columns that bind a table to its boundary list: empty cells, no SHA-256, more than one value."""
    checks = []
    for i, name in enumerate(EVENT_BINDING):
        v = F.trim(F.col(f"`{name}`"))
        bad = F.when(F.count_if(F.coalesce(v == "", F.lit(True))) > 0, "empty")
        bad = bad.when(F.count_if(~v.rlike("^[0-9a-fA-F]{64}$")) > 0, "not_sha256") if i else bad
        checks.append(F.struct(F.lit(name).alias("column"), bad.when(F.count_distinct(v) > 1, "not_one_value").alias("problem")))
    return events.agg(F.array(*checks).alias("c")).select(F.explode("c").alias("c")).select("c.*").where("problem is not null")


def normalize_bar_columns(df: DataFrame) -> DataFrame:
    """Vendor headers to canonical numeric columns, plus the day's range."""
    pick = lambda names: [F.col(f"`{n}`") for n in names if n in df.columns]
    out = []
    for name, aliases in BAR_ALIASES.items():
        found = pick(aliases)
        value = F.coalesce(*found) if found else F.lit(None)
        out.append((value.cast("string") if name == "date" else value.cast("string").try_cast("double")).alias(name))
    return df.select(*out).withColumn("high_low", F.col("high") - F.col("low"))

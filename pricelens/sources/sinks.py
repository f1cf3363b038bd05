"""Writers for result tables."""
from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, is_dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..schemas import EVENT_HEADERS
from . import archives, store


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """One folder per table; nested columns become JSON when the format is CSV."""
    for name, df in tables.items():
        if fmt == "csv":
            nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
            df = df.withColumns({n: F.to_json(n) for n in nested}) if nested else df
        df.write.mode("errorifexists").option("header", "true").format(fmt).save(f"{folder}/{name}")


def event_table(events: DataFrame) -> DataFrame:
    """The fixed event headers in order; absent columns are empty, arrays are comma-joined."""
    names = {"display_trade_date": "TradingDay", "event_anchor_start_key": "snapshot_seq_start", "event_anchor_end_key": "snapshot_seq_end",
             "last_price_anchor": "LastPrice", "interval_vwap_anchor": "interval_vwap", "interval_delta_volume": "delta_volume",
             "interval_delta_turnover": "delta_turnover"}
    types = {f.name: f.dataType.typeName() for f in events.schema.fields}
    out = []
    for name, header in EVENT_HEADERS.items():
        source = name if name in types else names.get(name, name)
        value = F.lit(None).cast("string") if source not in types else F.array_join(source, ",") if types[source] == "array" else F.col(source)
        out.append(value.alias(header))
    return events.select(*out)


# ---- table sets: several tables and a manifest that count as one ---------------------------------------------

# Columns of the five study tables, in file order; {h} stands for each recovery horizon, {m} for the excursion window.
_RECOVERY = ["recovery_valid_n_{h}s", "recovery_missing_n_{h}s", "recovery_ratio_{h}s_median", "recovery50_{h}s_rate", "recovery50_{h}s_n", "recovery80_{h}s_rate", "recovery80_{h}s_n",
             "recovery100_{h}s_rate", "recovery100_{h}s_n"]
_EXCURSION = ["mfe_mean_pct", "mfe_median_pct", "mae_mean_pct", "mae_median_pct", "mae_p95_pct"]
STUDY_COLUMNS = {
    "threshold_summary": ["InstrumentID", "side", "mode", "threshold_pct", "active_days", "candidate_rows", "deviation_records", "independent_events", "events_per_day", "mfe_mae_complete_n", "mfe_valid_n",
                          "mae_valid_n", *_EXCURSION, *_RECOVERY],
    "threshold_summary_by_day": ["trade_date", "InstrumentID", "side", "mode", "threshold_pct", "effective_day", "deviation_records", "candidate_rows", "independent_events", "mfe_mae_complete_n",
                                 "mfe_valid_n", "mae_valid_n", *_RECOVERY, *_EXCURSION],
    "event_details": ["event_id", "window_id", "source_file", "source_label", "trade_date", "TradingDay", "InstrumentID", "side", "mode", "threshold_pct", "event_start_time", "event_end_time", "event_time",
                      "event_start_row_order", "event_end_row_order", "row_order", "event_mid", "anchor_mid", "event_last", "bid1", "ask1", "spread", "spread_pct", "delta_volume", "deviation_pct",
                      "abs_deviation_pct", "mid_move_pct", "sim_fill_price", "cluster_candidate_rows", "mfe_mae_window_complete", "mfe_mae_covered_seconds", "mfe_{m}s_pct", "mae_{m}s_pct",
                      "mid_after_{h}s", "sample_ts_after_{h}s", "sample_time_after_{h}s", "sample_delay_after_{h}s", "recovery_ratio_{h}s", "recovery50_{h}s", "recovery80_{h}s", "recovery100_{h}s"],
    "deviation_distribution": ["scope", "InstrumentID", "trade_date", "new_trade_records", "q90_pct", "q95_pct", "q99_pct", "q99_5_pct", "q99_9_pct", "q99_99_pct", "max_pct"],
    "data_quality": ["source_label", "source_file", "source_type", "trade_date", "InstrumentID", "rows", "valid_time_rows", "invalid_time_rows", "valid_volume_rows", "invalid_volume_rows", "valid_bbo_rows",
                     "invalid_bbo_rows", "invalid_last_rows", "new_trade_records", "deviation_records", "volume_reset_rows", "time_break_rows", "status", "message"],
}


def study_columns(horizons: tuple[int, ...] = (1, 3, 5), excursion: int = 5) -> dict[str, list[str]]:
    """The study tables' columns with their horizons; a run of columns of one horizon stands before the next horizon's."""
    out = {}
    for table, columns in STUDY_COLUMNS.items():
        names = [c for c in columns if "{h}" in c]
        at = columns.index(names[0]) if names else len(columns)
        rest = [c.format(m=excursion) for c in columns if c not in names]
        out[table] = rest[:at] + [c.format(h=h) for h in horizons for c in names] + rest[at:]
    return out


def arranged(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly the given columns in their order; absent ones are null, others are left out."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def publish(tables: dict[str, DataFrame], folder: str, columns: dict[str, list[str]] | None = None, fmt: str = "parquet", facts: dict | None = None) -> dict:
    """Writes a set of tables and its manifest, and makes it the folder's current one; readers see the old or the new set.

    Each set has a folder of its own; the pointer ``CURRENT`` is replaced when all tables are whole. A writer that dies
    leaves a folder that nothing points to (see ``retire``). The manifest has each table's columns, rows and digest.
    """
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    place = f"{folder.rstrip('/')}/sets/{version}"
    manifest = {"version": version, "format": fmt, "tables": {}, **(facts or {})}
    for name, df in tables.items():
        df = arranged(df, columns[name]) if columns and name in columns else df
        nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
        if fmt == "csv" and nested:
            df = df.withColumns({n: F.to_json(n) for n in nested})
        df.write.option("header", "true").format(fmt).save(f"{place}/{name}")
        back = _loaded(spark, f"{place}/{name}", fmt, df.schema)
        digest = archives.result_digest(back, back.columns).first()
        manifest["tables"][name] = {"columns": df.columns, "schema": df.schema.json(), "rows": digest["n_rows"], "signature": digest["signature"]}
    store.put(spark, f"{place}/manifest.json", json.dumps(manifest, ensure_ascii=False), f"{place}/_manifest")
    store.put(spark, f"{folder.rstrip('/')}/CURRENT", version, f"{folder.rstrip('/')}/_{version}")
    return manifest


def _loaded(spark: SparkSession, path: str, fmt: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").format(fmt).load(path)


def manifest_of(spark: SparkSession, folder: str) -> dict | None:
    """The manifest of the current set, None before the first."""
    version = store.read_text(spark, f"{folder.rstrip('/')}/CURRENT")
    text = version and store.read_text(spark, f"{folder.rstrip('/')}/sets/{version}/manifest.json")
    return json.loads(text) if text else None


def current_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the current set with the types that they were written with."""
    manifest = manifest_of(spark, folder)
    if manifest is None:
        return {}
    place = f"{folder.rstrip('/')}/sets/{manifest['version']}"
    return {n: _loaded(spark, f"{place}/{n}", manifest["format"], StructType.fromJson(json.loads(t["schema"]))) for n, t in manifest["tables"].items()}


def retire(spark: SparkSession, folder: str) -> list[str]:
    """Deletes the sets that are not current, those of dead writers among them; call it when nobody reads old ones."""
    manifest = manifest_of(spark, folder)
    old = [n for n in store.names(spark, f"{folder.rstrip('/')}/sets") if not manifest or n != manifest["version"]]
    for name in old:
        store.remove(spark, f"{folder.rstrip('/')}/sets/{name}")
    return old


# ---- keyed results ---------------------------------------------------------------------------------------------

#: Part of every key; raise it when a cached result's columns change.
CACHE_SCHEMA = 1


def cache_key(config, source_digest: str, **more) -> str:
    """Key of a result by what it is made of: configuration, digest of the input's content, and what else decides it."""
    values = [CACHE_SCHEMA, asdict(config) if is_dataclass(config) else config, source_digest, more]
    return hashlib.sha256(json.dumps(values, sort_keys=True, default=str).encode()).hexdigest()


def cached(spark: SparkSession, root: str, key: str, build, partition_by: tuple[str, ...] = (), required: tuple[str, ...] = ()) -> tuple[DataFrame, bool]:
    """(result, whether it was there already). ``build()`` runs on a miss, or where the stored result lacks a required column.

    A result is written aside and counts from the moment its pointer appears; of writers at the same time the first one's
    stays, and all read that. Folders without a pointer are those of dead writers and are never read.
    """
    root = root.rstrip("/")
    pointer = f"{root}/keys/{key}"
    place = store.read_text(spark, pointer)
    if place and store.exists(spark, f"{root}/data/{place}/_SUCCESS"):
        stored = spark.read.parquet(f"{root}/data/{place}")
        if set(required) <= set(stored.columns):
            return stored, True
    if place:
        store.remove(spark, pointer)
    mine = uuid.uuid4().hex
    build().write.partitionBy(*partition_by).parquet(f"{root}/data/{mine}")
    if not store.put_new(spark, pointer, mine, f"{root}/_{mine}"):
        store.remove(spark, f"{root}/data/{mine}")
        mine = store.read_text(spark, pointer)
    return spark.read.parquet(f"{root}/data/{mine}"), False

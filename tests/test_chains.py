"""Chunked chains equal whole-group chains on the driver tables; sources, sinks and streams round-trip."""
import zipfile

import pytest
from pyspark.sql import functions as F

from pricelens.config import StudyConfig, TickConfig
from pricelens.functions import clock, codes
from pricelens.operators.chunked import CHUNK, chunk_of
from pricelens.plans import daily, study, ticks
from pricelens.registry import all_oracles, all_queries, study as RS, ticks as RT
from pricelens.schemas import EVENT_HEADERS
from pricelens.sources import files, sinks
from pricelens.sources.driver_tables import profiles
from pricelens.streaming import events as streams

D = "/root/testdata/sf0.001"


def test_study_chunked_equals_whole(spark):
    raw = RS.raw_rows(spark, D)
    pick = ["row_order", "segment_id", "ts_ms", "delta_volume", "prev_mid", "deviation"]
    whole = study.prepare(raw).select(*pick).orderBy("row_order").collect()
    split = study.prepare(raw.withColumn(CHUNK, chunk_of("row_order", 97)), chunk=CHUNK).select(*pick).orderBy("row_order").collect()
    assert whole == split


def test_frames_chunked_equals_whole(spark):
    raw = RT.raw_rows(spark, D)
    pick = ["contract", "market_time_key", "gap_ms", "delta_volume", "delta_turnover", "frame_turnover_desync"]
    order = ["trade_date", "contract", "market_time_key"]
    run = lambda w: ticks.prepare(raw, profiles(spark), TickConfig(), None, w).orderBy(*order).select(*pick).collect()
    assert run(None) == run(20_000)


def test_clock_and_sessions(spark):
    rows = spark.createDataFrame([("09:00:59", 0), ("09:01:00", 0), ("23:59:59.5", 1), ("24:00:00", 0), ("bad", 0), ("9:15:00", 1000)], "t string, ms int")
    got = clock.with_clock(rows, "c", F.col("t"), F.col("ms")).collect()
    assert [r["c"] for r in got] == [32_459_000, 32_460_000, 86_399_501, None, None, None]
    flags = rows.select(clock.is_open_protected(F.col("t")).alias("p")).collect()
    assert [r["p"] for r in flags][:2] == [True, False]


def test_codes(spark):
    df = spark.createDataFrame([("ap610",), ("AU2606",), ("A",)], "c string")
    assert [r[0] for r in df.select(codes.normalize_contract(F.col("c"))).collect()] == ["AP2610", "AU2606", "A"]
    info = spark.createDataFrame([("dir/cu2405_20240102.csv",), ("铜主力连续_20240102.csv",), ("x_1.csv",)], "f string").select(
        codes.file_contract_info(F.col("f")).alias("i")).select("i.*").collect()
    assert [(r.contract, r.parse_status, r.trade_date) for r in info] == [
        ("CU2405", "ok", "20240102"), (None, "continuous_alias", "20240102"), (None, "unknown_format", None)]


def _bars(spark, root, date, rows):
    spark.createDataFrame(rows, files.DAILY_FILE).toPandas().to_parquet(f"{root}/{date}.parquet")


def test_daily_tree(spark, tmp_path):
    year = tmp_path / "2025"
    year.mkdir()
    for date, close in (("20241101", 9.0), ("20250102", 10.0), ("20250103", 11.0)):
        folder = tmp_path / date[:4]
        folder.mkdir(exist_ok=True)
        _bars(spark, folder, date, [("a2505.DCE", date, None, None, close, close + 1, close - 1, close, 5.0), ("A.DCE", date, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)])
    bars, bounds = files.read_daily_bars(spark, str(tmp_path), "a", "20250102", "20250103")
    got = bars.orderBy("trade_date").collect()
    assert [(r.contract, r.pre_close) for r in got] == [("A2505", None), ("A2505", 10.0)]
    assert str(bounds.first()["listed_date"]) == "2024-11-01"
    (year / "oops.parquet").write_bytes((year / "20250102.parquet").read_bytes())
    with pytest.raises(Exception, match="bad daily file"):
        files.daily_files(spark, str(tmp_path)).collect()


def test_snapshot_archive_and_folder(spark, tmp_path):
    head = ",".join(files.COLUMNS)
    line = lambda i: f"20240102,cu2405,09:0{i}:00,0,70000,{i},69990,1,70010,1,70000,{i * 7e5},10,77000,63000"
    text = "\n".join([head] + [line(i) for i in range(5)])
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "cu2405_20240102.csv").write_text(text)
    with zipfile.ZipFile(tmp_path / "20240102.zip", "w") as z:
        z.writestr("d/cu2405_20240102.csv", text.encode("gb18030"))
        z.writestr("d/cu2405_20240103.csv", text)
    a = files.read_snapshot_folder(spark, str(tmp_path / "csv"))
    b = files.read_snapshot_archives(spark, str(tmp_path), "20240102")
    pick = ["contract", "trade_date", "UpdateTime", "Volume"]
    assert a.orderBy("snapshot_seq").select(*pick).collect() == b.orderBy("snapshot_seq").select(*pick).collect()
    assert b.count() == 5
    picked = spark.createDataFrame([("x/cu2405_20240102.csv", "cu2405_20240102.csv", "csv", None), ("20240102.zip:cu2405_20240102.csv", "cu2405_20240102.csv", "zip", "20240102")],
                                   "label string, file_name string, source_type string, archive_stem string")
    assert [r.status for r in files.choose_sources(picked).orderBy("priority").collect()] == ["selected", "duplicate"]


def test_event_table_keeps_headers_when_empty(spark):
    empty = spark.createDataFrame([], "event_id string, trigger_reasons array<string>")
    assert sinks.event_table(empty).columns == list(EVENT_HEADERS.values())


def test_streaming_sessions(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("C", "down", f"2024-01-01 00:00:{s:02d}", -0.01 * s) for s in (1, 6, 12)] + [("C", "down", "2024-01-01 00:05:00", -0.5)]
    spark.createDataFrame(rows, "contract string, side string, ts string, deviation double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(src)
    stream = spark.readStream.schema("contract string, side string, ts timestamp, deviation double").parquet(src)
    q = streams.deviation_events(stream).writeStream.format("memory").queryName("sess").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.candidate_rows for r in spark.table("sess").orderBy("start_ts").collect()] == [2, 1]


def test_registry_is_consistent():
    assert set(all_oracles()) <= set(all_queries())
    assert len(all_queries()) > 140


def test_event_tables_of_different_headers_unite_by_name(spark, tmp_path):
    from pricelens.sources.files import read_event_tables
    for day, text in (("20250102", "\ufeff交易日,品种,合约,extra\n2025-01-02,a,a01,x\n"), ("20250103", "合约,交易日,品种\nb01,2025-01-03,b\n")):
        (tmp_path / f"{day}_run").mkdir()
        (tmp_path / f"{day}_run" / "events.csv").write_text(text, encoding="utf-8")
    df = read_event_tables(spark, str(tmp_path / "*" / "*.csv"))
    rows = sorted((r.batch_date, r.extra, *[v for c, v in sorted(r.asDict().items()) if c not in ("batch_date", "extra")]) for r in df.collect())
    assert [r[:2] for r in rows] == [("20250102", "x"), ("20250103", None)]
    assert {"a", "a01", "2025-01-02"} == set(rows[0][2:]) and {"b", "b01", "2025-01-03"} == set(rows[1][2:])


def test_manifest_counts_events_without_their_paths(spark):
    """Details are one row per event, so their number needs no interval join."""
    from pricelens.registry.study import QUERIES
    assert "Join" not in QUERIES["agg_11_manifest"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()

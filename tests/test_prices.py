"""Prices whose binary value and shortest decimal round to different hundredths."""
import duckdb

from pricelens.sources.driver_tables import SNAPSHOTS_SQL, snapshots


def test_prices_round_as_in_sql(spark, tmp_path):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    con.execute("create view all_events as select * from '/root/testdata/sf0.1/events.parquet'")
    con.execute(f"copy (select * from all_events where event_id in (74737, 92007, 92490)) to '{tmp_path}/events.parquet' (format parquet)")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = con.execute("with " + SNAPSHOTS_SQL + " select snapshot_seq, last_price, bid, ask from snap").fetchall()
    got = snapshots(spark, str(tmp_path)).select("snapshot_seq", "LastPrice", "BidPrice1", "AskPrice1").collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) == 3

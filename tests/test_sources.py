"""Archives by byte ranges, encodings, discovery, caches and table sets on hand-made files."""
import hashlib
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from pricelens.plans import daily
from pricelens.sources import archives, files, sinks, store

HEAD = "InstrumentID,备注,Volume,LastPrice"


def _text(n, name="cu2405"):
    return "\n".join([HEAD] + [f'{name},"备,{i}",{i},{i}.5' for i in range(n)]) + "\n"


def test_members_and_blocks(tmp_path):
    pick, path = random.Random(1), tmp_path / "a.zip"
    parts = {"x/a.csv": pick.randbytes(3_000_000), "b.csv": b"", "主力连续_c.csv": b"z" * 9_000_000, "d.txt": b"t"}
    with zipfile.ZipFile(path, "w") as z:
        for i, (name, raw) in enumerate(parts.items()):
            z.writestr(zipfile.ZipInfo(name), raw, zipfile.ZIP_DEFLATED if i % 2 == 0 else zipfile.ZIP_STORED)
        z.writestr("folder/", b"")
        z.comment = b"PK comment"
    found = {s.member: s for s in archives.members(str(path))}
    assert set(found) == set(parts)
    for name, raw in parts.items():
        assert b"".join(archives.blocks(found[name])) == raw and found[name].size == len(raw)
    raw = bytearray(path.read_bytes())
    raw[found["x/a.csv"].header_at + 200] ^= 1
    path.write_bytes(raw)
    with pytest.raises(Exception):
        list(archives.blocks(found["x/a.csv"]))


def test_zip64_directory(tmp_path):
    path = tmp_path / "many.zip"
    with zipfile.ZipFile(path, "w") as z:
        for i in range(66_000):
            z.writestr(zipfile.ZipInfo(f"m{i}"), b"")
        with z.open(zipfile.ZipInfo("last.csv"), "w", force_zip64=True) as member:
            member.write(b"payload")
    found = archives.members(str(path))
    assert len(found) == 66_001 and b"".join(archives.blocks(found[-1])) == b"payload"
    directory = struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0, 0, 0, 0, 9, 0xFFFFFFFF, 0xFFFFFFFF, 1, 28, 0, 0, 0, 0, 0xFFFFFFFF) + b"w" + struct.pack("<HHQQQ", 1, 24, 7 << 32, 5 << 32, 3 << 32)
    (tmp_path / "wide.zip").write_bytes(directory + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 1, 1, len(directory), 0, 0))
    wide = archives.members(str(tmp_path / "wide.zip"))[0]
    assert (wide.size, wide.stored, wide.header_at) == (7 << 32, 5 << 32, 3 << 32)


def test_a_task_for_each_member_and_date_filter(spark, tmp_path):
    for month in ("202401", "202402"):
        with zipfile.ZipFile(tmp_path / f"{month}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for k in range(3):
                z.writestr(f"{month}0{k + 1}/cu240{k + 5}_{month}0{k + 1}.csv", _text(k * 40, f"cu240{k + 5}").encode("gb18030"))
            z.writestr("notes.txt", "no")
    (tmp_path / "bad.zip").write_bytes(b"PK not an archive")
    rows = archives.read_archives(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 7
    got = files.read_snapshot_archives(spark, str(tmp_path))
    assert got.count() == 2 * (0 + 40 + 80) and rows.where("source_status = 'bad_archive'").count() == 1
    one = files.read_snapshot_archives(spark, str(tmp_path / "202401.zip"), "20240103").orderBy("snapshot_seq").collect()
    assert [(r.contract, r.trade_date, r.snapshot_seq, r.Volume, r.LastPrice, r.BidPrice1) for r in one][-1] == ("CU2407", "20240103", 79, 79, 79.5, None) and len(one) == 80


def test_sources_with_encodings_and_broken_ones(spark, tmp_path):
    (tmp_path / "20240102").mkdir()
    place = tmp_path / "20240102"
    (place / "a2405_1.csv").write_text(_text(3, "a2405"), encoding="utf-8")
    (place / "b2405_20240102.csv").write_text(_text(4, "b2405"), encoding="utf-8-sig")
    (place / "c2405_20240102.csv").write_text(_text(5, "c2405"), encoding="gb18030")
    (place / "d2405_20240102.csv").write_bytes(_text(6, "d2405").encode() + b"\xff\xff")
    (place / "e2405_20240102.csv").write_bytes(b"")
    (tmp_path / "20240102.zip").write_bytes(b"broken")
    with zipfile.ZipFile(tmp_path / "202401.zip", "w") as z:
        z.writestr("c2405_20240102.csv", _text(50, "c2405"))
        z.writestr("20240103/f2405_x.csv", _text(2, "f2405"))
    chosen = {r.label.rsplit("/", 1)[-1]: (r.trade_date, r.status) for r in files.discover_sources(spark, str(tmp_path)).collect()}
    assert chosen["202401.zip::c2405_20240102.csv"] == ("20240102", "duplicate") and chosen["f2405_x.csv"] == ("20240103", "selected") and chosen["a2405_1.csv"] == ("20240102", "selected")
    rows, bad = files.read_snapshot_sources(spark, str(tmp_path))
    assert {r.contract: r["count"] for r in rows.groupBy("contract").count().collect()} == {"A2405": 3, "B2405": 4, "C2405": 5, "F2405": 2}
    assert {(r.source_file, r.status) for r in bad.collect()} == {("d2405_20240102.csv", "undecodable"), ("20240102.zip", "bad_archive")}
    digests = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in archives.file_digests(archives.sources(spark, str(place))).collect()}
    assert digests["d2405_20240102.csv"] == hashlib.sha256((place / "d2405_20240102.csv").read_bytes()).hexdigest() and len(digests) == 4  # the empty file has no rows and no part


def test_month_archives_stand_in_for_days(spark):
    paths = spark.createDataFrame([(f"file:/r/{p}",) for p in ("202401/20240102.zip", "20240102.zip", "20240103/a.csv", "2024/202401.zip", "202401.zip", "202402x.zip", "202403x.zip", "202403y.zip")], "path string")
    dates = spark.createDataFrame([(d,) for d in ("20240102", "20240103", "20240104", "20240201", "20240301")], "trade_date string")
    got = {r.trade_date: r.source and r.source[8:] for r in files.locate_day(paths, "/r", dates).collect()}
    assert got == {"20240102": "202401/20240102.zip", "20240103": "20240103", "20240104": "2024/202401.zip", "20240201": "202402x.zip", "20240301": None}


def test_result_digest_is_a_multiset(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "", "x"), (2, "", "x")], "i int, s string, t string")
    d = lambda df: tuple(archives.result_digest(df, df.columns).first())
    assert d(rows) == d(rows.repartition(3).select("t", "s", "i")) and d(rows) != d(rows.distinct()) and d(rows.limit(0))[0] == 0
    assert d(rows) != d(rows.withColumn("t", F.coalesce("t", F.lit("")))) and d(rows) != d(rows.union(rows.where("i = 1")))


def test_published_sets(spark, tmp_path):
    place, one = str(tmp_path / "set"), spark.range(5).withColumn("tags", F.array(F.lit("x")))
    assert sinks.current_tables(spark, place) == {} and sinks.manifest_of(spark, place) is None
    sinks.publish({"t": one}, place, {"t": ["absent", "tags", "id"]}, "csv")
    first = sinks.manifest_of(spark, place)
    assert first["tables"]["t"]["columns"] == ["absent", "tags", "id"] and first["tables"]["t"]["rows"] == 5
    broken = spark.range(3).select(F.raise_error(F.lit("dies while it writes")).alias("id"))
    with pytest.raises(Exception, match="dies"):
        sinks.publish({"t": one, "u": broken}, place)
    assert sinks.manifest_of(spark, place) == first and sinks.current_tables(spark, place)["t"].count() == 5
    second = sinks.publish({"t": one.limit(2)}, place)
    assert sinks.current_tables(spark, place)["t"].count() == 2 and len(sinks.retire(spark, place)) == 2
    assert sinks.manifest_of(spark, place)["version"] == second["version"] and store.names(spark, f"{place}/sets") == [second["version"]]


def test_cached_results(spark, tmp_path):
    root, built = str(tmp_path / "cache"), []

    def build():
        built.append(1)
        if len(built) == 1:  # another writer of the same key is faster
            sinks.cached(spark, root, "k", lambda: spark.range(4).withColumn("day", F.lit("b")), ("day",))
        return spark.range(3).withColumn("day", F.lit("a"))

    frame, hit = sinks.cached(spark, root, "k", build, ("day",))
    assert not hit and frame.count() == 4 and len(store.names(spark, f"{root}/data")) == 1
    frame, hit = sinks.cached(spark, root, "k", build, ("day",), required=("id", "day"))
    assert hit and len(built) == 1
    frame, hit = sinks.cached(spark, root, "k", build, ("day",), required=("more",))
    assert not hit and frame.count() == 3
    store.remove(spark, f"{root}/data/{store.read_text(spark, f'{root}/keys/k')}/_SUCCESS")
    assert not sinks.cached(spark, root, "k", build)[1] and len(built) == 3
    assert sinks.cache_key({"a": 1}, "x") != sinks.cache_key({"a": 2}, "x") != sinks.cache_key({"a": 2}, "y")


def test_numbers_that_json_has_not(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, nan, [1.0, nan], (float("inf"), "s"), {"k": nan}), (2, None, None, None, None)], "i int, x double, a array<double>, r struct<y: double, z: string>, m map<string, double>")
    got = [r.j for r in df.select(F.to_json(F.struct(*[daily.finite(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields]), {"ignoreNullFields": "false"}).alias("j")).collect()]
    assert got == ['{"i":1,"x":null,"a":[1.0,null],"r":{"y":null,"z":"s"},"m":{"k":null}}', '{"i":2,"x":null,"a":null,"r":null,"m":null}']


def test_small_members_share_tasks_and_large_ones_do_not():
    small = [archives.Source("a.zip", f"m{i:05}", 0, 10, 6_000) for i in range(36_000)]
    big = archives.Source("b.zip", "big", 0, 10, 1 << 30)
    groups = archives.grouped([*small, big, *small])
    assert [s for g in groups for s in g.items] == [*small, big, *small]
    assert len(groups) < 250 and [len(g.items) for g in groups if big in g.items] == [1]
    assert len(archives.grouped(small[:7])) == 7 and archives.grouped([]) == []

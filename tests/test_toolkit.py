"""Hand-written expectations: units, time, files, lake, streaming."""

from __future__ import annotations

import struct
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from barlake.functions import timeutil as tu
from barlake.operators import clean, frames, master
from barlake.plans import pipelines, topics
from barlake.sources import lake, readers
from barlake.streaming import ingest


def record(day, minute, price, amount=1.5, volume=7):
    packed = (day.year - 2004) * 2048 + day.month * 100 + day.day
    return struct.pack("<HhIIIIfii", packed, minute, price, price + 2, price - 2, price + 1, amount, volume, 0)


BARS = "close double, datetime timestamp, tick long, type string, year string, quarter string, sid string, date string"


def bars(spark, rows):
    df = spark.createDataFrame(rows, "sid string, datetime timestamp_ntz, close double")
    df = df.withColumn("tick", F.unix_timestamp(tu.local_to_utc(F.col("datetime")).cast("timestamp")))
    return clean.partition_keys(df).withColumn("type", F.lit("stock"))


def test_request_bounds():
    assert tu.flex_bound(20240105).isoformat() == "2024-01-05T00:00:00+08:00"
    assert tu.flex_bound(20240105, True).isoformat() == "2024-01-05T23:59:59+08:00"
    assert {int(tu.flex_bound(1704412800 * u).timestamp()) for u in (1, 10**3, 10**6, 10**9)} == {1704412800}
    assert tu.months(20231231, 20240201) == ["202312", "202401", "202402"]
    assert tu.months(1703952000, 1704038400) == ["202312", "202401"]  # 16:00 UTC is the next local day
    assert tu.quarter_bounds(date(2023, 11, 5), date(2024, 1, 1)) == [("2023q4", date(2023, 10, 1), date(2024, 1, 1)), ("2024q1", date(2024, 1, 1), date(2024, 4, 1))]


def test_epoch_and_intdate_are_inverse(spark):
    days = spark.createDataFrame([(20240101,), (20240229,), (20351231,)], "d int")
    back = days.select("d", tu.epoch_to_intdate(tu.intdate_to_epoch(F.col("d"))).alias("b"), tu.epoch_to_intdate(tu.intdate_to_epoch(F.col("d"), True), True).alias("l"))
    assert all(r.d == r.b == r.l for r in back.collect())
    odd = spark.createDataFrame([(0.0,), (-5.0,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in odd.select(tu.epoch_to_intdate(F.col("x"))).collect()] == [0, 0, 0, 0]


def test_num_to_datetime_carries(spark):
    df = spark.createDataFrame([(20240105.0,), (730000.5,), (1.7e9,), (None,), (-1.0,), (730000 + 0.9999999 / 86400,)], "n double")
    got = [r[0] for r in df.select(tu.num_to_datetime(F.col("n"))).collect()]
    assert got[:3] == [datetime(2024, 1, 5), datetime(1999, 9, 3, 12), datetime(2023, 11, 14, 22, 13, 20)]
    assert got[3] == got[4] == datetime(1, 1, 1)


def test_binary_files(spark, tmp_path):
    row = record(date(2024, 1, 5), 571, 1000)
    (tmp_path / "sh600000.01").write_bytes(row + row + record(date(2024, 1, 5), 572, 1001) + b"part")
    (tmp_path / "sz000001.01").write_bytes(row)
    (tmp_path / "sz000002.01").write_bytes(b"")
    (tmp_path / "other.dat").write_bytes(row)
    got = readers.read_binary_bars(spark, str(tmp_path), readers.FILE_NAMES["bin_stock"])
    assert sorted((r.sid, r.sub_dates) for r in got.collect()) == [("000001", 571), ("600000", 571), ("600000", 572)]
    r = clean.decode_packed(got).where("sid = '000001'").first()
    assert r.datetime == datetime(2024, 1, 5, 9, 31) and r.tick == 1704418260
    files = readers.discover(spark, str(tmp_path), ".01")
    assert files.count() == 2 and readers.of_kind(files, "bin_fund").count() == 0
    with pytest.raises(KeyError):
        readers.of_kind(files, "bin_none")
    with pytest.raises(Exception):  # noqa: B017
        readers.discover(spark, str(tmp_path / "missing")).count()
    assert readers.discover(spark, str(tmp_path), ".01", since=datetime(2100, 1, 1)).count() == 0


def test_feature_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(struct.pack("<5f", 10, 1, 2, 3, 4))
    (tmp_path / "b.bin").write_bytes(struct.pack("<1f", 10))
    got = readers.read_features(spark, str(tmp_path), 11, 99).collect()
    assert [(r["index"], r["value"]) for r in got] == [(11, 2.0), (12, 3.0), (13, 4.0)]


def test_pipelines(spark, tmp_path):
    src, root = tmp_path / "src", str(tmp_path / "lake")
    src.mkdir()
    (src / "sh600000.01").write_bytes(record(date(2024, 1, 31), 571, 1000) + record(date(2024, 2, 1), 571, 1001))
    pipelines.stock_bin(spark, str(src), root)
    schema = "amount long, close long, datetime timestamp, high long, low long, open long, tick long, volume long, type string, year string, quarter string, sid string, date string"
    got = lake.scan_lake(spark, root, schema).orderBy("tick").collect()
    assert [(r.sid, r.date, r.open, r.close, r.volume, r.amount) for r in got] == [("600000", "202401", 1000000, 1001000, 7000, 1500), ("600000", "202402", 1001000, 1002000, 7000, 1500)]
    csv = tmp_path / "csv"
    csv.mkdir()
    head = "日期,代码,开盘价,最高价,最低价,收盘价,成交量（手）,成交额（元）"
    for name in ("SZ.000001", "SH.510001", "SH.000300"):  # a folder of all kinds: each pipeline takes its own
        line = f"2024-01-05 09:31:00,{name},10.01,10.02,10.00,10.015,3,1.0015"
        (csv / f"{name}.csv").write_text(f"{head}\n{line}\n{line}\n", encoding="utf-8")
    for load, sid, volume in ((pipelines.stock_csv, "000001", 300000), (pipelines.fund_csv, "510001", 3000)):
        to = str(tmp_path / load.__name__)
        load(spark, str(csv), to)
        (r,) = lake.scan_lake(spark, to, schema).collect()
        assert (r.sid, r.date, r.volume, r.amount, r.tick) == (sid, "202401", volume, 1001, 1704418260)


def test_other_pipelines(spark, tmp_path):
    schema = "amount long, close long, datetime timestamp, high long, low long, open long, tick long, volume long, type string, year string, quarter string, sid string, date string"
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin" / "sh510001.01").write_bytes(record(date(2024, 1, 31), 571, 1000))
    (tmp_path / "bin" / "sh600000.01").write_bytes(record(date(2024, 1, 31), 571, 1000))
    pipelines.fund_bin(spark, str(tmp_path / "bin"), str(tmp_path / "fund"))
    (r,) = lake.scan_lake(spark, str(tmp_path / "fund"), schema).collect()
    assert (r.type, r.sid, r.date, r.open, r.volume) == ("fund", "510001", "202401", 1000000, 7000)
    (tmp_path / "csv").mkdir()
    head = "日期,代码,开盘价,最高价,最低价,收盘价,成交量,成交金额"
    (tmp_path / "csv" / "SH.000300.csv").write_text(f"{head}\n2024-01-05 09:31:00,SH.000300,10.01,10.02,10.00,10.015,3,7.9\n", encoding="utf-8")
    pipelines.benchmark_csv(spark, str(tmp_path / "csv"), str(tmp_path / "benchmark"))
    (r,) = lake.scan_lake(spark, str(tmp_path / "benchmark"), schema).collect()
    assert (r.type, r.sid, r.volume, r.amount, r.close) == ("benchmark", "000300", 3, 7, 1001500)
    (tmp_path / "index").mkdir()
    (tmp_path / "index" / "SH.000001.csv").write_text(f"{head}\n2024-01-05 09:31:00,SH.000001,10.01,10.02,10.00,10.015,3,7.9\n", encoding="utf-8")
    pipelines.benchmark_csv(spark, str(tmp_path / "index"), str(tmp_path / "indices"))
    (r,) = lake.scan_lake(spark, str(tmp_path / "indices"), schema).collect()
    assert (r.type, r.sid) == ("benchmark", "1A0001") and clean.classify(spark.createDataFrame([(r.sid,)], "sid string")).first().type == "benchmark"


def test_first_rows_and_text(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("k,v\n1,x\n1,y\n2,z\n")
    (tmp_path / "in" / "b.csv").write_text("k,v\n1,w\n3,\n")
    rows = readers.read_csv_bars(spark, str(tmp_path / "in"), {"k": "key"}, subset=["key"])
    assert sorted(map(tuple, rows.collect())) == [("1", "x"), ("2", "z"), ("3", None)]
    readers.write_text(rows.coalesce(1), str(tmp_path / "out"), sep="|")
    readers.write_text(rows.limit(1), str(tmp_path / "out"), sep="|", append=True)
    (whole,) = [p for p in (tmp_path / "out").glob("*.csv") if len(p.read_text().splitlines()) == 4]
    assert sorted(whole.read_text().splitlines()) == ["1|x", "2|z", "3|", "key|v"]


def test_database_upsert(spark, tmp_path):
    """Over Python's own database, so that no server is needed."""
    import sqlite3

    path = str(tmp_path / "db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE asset (sid TEXT PRIMARY KEY, delist INT)")
        db.execute("INSERT INTO asset VALUES ('a', 1), ('b', 2)")
    rows = spark.createDataFrame([("b", 9), ("c", 3), ("c", 4)], "sid string, delist int").coalesce(1)
    for update, want in ((False, [("a", 1), ("b", 2), ("c", 3)]), (True, [("a", 1), ("b", 9), ("c", 3)])):
        for _ in range(2):
            master.upsert_table(rows.coalesce(1), lambda: sqlite3.connect(path, timeout=30), "asset", "sid", update)
        with sqlite3.connect(path) as db:
            assert sorted(db.execute("SELECT * FROM asset")) == want
    assert "DO NOTHING" in master.upsert_statement("t", ["k"], "k")


def test_asset_load(spark, tmp_path):
    (tmp_path / "a.csv").write_text("sid,name,first_trading,delist,merger,ratio\n000001,x,20000101,,,1.5\n000001,x,20000101,,,1.5\n")
    empty = spark.createDataFrame([], "sid string, name string, first_trading int, delist int, merger string, ratio float")
    assert [tuple(r) for r in pipelines.asset_load(spark, str(tmp_path), empty).collect()] == [("000001", "x", 20000101, None, None, 1.5)]


def test_lake_write_scan_compact(spark, tmp_path):
    root, staging = str(tmp_path / "lake"), str(tmp_path / "staging")
    old = [("000001", datetime(2024, 1, 31, 23, 59), 1.0), ("000001", datetime(2024, 2, 1), 2.0), ("600000", datetime(2024, 1, 5, 9, 31), 3.0)]
    lake.write_lake(bars(spark, old), root)
    lake.write_lake(bars(spark, old[:1]), root)  # replaces January of 000001 only
    scan = lake.scan_lake(spark, root, BARS)
    assert sorted((r.sid, r.date, r.close) for r in scan.collect()) == [("000001", "202401", 1.0), ("000001", "202402", 2.0), ("600000", "202401", 3.0)]
    found = lake.scan_lake(spark, root, BARS, ["000001"], 20240201, 20240229)
    assert [r.close for r in found.collect()] == [2.0]
    assert "PartitionFilters: [isnotnull(date" in found._jdf.queryExecution().toString() or "202402" in found._jdf.queryExecution().toString()
    lake.write_lake(bars(spark, [("000001", datetime(2024, 2, 1), 9.0), ("000001", datetime(2024, 2, 2), 4.0)]), staging)
    for _ in range(2):
        merged = lake.compact(spark, root, staging, BARS)
        assert [(r.sid, r.date, r.n_rows) for r in merged.collect()] == [("000001", "202402", 2)]
        assert sorted(r.close for r in lake.scan_lake(spark, root, BARS).collect()) == [1.0, 3.0, 4.0, 9.0]
    with pytest.raises(ValueError, match="partitions"):
        lake.write_lake(bars(spark, old), str(tmp_path / "no"), most=1)


def test_streaming(spark, tmp_path):
    src, root, check = (str(tmp_path / x) for x in ("src", "lake", "check"))
    for i, close in enumerate((1.0, 2.0)):
        lake.shaped(bars(spark, [("000001", datetime(2024, 1, 5 + i), close)])).write.mode("append").parquet(src)
        ingest.ingest(spark, src, root, BARS, check).awaitTermination()
        assert spark.read.schema(BARS).parquet(root).count() == i + 1
    lake.shaped(bars(spark, [("000001", datetime(2024, 1, 9), 5.0)] * 2 + [("000001", datetime(2024, 1, 9), 6.0)])).coalesce(1).write.mode("append").parquet(src)
    merged = str(tmp_path / "merged")
    for close in (3.0, 4.0):
        lake.shaped(bars(spark, [("000001", datetime(2024, 1, 5), close)])).write.mode("append").parquet(src)
        ingest.ingest_merged(spark, src, merged, BARS, check + "2").awaitTermination()
    assert sorted(r.close for r in spark.read.schema(BARS).parquet(merged).collect()) == [2.0, 4.0, 6.0]


def test_cleaning(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([("a", 1.0), ("a", inf), ("a", nan), ("a", None), ("a", 3.0)], "sid string, close double")
    assert sorted(r.close for r in clean.fill_inf(df, "mean").collect()) == [1.0, 2.0, 2.0, 2.0, 3.0]
    assert sorted(r.close for r in clean.fill_inf(df, "nonsense").collect()) == [0.0, 0.0, 0.0, 1.0, 3.0]
    assert clean.drop_na(df).count() == 3
    assert clean.scale(spark.createDataFrame([("a", 1.0015)], "sid string, close double"), 1000).first().close == 1001
    ids = spark.createDataFrame([("399006",), ("510001",), ("2A01",), ("zz",)], "sid string")
    assert {r.sid: r.type for r in clean.classify(ids).collect()} == {"399006": "stock", "510001": "fund", "2A01": "benchmark"}
    assert {r.sid: r.type for r in clean.classify(ids, True).collect()}["399006"] == "benchmark"
    empty = df.limit(0)
    assert clean.fill_inf(empty).count() == clean.fill_na(empty).count() == clean.scale(empty, 10).count() == 0
    assert clean.steps(df, clean.drop_na, lambda d: d.limit(0), enabled={1: False}).count() == 3


def test_frames_and_master(spark):
    df = spark.range(5).select(F.lit("a").alias("sid"), F.col("id").alias("k"))
    out = frames.export(df, "tick", "sid", "k", 2).orderBy("frame").collect()
    assert [r.n_rows for r in out] == [2, 2, 1]
    meta, table = frames.decode_frame(bytes(out[1].payload))
    assert meta == {"rpc_type": "tick", "sid": "a"} and table["k"].to_pylist() == [2, 3]
    with pytest.raises(KeyError):
        topics.fetch("calendar", df, 0, 0)
    t = spark.createDataFrame([("a", 1), ("b", 2)], "sid string, delist int")
    u = spark.createDataFrame([("b", 9), ("c", 3)], "sid string, delist int")
    assert sorted(map(tuple, master.upsert(t, u).collect())) == [("a", 1), ("b", 9), ("c", 3)]
    assert sorted(map(tuple, master.bulk_update(t, u, "delist").collect())) == [("a", 1), ("b", 9)]
    twice = u.union(spark.createDataFrame([("b", 7), ("b", None)], u.schema))
    assert sorted(map(tuple, master.bulk_update(t, twice, "delist").collect())) == [("a", 1), ("b", 9)]
    assert sorted(map(str, master.upsert(t, twice).collect())) == sorted(map(str, master.upsert(t, u.where("sid <> 'b'").union(twice.where("delist is null"))).collect()))
    assert sorted(r.close for r in clean.fill_inf(spark.createDataFrame([("a", 2.0), ("a", 4.0), ("a", None)], "sid string, close double"), "prod").collect()) == [2.0, 4.0, 8.0]


def test_runs_over_stretches(spark):
    rows = [("g" if i % 50 else "h", "abc"[(i // 7) % 3] if i % 11 else "z", i * i) for i in range(900)]
    got = sorted(map(tuple, frames.runs(spark.createDataFrame(rows, "w string, v string, k long"), "v", "k", "w").collect()))
    want, last = {}, {}
    for w, v, k in rows:
        n, old = last.get(w, (0, None))
        n += v != old
        last[w] = (n, v)
        low, _, count = want.get((w, v, n), (k, k, 0))
        want[w, v, n] = (low, k, count + 1)
    assert got == sorted((*key, *value) for key, value in want.items())
    assert frames.runs(spark.createDataFrame([], "w string, v string, k long"), "v", "k", "w").count() == 0

"""What the library does with large files, hot groups, pruned folders and interrupted writes, on small data."""

from __future__ import annotations

import sqlite3
import struct
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_queries import rows
from test_toolkit import BARS, bars, record

from barlake.functions import timeutil as tu
from barlake.operators import clean, frames, quantiles
from barlake.plans import catalog, topics
from barlake.sources import lake, readers, records


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_topics_read_the_folders_of_a_request(spark, tmp_path):
    root = str(tmp_path / "lake")
    rows = [(sid, datetime(2023, 11, 15) + timedelta(days=20 * i), float(i)) for sid in ("600000", "600001", "000001") for i in range(9)]
    lake.write_lake(bars(spark, rows), root)
    whole = spark.read.schema(BARS).parquet(root)
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    for topic in ("tick", "close"):
        plan = plan_of(topics.fetch(topic, whole, 20240105, 20240220, ["600000"]))
        (filters,) = [x for x in plan.split("\n") if "PartitionFilters" in x]
        filters = filters[filters.index("PartitionFilters") : filters.index("PushedFilters")]
        assert "202401" in filters and "202402" in filters and "600000" in filters and "Q1" in filters and "year" in filters
    ids = spark.createDataFrame([("600001",), ("600001",), (None,), ("999999",)], "sid string")
    found = topics.fetch("tick", whole, 20240105, 20240220, ids)
    assert "dynamicpruning" in plan_of(found)
    assert [(r.sid, r.close) for r in found.collect()] == [("600001", 3.0), ("600001", 4.0)]
    assert found.columns == whole.columns
    assert topics.fetch("tick", whole, 20240105, 20240220).count() == 0


def test_large_id_frames_drop_rows_before_the_shuffle(spark):
    df = spark.range(20000).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("sid"), "id")
    ids = df.where("id % 100 = 0").union(df.where("id % 100 = 0"))
    got = lake.semi_join(df, ids, most=10)
    assert sorted(r.id for r in got.collect()) == list(range(0, 20000, 100)) and got.columns == df.columns
    plan = got._jdf.queryExecution()
    near = [line for line in plan.executedPlan().toString().split("\n") if "BroadcastHashJoin" in line]
    assert near, "the bitmap is joined first"
    assert lake.semi_join(df, ids.limit(0), most=10).count() == 0


def test_binary_files_in_ranges(spark, tmp_path):
    rows = b"".join(record(date(2024, 1, 5), 571 + i % 7, 1000 + i % 11) for i in range(1000))
    (tmp_path / "sh600000.01").write_bytes(rows + b"part")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "sz000001.01").write_bytes(rows[:3200])
    (tmp_path / "sz000002.01").write_bytes(b"")
    (tmp_path / "other.dat").write_bytes(rows)
    whole, split = (readers.read_binary_bars(spark, str(tmp_path), readers.FILE_NAMES["bin_stock"], split=n) for n in (0, 90))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, split.collect())) and split.count() == 154
    raw = records.read_fixed(spark, str(tmp_path), readers.RECORD, readers.BAR_FIELDS, "01$", 640)
    assert raw.rdd.getNumPartitions() == 55 and raw.count() == 1100
    assert sorted(r.place for r in raw.where("path like '%sz000001%'").collect()) == list(range(100))
    first = [readers.read_binary_bars(spark, str(tmp_path), readers.FILE_NAMES["bin_stock"], subset=["sub_dates"], split=n).where("sid = '600000'") for n in (0, 320)]
    for df in first:
        assert sorted((r.sub_dates, r.open) for r in df.collect()) == [(571 + i, 1000 + i) for i in range(7)]
    with pytest.raises(Exception, match="missing"):
        readers.read_binary_bars(spark, str(tmp_path / "missing"), split=320).count()


def test_a_file_of_three_gigabytes_is_many_tasks(spark, tmp_path):
    with open(tmp_path / "sh600000.01", "wb") as f:  # with a hole in it, so it takes no space
        f.truncate(3 << 30)
        f.seek((3 << 30) - 32)
        f.write(record(date(2024, 1, 5), 571, 1000))
    raw = records.read_fixed(spark, str(tmp_path), readers.RECORD, readers.BAR_FIELDS, "01$")
    assert raw.rdd.getNumPartitions() == 24
    assert readers.discover(spark, str(tmp_path)).where(F.col("size") >= readers.WHOLE).count() == 1


def test_stretches_hold_equally_many_rows(spark):
    rnd = np.random.default_rng(2)
    rows = [("hot", 0)] + [("hot", int(x)) for x in rnd.choice(10**9, 6000, replace=False) + 10**12] + [("cold", int(x)) for x in range(50)] + [("hot", None)]
    df = spark.createDataFrame(rows, "sid string, k long")
    cut, several = quantiles.stretches(df, ["sid"], "k", 500)
    sizes = {(r.sid, r.stretch): r["count"] for r in cut.groupBy("sid", "stretch").count().collect()}
    hot = [n for (sid, s), n in sizes.items() if sid == "hot" and s >= 0]
    assert several and len(hot) == 13 and max(hot) < 2 * sum(hot) / len(hot) and sizes["cold", 0] == 50 and sizes["hot", -1] == 1
    for number in (500, 10**6):
        got = frames.chunks(df.where("k is not null"), "sid", "k", 16, rows=number).collect()
        for sid in ("hot", "cold"):
            own = sorted((r.k, r.frame) for r in got if r.sid == sid)
            assert [f for _, f in own] == [i // 16 for i in range(len(own))]


def test_median_of_hot_groups(spark):
    rnd = np.random.default_rng(4)
    groups = {"normal": rnd.normal(0, 1, 4001).tolist(), "ties": [1.0] * 3000 + rnd.random(999).tolist(), "halves": [1.0] * 1500 + [2.0] * 1500, "three": [1.0, 2.0, 3.0] * 900 + [2.0], "few": [5.0, 1.0, 3.0], "none": [None] * 2000, None: [float(i) for i in range(1000)], "outlier": [1e300, -1e300] + rnd.random(2000).tolist()}
    df = spark.createDataFrame([(g, v, None if v is None else -v) for g, values in groups.items() for v in values], "sid string, close double, open double")
    got = {r.sid: r for r in quantiles.medians(df, "sid", ["close", "open"], 150).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        want = None if values[0] is None else float(np.median(values))
        assert got[g].close_fill == (want if want is None else pytest.approx(want, rel=1e-15)) and (want is None or got[g].open_fill == pytest.approx(-want, rel=1e-15)), g
    assert sorted(r.close for r in clean.fill_inf(spark.createDataFrame([("a", 2.0), ("a", 9.0), ("a", None)], "sid string, close double"), "ptp").collect()) == [2.0, 7.0, 9.0]
    with pytest.raises(NotImplementedError):
        clean.fill_inf(df, "argmax", ["close"])


def test_hot_partitions_are_written_by_several_tasks(spark, tmp_path):
    rows = [("600000", datetime(2024, 1, 5) + timedelta(minutes=i), float(i)) for i in range(2000)] + [("600001", datetime(2024, 1, 5), 1.0)]
    rows = rows[::-7] + [x for i, x in enumerate(rows[::-1]) if i % 7]
    assert len(rows) == 2001
    lake.write_lake(bars(spark, rows), str(tmp_path / "plain"))
    (file,) = (tmp_path / "plain").glob("*/*/*/sid=600000/*/*.parquet")
    ticks = [r.tick for r in spark.read.parquet(str(file)).collect()]
    assert len(ticks) == 2000 and ticks == sorted(ticks)
    lake.write_lake(bars(spark, rows), str(tmp_path / "lake"), hot_rows=200)
    files = {sid: list((tmp_path / "lake").glob(f"*/*/*/sid={sid}/*/*.parquet")) for sid in ("600000", "600001")}
    assert 8 <= len(files["600000"]) <= 12 and len(files["600001"]) == 1
    held = [[r.tick for r in spark.read.parquet(str(f)).collect()] for f in files["600000"]]
    assert all(ticks == sorted(ticks) and len(ticks) <= 250 for ticks in held) and sum(map(len, held)) == 2000
    assert lake.scan_lake(spark, str(tmp_path / "lake"), BARS).count() == 2001


@pytest.mark.parametrize("fails", range(1, 5))
def test_interrupted_compaction_is_made_good(spark, tmp_path, monkeypatch, fails):
    root, staging = str(tmp_path / "lake"), str(tmp_path / "staging")
    lake.write_lake(bars(spark, [(s, datetime(2024, 1, 5), 1.0) for s in ("600000", "600001")]), root)
    lake.write_lake(bars(spark, [(s, datetime(2024, 1, 5), 2.0) for s in ("600000", "600001", "600002")]), staging)
    moves, move = [], lake._move

    def killed(*args):
        moves.append(args)
        if len(moves) == fails:
            raise KeyboardInterrupt
        move(*args)

    monkeypatch.setattr(lake, "_move", killed)
    with pytest.raises(KeyboardInterrupt):
        lake.compact(spark, root, staging, BARS, clear=True)
    monkeypatch.setattr(lake, "_move", move)
    assert lake.exists(spark, staging)
    (tmp_path / "lake" / "_swap-unfinished" / "new").mkdir(parents=True)  # ended before its journal
    assert lake.recover(spark, root) == 1 and lake.recover(spark, root) == 0
    assert sorted((r.sid, r.close) for r in lake.scan_lake(spark, root, BARS).collect()) == [("600000", 2.0), ("600001", 2.0), ("600002", 2.0)]
    counts = lake.compact(spark, root, staging, BARS, clear=True)
    assert sorted((r.sid, r.n_rows) for r in counts.collect()) == [("600000", 1), ("600001", 1), ("600002", 1)]
    assert not lake.exists(spark, staging) and not list((tmp_path / "lake").glob("_swap-*"))


def test_database_ranges(spark, tmp_path):
    path = str(tmp_path / "db")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE t (k INT, name TEXT, "odd ""name" REAL)')
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(1 if i % 3 else i * i, f"n{i}", i / 2) for i in range(900)] + [(None, "null", None)])
    connect = lambda: sqlite3.connect(path)
    table = records.read_database(spark, connect, "t", 'k long, name string', "k", 4)
    assert table.count() == 901 and table.rdd.getNumPartitions() == 4  # two thirds of the rows have one key: bounds that are equal count once, and null keys have a range
    assert sorted(r.name for r in table.where("k > 10 and k <= 900").collect()) == ["n12", "n15", "n18", "n21", "n24", "n27", "n30", "n6", "n9"]
    assert table.where("name in ('n3', 'null')").count() == 2 and table.where("name = 'n4'").first().k == 1
    assert records.read_database(spark, connect, "t", "name string").count() == 901
    with sqlite3.connect(path) as db:
        db.execute("DELETE FROM t")
    assert table.count() == 0


def test_intervals(spark):
    rows = spark.createDataFrame([(float(x),) if x is not None else (None,) for x in (0, 1, 4.999, 5, 9, 100, -3, None)], "at double")
    spans = spark.createDataFrame([("a", 0.0, 5.0), ("b", 4.0, 100.0), ("none", 3.0, 3.0), ("back", 9.0, 1.0), ("low", -10.0, 0.0), ("null", None, 5.0)], "name string, low double, high double")
    for width in (0.7, 3.0, 1000.0):
        got = tu.in_intervals(rows, "at", spans, "low", "high", width)
        assert sorted((r.at, r.name) for r in got.collect()) == [(-3.0, "low"), (0.0, "a"), (1.0, "a"), (4.999, "a"), (4.999, "b"), (5.0, "b"), (9.0, "b")]
        assert "Cartesian" not in plan_of(got) and "NestedLoop" not in plan_of(got)
    quarters = tu.quarter_table(spark, date(2023, 11, 5), date(2024, 1, 1)).collect()
    assert [(r.label, r.from_epoch, r.to_epoch) for r in quarters] == [("2023q4", 1696089600, 1704038400), ("2024q1", 1704038400, 1711900800)]


def test_written_files(spark, tmp_path):
    files = spark.createDataFrame([("x/a.bin", bytearray(struct.pack("<3f", 10, 1, 2))), ("b.bin", bytearray(b""))], "path string, content binary")
    for _ in range(2):
        readers.write_files(files, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.bin", "b.bin"]
    assert [r["value"] for r in readers.read_features(spark, str(tmp_path / "out")).collect()] == [1.0, 2.0]


def test_interval_sums_join_places_and_not_rows(spark, monkeypatch):
    join, sizes = tu.in_intervals, []

    def seen(df, at, intervals, *args):
        sizes.append((df.count(), intervals.count()))
        return join(df, at, intervals, *args)

    monkeypatch.setattr(tu, "in_intervals", seen)
    catalog.QUERIES["interval_join"](spark, SF)
    (n_places, n_spans), orders, parts = sizes[0], *(spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("orders", "part"))
    assert n_places <= 84 < orders and n_spans <= min(420, parts)
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (2.0, None), (None, 5.0), (9.0, 1.0)], "at double, x double")
    spans = spark.createDataFrame([("a", 0.0, 2.0), ("b", 0.0, 2.0), ("b", 1.0, 3.0), ("c", 2.0, 3.0), ("none", 3.0, 4.0), ("back", 9.0, 1.0)], "k string, low double, high double")
    got = tu.sums_in_intervals(rows, "at", "x", spans, "k", "low", "high", 0.7)
    assert sorted(map(tuple, got.collect())) == [("a", 2, 5.0), ("b", 5, 10.0), ("c", 1, None)]


@pytest.fixture(scope="module")
def long_keys(spark, tmp_path_factory):
    """Parts whose keys have six and seven digits: ids are cut to six, so several parts have one; two of them are equal but for
    their keys."""
    root = str(tmp_path_factory.mktemp("parts"))
    k = F.col("id")
    rows = spark.range(100000, 100003).union(spark.range(1000000, 1000030)).union(spark.createDataFrame([(108888,), (1088888,)], "id long"))
    rows.select(k.alias("p_partkey"), F.concat(F.lit("part"), k % 20000).alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("SMALL").alias("p_type"), (k % 50).cast("int").alias("p_size"), F.lit(1.0).alias("p_retailprice")).write.parquet(f"{root}/part.parquet")
    return root


def equals_sql(spark, root, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{root}/part.parquet/*.parquet'")
    df, want = catalog.QUERIES[name](spark, root), con.sql(catalog.ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_bulk_update_of_ids_that_several_rows_have(spark, long_keys):
    equals_sql(spark, long_keys, "asset_bulk_update")


def test_assets_of_one_id_are_cleaned_by_key(spark, long_keys):
    equals_sql(spark, long_keys, "asset_clean")


def test_assets_of_one_id_are_all_in_the_database(spark, long_keys):
    equals_sql(spark, long_keys, "database_scan")


def test_many_small_ranges_share_tasks(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"sh60000{i}.01").write_bytes(b"".join(record(date(2024, 1, 5), 571, 10 + j) for j in range(2000 + i)))
    (tmp_path / "sh600009.01").write_bytes(b"")
    raw = records.read_fixed(spark, str(tmp_path), readers.RECORD, readers.BAR_FIELDS, "01$", 64)
    assert raw.rdd.getNumPartitions() <= 1.5 * records.TASKS  # 3,002 ranges
    got = sorted((r.path[-9:-3], r.place, r.open) for r in raw.collect())
    assert got == [(f"60000{i}", j, 10 + j) for i in range(3) for j in range(2000 + i)]


def test_files_of_hot_partitions_stay_few(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quantiles, "MOST_PARTS", 8)
    rows = [("600000", datetime(2024, 1, 1) + timedelta(minutes=i), float(i)) for i in range(8000)]
    lake.write_lake(bars(spark, rows), str(tmp_path / "lake"), hot_rows=50)
    files = list((tmp_path / "lake").glob("*/*/*/*/*/*.parquet"))
    assert 4 <= len(files) <= 16  # 128 or more, if each had 62 rows at most
    assert sorted(r.close for r in lake.scan_lake(spark, str(tmp_path / "lake"), BARS).collect()) == [float(i) for i in range(8000)]

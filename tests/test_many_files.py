"""Loads of many small files: the work of a file stays in few, even tasks, and none of it in the driver."""

from __future__ import annotations

import pytest

from barlake.plans import pipelines
from barlake.sources import lake, readers

SCHEMA = "close double, tick long, type string, year string, quarter string, sid string, date string"


def bars(spark, sids, close):
    return spark.createDataFrame([(close, i, "stock", "2024", "Q1", f"{s:06d}", "202401") for s in sids for i in range(3)], SCHEMA)


@pytest.fixture
def stages(spark):
    """The tasks of each stage of a call."""

    def run(call):
        spark.sparkContext.setJobGroup("stages of a call", "")
        seen = set(spark.sparkContext.statusTracker().getJobIdsForGroup("stages of a call"))
        call()
        tracker = spark.sparkContext.statusTracker()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("stages of a call") if j not in seen]
        infos = [tracker.getStageInfo(s) for j in jobs for s in j.stageIds]
        return [x.numTasks for x in infos if x and x.numCompletedTasks]

    yield run
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_header_is_read_from_one_file(spark, stages, tmp_path):
    for i in range(100):
        (tmp_path / f"SH.6{i:05d}[1].csv").write_text(f"代码,收盘价\n6{i:05d},{i}\n", encoding="utf-8")
    (tmp_path / "SH.600999.csv").write_text("")  # an empty file has no header
    made = []
    read = lambda: made.append(readers.read_csv_bars(spark, str(tmp_path), {"代码": "sid", "收盘价": "close"}, pattern=readers.FILE_NAMES["csv_stock"]))
    assert max(stages(read)) < 20
    assert made[0].columns == ["sid", "close"] and sorted(int(r.close) for r in made[0].collect()) == list(range(100))


def test_small_partitions_are_written_by_all_cores_and_listed_by_few_tasks(spark, stages, tmp_path):
    root = str(tmp_path / "lake")
    written = stages(lambda: lake.write_lake(bars(spark, range(100), 1.0), root))
    assert max(written) >= 2 * spark.sparkContext.defaultParallelism
    assert max(stages(lambda: lake.opened(spark, root, SCHEMA))) <= 4 * spark.sparkContext.defaultParallelism
    assert lake.opened(spark, root, SCHEMA).count() == 300
    assert not list((tmp_path / "lake").glob("_*")) and len(list((tmp_path / "lake").glob("*/*/*/*/*/*.parquet"))) == 100


def test_first_write_of_a_kind_replaces_nothing_else_and_gives_way_to_a_race(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "lake")
    pipelines._to_lake(bars(spark, [1], 1.0).selectExpr("close", "tick", "sid", "timestamp_ntz'2024-01-05 10:00:00' datetime"), root, "fund", False)
    lake.write_lake(bars(spark, [1, 2], 1.0), root, lead="type=stock")
    real, asked = lake.exists, []
    # As if the kind had come between the look and the move: partitions of both are replaced, those of one are kept.
    monkeypatch.setattr(lake, "exists", lambda *x: real(*x) if asked else bool(asked.append(x)))
    lake.write_lake(bars(spark, [2, 3], 2.0), root, lead="type=stock")
    got = {(r.type, r.sid): (r.close, r.n) for r in lake.opened(spark, root, SCHEMA).groupBy("type", "sid", "close").count().withColumnRenamed("count", "n").collect()}
    assert got == {("fund", "000001"): (1.0, 3), ("stock", "000001"): (1.0, 3), ("stock", "000002"): (2.0, 3), ("stock", "000003"): (2.0, 3)}
    assert not list((tmp_path / "lake").glob("_first-*"))


def test_a_new_local_lake_is_as_spark_writes_it_without_a_process_for_each_file(spark, tmp_path):
    sids = ["000001", None, "", "a=b/c", "100%", "上证 [x]'\"{^:#*?\\", "t\tt\x7f", "__HIVE_DEFAULT_PARTITION__"]
    made = spark.createDataFrame([(s, i) for s in sids for i in range(25)], "sid string, tick long").selectExpr(
        "sid", "tick", "'stock' type", "'2024' year", "nullif('Q1', sid) quarter", "'202401' date", "if(tick % 5 = 0, null, tick / 4) close", "cast(tick as short) n", "cast(tick as byte) b", "cast(tick as float) f",
        "timestamp'2024-01-05 10:00:00.123456' + make_interval(0, 0, 0, 0, 0, 0, tick) at", "timestamp_ntz'1500-01-05 10:00:00.123456' ntz", "date'1500-01-05' day", "cast(tick as decimal(38,6)) d", "tick % 2 = 0 flag", "cast(sid as binary) raw", "nullif(sid, '') text")
    ours, spark_s = tmp_path / "ours", tmp_path / "spark"
    lake.write_lake(made, str(ours), file_rows=10)
    lake.write_lake(made, str(spark_s), append=True, file_rows=10)
    folders = lambda root: sorted((str(p.parent.relative_to(root)) for p in root.rglob("*.parquet") if p.name[0] != "."))
    assert len(set(folders(ours))) == 6 and set(folders(ours)) == set(folders(spark_s))
    assert len(folders(ours)) == len(folders(spark_s)) and not list(ours.glob("_*"))
    schema = lake.shaped(made).schema
    rows = [sorted(map(repr, lake.opened(spark, str(x), schema).collect())) for x in (ours, spark_s)]
    assert rows[0] == rows[1] and len(rows[0]) == 200
    assert spark.read.parquet(str(ours)).drop(*lake.KEYS).dtypes == spark.read.parquet(str(spark_s)).drop(*lake.KEYS).dtypes
    # Hadoop's local file system writes a checksum beside each file, and starts a process for each of both.
    assert list(spark_s.rglob(".*.crc")) and not list(ours.rglob(".*.crc"))


def test_a_new_local_lake_may_be_empty_or_have_types_that_spark_writes(spark, tmp_path):
    lake.write_lake(bars(spark, [], 1.0), str(tmp_path / "none"))
    assert lake.opened(spark, str(tmp_path / "none"), SCHEMA).count() == 0
    lists = bars(spark, [1, 2], 1.0).selectExpr("array(close) closes", "tick", *lake.KEYS)
    lake.write_lake(lists, str(tmp_path / "lists"))
    assert sorted(r.closes for r in lake.opened(spark, str(tmp_path / "lists"), lists.schema).collect()) == [[1.0]] * 6

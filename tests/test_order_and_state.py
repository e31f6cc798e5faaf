"""Order of rows, files that are set aside, frames in one pass, and the stream that passes on changed bars only."""

from __future__ import annotations

from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barlake.operators import clean, frames, order
from barlake.plans import pipelines
from barlake.sources import lake, readers
from barlake.streaming import ingest
from test_toolkit import BARS, bars, record

SCHEMA = "amount long, close long, datetime timestamp, tick long, volume long, type string, year string, quarter string, sid string, date string"


def test_rows_return_in_the_order_of_their_files(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "2.csv").write_text("sid,close\n" + "".join(f"x,{i}\n" for i in range(50, 0, -1)))
    (tmp_path / "1.csv").write_text("sid,close\nx,7\nx,NaN\nx,7\n")
    rows = readers.read_csv_bars(spark, str(tmp_path), {}, "sid string, close double", dedup=False, place=True)
    filled = clean.fill_inf(rows.repartition(7, F.rand(1)), "max", ["close"])
    want = [7.0, 50.0, 7.0, *map(float, range(50, 0, -1))]
    assert [r.close for r in order.restored(filled).collect()] == want
    got = order.indexed(filled).collect()
    assert [r.close for r in sorted(got, key=lambda r: r.row_index)] == want and sorted(r.row_index for r in got) == list(range(53))
    once = readers.read_csv_bars(spark, str(tmp_path), {}, "sid string, close double", place=True)
    assert [r.close for r in order.restored(once).collect()][0] == 7.0 and once.count() == 51
    assert order.indexed(filled.limit(0)).count() == 0


def test_bad_files_are_set_aside(spark, tmp_path):
    source, root = tmp_path / "vendor", str(tmp_path / "lake")
    source.mkdir()
    day = datetime(2024, 1, 5)
    (source / "sh600000.01").write_bytes(record(day, 600, 1000) + b"rest")
    (source / "sh600001.01").write_bytes(record(day, 600, 1000) + record(day, 1500, 1000))
    (source / "sh600002.01").write_bytes(b"")
    bad = pipelines.stock_bin(spark, str(source), root, on_error="skip").collect()
    assert [(r.path.rpartition("/")[2], r.reason, r.n_rows) for r in bad] == [("sh600001.01", "no such time", 1)]
    assert [r.sid for r in spark.read.schema(SCHEMA).parquet(root).collect()] == ["600000"]
    with pytest.raises(Exception, match="hour|Hour|HourOfDay|DATETIME"):
        pipelines.stock_bin(spark, str(source), root)
    with pytest.raises(ValueError, match="on_error"):
        pipelines.stock_bin(spark, str(source), root, on_error="ignore")


def test_bad_csv_files_are_set_aside(spark, tmp_path):
    source, root = tmp_path / "vendor", str(tmp_path / "lake")
    source.mkdir()
    header = ",".join(pipelines.STOCK_HEADER) + "\n"
    row = "{},SH.{},1.5,2,1,1.5,{},10\n"
    (source / "SH.600000.csv").write_text(header + row.format("2024-01-05 10:00:00", 600000, 7) * 2)
    (source / "SH.600001.csv").write_text(header + row.format("2024-01-05 10:00:00", 600001, "seven"))
    (source / "SH.600002.csv").write_text(header + row.format("2024-13-05 10:00:00", 600002, 7) + row.format("2024-01-05 10:00:00", 600002, 7))
    # Another kind's header must not be taken for this kind's.
    (source / "AA.csv").write_text("a,b,c,d,e,f,g,h\n")
    bad = pipelines.stock_csv(spark, str(source), root, on_error="skip").collect()
    assert {r.path.rpartition("/")[2]: (r.reason, r.n_rows) for r in bad} == {"SH.600001.csv": ("no number", 1), "SH.600002.csv": ("no such time", 1)}
    assert [(r.sid, r.close, r.volume) for r in spark.read.schema(SCHEMA).parquet(root).collect()] == [("600000", 150000, 700000)]


def _frames(spark, data, hot=frames.HOT_ROWS):
    df = spark.createDataFrame(data, "sid string, k long, v double")
    out = frames.export(df, "tick", "sid", "k", 3, hot)
    got = {}
    for r in out.collect():
        meta, held = frames.decode_frame(r.payload)
        assert meta["sid"] == str(r.sid) and held.num_rows == r.n_rows and (r.sid, r.frame) not in got
        got[r.sid, r.frame] = held["k"].to_pylist()
    return out, got


@pytest.mark.parametrize("batch", [1, 5, 10_000])
def test_frames_are_cut_in_one_pass(spark, batch):
    rows = [(s, k, None if k % 4 else 1.0) for s, n in (("a", 7), ("b", 3), (None, 4), ("c", 1)) for k in reversed(range(n))]
    want = {(s, f): list(range(f * 3, min(n, f * 3 + 3))) for s, n in (("a", 7), ("b", 3), (None, 4), ("c", 1)) for f in range(-(-n // 3))}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        out, got = _frames(spark, rows)
        assert got == want
        assert _frames(spark, rows, 4)[1] == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange ") == 1 and plan.count("Sort ") == 1
    assert _frames(spark, [])[1] == {}
    assert isinstance(frames.decode_frame(out.first().payload)[1], pa.Table)


def test_only_changed_bars_are_passed_on(spark, tmp_path):
    src = str(tmp_path / "src")
    late, now = datetime(2023, 2, 1, 10), datetime(2024, 1, 5, 10)
    batches = [
        [("000001", now, 1.0), ("000001", late, 9.0), ("000002", now, 2.0)],
        [("000001", now, 1.0), ("000001", late, 9.0), ("000002", now, 2.0)],  # the same again
        [("000001", now, 3.0), ("000002", now, 2.0), ("000003", now, 5.0), ("000003", now, 6.0), ("000003", now, 6.0)],  # two bars of a tick
        [("000001", now, 1.0), ("000001", late, None), ("000003", now, 6.0), ("000003", now, 5.0)],  # one is changed back
    ]
    seen = []
    for rows in batches:
        lake.shaped(bars(spark, rows)).coalesce(1).write.mode("append").parquet(src)
        passed = ingest.changed(ingest._arriving(spark, src, BARS)).writeStream.foreachBatch(lambda b, _: seen.append([(r.sid, r.close) for r in b.collect()]))
        ended = ingest.started(spark, passed.outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True))
        assert ended.awaitTermination(60)
    assert [sorted(x, key=str) for x in seen if x] == [
        [("000001", 1.0), ("000001", 9.0), ("000002", 2.0)],
        [("000001", 3.0), ("000003", 5.0), ("000003", 6.0)],
        [("000001", 1.0), ("000001", None)],
    ]


def test_changed_bars_reach_the_lake(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "lake")
    now = datetime(2024, 1, 5, 10)
    for close in (1.0, 2.0):
        lake.shaped(bars(spark, [("000001", now, close), ("000002", now, 2.0)])).coalesce(1).write.mode("append").parquet(src)
        assert ingest.ingest_changed(spark, src, root, BARS, str(tmp_path / "check")).awaitTermination(60)
    got = spark.read.schema(BARS).parquet(root).collect()
    assert sorted((r.sid, r.close) for r in got) == [("000001", 2.0), ("000002", 2.0)]
    assert {r.datetime for r in got} == {datetime(2024, 1, 5, 2)}

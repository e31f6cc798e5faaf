"""Splitting results for export: runs of an id, numbered chunks, Arrow frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import HOT_ROWS, stretches

CHUNK = 1024


def runs(df: DataFrame, by: str, order: str, within: str, rows: int = HOT_ROWS) -> DataFrame:
    """Runs of equal values in an order, inside each group of `within`: the value, the run's number, its first and last
    place in the order, and its rows. Groups of more than `rows` rows are cut into stretches of the order that hold equally
    many, so a hot one isn't one task: runs are numbered in each stretch, and its first row is compared with the last one of
    the stretch before."""
    marked, cut = stretches(df.select(within, by, order), [within], order, rows)
    rank = Window.partitionBy(within, "stretch").orderBy(order)
    first = F.row_number().over(rank) == 1
    new = F.when(first, 0 if cut else 1).otherwise(F.coalesce((F.lag(by).over(rank) != F.col(by)).cast("int"), F.lit(1)))
    marked = marked.select("*", new.alias("new")).withColumn("run", F.sum("new").over(rank.rowsBetween(Window.unboundedPreceding, 0)))
    if cut:
        ends = marked.groupBy(within, "stretch").agg(F.min_by(by, order).alias("head"), F.max_by(by, order).alias("tail"), F.sum("new").alias("news"))
        along = Window.partitionBy(within).orderBy("stretch")
        ends = ends.withColumn("opens", F.coalesce((F.lag("tail").over(along) != F.col("head")).cast("int"), F.lit(1)))
        ends = ends.withColumn("before", F.sum(F.col("news") + F.col("opens")).over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("news"))
        ends = ends.select(F.col(within).alias("within_of"), F.col("stretch").alias("stretch_of"), "before")
        marked = marked.join(ends, marked[within].eqNullSafe(ends["within_of"]) & (F.col("stretch") == F.col("stretch_of"))).withColumn("run", F.col("run") + F.col("before"))
    return marked.groupBy(within, by, "run").agg(F.min(order).alias("run_start"), F.max(order).alias("run_end"), F.count("*").alias("n_rows"))


def chunks(df: DataFrame, by: str, order: str, size: int = CHUNK, rows: int = HOT_ROWS) -> DataFrame:
    """Add the frame number of each row: at most `size` rows of one id. An id of more than `rows` rows is numbered in
    stretches of the order that hold equally many, so a hot one isn't one task."""
    return _chunks(df, by, order, size, rows)[0]


def _chunks(df: DataFrame, by: str, order: str, size: int, rows: int) -> tuple[DataFrame, bool]:
    """chunks(), and whether an id was cut; if none was, the rows of an id lie together, in order."""
    marked, cut = stretches(df, [by], order, rows)
    place = F.row_number().over(Window.partitionBy(by, "stretch").orderBy(order))
    ranked = marked.withColumn("place", place)
    if not cut:
        return ranked.select(*df.columns, F.floor((F.col("place") - 1) / size).alias("frame")), False
    counts = marked.groupBy(by, "stretch").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(by).orderBy("stretch").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    counts = counts.select(F.col(by).alias("group_of"), F.col("stretch").alias("stretch_of"), before.alias("before"))
    joined = ranked.join(counts, F.col(by).eqNullSafe(F.col("group_of")) & (F.col("stretch") == F.col("stretch_of")))
    return joined.select(*df.columns, F.floor((F.col("place") + F.col("before") - 1) / size).alias("frame")), True


def export(df: DataFrame, kind: str, by: str, order: str, size: int = CHUNK, rows: int = HOT_ROWS) -> DataFrame:
    """One row for each frame: id, frame, n_rows and payload, an lz4-compressed Arrow stream with the kind and the id in
    its metadata.

    Rows are shuffled and sorted once, by id; frames are cut from the batches of a task in one pass, which holds one frame
    and one batch. Only where an id has more than `rows` rows do the numbered frames get a shuffle of their own, so that it
    isn't one task.
    """

    def packed(table: pa.Table) -> tuple:
        sid, frame = table[by][0].as_py(), table["frame"][0].as_py()
        held = table.drop_columns([by, "frame"]).combine_chunks().replace_schema_metadata({"rpc_type": kind, "sid": str(sid)})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
            writer.write_table(held)
        return sid, frame, held.num_rows, sink.getvalue().to_pybytes()

    def differ(a: pa.Array, b: pa.Array) -> pa.Array:
        return pc.coalesce(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])]).combine_chunks()
            new = [differ(table[c].slice(0, table.num_rows - 1), table[c].slice(1)) for c in (by, "frame")]
            ends = np.flatnonzero(pc.or_(*new).to_numpy()) + 1
            begins = [0, *ends.tolist()]
            yield from framed([packed(table.slice(i, j - i)) for i, j in zip(begins, ends.tolist(), strict=False)])
            rest = table.slice(begins[-1])
        if rest is not None:
            yield from framed([packed(rest)])

    def framed(out: list[tuple]) -> Iterator[pa.RecordBatch]:
        if out:
            types = (pa.string(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], [by, "frame", "n_rows", "payload"])

    numbered, several = _chunks(df, by, order, size, rows)
    numbered = numbered.repartition(by, "frame") if several else numbered
    # Where no id was cut the rows are in this order already, and Spark leaves the sort out.
    return numbered.sortWithinPartitions(by, *(["frame"] if several else []), order).mapInArrow(cut, f"{by} string, frame long, n_rows long, payload binary")


def decode_frame(payload: bytes) -> tuple[dict[str, str], pa.Table]:
    table = pa.ipc.open_stream(payload).read_all()
    return {k.decode(): v.decode() for k, v in (table.schema.metadata or {}).items()}, table

"""Readers of vendor files: binary bars, CSV, text, feature files; discovery by suffix and name."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import records

#: A vendor's bar of 32 bytes, little-endian, and what is read of it.
RECORD = np.dtype([("dates", "<u2"), ("sub_dates", "<i2"), ("open", "<u4"), ("high", "<u4"), ("low", "<u4"), ("close", "<u4"), ("amount", "<f4"), ("volume", "<i4"), ("appendix", "<i4")])
BAR_FIELDS = "dates int, sub_dates short, open long, high long, low long, close long, amount float, volume int"
BAR_SCHEMA = f"path string, place long, {BAR_FIELDS}"
#: Bytes from which on a file is read in ranges, if no other split is asked for: a row of Spark holds less than 2 GB.
WHOLE = 1 << 30
#: Names of files that a dataset takes, by format and kind.
FILE_NAMES = {
    "bin_stock": r"^(sh6|sz0|sz3)[0-9]{5}.*\.01$", "bin_fund": r"^(sh51|sz15|sz16)[0-9]{4}.*\.01$", "bin_any": r"\.01$",
    "csv_stock": r"^(SH\.6|SZ\.0|SZ\.3)[0-9]{5}.*\.csv$", "csv_fund": r"^(SH\.51|SZ\.15|SZ\.16)[0-9]{4}.*\.csv$", "csv_any": r"\.csv$",
}
#: Globs for listing that hold all names of a kind: a CSV reader takes its header from the first file listed.
GLOBS = {FILE_NAMES["csv_stock"]: "{SH.6,SZ.0,SZ.3}*.csv", FILE_NAMES["csv_fund"]: "{SH.51,SZ.15,SZ.16}*.csv"}


def file_sid(path: Column) -> Column:
    """The id in a file's name: up to the first dot, without the market's two letters."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.substring(F.split(name, r"\.")[0], F.lit(3), F.length(name))


def discover(spark: SparkSession, root: str, suffix: str = "", pattern: str = "", since: datetime | None = None) -> DataFrame:
    """path, name, size and modification time of the files under a folder (or one file); contents aren't read.

    since: only files modified later. A missing folder raises; Spark leaves empty files out.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    files = reader.load(root).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    files = files.where(F.col("name").rlike(pattern)) if pattern else files
    return files.where(F.col("modified") > F.lit(since)) if since else files


def of_kind(files: DataFrame, kind: str) -> DataFrame:
    """The files of a dataset kind, such as bin_stock; an unknown kind raises KeyError."""
    return files.where(F.col("name").rlike(FILE_NAMES[kind]))


def _files(spark: SparkSession, root: str, suffix: str, pattern: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(root)
    return files.where(F.element_at(F.split("path", "/"), -1).rlike(pattern)) if pattern else files


def read_binary_bars(spark: SparkSession, root: str, pattern: str = FILE_NAMES["bin_any"], dedup: bool = True, subset: list[str] | None = None, split: int = 0, skip: DataFrame | None = None, paths: bool = False) -> DataFrame:
    """Bars of binary files under a folder; see decode_bars(). skip: a frame of the paths (path) of files to leave out.

    Where a file has `WHOLE` bytes or more, or `split` is given, the files are read in byte ranges, each a task of its own.
    """
    if not split and discover(spark, root, "", pattern).where(F.col("size") >= WHOLE).limit(1).count():
        split = records.RANGE
    if split:
        return _bars(records.read_fixed(spark, root, RECORD, BAR_FIELDS, pattern, split), dedup, subset, skip, paths)
    return decode_bars(_files(spark, root, "", pattern), dedup, subset, skip, paths)


def _bars(rows: DataFrame, dedup: bool, subset: list[str] | None, skip: DataFrame | None, paths: bool) -> DataFrame:
    """Records without those that repeat in their file: of equal rows one, or of equal keys the first."""
    rows = rows.join(skip.select("path"), "path", "left_anti") if skip else rows
    if dedup and subset:
        rank = F.row_number().over(Window.partitionBy("path", *subset).orderBy("place"))
        rows = rows.withColumn("row_rank", rank).where("row_rank = 1").drop("row_rank")
    elif dedup:
        rows = rows.drop("place").dropDuplicates()
    return rows.withColumn("sid", file_sid(F.col("path"))).drop("place", *([] if paths else ["path"]))


def decode_bars(files: DataFrame, dedup: bool = True, subset: list[str] | None = None, skip: DataFrame | None = None, paths: bool = False) -> DataFrame:
    """Bars of files (path, content): the record's fields but the last, and sid from the file's name; the path, if asked for.

    A trailing part of a record is ignored; equal rows of a file count once, or, with `subset`, the first row of each of its
    keys; an empty file has no rows.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                rows = np.frombuffer(content, RECORD, len(content) // RECORD.itemsize)
                if len(rows):
                    kinds = (pa.int32(), pa.int16(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(np.arange(len(rows))), *(pa.array(rows[c], t) for c, t in zip(RECORD.names, kinds, strict=False))], ["path", "place", *RECORD.names[:-1]])

    return _bars(files.select("path", "content").mapInArrow(decode, BAR_SCHEMA), dedup, subset, skip, paths)


def read_csv_bars(spark: SparkSession, root: str, rename: dict[str, str], schema: str | None = None, sep: str = ",", subset: list[str] | None = None, pattern: str = "", dedup: bool = True, place: bool = False, skip: DataFrame | None = None) -> DataFrame:
    """CSV with a header, renamed, without repeated rows, or with the first row of each key in `subset`: the first of
    the first file, by path and by place in it. pattern: only files whose names it finds; skip: a frame of the paths (path)
    of files to leave out; place: keep where a row stood (see placed()), of repeated rows the first place."""
    glob = GLOBS.get(pattern, "*.csv")
    reader = spark.read.option("header", "true").option("sep", sep).option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    schema = schema or _header(spark, root, sep, glob)
    rows = (reader.schema(schema) if schema else reader).csv(root)
    rows = rows.where(F.col("_metadata.file_name").rlike(pattern)) if pattern else rows
    if not (subset or place or skip):
        rows = rows.withColumnsRenamed(rename)
        return rows.dropDuplicates() if dedup else rows
    rows = placed(rows).withColumnsRenamed(rename)
    rows = rows.join(skip.select("path"), rows["row_place.path"] == skip["path"], "left_anti") if skip else rows
    rows = _first(rows, subset or [c for c in rows.columns if c != "row_place"]) if subset or dedup else rows
    return rows if place else rows.drop("row_place")


def _header(spark: SparkSession, root: str, sep: str, glob: str) -> StructType | None:
    """Text columns by the header of the largest file, if there is one. Spark, left to find the header in a folder, lists
    every file in a task of its own."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    largest = files.select("path", "length").orderBy(F.desc("length"), "path").first()
    if largest is None:
        return None
    path = re.sub(r"([\\{}\[\]*?])", r"\\\1", largest["path"])  # it is no pattern
    return spark.read.option("header", "true").option("sep", sep).csv(path).schema


def placed(rows: DataFrame) -> DataFrame:
    """Rows as a file source has read them, with row_place: path, the block's begin in the file, and a number that grows
    along the block. It sorts as the rows stand in their files, and travels with them through joins and shuffles."""
    block = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return rows.select("*", block.alias("row_place"))


def _first(rows: DataFrame, subset: list[str]) -> DataFrame:
    """The first row of each key, by row_place."""
    rank = F.row_number().over(Window.partitionBy(*subset).orderBy("row_place"))
    return rows.withColumn("row_rank", rank).where("row_rank = 1").drop("row_rank")


def read_lines(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.text(root).withColumnRenamed("value", "line")


def read_avro(spark: SparkSession, root: str, subset: list[str] | None = None) -> DataFrame:
    """Avro rows without repeats; needs the Avro module on Spark's classpath."""
    rows = spark.read.format("avro").load(root)
    return _first(placed(rows), subset).drop("row_place") if subset else rows.dropDuplicates()


def write_avro(rows: DataFrame, root: str, append: bool = False, codec: str = "snappy", schema: str = "") -> None:
    """Avro files, in a given Avro schema (the text of an .avsc file) if there is one; needs the Avro module on Spark's
    classpath."""
    writer = rows.write.format("avro").option("compression", codec).mode("append" if append else "overwrite")
    (writer.option("avroSchema", schema) if schema else writer).save(root)


def write_text(rows: DataFrame, root: str, sep: str = ",", header: bool = True, append: bool = False) -> None:
    """Delimited text in UTF-8, with a header in each file; instants as ISO 8601, null as an empty field."""
    writer = rows.write.option("sep", sep).option("header", str(header).lower()).option("encoding", "UTF-8").option("emptyValue", "")
    writer.mode("append" if append else "overwrite").csv(root)


def write_files(files: DataFrame, root: str) -> None:
    """Files (path, content) under a folder of a store that Arrow opens, by the last part of their paths; those of equal
    names replace each other. A file is written whole, beside its name, and then moved to it, so a task may run again."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(root)
        store.create_dir(top, recursive=True)
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                name = path.rpartition("/")[2]
                beside = f"{top}/.{name}-{uuid.uuid4().hex}"
                with store.open_output_stream(beside) as out:
                    out.write(content)
                store.move(beside, f"{top}/{name}")
            yield pa.RecordBatch.from_arrays([batch["path"]], ["path"])

    files.select("path", "content").mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()


def read_table(spark: SparkSession, url: str, name: str, key: str = "", low: int = 0, high: int = 0, parts: int = 8, **options: str) -> DataFrame:
    """A database table over JDBC, in parts of a numeric key if one is named; needs a driver on the classpath."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, fetchsize="10000", **options)
    if key:
        reader = reader.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.load()


def read_features(spark: SparkSession, root: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Feature files under a folder; see decode_features()."""
    return decode_features(_files(spark, root, ".bin", ""), start, end)


def decode_features(files: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Files (path, content) of a float32 start index, then float32 values, to rows (path, index, value) with
    start <= index <= end."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                data = np.frombuffer(content, "<f4", len(content) // 4)
                if len(data) < 2:
                    continue
                index = int(data[0]) + np.arange(len(data) - 1)
                keep = (index >= (index[0] if start is None else start)) & (index <= (index[-1] if end is None else end))
                yield pa.RecordBatch.from_arrays([pa.array([path] * int(keep.sum()), pa.string()), pa.array(index[keep], pa.int64()), pa.array(data[1:][keep], pa.float32())], ["path", "index", "value"])

    return files.select("path", "content").mapInArrow(decode, "path string, index long, value float")

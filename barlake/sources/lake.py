"""The bar lake: Parquet in folders type / year / quarter / sid / date. Writing, scanning, merging and repair."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import timeutil
from ..operators import clean, quantiles

KEYS = ["type", "year", "quarter", "sid", "date"]
#: Rows of a file and bytes of a row group at most; months of which the folders are listed for a scan or a merge.
FILE_ROWS, ROW_GROUP, MONTHS = 1_000_000, 128 << 20, 1200
#: Different ids that are broadcast at most; 64-bit words of the bitmap that stands for more of them.
BROADCAST_IDS, BITMAP_WORDS = 500_000, 1 << 20
#: Fixed value: what Spark calls the folder of a null key.
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"
#: A folder of a lake in which new partitions wait to be moved in; Spark's readers pass over names that begin so.
SWAP = "_swap-"
#: A folder of a lake in which the first bars of a kind are written; passed over likewise.
FIRST = "_first-"
#: Types and codecs that Arrow writes to Parquet as Spark reads them; bytes of rows in memory for one group of rows there.
PLAIN = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.StringType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType)
CODECS, HELD = ("zstd", "snappy", "gzip", "none"), 32 << 20


def shaped(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Data columns in alphabetical order, then the keys as text; instants to the millisecond."""
    data = sorted(c for c in df.columns if c not in keys)
    stamp = lambda c: F.date_trunc("millisecond", F.col(c)).alias(c) if isinstance(df.schema[c].dataType, T.TimestampType) else F.col(c)
    return df.select(*(stamp(c) for c in data), *(F.col(k).cast("string") for k in keys if k in df.columns))


def write_lake(df: DataFrame, root: str, append: bool = False, keys: list[str] = KEYS, order: str = "tick", file_rows: int = FILE_ROWS, most: int = 0, codec: str = "zstd", row_group: int = ROW_GROUP, hot_rows: int = 0, lead: str = "") -> None:
    """Write bars into their partitions, sorted by tick: replace the partitions that they touch, or add files.

    The input is computed once. All rows of a partition go to one task, which starts a new file every `file_rows` rows; a
    partition is a security's month, so it is small. Where partitions may be large, `hot_rows` lets those with more rows be
    written by several tasks, each a stretch of the order of about so many rows (or more, where a partition would have more
    than `quantiles.MOST_PARTS` stretches, so that its files stay few); that costs a count by keys, and a sketch of
    the large ones. Where `most` is given, more partitions than that raise, which costs a count of the keys beforehand.
    `row_group` is a row group's size in bytes. `lead`, such as type=stock, is a folder of the lake that all bars go to, if
    there is one. Where that folder (or the lake) isn't there yet, nothing is replaced, and the bars are written beside it
    and moved in by one rename for each top folder: Spark's dynamic overwrite makes and moves each partition in the driver.
    On a local file system (a mount that all share, on a cluster) Arrow writes them, as Hadoop starts a process for each
    new folder and file there; see _written().
    """
    spark = df.sparkSession
    keys = [k for k in keys if k in df.columns]
    if most and df.select(*keys).distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} partitions")
    # Spark's writer sorts anew, by the keys alone, where a key may be null or is a constant (which falls out of a sort):
    # so null keys get their folder's name here, and no key is seen to be constant.
    whole = lambda k: F.when(F.spark_partition_id() < 0, F.lit(NULL_FOLDER)).otherwise(F.coalesce(F.col(k), F.lit(NULL_FOLDER)))
    out = shaped(df, keys).withColumns({k: whole(k) for k in keys})
    if hot_rows:
        cut, longest = quantiles.stretches(out, keys, order, hot_rows)
        file_rows = min(file_rows, max(hot_rows, longest) * 5 // 4)  # a task may get several stretches
        out = cut.repartition(_tasks(spark), *keys, "stretch").sortWithinPartitions(*keys, order).drop("stretch")
    else:
        out = out.repartition(_tasks(spark), *keys).sortWithinPartitions(*keys, order)
    writer = out.write.option("maxRecordsPerFile", file_rows).option("compression", codec).option("parquet.block.size", row_group).partitionBy(*keys)
    if append or exists(spark, f"{root.rstrip('/')}/{lead}"):
        writer.mode("append" if append else "overwrite").option("partitionOverwriteMode", "dynamic").parquet(root)
        return
    folder = f"{root.rstrip('/')}/{FIRST}{uuid.uuid4().hex}"
    try:
        local = _local(spark, folder)
        if local and codec in CODECS and len(out.columns) > len(keys) and all(isinstance(f.dataType, PLAIN) for f in out.schema):
            _written(out, local, keys, file_rows, codec, min(row_group, HELD))
        else:
            writer.parquet(folder)
        if not _moved_in(spark, folder, root):  # someone else wrote such bars meanwhile, which these replace
            rest = opened(spark, folder, out.schema)
            write_lake(rest, root, False, keys, order, file_rows, 0, codec, row_group, hot_rows)
    finally:
        empty(spark, folder)


def _local(spark: SparkSession, folder: str) -> str:
    """A path's name on a local file system; empty on any other one."""
    fs, path = _store(spark, folder)
    return fs.makeQualified(path(folder)).toUri().getPath() if fs.getUri().getScheme() == "file" else ""


def _written(df: DataFrame, folder: str, keys: list[str], file_rows: int, codec: str, held: int) -> None:
    """Write rows that are sorted by text keys in each task to partition folders of a new local folder, as Spark names them.

    A task has one file open, and holds up to `held` bytes of rows for it. A file is written beside the partitions and
    moved to its name, which the task's number settles, so a task may run again, also while its first run goes on.
    """
    job, data = uuid.uuid4().hex, [c for c in df.columns if c not in keys]
    os.makedirs(folder)  # also for no rows

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        beside = f"{folder}/_beside/{uuid.uuid4().hex}"
        os.makedirs(f"{folder}/_beside", exist_ok=True)
        task, writer, current, parts = TaskContext.get().partitionId(), None, None, []
        n_rows = n_files = size = 0

        def place(values: list[str]) -> str:
            escaped = (re.sub("[\x01-\x1f\x7f\"#%'*/:=?\\\\{\\[\\]^]", lambda m: f"%{ord(m[0]):02X}", x) or NULL_FOLDER for x in values)
            return "/".join([folder, *(f"{k}={x}" for k, x in zip(keys, escaped, strict=True))])

        def flush() -> None:
            nonlocal writer, parts, size
            if parts:
                table = pa.Table.from_batches(parts)
                writer = writer or pq.ParquetWriter(beside, table.schema, compression=codec, store_schema=False)
                writer.write_table(table)
                parts, size = [], 0

        def close() -> None:
            nonlocal writer, n_rows, n_files
            flush()
            if writer:
                writer.close()
                to = place(current)
                os.makedirs(to, exist_ok=True)
                os.replace(beside, f"{to}/part-{task:05d}-{job}.c{n_files:03d}.{codec}.parquet")
                writer, n_rows, n_files = None, 0, n_files + 1

        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for k in keys:
                new[1:] |= pc.not_equal(batch[k].slice(1), batch[k].slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(new).tolist()
            rows = batch.select(data)
            for begin, end in zip(begins, [*begins[1:], batch.num_rows], strict=True):
                own = [batch[k][begin].as_py() for k in keys]
                if own != current:
                    close()
                    current = own
                while begin < end:
                    part = rows.slice(begin, min(end - begin, file_rows - n_rows))
                    parts.append(part)
                    begin, n_rows, size = begin + part.num_rows, n_rows + part.num_rows, size + part.nbytes
                    if n_rows == file_rows:
                        close()
                    elif size >= held:
                        flush()
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])
        close()

    df.mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()


def _tasks(spark: SparkSession) -> int:
    """Tasks of a write. A small file costs much more than its bytes, by which adaptive execution would join tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def _moved_in(spark: SparkSession, folder: str, root: str) -> bool:
    """Move the top folders of new bars into a lake that has none of them; whether all could be moved."""
    fs, path = _store(spark, root)
    for name in _leaves(fs, path(folder), 1):
        if fs.exists(path(f"{root}/{name}")) or not fs.rename(path(f"{folder}/{name}"), path(f"{root}/{name}")):
            return False
    return True


def opened(spark: SparkSession, root: str, schema: T.StructType | str) -> DataFrame:
    """All bars of a lake. Its folders are listed by a few tasks for each core; Spark would make a task for each folder."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(min(int(before or 10_000), 4 * spark.sparkContext.defaultParallelism)))
    try:
        return spark.read.schema(schema).parquet(root)
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def scan_lake(spark: SparkSession, root: str, schema: T.StructType | str, sids: list[str] | DataFrame | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Bars of a lake. Lists of ids and the months of a request prune folders; the instants filter within them.

    The schema is given, since folder names such as sid=000001 aren't numbers. A frame of ids is a semi join.
    """
    bars = opened(spark, root, schema)
    bars = within(bars, start, end) if start is not None and end is not None else bars
    return with_sids(bars, sids)


def within(bars: DataFrame, start: int, end: int) -> DataFrame:
    """The bars of a request's range. Of a lake's bars (known by their key columns) only the folders of its years,
    quarters and months are read: bounds of the instant alone say nothing about folders to Spark."""
    months = timeutil.months(start, end)
    if {"year", "quarter", "date"} <= set(bars.columns):
        bars = bars.where(F.col("date").between(months[0], months[-1]) & F.col("year").between(months[0][:4], months[-1][:4]))
        if len(months) < 10:
            bars = bars.where(F.col("quarter").isin(sorted({f"Q{(int(m[4:]) + 2) // 3}" for m in months})))
    return bars.where(in_range(F.col("datetime"), start, end))


def in_range(at, start: int, end: int):  # noqa: ANN001, ANN201
    """Instants from the begin of the start day (or its epoch) to the end of the end day (or its epoch), inclusive."""
    bound = lambda x, last: F.timestamp_seconds(F.lit(int(timeutil.flex_bound(x, last).timestamp())))
    return at.between(bound(start, False), bound(end, True))


def with_sids(df: DataFrame, sids: list[str] | DataFrame | None) -> DataFrame:
    """The rows of some ids: a list, or a frame with a column sid (of any size, repeats allowed); all rows if None."""
    if sids is None:
        return df
    return semi_join(df, sids) if isinstance(sids, DataFrame) else df.where(F.col("sid").isin(list(dict.fromkeys(sids))))


def semi_join(df: DataFrame, ids: DataFrame, key: str = "sid", most: int = BROADCAST_IDS) -> DataFrame:
    """The rows of df whose text key is among those of ids.

    Up to `most` different ids are broadcast, and where the key is a folder of a lake, Spark skips the other folders
    (dynamic partition pruning, which wants to see a predicate on the ids' side; this one keeps all but nulls). More ids
    are first made a bitmap of fixed size, which is broadcast and drops most rows of other ids before the join's shuffle.
    """
    wanted = ids.select(key).where(F.col(key) >= "").distinct()
    if wanted.limit(most + 1).count() <= most:
        return df.join(F.broadcast(wanted), key, "left_semi").select(df.columns)
    slot, word = F.pmod(F.xxhash64(F.col(key)), F.lit(64 * BITMAP_WORDS)), "bitmap_word"
    words = wanted.select(slot.alias("slot")).groupBy(F.expr("shiftright(slot, 6)").alias(word)).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bitmap_bits"))
    marked = df.withColumn("bitmap_slot", slot)
    near = marked.join(F.broadcast(words), F.expr("shiftright(bitmap_slot, 6)") == words[word]).where("(shiftright(bitmap_bits, cast(bitmap_slot & 63 as int)) & 1) = 1")
    return near.join(wanted, key, "left_semi").select(df.columns)


def merge_bars(target: DataFrame, staging: DataFrame, keys: list[str]) -> DataFrame:
    """Bars of both, one for each key and tick; staging wins."""
    both = target.withColumn("priority", F.lit(0)).unionByName(staging.withColumn("priority", F.lit(1)))
    return clean.keep_last(both, [*keys, "tick"], [F.desc("priority")]).drop("priority")


def compact(spark: SparkSession, target: str, staging: str, schema: T.StructType | str, keys: list[str] = KEYS, clear: bool = False, row_keys: list[str] | None = None) -> DataFrame:
    """Merge a staging lake into a lake, touching only the partitions that staging holds; returns rows by partition.

    The lake's folders are pruned by the months and ids that staging has (as literals, up to `MONTHS` of them; a semi join
    on all keys does the rest). The merged partitions are written inside the lake, where readers don't look, and moved into
    place by swap(); staging is cleared only after that. A run that ended halfway is made good by the next one (or by
    recover()). Running again changes nothing. A row is known by `row_keys` (the partition's keys if not given) and tick.
    """
    recover(spark, target)
    new = opened(spark, staging, schema)
    touched = new.select(*keys).distinct()
    old = opened(spark, target, schema)
    for key in keys:
        values = [r[0] for r in touched.select(key).distinct().limit(MONTHS + 1).collect()]
        old = old.where(F.col(key).isin(values)) if len(values) <= MONTHS else old
    old = old.join(touched, keys, "left_semi").select(new.columns)
    merged = merge_bars(old, new, row_keys or keys)
    merged = write_swap(spark, merged, target, keys)
    counts = quantiles.written(opened(spark, f"{merged}/new", schema).groupBy(*keys).agg(F.count("*").alias("n_rows")), "counts")
    swap(spark, merged, target)
    if clear:
        empty(spark, staging)
    return counts


def write_swap(spark: SparkSession, df: DataFrame, root: str, keys: list[str] = KEYS) -> str:
    """Write whole new partitions of a lake beside its own, and then, as the last step, a journal that names them."""
    folder = f"{root.rstrip('/')}/{SWAP}{uuid.uuid4().hex}"
    write_lake(df, f"{folder}/new", keys=keys)
    fs, path = _store(spark, folder)
    names = _leaves(fs, path(f"{folder}/new"), len(keys))
    out = fs.create(path(f"{folder}/journal.tmp"))
    out.write(bytearray("\n".join(names).encode()))
    out.close()
    fs.rename(path(f"{folder}/journal.tmp"), path(f"{folder}/journal"))
    return folder


def swap(spark: SparkSession, folder: str, root: str) -> None:
    """Move the partitions that a journal names into a lake, each by two renames: the old folder out, the new one in.

    A step that was done before is passed over, so a swap may be run again after a failure at any point. A reader sees a
    partition as it was or as it will be, but for the moment between its two renames.
    """
    fs, path = _store(spark, folder)
    for name in [x for x in _read(fs, path(f"{folder}/journal")).split("\n") if x]:
        new, old, own = (path(f"{x}/{name}") for x in (f"{folder}/new", f"{folder}/old", root.rstrip("/")))
        if not fs.exists(new):
            continue  # it was moved before
        if fs.exists(own):
            fs.mkdirs(old.getParent())
            _move(fs, own, old)
        fs.mkdirs(own.getParent())
        _move(fs, new, own)
    fs.delete(path(folder), True)


def recover(spark: SparkSession, root: str) -> int:
    """Finish the swaps of a lake that have a journal, drop those that don't; how many were finished."""
    fs, path = _store(spark, root)
    if not fs.exists(path(root)):
        return 0
    done = 0
    for status in fs.listStatus(path(root)):
        name = status.getPath().getName()
        if not name.startswith(SWAP):
            continue
        folder = f"{root.rstrip('/')}/{name}"
        if fs.exists(path(f"{folder}/journal")):
            swap(spark, folder, root)
            done += 1
        else:
            fs.delete(path(folder), True)
    return done


def _store(spark: SparkSession, root: str):  # noqa: ANN202
    """The Hadoop file system of a path, and a function from text to its paths."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark._jsc.hadoopConfiguration()), path


def _move(fs, old, new) -> None:  # noqa: ANN001
    if not fs.rename(old, new):
        raise OSError(f"can't move {old} to {new}")


def _read(fs, path) -> str:  # noqa: ANN001
    file = fs.open(path)
    data = bytes(file.readAllBytes())
    file.close()
    return data.decode()


def _leaves(fs, path, depth: int, lead: str = "") -> list[str]:  # noqa: ANN001
    """Partition folders so many levels under a path, as relative paths."""
    found = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if status.isDirectory() and "=" in name:
            own = f"{lead}{name}"
            found += [own] if depth == 1 else _leaves(fs, status.getPath(), depth - 1, f"{own}/")
    return found


def exists(spark: SparkSession, root: str) -> bool:
    """Whether there is something at a path of any store."""
    fs, path = _store(spark, root)
    return fs.exists(path(root))


def empty(spark: SparkSession, root: str) -> None:
    """Remove a lake's folder with all in it."""
    fs, path = _store(spark, root)
    fs.delete(path(root), True)


def repaired(df: DataFrame) -> DataFrame:
    """Bars whose tick and datetime are eight hours late, corrected."""
    return df.withColumns({"tick": F.col("tick") - timeutil.SHIFT, "datetime": F.col("datetime") - F.expr("interval 8 hours")})


def repair_lake(spark: SparkSession, root: str, to: str, schema: T.StructType | str, keys: list[str] = KEYS) -> None:
    """Write a corrected copy of a lake in the same layout, ZSTD-compressed."""
    write_lake(repaired(opened(spark, root, schema)), to, keys=keys)


def partitions(spark: SparkSession, root: str, schema: T.StructType | str, keys: list[str] = KEYS) -> DataFrame:
    """Rows of each partition."""
    return opened(spark, root, schema).groupBy(*keys).agg(F.count("*").alias("n_rows"))

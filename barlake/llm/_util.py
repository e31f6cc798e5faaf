"""Shared plumbing: lineage cuts, code shipping, skew-proof numbering, size-checked broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast only if it has at most so many bytes, after counting its rows.
BROADCAST_BYTES = 32 << 20


#: Rows of one key that go to one task of a join.
HOT_ROWS = 1000
#: What a Python worker keeps between tasks: one entry, the last operator's.
_kept: dict[str, object] = {}


def give_back() -> None:
    """Return to the system what Arrow and the C library hold back for later use."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps what it has
        ctypes.CDLL(None).malloc_trim(0)


def kept(name: str, make: Callable[[], object] | None = None) -> object:
    """The worker's entry of that name, made if it isn't there; entries of other names are let go first, and with them the
    memory that is held back for later use."""
    if name not in _kept:
        _kept.clear()
        gc.collect()
        give_back()
        if make:
            _kept[name] = make()
            give_back()
    return _kept.get(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once for each context (a real cluster has no copy of it).

    Where the session has Spark's default for rows of an Arrow batch, batches get fewer: whole texts are long.
    """
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    if getattr(sc, "_barlake_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    to = os.path.join(tempfile.mkdtemp(prefix="spark-"), "barlake_src.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(to)
    sc._barlake_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's checkpoint folder, or the setting that names it.

    Where neither is set, a temporary one in local mode; on a cluster that is an error, since executors don't share it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise a frame in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """A frame written as Parquet to the shared folder, and read again: compressed, and columns that aren't asked for
    aren't read. Columns without a type come back as they were."""
    void = [f.name for f in df.schema if isinstance(f.dataType, T.NullType)]
    to = f"{shared_folder(df.sparkSession)}/barlake-{uuid.uuid4().hex}"
    df.drop(*void).write.parquet(to)
    back = df.sparkSession.read.schema(T.StructType([f for f in df.schema if f.name not in void])).parquet(to)
    return back.select(*(F.lit(None).alias(c) if c in void else F.col(f"`{c}`") for c in df.columns)) if void else back


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a materialised frame for broadcast if its counted rows fit the bound; else leave it to a shuffle join."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def free_name(df: DataFrame, want: str) -> str:
    """A column name that clashes with none of the frame's."""
    taken = {c.lower() for c in df.columns}
    while want.lower() in taken:
        want = f"_{want}"
    return want


def numbered(df: DataFrame, group: str, ties: list[Column], buckets: int, out: str) -> DataFrame:
    """Give the rows of each group gapless numbers from 0, without bringing a group into one task.

    The rows of a group are dealt into `buckets` parts by the hash of `ties`; each part is numbered by itself in the
    order of `ties`, and the sizes of the parts before it are added. df must be materialised (it is read twice).
    """
    part, first, n = (free_name(df, c) for c in ("part_no", "first_no", "part_n"))
    df = df.withColumn(part, F.pmod(F.xxhash64(*ties), F.lit(buckets)).cast("int"))
    sizes = df.groupBy(group, part).agg(F.count("*").alias(n))
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(group).alias(f"{group}_g"), F.col(part).alias(f"{part}_g"), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    own = F.row_number().over(Window.partitionBy(group, part).orderBy(*ties)) - 1
    df = df.withColumn(out, own.cast("long"))
    df = df.join(sizes, (df[group] == sizes[f"{group}_g"]) & (df[part] == sizes[f"{part}_g"]))
    return df.withColumn(out, F.col(out) + F.col(first)).drop(part, first, f"{group}_g", f"{part}_g")


def spread_join(many: DataFrame, few: DataFrame, key: str, count: str, by: str, how: str = "inner") -> DataFrame:
    """Join on a key that may be hot: rows of `many` with one key are dealt by the hash of `by` into parts of about
    `HOT_ROWS`, and the key's rows of `few` are repeated for each part. `count` is a column of both frames: how many rows
    of `many` have the key, at most. It comes back from `many`."""
    part = free_name(many, "key_part")
    parts = lambda df: F.greatest(F.lit(1), F.ceil(df[count] / HOT_ROWS)).cast("int")
    left = many.withColumn(part, F.pmod(F.xxhash64(by), parts(many)).cast("int"))
    right = few.withColumn(part, F.explode(F.sequence(F.lit(0), parts(few) - 1))).drop(count)
    return left.join(right, [key, part], how).drop(part)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice has few bytes of text (or one row), for arrays that stay in cache."""
    col = batch.column(batch.schema.get_field_index(column))
    size = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(size):
        if i > begin and held + n > most_bytes:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(n)
    if batch.num_rows > begin:
        yield batch.slice(begin)

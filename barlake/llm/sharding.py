"""Sharding by jump consistent hashing: no ring table, and one more shard takes rows only into itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import cut, free_name, numbered, table

#: Fixed values of the published jump hash: the multiplier of its generator and the scale of its draws.
STEP = 2862933555777941757
DRAW = 1 << 31
#: Parts in which each shard's rows are numbered.
BUCKETS = 256


def jump_hash(key: Column, shards: int) -> Column:
    """Shard (0 to shards - 1) of an integer key. Each round jumps ahead; a shard that is never reached keeps no state.

    The generator's 64-bit products are exact decimals of at most 38 digits. A null key counts as -1.
    """
    wide = "decimal(38,0)"
    whole = F.expr("cast(18446744073709551616 as decimal(38,0))")
    start = F.coalesce(key.cast("long"), F.lit(-1)).cast(wide)
    start = F.when(start < 0, (start + whole).cast(wide)).otherwise(start)
    state = F.struct(start.alias("key"), F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("next"))

    def jump(s: Column, _: Column) -> Column:
        key = F.pmod((s["key"] * F.lit(STEP).cast("decimal(19,0)") + F.lit(1)).cast(wide), whole).cast(wide)
        draw = F.floor(key / F.lit(1 << 33).cast("decimal(11,0)")).cast("long") + 1
        far = F.floor((s["next"] + 1).cast("double") * (F.lit(float(DRAW)) / draw.cast("double"))).cast("long")
        moved = F.struct(key.alias("key"), s["next"].alias("shard"), far.alias("next"))
        return F.when(s["next"] < shards, moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), state, jump)["shard"].cast("int")


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text plus 1; null has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def assign_shards(df: DataFrame, key: str = "doc_id", shards: int = 16, shard: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """Add each row's shard, and its shard when one more is appended.

    A map: no shuffle and no state. Keys are whole numbers (hash others first). Null keys go where -1 goes; repeated rows go together; an empty table stays empty.
    Columns of the frame that have the new names are replaced.
    """
    return df.withColumns({shard: jump_hash(F.col(key), shards), grown: jump_hash(F.col(key), shards + 1)})


def shard_layout(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 16, buckets: int = BUCKETS) -> DataFrame:
    """One row for each document: key, size, text_crc32, law, shard, slot, grown_shard.

    Only these narrow columns are shuffled. Slots are gapless from 0 in each shard: each shard's rows are numbered in
    `buckets` parts, so no task gets a whole shard. Equal keys are told apart by checksum and size; equal rows by chance.
    A null text has size 1 and checksum 0.
    """
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    rows = df.select(F.col(key), text_size(F.col(text)).alias("size"), crc.alias("text_crc32"), F.lit("key").alias("law"))
    rows = cut(assign_shards(rows, key, shards))
    return numbered(rows, "shard", [F.col(key), F.col("text_crc32"), F.col("size")], buckets, "slot").select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: int = 16, files: int = 1) -> None:
    """Write whole rows as Parquet under shard=N folders, `files` files each, so that a large shard isn't one task."""
    shard, salt = free_name(df, "shard"), free_name(df, "file_no")
    out = df.withColumn(shard, jump_hash(F.col(key), shards)).withColumn(salt, F.pmod(F.xxhash64(key), F.lit(files)))
    out.repartition(shards * files, shard, salt).drop(salt).write.partitionBy(shard).parquet(path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by the law `key`."""
    return shard_layout(table(spark, sf_dir, "documents"))

"""Document fingerprints by a homomorphic multiset hash.

Each paragraph (line) is hashed to a wide vector; a document's fingerprint is the sum of its paragraphs' vectors, lane by
lane modulo a power of two. So the order of paragraphs doesn't matter, equal multisets have equal fingerprints, and a
paragraph is inserted or deleted by adding or subtracting its vector. A vector has two kinds of lanes: eight of 64 bits
from a cryptographic hash of the whole paragraph, for equality, and 256 of 16 bits to which each run of eight bytes of the
paragraph adds 1 or -1, so that the squared length of a difference estimates how much two documents differ.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import _BASE, _SALT, mix
from ._util import free_name, ship, slices, table

LANES, WIDE = 256, 8
#: Ranges of keys for each shuffle partition.
RANGES = 4


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Both kinds of lanes of each text's fingerprint. An empty text has no paragraph: all zero."""
    n = len(texts)
    equal, like = np.zeros((n, WIDE), np.uint64), np.zeros((n, LANES), np.uint16)
    own = [x.encode("utf-8", "surrogatepass") for x in texts]
    full = [i for i in range(n) if own[i]]
    if not full:
        return equal, like
    lines = [own[i].split(b"\n") for i in full]
    digests = np.frombuffer(b"".join([hashlib.blake2b(p).digest() for x in lines for p in x]), "<u8").reshape(-1, WIDE)
    counts = np.array([len(x) for x in lines])
    equal[full] = np.add.reduceat(digests, np.cumsum(counts) - counts)
    data = np.frombuffer(b"\n".join([own[i] for i in full]) + b"\n" * 8, np.uint8)
    stop = data == 10
    h, gap = _SALT[data] | np.uint64(1), stop.copy()
    h[stop] = 0
    power = _BASE
    for step in (1, 2, 4):  # hashes of 2, 4, then 8 bytes, or fewer at the end of a paragraph
        h[:-step] = h[:-step] * power + np.where(gap[:-step], np.uint64(0), h[step:])
        h[stop] = 0
        for _ in range(step):  # gap: a paragraph ends in the bytes that the hash covers so far
            gap[:-1] |= gap[1:]
        power = np.uint64(int(power) ** 2 % (1 << 64))
    text = np.repeat(np.arange(len(full)), [len(own[i]) + 1 for i in full])
    keep = np.flatnonzero(~stop[: len(text)])
    m = mix(h[keep])
    sign = ((m >> np.uint64(40)) & np.uint64(1)).astype(np.float64) * 2 - 1
    sums = np.bincount(text[keep] * LANES + (m & np.uint64(LANES - 1)).astype(np.int64), sign, len(full) * LANES)
    like[full] = (sums.astype(np.int64) & 0xFFFF).astype(np.uint16).reshape(-1, LANES)
    return equal, like


def encoded(equal: np.ndarray, like: np.ndarray) -> list[str]:
    rows = np.concatenate([equal.astype("<u8").view(np.uint8).reshape(len(equal), -1), like.astype("<u2").view(np.uint8).reshape(len(like), -1)], axis=1)
    return [base64.b64encode(x.tobytes()).decode() for x in rows]


def decoded(prints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(b"".join(map(base64.b64decode, prints)), np.uint8).reshape(len(prints), -1)
    return rows[:, : 8 * WIDE].copy().view("<u8").astype(np.uint64), rows[:, 8 * WIDE :].copy().view("<u2").astype(np.uint16)


def fingerprint(text: str) -> str:
    return encoded(*vectors([text]))[0]


def insert(print_: str, paragraphs: str) -> str:
    """The fingerprint with more paragraphs (lines), or with another document's."""
    (e, k), (e2, k2) = decoded([print_]), vectors([paragraphs])
    return encoded(e + e2, k + k2)[0]


def delete(print_: str, paragraphs: str) -> str:
    """The fingerprint without these paragraphs; undoes insert()."""
    (e, k), (e2, k2) = decoded([print_]), vectors([paragraphs])
    return encoded(e - e2, k - k2)[0]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """1 for equal fingerprints; else the estimated share of content in common, twice the shared over the sum, in 0 to 1."""
    signed = [x[1].view(np.int16).astype(np.float64) for x in (a, b)]
    apart = ((a[1] - b[1]).view(np.int16).astype(np.float64) ** 2).sum(1)
    both = (signed[0] ** 2).sum(1) + (signed[1] ** 2).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        near = np.where(both > 0, np.clip(1 - apart / both, 0, 1), 0)
    return np.where((a[0] == b[0]).all(1) & (apart == 0), 1.0, near)


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fingerprint of each row: a map. A null text counts as empty (all lanes zero)."""
    ship(df.sparkSession)
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(encoded(*vectors([x or "" for x in part.column(1).to_pylist()])))], schema.names)

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def in_key_ranges(df: DataFrame, key: str, ranges: int) -> tuple[DataFrame, str, str]:
    """Rows dealt into ranges of the key, each with a guest: the first row (in descending order) of the range below, or
    of the highest for the lowest. Each row's successor is then in its own range, so no task sees all rows.

    Two narrow reads of the key fix the ranges; one row a range goes to the driver.
    """
    edges = sorted(set(df.approxQuantile(key, [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))))
    wide = max(1, int(len(edges) ** 0.5))
    groups = [edges[i : i + wide] for i in range(0, len(edges), wide)] or [[]]
    heads = F.array(*(F.lit(float(g[0])) for g in groups[1:])).cast("array<double>")
    below = lambda values: F.size(F.filter(values, lambda x: x <= F.col(key).cast("double")))
    coarse = F.coalesce(below(heads), F.lit(0))
    lists = F.array(*(F.array(*(F.lit(float(x)) for x in g)).cast("array<double>") for g in groups))
    own = F.coalesce(coarse * wide + below(F.element_at(lists, coarse + 1)), F.lit(0)).cast("int")
    bucket, guest, top = free_name(df, "key_range"), free_name(df, "is_guest"), free_name(df, "top_key")
    tops = sorted((r[0], r[1]) for r in df.select(own.alias("b"), F.col(key).alias("k")).groupBy("b").agg(F.max("k")).collect())
    kind = df.schema[key].dataType
    to = [(tops[i][1], tops[(i + 1) % len(tops)][0]) for i in range(len(tops))]
    guests = df.sparkSession.createDataFrame(to, T.StructType([T.StructField(top, kind), T.StructField("guest_of", T.IntegerType())]))
    here = F.struct(own.alias(bucket), F.lit(False).alias(guest))
    there = F.struct(F.col("guest_of").alias(bucket), F.lit(True).alias(guest))
    df = df.join(F.broadcast(guests), df[key].eqNullSafe(guests[top]), "left")
    df = df.select("*", F.inline(F.when(F.col("guest_of").isNotNull(), F.array(here, there)).otherwise(F.array(here)))).drop(top, "guest_of")
    return df, bucket, guest


def fingerprint_edits(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of whole texts, of edited texts and of the next document's, with their likeness.

    The edit replaces the last third of a text's code points by the first as many of the next document's, in descending
    order of the key (nulls last, ties by text; after the last comes the first). Texts are shuffled once, by ranges of
    the key, which has to be a number. A null text counts as empty; repeated rows follow each other; an empty table gives an empty one; other
    columns don't matter.
    """
    ship(df.sparkSession)
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("n_chars", T.LongType()), *(T.StructField(x, T.StringType()) for x in ("edited_sha256", "fingerprint", "edited_fingerprint")), *(T.StructField(x, T.DoubleType()) for x in ("near_edited", "near_next"))])
    tasks = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows, bucket, guest = in_key_ranges(df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("whole_text")), key, tasks * RANGES)
    rows = rows.repartition(tasks, bucket).sortWithinPartitions(bucket, guest, F.desc_nulls_last(key), "whole_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row so far, whose successor is still to come
        for batch in batches:
            for part in slices(batch, "whole_text", 1 << 20):
                both = pa.Table.from_batches([held, part] if held is not None else [part]).combine_chunks()
                texts, buckets, guests = (both[x].to_pylist() for x in ("whole_text", bucket, guest))
                held = part.slice(part.num_rows - 1)
                keep = [i for i in range(len(texts) - 1) if buckets[i] == buckets[i + 1] and not guests[i]]
                if not keep:
                    continue
                third = [len(x) // 3 for x in texts]
                edited = [texts[i][: len(texts[i]) - third[i]] + texts[i + 1][: third[i]] for i in keep]
                e, k = vectors(texts)
                edit = vectors(edited)
                own, after = (e[keep], k[keep]), (e[[i + 1 for i in keep]], k[[i + 1 for i in keep]])
                arrays = [
                    both[key].combine_chunks().take(pa.array(keep)), pa.array([len(texts[i]) for i in keep], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                    pa.array(encoded(*own)), pa.array(encoded(*edit)), pa.array(likeness(own, edit)), pa.array(likeness(own, after)),
                ]
                yield pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in arrays], schema.names)

    return rows.mapInArrow(run, schema)


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts and of the next documents."""
    return fingerprint_edits(table(spark, sf_dir, "documents"))

"""Token counts by a compiled finite-state tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import ship, slices, table
from .bpe import VOCAB, TokenCounter, shared, vocabulary_path

LIMIT = 2048


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCAB, limit: int = LIMIT) -> DataFrame:
    """One row for each row: key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A map over whole texts, without a shuffle. A null text counts as empty: no bytes, no tokens. Null keys, repeated
    rows and other columns don't matter; an empty table gives an empty one. A very long text is cut into chunks whose
    state maps are composed, so memory stays at a few times its size.
    """
    ship(df.sparkSession)
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared(TokenCounter, vocabulary_path(vocabulary))
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                texts = [x or "" for x in part.column(1).to_pylist()]
                n_bytes = [len(x.encode()) for x in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_bytes, pa.int64()), pa.array(list(map(counter.tokens, texts)), pa.int64())], [key, "n_bytes", "n_tokens"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return count_tokens(table(spark, sf_dir, "documents"))

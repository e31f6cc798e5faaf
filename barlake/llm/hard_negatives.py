"""Hard negatives by Fagin's threshold algorithm.

Rows are dealt into blocks of bounded size. A block has a sorted list of its rows for each dimension. An anchor reads the
lists in parallel, from the top where its own component is positive and from the bottom where it is negative; each row that
it meets is fetched and scored (exact integers). No row that hasn't been met can score more than the anchor's product with
the values last read, the threshold; so reading stops once that falls strictly below what each window still asks for: its
lower bound, or its kth score so far (ties go by id, so an equal score has to be seen). Spark deals the blocks, brings the
anchors to each in chunks, and merges the blocks' best rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._util import ship, stored, table

#: Positives of an anchor, negatives of a positive; scale of components; the window of a negative's score in hundredths.
POSITIVES, NEGATIVES, SCALE, LOW, HIGH = 5, 3, 256, 50, 95
#: Rows of a block and anchors of a chunk (on average), and places read in each list at first; it doubles each time.
BLOCK, CHUNK, STEP = 8192, 2048, 64


def usable(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """id, label and q (whole components, times SCALE and rounded down) of the rows that take part: one for each id."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    found = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).where(F.coalesce(finite, F.lit(False)))
    return found.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.transform(v, lambda x: F.floor(x * SCALE)).alias("q"))


def exact_kind(x: np.ndarray, a: np.ndarray) -> type:
    """The narrowest kind of number in which all products of rows of both, and their sums in any order, are exact."""
    most = float(np.abs(x.astype(np.float64)).sum(1).max(initial=0)) * float(np.abs(a.astype(np.float64)).max(initial=0))
    if most >= 2.0**62:
        raise ValueError("scores don't fit 64 bits")
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


class Block:
    """Rows of a block with their sorted lists."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray) -> None:
        self.ids, self.labels, self.q = ids, labels, q
        up = np.argsort(q, axis=0, kind="stable").T.astype(np.int32)
        self.lists = np.concatenate([up, up[:, ::-1]])  # of dimension d upwards, and at d + dims downwards
        self.dims = q.shape[1]
        self.values = np.concatenate([np.sort(q, axis=0).T, np.sort(q, axis=0).T[:, ::-1]])

    def best(self, anchor: int, a: np.ndarray, allowed: np.ndarray, k: int, low: np.ndarray, high: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window low <= score <= high the k best allowed rows (places, scores): higher scores, then smaller ids."""
        n = len(self.ids)
        used = np.flatnonzero(a)
        sign = used + self.dims * (a[used] > 0)
        weights = a[used]
        seen = np.zeros(n, bool)
        places, scores = [], []
        least = low.astype(np.float64)  # what a row that hasn't been met must reach
        depth, step, unread = 0, STEP, int(allowed.sum())
        # At depth 0 the values at the lists' heads bound all rows.
        while unread and depth < n:
            frontier = weights @ self.values[sign, max(0, depth - 1)] if len(used) else 0
            if frontier < least.min():
                break
            met = np.zeros(n, bool)
            if len(used):
                met[self.lists[sign, depth : depth + step]] = True
            else:
                met[:] = True  # a zero anchor has no lists: all rows score alike
            new = np.flatnonzero(met & ~seen & allowed)
            seen |= met
            unread -= len(new)
            if len(new):
                got = self.q[new] @ a
                places.append(new)
                scores.append(got)
                if len(places) > 1:
                    places, scores = [np.concatenate(places)], [np.concatenate(scores)]
                for w in range(len(low)):
                    inside = scores[0][(scores[0] >= low[w]) & (scores[0] <= high[w])]
                    if len(inside) >= k:
                        least[w] = max(low[w], np.partition(inside, len(inside) - k)[len(inside) - k])
            depth, step = (depth + step, step * 2) if len(used) else (n, step)
        if not places:
            return [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(low)
        at, got = places[0], scores[0]
        out = []
        for w in range(len(low)):
            inside = np.flatnonzero((got >= low[w]) & (got <= high[w]))
            order = inside[np.lexsort((self.ids[at[inside]], -got[inside]))[:k]]
            out.append((at[order], got[order].astype(np.int64)))
        return out


def _arrays(part: pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels and components of rows, one row for each id (of several the least, by label and components)."""
    ids, labels = part["id"].to_numpy(), part["label"].to_numpy()
    q = pa.compute.list_flatten(part["q"]).to_numpy().reshape(len(ids), dims)
    order = np.lexsort((*q.T[::-1], labels, ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids)
    first = order[np.concatenate([[True], np.diff(ids[order]) != 0])] if len(order) else order
    return ids[first], labels[first], q[first]


def in_blocks(rows: DataFrame, anchors: DataFrame, search, schema: str) -> DataFrame:  # noqa: ANN001
    """Bring each chunk of anchors to each block of rows of the same number of components, and search there."""
    size = lambda df, most: max(1, -(-df.count() // most))
    blocks, chunks = size(rows, BLOCK), size(anchors, CHUNK)
    deal = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    left = rows.select(F.size("q").alias("dims"), deal(blocks, 1).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "id", "label", "q")
    right = anchors.withColumns({"dims": F.size("q"), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "chunk": deal(chunks, 2)})

    def run(keys: tuple, left: Iterator[pa.RecordBatch], right: Iterator[pa.RecordBatch]) -> pa.Table:
        dims = keys[0].as_py()
        ids, labels, q = _arrays(left, dims)
        a = pa.compute.list_flatten(right["q"]).to_numpy().reshape(right.num_rows, dims)
        kind = exact_kind(q, a) if len(q) and len(a) else np.int64
        return search(Block(ids, labels, q.astype(kind)), a.astype(kind), right)

    keys = ["dims", "block", "chunk"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def best_positives(rows: DataFrame, anchors: DataFrame, k: int = POSITIVES) -> DataFrame:
    """anchor, other, score: each anchor's k best other rows of its label."""

    def search(block: Block, a: np.ndarray, right: pa.Table) -> pa.Table:
        out = []
        no, any_ = np.array([-np.inf]), np.array([np.inf])
        for i, (anchor, label) in enumerate(zip(right["id"].to_pylist(), right["label"].to_pylist(), strict=True)):
            ((at, score),) = block.best(anchor, a[i], (block.labels == label) & (block.ids != anchor), k, no, any_)
            out.append((np.full(len(at), anchor), block.ids[at], score))
        return _table(out, ["anchor", "other", "score"])

    found = in_blocks(rows, anchors, search, "anchor long, other long, score long")
    return _top(found, ["anchor"], [F.desc("score"), F.asc("other")], k)


def best_negatives(rows: DataFrame, anchors: DataFrame, k: int = NEGATIVES) -> DataFrame:
    """anchor, positive, positive_score, other, score, rank: the k best rows of another label in each positive's window.
    anchors: id, label, q and positives (array of other, score)."""

    def search(block: Block, a: np.ndarray, right: pa.Table) -> pa.Table:
        out = []
        for i, (anchor, label, pos) in enumerate(zip(right["id"].to_pylist(), right["label"].to_pylist(), right["positives"].to_pylist(), strict=True)):
            p = np.array([x["score"] for x in pos], object)
            low = np.array([-(-LOW * int(x) // 100) for x in p], np.int64)
            high = np.array([HIGH * int(x) // 100 for x in p], np.int64)
            some = np.flatnonzero(low <= high)  # a negative positive leaves no window
            if not len(some):
                continue
            for w, (at, score) in zip(some.tolist(), block.best(anchor, a[i], block.labels != label, k, low[some], high[some]), strict=True):
                n = len(at)
                out.append((np.full(n, anchor), np.full(n, pos[w]["other"]), np.full(n, pos[w]["score"]), block.ids[at], score))
        return _table(out, ["anchor", "positive", "positive_score", "other", "score"])

    found = in_blocks(rows, anchors, search, "anchor long, positive long, positive_score long, other long, score long")
    return _top(found, ["anchor", "positive"], [F.desc("score"), F.asc("other")], k)


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = [np.concatenate(x) for x in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * len(names)
    return pa.table([pa.array(x.astype(np.int64)) for x in columns], names)


def _top(found: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The k first rows of each group; tasks keep k of each group before the shuffle."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, for rows and anchors of usable().

    A positive is one of the anchor's best other rows of its label; its negatives are the best rows of other labels that
    score LOW to HIGH hundredths of it. Ties go to smaller ids. Ids that repeat count once; vectors of different lengths
    never meet; a zero vector scores 0 with all. Positives that score below 0 have no window. Without rows, anchors,
    positives or negatives there is nothing to return. Scores beyond 64 bits are an error.
    """
    ship(rows.sparkSession)
    rows, anchors = stored(rows), stored(anchors.groupBy("id").agg(F.min(F.struct("label", "q")).alias("v")).select("id", "v.label", "v.q"))
    positives = best_positives(rows, anchors).groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "other", "score"))).alias("positives"))
    searched = stored(anchors.join(positives, anchors["id"] == positives["anchor"]).select("id", "label", "q", "positives"))
    found = best_negatives(rows, searched)
    return found.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by 50; ids divisible by 7 have the next label."""
    rows = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    rows = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, rows.where("id % 50 = 0"))


#: The definition itself: the score of every anchor with every row.
ORACLE_SQL = """
WITH rows_ AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
scored AS (
  SELECT a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM rows_ a JOIN rows_ b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor, other, score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5)
SELECT p.anchor AS anchor_id, p.other AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other) AS INT) AS rank,
  n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other) <= 3
"""

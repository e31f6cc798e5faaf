"""Benchmark decontamination: rare n-gram seeds join documents to test items, local alignment scores the passages.

No copy above the score is lost. An alignment that scores `score` of the best possible may lose a bounded number of
points. Each word of the item that it leaves out costs a match's points at least, so a number of the item's words are in
every such alignment; each border between neighbouring words that it breaks costs a point at least (an inserted word), so a
number of its word pairs are whole, too, where scores are high. Leaving out the most frequent words (or pairs) but for that
number, less the hits asked for, still leaves so many hits in every alignment. These, the rare ones, are the seeds; for each
item the words or the pairs are taken, whichever occur less often in all documents. At 0.6 that leaves out the more frequent
half of an item's words, stop words first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import ALNUM, flat, shingles, word_hashes
from ._util import BROADCAST_BYTES, cut, free_name, ship, slices, small, table

#: Share of the best possible alignment from which on a passage is a copy.
SCORE = 0.6
#: Alignment: a match, a mismatch and a gap of one word.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Points that a broken border between two words of an item costs at least, and seeds that a passage has to have, if all may.
BORDER, HITS = min(-GAP, (MATCH - MISMATCH) / 2, (MATCH - GAP) / 2, MATCH), 3
#: Slots of the map that keeps n-grams of no item out of the join: its size doesn't depend on the tables.
SLOTS = 1 << 23


def whole_grams(words: int, score: float) -> tuple[dict[int, int], int]:
    """Of an item of so many words: how many of its words (1) and word pairs (2) any alignment of that score leaves whole,
    where it is any, and the points that it may lose."""
    slack = int(MATCH * words * (1 - score) + 1e-9)
    whole = {1: max(1, words - slack // MATCH), 2: words - 1 - int(slack / BORDER)}
    return {width: n for width, n in whole.items() if n > 0}, slack


def item_grams(tests: DataFrame, score: float) -> DataFrame:
    """item, gram, item_pos, width (words of the n-gram), words (of the item), slack, and keep: how many of the item's
    rarest n-grams of that width are enough, and hits: how many of those a copy has at least."""
    kind = tests.schema["item"].dataType
    names = ["gram", "item_pos", "width", "words", "slack", "keep", "hits"]
    schema = T.StructType([T.StructField("item", kind), *(T.StructField(x, T.LongType()) for x in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, _, _, at = word_hashes(*flat(part["text"]), ALNUM)
                rows, out = [], []
                for i, n in enumerate(np.diff(at).tolist()):
                    if not n:
                        continue
                    whole, slack = whole_grams(n, score)
                    for width, need in whole.items():
                        own = shingles(hashes[at[i] : at[i + 1]], np.array([0, n]), width)[0].view(np.int64)
                        hits = min(need, HITS)
                        one = [np.full(len(own), x) for x in (width, n, slack, len(own) - need + hits, hits)]
                        rows.append(np.full(len(own), i))
                        out.append(np.stack([own, np.arange(len(own)), *one]))
                if out:
                    yield pa.RecordBatch.from_arrays([part["item"].take(pa.array(np.concatenate(rows))), *map(pa.array, np.concatenate(out, axis=1))], schema.names)

    return tests.select("item", "text").mapInArrow(run, schema)


def _slots(grams: DataFrame) -> np.ndarray:
    """The map's slots that some gram falls in, packed: the driver gets words of 64 slots, SLOTS / 64 at most."""
    slot = F.expr(f"gram & {SLOTS - 1}")
    found = grams.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits")).toArrow()
    words = np.zeros(SLOTS // 64, np.int64)
    words[found["at"].to_numpy()] = found["bits"].to_numpy()
    return words.view(np.uint64)


def _known(values: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Places of the values whose slot isn't empty."""
    slot = values & np.uint64(SLOTS - 1)
    return np.flatnonzero((words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1))


def gram_rows(rows: DataFrame, widths: list[int], words: np.ndarray) -> DataFrame:
    """gram, doc and pos (its place in the text) of the texts of rows (doc, text), less those whose slot is empty."""
    kind = rows.schema["doc"].dataType
    schema = T.StructType([T.StructField("gram", T.LongType()), T.StructField("doc", kind), T.StructField("pos", T.LongType())])
    known = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values, begin, keep in _held(batches, widths, known.value):
            text = np.searchsorted(begin, keep, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(values[keep].view(np.int64)), part["doc"].take(pa.array(text)), pa.array(keep - begin[text])], schema.names)

    return rows.select("doc", "text").mapInArrow(run, schema)


def _held(batches: Iterator[pa.RecordBatch], widths: list[int], words: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of texts, their n-grams, where each text's begin, and the places of those whose slot isn't empty."""
    for batch in batches:
        for part in slices(batch, "text"):
            hashes, _, _, at = word_hashes(*flat(part["text"]), ALNUM)
            for width in widths:
                values, begin = shingles(hashes, at, width)
                yield part, values, begin, _known(values, words)


def gram_counts(rows: DataFrame, widths: list[int], words: np.ndarray) -> DataFrame:
    """gram and n, its occurrences in the texts, for the n-grams whose slot isn't empty. A task sums its own."""
    known = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            values, where = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return values, np.bincount(where, np.concatenate([n for _, n in held])).astype(np.int64)

        for _, values, _, keep in _held(batches, widths, known.value):
            held.append(np.unique(values[keep].view(np.int64), return_counts=True))
            if len(held) == 32:
                held = [summed()]
                if len(held[0][0]) > SLOTS // 8:
                    yield pa.RecordBatch.from_arrays([*map(pa.array, held.pop())], ["gram", "n"])
        if held:
            yield pa.RecordBatch.from_arrays([*map(pa.array, summed())], ["gram", "n"])

    return rows.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman over words: best score over that of the whole item, and the words of the passage it covers."""
    m, n = len(item), len(passage)
    if not m or not n:
        return 0.0, 0, 0
    row = np.zeros(n + 1, np.int64)
    begin = np.arange(n + 1)  # where the alignment that ends here began
    step = np.arange(n + 1) * GAP
    best, span = 0, (0, 0)
    for word in item:
        take = row[:-1] + np.where(passage == word, MATCH, MISMATCH)
        skip = row[1:] + GAP
        new = np.zeros(n + 1, np.int64)
        new[1:] = np.maximum(np.maximum(take, skip), 0)
        start = np.arange(n + 1)
        start[1:] = np.where(new[1:] == 0, start[1:], np.where(take >= skip, begin[:-1], begin[1:]))
        # a run of gaps in the item: the best of all earlier columns, less a gap for each step
        lifted = new - step
        top = np.maximum.accumulate(lifted)
        first = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        gapped = top + step
        start = np.where(gapped > new, start[first], start)
        row, begin = np.maximum(new, gapped), start
        j = int(row.argmax())
        if row[j] > best:
            best, span = int(row[j]), (int(begin[j]), j)
    return best / (MATCH * m), *span


def find_copies(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", score: float = SCORE) -> DataFrame:
    """Passages of documents that copy or edit a test item: key, item, score (0 to 1), begin and end (code points).

    One row, the best, for each document and item at `score` or above: the same rows as alignment of all documents with
    all items would give, word by word, without case and punctuation. Seeds are an item's words or word pairs without the
    most frequent ones over all documents; how many are left out, and how many hits in one stretch of a document make a
    passage to align, follows from the score (see the module). An item of one word is found in every document that has it. Null keys, and null or empty texts, match nothing;
    repeated rows count once; empty tables give an empty one; other columns don't matter. Texts are hashed twice, for
    counts and for seeds, and aren't shuffled but for those with a passage. Where the seeds are too large to broadcast, a
    hot one's rows are split by Spark's skew join.
    """
    ship(docs.sparkSession)
    tests = items.select(F.col(item).alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null").distinct()
    tests = cut(tests.groupBy("item").agg(F.min("text").alias("text")))
    grams = cut(item_grams(tests, score))
    widths = sorted(r[0] for r in grams.select("width").distinct().collect()) or [2]
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    counts = gram_counts(rows, widths, _slots(grams))
    counts = counts.join(small(grams.select("gram").distinct(), 16), "gram", "left_semi")
    rank = F.row_number().over(Window.partitionBy("item", "width").orderBy(F.coalesce("n", F.lit(0)), "gram", "item_pos"))
    rare = grams.join(counts, "gram", "left").withColumn("rank", rank).where("rank <= keep")
    cost = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("item", "width"))
    cheaper = F.min(F.struct("cost", "width")).over(Window.partitionBy("item"))["width"]
    rare = rare.withColumn("cost", cost).withColumn("cheaper", cheaper).where("width = cheaper and n is not null")
    seeds = cut(rare.drop("rank", "keep", "n", "cost", "cheaper"))
    used = sorted(r[0] for r in seeds.select("width").distinct().collect()) or widths
    seeds = seeds.drop("width")
    met = gram_rows(rows, used, _slots(seeds)).join(small(seeds, 64), "gram")
    # A copy is no longer than its item and what may be inserted; it may lie across the border of two stretches of that
    # length, so each hit counts in both. Places of the item are told apart by a bit each; where 64 bits don't do, hits
    # of one place may count more than once, which can only add passages.
    stretch = F.floor(F.col("pos") / (F.col("words") + F.col("slack")))
    low, high = F.col("pos") - F.col("item_pos") - F.col("slack"), F.col("pos") - F.col("item_pos") + F.col("words") + F.col("slack")
    met = met.select("doc", "item", "hits", F.expr("shiftleft(1L, cast(item_pos % 64 as int))").alias("bit"), (F.col("words") > 64).alias("long"), low.alias("low"), high.alias("high"), F.explode(F.array(stretch, stretch + 1)).alias("stretch"))
    met = met.groupBy("doc", "item", "stretch").agg(F.bit_or("bit").alias("bits"), F.count("*").alias("n"), F.first("long").alias("long"), F.min("low").alias("low"), F.max("high").alias("high"), F.first("hits").alias("hits"))
    met = met.where("if(long, n, bit_count(bits)) >= hits")
    spans = met.groupBy("doc", "item").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("spans"))
    found = cut(spans.join(tests.withColumnRenamed("text", "item_text"), "item").groupBy("doc").agg(F.collect_list(F.struct("item", "item_text", "spans")).alias("tests")))
    size = found.select(F.sum(F.expr("aggregate(tests, 0L, (n, t) -> n + 40 + length(t.item_text) * 4 + size(t.spans) * 16)"))).first()[0] or 0
    both = rows.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "doc")
    columns = [("doc", docs.schema[key].dataType), ("item", items.schema[item].dataType), ("score", T.DoubleType()), ("begin", T.LongType()), ("end", T.LongType())]
    schema = T.StructType([T.StructField(*x) for x in columns])

    def own_kind(batch: pa.RecordBatch) -> pa.DataType:
        return batch["tests"].type.value_type.field("item").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(1 << 12)
        def item_words(text: str) -> tuple[np.ndarray, frozenset]:
            own = word_hashes(*flat(pa.array([text])), ALNUM)[0]
            return own, frozenset(own.tolist())

        for batch in batches:
            out = []
            for doc, text_, wanted in zip(batch["doc"].to_pylist(), batch["text"].to_pylist(), batch["tests"].to_pylist(), strict=True):
                data, at = flat(pa.array([text_]))
                words, first, last, _ = word_hashes(data, at, ALNUM)
                for test in wanted:
                    own, kinds = item_words(test["item_text"])
                    best = (0.0, 0, 0)
                    low = high = -1
                    merged = []  # stretches that overlap are one passage
                    for s in test["spans"]:
                        if s["low"] > high or not merged:
                            low, high = max(0, s["low"]), s["high"]
                            merged.append([low, high])
                        else:
                            high = merged[-1][1] = max(high, s["high"])
                    for low, high in merged:
                        # a copy has at least so many words of the item's
                        if sum(x in kinds for x in words[low:high].tolist()) < score * len(own) - 1e-9:
                            continue
                        share, i, j = align(own, words[low:high])
                        if share > best[0]:
                            best = (share, low + i, low + j)
                    if best[0] >= score:
                        lead = bytes(data[: first[best[1]]]).decode()
                        inner = bytes(data[first[best[1]] : last[best[2] - 1]]).decode()
                        out.append((doc, test["item"], best[0], len(lead), len(lead) + len(inner)))
            made = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(made, (batch["doc"].type, own_kind(batch), pa.float64(), pa.int64(), pa.int64()), strict=True)], schema.names)

    copies = both.select("doc", "text", "tests").mapInArrow(run, schema)
    best = copies.groupBy("doc", "item").agg(F.max(F.struct("score", "begin", "end")).alias("b"))
    return best.select(F.col("doc").alias(key), F.col("item").alias(item), F.col("b.score"), F.col("b.begin"), F.col("b.end"))


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **more: str) -> DataFrame:
    """The rows of docs, with all their columns, that hold no copy of a test item."""
    name = free_name(docs, "leaky_key")
    gone = cut(find_copies(docs, items, key, text, **more).select(F.col(key).alias(name)).distinct())
    gone = F.broadcast(gone) if gone.count() * 16 <= BROADCAST_BYTES else gone
    return docs.join(gone, docs[key] == gone[name], "left_anti")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages of all documents that copy a benchmark item."""
    return find_copies(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

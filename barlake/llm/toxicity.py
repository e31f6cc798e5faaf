"""Toxicity by two class-conditional Kneser-Ney models of spelling that share their backoff.

A model predicts each byte of a lower-cased word from the bytes before it, back to the word's begin but at most
`ORDER` - 1. Each class has its own counts of full contexts, discounted; the mass taken off goes to one Kneser-Ney model
of shorter contexts with continuation counts pooled over both classes. So expressions that neither class knows cost both
the same, and only what one class writes more often tells them apart.

Toxic text is ordinary text for the most part. So its likelihood is, for each word, that of the ordinary model but for a
share of `TOXIC_WORDS`, which is the toxic model's. A text's score is a logistic function of the difference of the two
log-likelihoods a word. Every n-gram that either class has moves it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import flat
from ._util import cut, kept, ship, slices, table

#: Bytes of an n-gram with the word's begin; seven fit a long.
ORDER, DISCOUNT = 7, 0.75
#: How many pooled observations a class's context counts for besides its own: what is rare in both classes stays shared.
PRIOR = 20.0
#: Share of a toxic text's words that are toxic expressions.
TOXIC_WORDS = 0.01
#: Bound of the fit: labelled rows (of those, the first in an order of hashes). All their n-grams count.
FIT_ROWS = 100_000
FOLDS, CALIBRATE = 5, 4

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] += 32
_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte of a word, packed into a long (value 1 before a word's first byte, and 2 past
    its last one), and where each text's n-grams begin (n + 1 offsets)."""
    n, texts = len(data), len(at) - 1
    # A break stands before each text and after the last, so words never cross texts.
    low = np.full(n + texts + 1, 32, np.uint8)
    low[np.arange(n) + np.repeat(np.arange(1, texts + 1), np.diff(at))] = _CLASS[data]
    stop = _BREAK[low]
    symbol = np.where(stop, 1, low).astype(np.uint64)
    gram = symbol.copy()
    inside = ~stop  # whether the bytes back to here belong to the word
    for back in range(1, ORDER):
        gram[back:] |= np.where(inside[back:], symbol[:-back] << np.uint64(8 * back), np.uint64(0))
        inside[back:] &= ~stop[:-back]
        inside[:back] = False
    # A word's end is predicted, too: the break after a word stands for it.
    ends = np.flatnonzero(stop[1:] & ~stop[:-1]) + 1
    keep = ~stop
    gram[ends] = (gram[ends - 1] << np.uint64(8) & np.uint64((1 << 8 * ORDER) - 1)) | np.uint64(2)
    keep[ends] = True
    count = np.zeros(len(low) + 1, np.int64)
    np.cumsum(keep, out=count[1:])
    return gram[keep], count[at + np.arange(texts + 1) + 1]


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    found, where = np.unique(keys, return_inverse=True)
    return found, *(np.bincount(where, v, len(found)) for v in values)


def _seek(keys: np.ndarray, wanted: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return [np.where(keys[i] == wanted, v[i], 0) for v in values]


def _width(gram: np.ndarray) -> np.ndarray:
    width = np.zeros(len(gram), np.int64)
    for b in range(8):
        width += gram >> np.uint64(8 * b) > 0
    return width


def _shorter(gram: np.ndarray) -> np.ndarray:
    """N-grams without their first symbol; 0 where nothing is left."""
    width = np.maximum(_width(gram) - 1, 0).astype(np.uint64)
    return gram & ((np.uint64(1) << np.uint64(8) * width) - np.uint64(1))


def _levels(gram: np.ndarray) -> list[np.ndarray]:
    levels = [gram]
    for _ in range(ORDER - 1):
        levels.append(_shorter(levels[-1]))
    return levels


def short_counts(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of distinct n-grams: level << 16 | its two last bytes, for each level at which two are left, and the distinct
    left neighbours there (level 0 has none: 1). Sums over parts that share no context of two bytes are those of all."""
    levels, out = _levels(gram), []
    for level, own in enumerate(levels):
        two = _width(own) == 2
        longer = np.unique(levels[max(level - 1, 0)][two])
        keys, cont = np.unique(_shorter(longer) if level else longer, return_counts=True)
        out.append((keys | np.uint64(level << 16), cont))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def short_backoff(code: np.ndarray, cont: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(last byte | at most one byte before it) at each level: level << 16 | bytes, sorted, and the probabilities."""
    level, own = code >> np.uint64(16), code & np.uint64(0xFFFF)
    one, kinds = np.unique(((level + np.uint64(1)) << np.uint64(16)) | (own & np.uint64(0xFF)), return_counts=True)
    levels, total, kind = _sums(one >> np.uint64(16), kinds, np.ones(len(one)))
    all_, n = _seek(levels, one >> np.uint64(16), total, kind) if len(one) else (np.ones(0), np.ones(0))
    p_one = (np.maximum(kinds - DISCOUNT, 0) + DISCOUNT * n / 256) / all_
    two = level > 0
    code, cont = code[two], cont[two]
    if not len(code):
        return one, p_one
    context = code >> np.uint64(8)
    contexts, total, kind = _sums(context, cont, np.ones(len(code)))
    all_, n = _seek(contexts, context, total, kind)
    (lower,) = _seek(one, (((code >> np.uint64(16)) + np.uint64(1)) << np.uint64(16)) | (code & np.uint64(0xFF)), p_one)
    keys, p = np.concatenate([one, code]), np.concatenate([p_one, (np.maximum(cont - DISCOUNT, 0) + DISCOUNT * n * lower) / all_])
    order = np.argsort(keys)
    return keys[order], p[order]


def shared_backoff(gram: np.ndarray, short: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """P(last byte | shorter context) of each n-gram under the pooled model with continuation counts. `gram` has all
    distinct n-grams of its contexts' last two bytes; what has less context is in `short`."""
    levels = _levels(gram)
    p = np.full(len(gram), 1 / 256)
    for level in range(ORDER - 1, 0, -1):
        own, width = levels[level], _width(levels[level])
        few = np.flatnonzero((width > 0) & (width < 3))
        if len(few):
            (p[few],) = _seek(short[0], own[few] | np.uint64(level << 16), short[1])
        here = np.flatnonzero(width > 2)
        if not len(here):
            continue
        longer = np.unique(levels[level - 1][here])  # distinct left neighbours, each with what follows
        keys, cont = np.unique(_shorter(longer), return_counts=True)
        contexts, total, kinds = _sums(keys >> np.uint64(8), cont, np.ones(len(keys)))
        (n,) = _seek(keys, own[here], cont)
        all_, kind = _seek(contexts, own[here] >> np.uint64(8), total, kinds)
        p[here] = (np.maximum(n - DISCOUNT, 0) + DISCOUNT * kind * p[here]) / all_
    return p


def log_ratios(gram: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray, short: tuple[np.ndarray, np.ndarray], prior: float = PRIOR) -> np.ndarray:
    """Log-likelihood ratio (toxic to ordinary) of each distinct n-gram; 0 for those without counts."""
    out = np.zeros(len(gram))
    known = np.flatnonzero(ordinary + toxic > 0)
    gram, counts = gram[known], [x[known] for x in (ordinary, toxic)]
    if not len(gram):
        return out
    context = gram >> np.uint64(8)
    both = counts[0] + counts[1]
    keys, total, kinds = _sums(context, both, both > 0)
    all_, kind = _seek(keys, context, total, kinds)
    base = (np.maximum(both - DISCOUNT, 0) + DISCOUNT * kind * shared_backoff(gram, short)) / np.maximum(all_, 1)
    logs = []
    for n in counts:
        keys, total, kinds = _sums(context, n, n > 0)
        all_, kind = _seek(keys, context, total, kinds)
        logs.append(np.log((np.maximum(n - DISCOUNT, 0) + (DISCOUNT * kind + prior) * base) / (all_ + prior)))
    out[known] = logs[1] - logs[0]
    return out


class Model:
    """Log-likelihood ratios (toxic to ordinary) of all n-grams that either class has, in a hash table. N-grams that
    neither class has cost both the same."""

    def __init__(self, gram: np.ndarray, ratio: np.ndarray) -> None:
        self._fill(gram.astype(np.uint64), ratio)

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(10, int(2 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys, self.values, self.probes = np.zeros(size, np.uint64), np.zeros(size, np.float32), 0
        slot = self._slot(keys)
        while len(keys):
            spots, first = np.unique(slot, return_index=True)
            put = first[self.keys[spots] == 0]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & (size - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ratios(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        at = self.keys[slot]
        found = np.where(at == keys, self.values[slot], np.float32(0))
        open_ = np.flatnonzero((at != keys) & (at != 0))
        for _ in range(self.probes - 1):
            slot_ = slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            at = self.keys[slot_]
            hit = at == keys[open_]
            found[open_[hit]] = self.values[slot_[hit]]
            open_ = open_[~hit & (at != 0)]
        return found

    def evidence(self, data: np.ndarray, at: np.ndarray, share: float = TOXIC_WORDS) -> np.ndarray:
        """Toxic less ordinary log-likelihood of each text, a word; 0 for texts without words."""
        gram, begin = grams(data, at)
        first = np.flatnonzero(gram < 1 << 16)  # a word's begin and its first byte
        word = np.add.reduceat(self.ratios(gram), first) if len(first) else np.zeros(0)
        total = np.zeros(len(first) + 1)
        np.cumsum(np.log1p(share * np.expm1(np.clip(word, -30, 30).astype(float))), out=total[1:])
        words = np.searchsorted(first, begin)
        return (total[words[1:]] - total[words[:-1]]) / np.maximum(np.diff(words), 1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and intercept by Newton's method with a slight penalty on the slope."""
    scale = max(float(np.sqrt(np.average(x**2, weights=weight))), 1e-9) if len(x) else 1.0
    z = np.stack([x / scale, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - y)) + np.array([1e-3, 1e-3]) * w
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([1e-3, 1e-3])
        w -= np.clip(np.linalg.solve(hess, grad), -5, 5)
    return float(w[0] / scale), float(w[1])


def fold_of(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")


def _gram_counts(marked: DataFrame) -> DataFrame:
    """Counts of each n-gram by class (0, 1) and by use (fit, calibrate): four columns, summed over all tasks. The
    n-grams whose contexts end in the same two bytes (`ends`) are in one partition."""
    schema = "gram long, fit_0 double, fit_1 double, more_0 double, more_1 double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("toxicity")
        keys, counts = np.zeros(0, np.uint64), np.zeros((4, 0))
        for batch in batches:
            for part in slices(batch, "text"):
                gram, begin = grams(*flat(part["text"]))
                column = part["toxic"].to_numpy(zero_copy_only=False) + 2 * (part["fold"].to_numpy(zero_copy_only=False) == CALIBRATE)
                column = np.repeat(column, np.diff(begin))
                found, where = np.unique(np.concatenate([keys, gram]), return_inverse=True)
                new = np.zeros((4, len(found)))
                new[:, where[: len(keys)]] = counts
                for c in range(4):
                    new[c] += np.bincount(where[len(keys) :][column == c], minlength=len(found))
                keys, counts = found, new
        for i in range(0, len(keys), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 50_000].astype(np.int64)), *(pa.array(x[i : i + 50_000]) for x in counts)], ["gram", "fit_0", "fit_1", "more_0", "more_1"])

    parts = marked.select("text", "toxic", "fold").mapInArrow(run, schema)
    parts = parts.withColumn("ends", F.expr("shiftright(gram, 8) & 65535")).repartition("ends")
    return parts.groupBy("ends", "gram").agg(*(F.sum(x).alias(x) for x in ("fit_0", "fit_1", "more_0", "more_1")))


def _uses(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """A partition's n-grams, sorted, and the counts of either class: those to fit with, and those of all rows."""
    rows = pa.Table.from_batches(list(batches))
    gram, *n = (rows[x].to_numpy() for x in ("gram", "fit_0", "fit_1", "more_0", "more_1"))
    order = np.argsort(gram)
    n = [x[order] for x in n]
    return gram[order].astype(np.uint64), [(n[0], n[1]), (n[0] + n[2], n[1] + n[3])]


def _ratios(counts: DataFrame) -> pa.Table:
    """gram, and its log ratio by the rows to fit with (ratio_0) and by all (ratio_1).

    Contexts of two bytes or more are wholly in a partition; the driver gets the counts of the shorter ones (a bounded
    number), makes their probabilities, and gets the ratios: as many as the bounded labelled rows have n-grams.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (first := next(batches, None)) is None:
            return
        gram, uses = _uses([first, *batches])
        for use, (a, b) in enumerate(uses):
            code, cont = short_counts(gram[a + b > 0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), use)), pa.array(code.astype(np.int64)), pa.array(cont.astype(np.int64))], ["use", "code", "cont"])

    found = counts.mapInArrow(count, "use long, code long, cont long").groupBy("use", "code").agg(F.sum("cont").alias("cont")).orderBy("use", "code").toArrow()
    use, code, cont = (found[x].to_numpy() for x in ("use", "code", "cont"))
    short = counts.sparkSession.sparkContext.broadcast([short_backoff(code[use == i].astype(np.uint64), cont[use == i]) for i in (0, 1)])

    def ratio(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (first := next(batches, None)) is None:
            return
        gram, uses = _uses([first, *batches])
        ratios = [log_ratios(gram, *n, short.value[i]) for i, n in enumerate(uses)]
        yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int64)), *(pa.array(x.astype(np.float32)) for x in ratios)], ["gram", "ratio_0", "ratio_1"])

    return counts.mapInArrow(ratio, "gram long, ratio_0 float, ratio_1 float").toArrow()


def _scored(rows: DataFrame, keep: list[str], model: Model, slope: float, intercept: float, out: str) -> DataFrame:
    """The columns `keep` of rows, and the logistic function of slope * evidence + intercept (evidence itself if None)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(rows.schema[x] for x in keep), T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = shared.value.evidence(*flat(part["text"]))
                if slope is not None:
                    x = 1 / (1 + np.exp(-np.clip(slope * x + intercept, -700, 700)))
                yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), pa.array(x)], schema.names)

    return rows.select(*keep, "text").mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS) -> tuple[Model, float, float]:
    """Model, slope and intercept, from labelled rows of the folds that aren't held out.

    At most `rows` labelled keys are used (the first in an order of hashes; a key with both labels counts as toxic, null
    labels and keys don't count), so the labels are broadcast; n-gram counts are summed over tasks, and the driver gets
    the ratios of all n-grams. A first model without the last fold sets slope and intercept on it. With one class only
    the model knows nothing and the score is the smoothed share of toxic labels.
    """
    spark = docs.sparkSession
    ship(spark)
    chosen = labels.select(F.col(key).alias("label_key"), F.col(label).cast("int").alias("toxic")).where("label_key is not null and toxic in (0, 1)")
    chosen = chosen.groupBy("label_key").agg(F.max("toxic").alias("toxic")).withColumn("fold", fold_of(F.col("label_key"))).where("fold <> 0")
    chosen = cut(chosen.orderBy(F.xxhash64("label_key"), "label_key").limit(rows))
    marked = docs.select(F.col(key).alias("text_key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), F.expr("text_key = label_key"))
    counts = cut(_gram_counts(marked))
    top = _ratios(counts)
    gram = top["gram"].to_numpy()
    first = Model(gram, top["ratio_0"].to_numpy())
    seen = _scored(marked, ["toxic", "fold"], first, None, 0.0, "x").where(F.col("fold") == CALIBRATE).select("toxic", "x").toArrow()
    y, x = seen["toxic"].to_numpy(), seen["x"].to_numpy()
    if not all(counts.agg(F.sum("fit_0"), F.sum("fit_1")).first()) or len(set(y.tolist())) < 2:
        toxic, all_ = chosen.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
        share = (toxic + 0.5) / (all_ + 10)
        return Model(np.zeros(0), np.zeros(0)), 0.0, float(np.log(share / (1 - share)))
    slope, intercept = logistic(x, y, np.ones(len(y)))
    return Model(gram, top["ratio_1"].to_numpy()), slope, intercept


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """One row for each row of docs: key, held_out, score (0 to 1), predicted (score >= 0.5).

    Scores come from whole texts alone. Empty and null texts get the score of no evidence. Rows without a label, null
    keys, repeated rows and other columns are fine; an empty table gives an empty one.
    """
    model, slope, intercept = fit(docs, labels, key, text, label)
    out = _scored(docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text")), [key], model, slope, intercept, "score")
    return out.select(key, (fold_of(F.col(key)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """The rows of docs that the score doesn't call toxic, with all their columns: a filter, without a shuffle."""
    model, slope, intercept = fit(docs, labels, key, text, label)
    shared, schema, names = docs.sparkSession.sparkContext.broadcast(model), docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                keep = slope * shared.value.evidence(*flat(part[text])) + intercept < 0
                yield pa.RecordBatch.from_arrays([part[x] for x in names], names).filter(pa.array(keep))

    return docs.mapInArrow(run, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, by the labels of the folds that aren't held out."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

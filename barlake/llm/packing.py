"""Best-fit packing of token sequences by a configuration linear program over the length histogram."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import cut, free_name, give_back, numbered, ship, slices, table
from .bpe import VOCAB, IdCache, shared, vocabulary_path

CAPACITY = 4096
END_ID = 1
BUCKETS = 64
#: Bytes of a slice of texts: lists of its runs and places of its ids are in memory, many times as large as it is.
SLICE = 1 << 20
#: A round's sequence is worth at least 1 - NEAR of the most valuable one; a length's first weight is its share of the capacity
#: to the power of LEAN, a little over 1: of sequences as full, those of large pieces, which fewer gaps hold, go first.
NEAR, LEAN = 0.01, 1.05
#: The share of the tokens that `program` leaves where its caller doesn't say; `plan` has it leave none.
REST = 0.02
#: A round covers this share of its scarcest length (all of it from FULL_STEP lengths on), and weights fall by RATE over it.
LEAST_STEP, FULL_STEP, RATE, MOST_RATE = 0.01, 4000, 0.05, 3.0

Config = dict[int, int]


def priced(lengths: np.ndarray, worth: np.ndarray, most: np.ndarray, capacity: int) -> tuple[Config, np.ndarray]:
    """The most valuable sequence of at most `most` pieces of each length, and the most value that each room can hold: a
    knapsack, by dynamic programming over the capacity. Several pieces of a length are items of 1, 2, 4, ... pieces."""
    items = []
    for size, value, left in zip(lengths.tolist(), worth.tolist(), np.minimum(most, capacity // lengths).tolist(), strict=True):
        n = 1
        while left:
            n = min(n, left)
            items.append((size, n, value * n))
            left, n = left - n, 2 * n
    best, taken = np.zeros(capacity + 1, np.float32), np.zeros((len(items), capacity + 1), bool)
    for j, (size, n, value) in enumerate(items):
        new = best[: -size * n] + np.float32(value)
        np.greater(new, best[size * n :], out=taken[j, size * n :])
        np.maximum(best[size * n :], new, out=best[size * n :])
    config: Config = {}
    room = capacity
    for j in reversed(range(len(items))):
        if taken[j, room]:
            size, n, _ = items[j]
            config[size] = config.get(size, 0) + n
            room -= size * n
    return config, best


def price(lengths: np.ndarray, worth: np.ndarray, most: np.ndarray, capacity: int) -> Config:
    """The most valuable sequence of at most `most` pieces of each length."""
    return priced(lengths, worth, most, capacity)[0]


def filled(best: np.ndarray, weight: np.ndarray, left: np.ndarray, capacity: int) -> tuple[Config, float]:
    """A sequence and its value, led by what each room could hold when lengths were last priced: piece by piece that of all
    lengths which with the room after it is worth most; then pieces give way to longer ones, while there is a gap.
    `weight` by length is -inf where no piece is left."""
    config: Config = {}
    worth, after = weight.copy(), best[::-1]
    room = capacity
    while room:
        size = int((after[capacity - room + 1 :] + worth[1 : room + 1]).argmax()) + 1
        if worth[size] == -np.inf:
            break
        config[size] = config.get(size, 0) + 1
        room -= size
        if config[size] == left[size]:
            worth[size] = -np.inf
    while room:
        gain, size, longer = max((float(worth[x + 1 : x + room + 1].max(initial=-np.inf) - weight[x]), x, int(worth[x + 1 : x + room + 1].argmax()) + x + 1) for x in config if x < capacity)
        if gain <= 0:
            break
        config[size] -= 1
        config[longer] = config.get(longer, 0) + 1
        config = {x: n for x, n in config.items() if n}
        room -= longer - size
        if config[longer] == left[longer]:
            worth[longer] = -np.inf
    return config, sum(n * float(weight[x]) for x, n in config.items())


def program(demand: dict[int, int], capacity: int, rest: float = REST) -> tuple[list[tuple[Config, int]], dict[int, int]]:
    """The configuration program: sequences of each configuration, as few as possible, that cover the demand of every
    length; returned with what is still uncovered, which is nothing if `rest` is 0.

    Multiplicative weights: a length's weight, about its size at first, falls exponentially with the share of its demand
    that is covered. Each round takes a configuration that is the most valuable by the weights, or within NEAR of it,
    and uses it for a share of its scarcest length, rounded down to whole sequences (one at least), so that the rounding of one
    round is made good by later ones. Every length that has pieces left is priced. As weights and what is left only fall,
    the value of the last exact pricing is a bound from above, so the knapsack is solved anew only when a sequence led by it is
    worth less than that. The fewer lengths, the smaller the steps, so the rounds are a few thousand whatever the demand.
    """
    lengths = np.array(sorted(demand), np.int64)
    need, left = np.zeros((2, capacity + 1), np.int64)
    need[lengths] = left[lengths] = [demand[x] for x in lengths.tolist()]
    share = min(1.0, max(LEAST_STEP, len(lengths) / FULL_STEP))
    rate = min(MOST_RATE, RATE / share)
    first = (np.arange(capacity + 1) / capacity) ** LEAN
    weight = np.full(capacity + 1, -np.inf, np.float32)
    weight[need > 0] = first[need > 0]
    found: list[tuple[Config, int]] = []
    tokens = int((np.arange(capacity + 1) * need).sum())
    least = rest * tokens
    config: Config = {}
    best = np.zeros(capacity + 1, np.float32)
    while tokens and tokens > least:
        open_, value = np.flatnonzero(left), -1.0
        if 0 < sum(config.values()) < len(open_):  # else the knapsack costs less than a sequence piece by piece
            config, value = filled(best, weight, left, capacity)
        if value < (1 - NEAR) * best[capacity]:
            config, best = priced(open_, weight[open_], left[open_], capacity)
        i, k = np.array(list(config)), np.array(list(config.values()))
        amount = max(1, int(share * (left[i] // k).min()))
        left[i] -= amount * k
        tokens -= amount * int((i * k).sum())
        weight[i] = np.where(left[i] > 0, first[i] * np.exp(rate * (left[i] / need[i] - 1)), -np.inf)
        found.append((config, amount))
    return found, {x: int(left[x]) for x in lengths.tolist() if left[x]}


def best_fit(demand: dict[int, int], capacity: int) -> list[tuple[Config, int]]:
    """Best-fit decreasing on counts: sequences with the same room are handled as one."""
    rooms: list[int] = []
    open_: dict[int, list[tuple[Config, int]]] = {}
    done: list[tuple[Config, int]] = []

    def put(room: int, config: Config, n: int) -> None:
        if room == 0:
            done.append((config, n))
            return
        if room not in open_:
            insort(rooms, room)
            open_[room] = []
        open_[room].append((config, n))

    for size in sorted(demand, reverse=True):
        left = demand[size]
        while left:
            i = bisect_left(rooms, size)
            if i < len(rooms):
                room = rooms[i]
                config, n = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[i]
            else:
                room, config, n = capacity, {}, left
            each = min(room // size, left)
            use = min(n, left // each)
            if n > use:
                put(room, config, n - use) if config else None
            put(room - each * size, config | {size: config.get(size, 0) + each}, use)
            left -= each * use
    return done + [x for group in open_.values() for x in group]


def plan(demand: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Config, int]]:
    """Sequences of each configuration that hold exactly the demand.

    Lengths equal to the capacity need no program; it places all pieces of the others.
    """
    whole = [({capacity: 1}, demand[capacity])] if demand.get(capacity) else []
    return whole + program({x: n for x, n in demand.items() if x != capacity and n}, capacity, rest=0.0)[0]


class Places:
    """Where the r-th piece of a length goes. At most a block for each length of each configuration."""

    def __init__(self, chosen: list[tuple[Config, int]], capacity: int) -> None:
        blocks, first = [], 0
        for config, n in chosen:
            offset = 0
            for size in sorted(config, reverse=True):
                blocks.append((size, first, config[size], offset, n * config[size]))
                offset += size * config[size]
            first += n
        self.sequences = first
        blocks.sort()
        size, self.first, self.each, self.offset, count = (np.array(x, np.int64) for x in zip(*blocks, strict=True)) if blocks else np.zeros((5, 0), np.int64)
        self.ends = np.cumsum(count)
        self.begins = self.ends - count
        per = np.bincount(size, weights=count, minlength=capacity + 1).astype(np.int64)
        self.base = np.cumsum(per) - per

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.base[length] + rank
        i = np.searchsorted(self.ends, at, side="right")
        within = at - self.begins[i]
        return self.first[i] + within // self.each[i], self.offset[i] + within % self.each[i] * length


def token_pieces(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCAB, with_ids: bool = False) -> DataFrame:
    """Ids of each whole text and an end id, cut into pieces of at most `capacity`: key, piece, start, length,
    ids_crc32, and ids if asked for. A null text counts as empty: its one piece is the end id."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType
    columns = [(key, kind), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]
    schema = T.StructType([T.StructField(*x) for x in columns + [("ids", T.ArrayType(T.IntegerType()))] * with_ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = shared(IdCache, vocabulary_path(vocabulary))
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                row, piece, size, crc, held = [], [], [], [], []
                for i, own_ids in enumerate(cache.many(part.column(1))):
                    ids = np.append(own_ids, END_ID).astype("<u4")
                    for p, begin in enumerate(range(0, len(ids), capacity)):
                        own = ids[begin : begin + capacity]
                        row.append(i)
                        piece.append(p)
                        size.append(len(own))
                        crc.append(zlib.crc32(own.tobytes()))
                        if with_ids:
                            held.append(own.astype(np.int32))
                starts = pa.array(np.array(piece, np.int64) * capacity)
                arrays = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), starts, pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(held, pa.list_(pa.int32()))] * with_ids, schema.names)
            give_back()

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def pack(pieces: DataFrame, ties: list[str], capacity: int = CAPACITY, length: str = "length", buckets: int = BUCKETS) -> DataFrame:
    """Add sequence_id and offset to pieces of 1 to `capacity` tokens: as few sequences as the plan finds, no gaps.

    The driver sees the histogram only (at most `capacity` rows), whatever the number of pieces. Pieces of a length are
    numbered in `buckets` parts, and a piece's number gives its place by a search in the plan, so nothing is joined but
    part sizes. Repeated rows are packed each; the order of `ties` settles who goes where; an empty table stays empty.
    """
    ship(pieces.sparkSession)
    pieces = cut(pieces)
    demand = {int(r[0]): int(r[1]) for r in pieces.groupBy(length).count().collect()}
    places = pieces.sparkSession.sparkContext.broadcast(Places(plan(demand, capacity), capacity))
    rank = free_name(pieces, "rank")
    ranked = numbered(pieces, length, [F.col(x) for x in ties], buckets, rank)
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.value.of(batch[length].to_numpy().astype(np.int64), batch[rank].to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch[x] for x in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCAB, with_ids: bool = False) -> DataFrame:
    """Tokenise and pack whole texts: a row for each piece (key, piece, start, length, ids_crc32, sequence_id, offset).

    Null keys are kept; a null or empty text is one piece of one id; other columns don't matter; a long text is cut into
    pieces of `capacity`, only the last of which may be shorter.
    """
    return pack(token_pieces(df, key, text, capacity, vocabulary, with_ids), [key, "piece", "ids_crc32"], capacity)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 4096 tokens, without the ids themselves."""
    return pack_documents(table(spark, sf_dir, "documents"))

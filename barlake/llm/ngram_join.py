"""Jaccard self-join of documents on word shingles by PartEnum signatures.

Two sets of sizes s and t whose Jaccard similarity is `percent` or more differ in few elements: their symmetric difference
has (s + t) * (100 - percent) / (100 + percent) at most. Sizes are cut into bands, and within a band (with the smaller sets
that may have a partner in it) that bound is one number d. The hashed domain of shingles is partitioned into more than
d / 2 parts, so a pair that is similar enough has a part in which it differs once at most; each part is partitioned again
into three, and all subsets of two of them are enumerated: in one of these the pair doesn't differ at all. Each subset's
elements are hashed to one signature, so every similar pair has a signature in common, exactly.

Nodes with a common signature meet its leader first; what isn't of one class then is compared in blocks by bitmaps of
parities, whose distance is never above the sets' own. All links are confirmed on full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import mix
from ._util import kept, ship, slices, small, spread_join, stored, table
from .near_dedup import _some, components, confirmed, leader_pairs, sets_of, several_classes

#: Second-level parts, and how many of them an enumerated subset leaves out; a band's largest size over its smallest.
SECOND, OMITTED, BAND = 3, 1, 1.25
#: Members of a block of a list, and bits of a bitmap for each difference that the threshold allows (a power of two, 256 at least).
BLOCK, BITS = 512, 4
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def distance(total: int, percent: int) -> int:
    """Elements in which two sets of that total size may differ at most."""
    return total * (100 - percent) // (100 + percent)


def bands(most: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last size of each band, up to one that holds `most`."""
    low, first, last = 1, [], []
    while low <= most or not first:
        first.append(low)
        last.append(max(low, int(low * BAND)))
        low = last[-1] + 1
    return np.array(first), np.array(last)


def signature_jobs(n: np.ndarray, percent: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(sets, band, difference) for each time that sets are to be enumerated: for their own band, then for each larger one
    in which they may have a partner. Sets that may differ in nothing need no signature: equal sets are one node."""
    most = int(n.max(initial=1))
    first, last = bands(most * 100 // percent + 1)
    allowed = np.array([distance(2 * x, percent) for x in last.tolist()])
    own = np.searchsorted(last, n)
    jobs, more = [], 0
    while True:
        at = own + more
        sets = np.flatnonzero((n > 0) & (at < len(first)))
        if more:
            sets = sets[100 * n[sets] >= percent * first[at[sets]]]
        if not len(sets):
            return jobs
        found = sets[allowed[at[sets]] > 0]
        jobs.append((found, at[found], allowed[at[found]]))
        more += 1


def enumerate_signatures(values: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets (sorted distinct hashes, and where each set's begin), and where each set's signatures begin."""
    n = np.diff(at)
    out: list[np.ndarray] = []
    of: list[np.ndarray] = []
    for sets, band, allowed in signature_jobs(n, percent):
        if not len(sets):
            continue
        parts = (allowed + 2) // 2  # 2 * parts > allowed
        begin = np.zeros(len(sets) + 1, np.int64)
        np.cumsum(parts * SECOND, out=begin[1:])
        size = n[sets]
        rows = np.repeat(np.arange(len(sets)), size)
        take = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(at[:-1][sets], size)
        salted = mix(values[take] ^ (_C[0] * (band[rows].astype(np.uint64) + np.uint64(1))))
        place = begin[rows] + (((salted >> np.uint64(32)) * (parts[rows] * SECOND).astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        element = mix(values[take] * _C[1] + _C[2])
        sums = np.bincount(place, (element & np.uint64(0xFFFFFFFF)).astype(np.float64), begin[-1]).astype(np.uint64)
        sums += np.bincount(place, (element >> np.uint64(32)).astype(np.float64), begin[-1]).astype(np.uint64) << np.uint64(32)
        sums = sums.reshape(-1, SECOND)
        where = np.arange(len(sums)) - np.repeat(begin[:-1] // SECOND, parts)
        tag = mix((np.repeat(band, parts).astype(np.uint64) << np.uint64(32)) + where.astype(np.uint64) + _C[3])
        for left_out in range(SECOND):
            a, b = (x for x in range(SECOND) if x != left_out)
            out.append(mix(mix(sums[:, a] * _C[1] + tag) + sums[:, b] * _C[2] + np.uint64(left_out)))
            of.append(np.repeat(sets, parts))
    counts = np.zeros(len(n) + 1, np.int64)
    if not out:
        return np.zeros(0, np.int64), counts
    owner = np.concatenate(of)
    order = np.argsort(owner, kind="stable")
    np.cumsum(np.bincount(owner, minlength=len(n)), out=counts[1:])
    return np.concatenate(out)[order].view(np.int64), counts


def bitmap(values: np.ndarray, percent: int) -> bytes:
    """For each slot of a set's elements, whether their number is odd: two bitmaps differ in no more slots than the sets do.
    Larger sets have more slots, a power of two, so a bitmap can be folded to a smaller one's size."""
    bits = 256
    while bits < BITS * distance(2 * len(values), percent):
        bits *= 2
    slot = (mix(values ^ _C[3]) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(slot, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def set_ids(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """doc, n_shingles and set_id (128 bits; null for an empty set)."""
    schema = T.StructType([T.StructField("doc", docs.schema[key].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("set_id", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("ngram_join")
        for batch in batches:
            for part in slices(batch, "text"):
                values, at = sets_of(part["text"], k)
                n = np.diff(at)
                ids = [hashlib.blake2b(values[at[i] : at[i + 1]].tobytes(), digest_size=16).digest() if n[i] else None for i in range(len(n))]
                yield pa.RecordBatch.from_arrays([part["doc"], pa.array(n), pa.array(ids, pa.binary())], schema.names)

    return docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).mapInArrow(run, schema)


def signed_nodes(docs: DataFrame, nodes: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    """node, n, signatures and bits (a bitmap of parities) of the documents in nodes; a document's repeated rows stay."""
    schema = T.StructType([T.StructField("node", docs.schema[key].dataType), T.StructField("n", T.LongType()), T.StructField("signatures", T.ArrayType(T.LongType())), T.StructField("bits", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                values, at = sets_of(part["text"], k)
                found, begin = enumerate_signatures(values, at, percent)
                bits = [bitmap(values[i:j], percent) for i, j in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part["node"], pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(found)), pa.array(bits, pa.binary())], schema.names)

    return _some(docs, nodes, key, text).mapInArrow(run, schema)


def signature_lists(signed: DataFrame) -> DataFrame:
    """key, node, n, count (nodes with that signature), shared (common signatures of the node) and before (0), for all
    signatures that several nodes have. The signatures are counted map-side first; the common ones are few, so they are
    brought to the nodes' lists (in a broadcast, if their counted size allows; else a frequent one is dealt over tasks)."""
    posted = signed.select("node", F.explode("signatures").alias("key"))
    common = stored(posted.groupBy("key").agg(F.count("*").alias("count")).where("count > 1"))
    held = stored(signed.select("node", "n", F.explode("signatures").alias("key")).join(small(common, 32), "key").distinct())
    shared = held.groupBy("node").agg(F.count("*").alias("shared"))
    return held.join(small(stored(shared), 32), "node").select("key", "node", "n", F.lit(0).cast("long").alias("before"), "shared", "count")


def block_groups(members: DataFrame) -> DataFrame:
    """The members of lists of several classes (key, node, comp, n, bits, size) dealt into groups (key, i, j, sort): every
    pair that is of two classes meets in one group at least. A list's largest class needn't meet itself, so what a
    large class costs grows with the number of the others."""
    classes = members.groupBy("key", "comp").agg(F.count("*").alias("c"), F.max("size").alias("size"))
    lists = classes.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("all"), F.max("size").alias("size"))
    lists = stored(lists.select("key", F.col("top.comp").alias("main"), F.col("top.c").alias("n_main"), (F.col("all") - F.col("top.c")).alias("n_rest"), "size"))
    rows = spread_join(members, lists, "key", "size", "node")
    blocks = lambda c: F.greatest(F.ceil(F.col(c) / BLOCK), F.lit(1)).cast("int")
    main = F.col("comp") == F.col("main")
    own = F.pmod(F.xxhash64("node"), F.when(main, blocks("n_main")).otherwise(blocks("n_rest"))).cast("int")
    rows = rows.withColumns({"block": own, "is_main": main, "rest": F.sequence(F.lit(0), blocks("n_rest") - 1), "mains": F.sequence(F.lit(0), blocks("n_main") - 1)})
    meet = lambda i, j, of_main: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(of_main).alias("of_main"))
    block = F.col("block")
    with_main = F.when(F.col("is_main"), F.transform("rest", lambda x: meet(x, block, True))).otherwise(F.transform("mains", lambda x: meet(block, x, True)))
    groups = F.when(F.col("is_main"), with_main).otherwise(F.concat(with_main, F.transform("rest", lambda x: meet(F.least(x, block), F.greatest(x, block), False))))
    return rows.select("key", F.explode(groups).alias("g"), "node", "comp", "n", "bits").select("key", "g.i", "g.j", "g.of_main", "node", "comp", "n", "bits")


def alike(n: np.ndarray, comp: np.ndarray, bits: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one group that are of two classes and that sizes and bitmaps don't rule out."""
    least = min(map(len, bits)) // 8
    folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(b, np.uint64).reshape(-1, least), axis=0) for b in bits])
    one, two = [], []
    for i in range(len(n) - 1):
        s, t = n[i], n[i + 1 :]
        ok = np.flatnonzero((comp[i + 1 :] != comp[i]) & (100 * np.minimum(s, t) >= percent * np.maximum(s, t))) + i + 1
        if len(ok):
            far = np.bitwise_count(folded[ok] ^ folded[i]).sum(1, dtype=np.int64)
            ok = ok[far * (100 + percent) <= (100 - percent) * (s + n[ok])]
            one.append(np.full(len(ok), i))
            two.append(ok)
    return (np.concatenate(one), np.concatenate(two)) if one else (np.zeros(0, np.int64),) * 2


def candidate_pairs(groups: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of different classes that bitmaps leave, group by group."""
    kind = groups.schema["node"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    names = ["key", "i", "j", "of_main"]
    # As many tasks as asked for: a few bytes make much work here, so they aren't put together by size.
    tasks = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = groups.withColumn("of_main", F.col("of_main").cast("int")).repartition(tasks, *names).sortWithinPartitions(*names)

    def pairs(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(held).combine_chunks()
        if group.num_rows > 1:
            labels = group["comp"].to_numpy()
            a, b = alike(group["n"].to_numpy(), np.unique(labels, return_inverse=True)[1], group["bits"].to_pylist(), percent)
            if len(a):
                nodes = group["node"].combine_chunks()
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(a)), nodes.take(pa.array(b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch[x].to_numpy().astype(np.int64) for x in names])
            cuts = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                own = tuple(ids[:, begin].tolist())
                if own != last and held:
                    yield from pairs(held)
                    held = []
                last = own
                held.append(batch.slice(begin, end - begin))
        if held:
            yield from pairs(held)

    found = rows.mapInArrow(run, schema)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """One row for each row of docs: key, n_shingles and component_id (the least key reachable over links).

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of k-word shingles. A text of fewer
    words has its whole sequence as one shingle; null and empty texts are linked with nothing, nor are null keys, whose
    component_id is null. Equal sets are one node from the start, whatever their number. Keys are meant to tell documents
    apart: rows that repeat a key and its text count once. Texts of any length are taken whole. An empty table gives an empty one; other columns don't matter. Any percentage from
    50 on finds all links; lower ones are an error.
    """
    if not 50 <= percent <= 100:
        raise ValueError(f"percent has to be 50 to 100: {percent}")
    ship(docs.sparkSession)
    rows = stored(set_ids(docs, key, text, k))
    classes = stored(rows.where("doc is not null and set_id is not null").groupBy("set_id").agg(F.min("doc").alias("node")))
    nodes = stored(classes.select("node").distinct())
    signed = stored(signed_nodes(docs, nodes, key, text, k, percent))
    lists = stored(signature_lists(signed))
    edges = stored(confirmed(leader_pairs(lists), docs, key, text, k, percent))
    members = several_classes(lists, components(edges)).join(signed.select("node", "n", "bits"), ["node", "n"])
    pairs = candidate_pairs(block_groups(stored(members.select("key", "node", "comp", "n", "bits", "size"))), percent)
    edges = edges.union(confirmed(pairs, docs, key, text, k, percent))
    comps = components(edges)
    heads = comps.groupBy("comp").agg(F.min("node").alias("component_id"))
    reached = comps.join(heads, "comp").select("node", "component_id")
    found = classes.join(reached, "node", "left").select("set_id", F.coalesce("component_id", "node").alias("component_id"))
    out = rows.select("doc", "n_shingles", "set_id").join(found, "set_id", "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc"))
    return out.select(F.col("doc").alias(key), "n_shingles", component.alias("component_id"))


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents by shingles of three words at a similarity of 0.9."""
    return similar_documents(table(spark, sf_dir, "documents"))


#: The definition itself: all pairs of different sets with a shingle in common, then reachability.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM words),
nodes AS (SELECT min(doc_id) AS node, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
rows_ AS (SELECT node, unnest(s) AS shingle FROM nodes),
shared AS (SELECT a.node AS a, b.node AS b, count(*) AS n FROM rows_ a JOIN rows_ b ON a.shingle = b.shingle AND a.node <> b.node GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN nodes x ON x.node = a JOIN nodes y ON y.node = b WHERE 100 * shared.n >= 90 * (x.n + y.n - shared.n)),
reach(a, b) AS (SELECT node, node FROM nodes UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
heads AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM sets LEFT JOIN nodes USING (s) LEFT JOIN heads ON a = node
"""

"""MinHash near-duplicate classes by a signature-coordinate inverted join.

Every distinct shingle set has a signature of `COORDS` minima. Each (coordinate, minimum) pair is a posting list. A pair
of sets as similar as the threshold agrees in at least `MATCHES` coordinates (but for about one in a million), so it meets
in one of the `PREFIX` rarest entries of both signatures; the frequent ones are never joined. Links are confirmed on full
sets. In a list each member first meets one leader only; lists that then hold one class are done, and only members of
different classes are compared further, in blocks. The members of large lists are posted once more under their rarest
shingles, where those whose own shingles rule a partner out are passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import distinct, flat, shingles, word_hashes
from ._util import BROADCAST_BYTES, HOT_ROWS, free_name, kept, ship, slices, small, spread_join, stored, table

#: Coordinates, the matches asked for, and the least percentage for which so many find all but one pair in a million.
COORDS, MATCHES, LEAST_PERCENT = 48, 24, 80
PREFIX = COORDS - MATCHES + 1
#: Parts in which the nodes of a posting list are counted.
PARTS = 64
#: Members of a list up to which its pairs are made in one go; larger ones are cut into blocks of so many.
BLOCK = 64

_RNG = np.random.default_rng(48)
_MUL = _RNG.integers(1, 2**63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(1, 2**63, COORDS, dtype=np.uint64)


def sets_of(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, and where each text's begin."""
    hashes, _, _, words = word_hashes(*flat(column))
    return distinct(*shingles(hashes, words, k))


def signatures(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """doc, n_shingles, set_id (128 bits; null for an empty set) and signature (coordinate << 32 | minimum)."""
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("doc", kind), T.StructField("n_shingles", T.LongType()), T.StructField("set_id", T.BinaryType()), T.StructField("signature", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("near_dedup")
        for batch in batches:
            for part in slices(batch, "text"):
                values, at = sets_of(part["text"], k)
                n = np.diff(at)
                full = np.flatnonzero(n)
                least = np.zeros((len(n), COORDS), np.int64)
                for c in range(COORDS if len(full) else 0):
                    low = np.minimum.reduceat((values * _MUL[c] + _ADD[c]) >> np.uint64(32), at[:-1][full])
                    least[full, c] = low.astype(np.int64) | (c << 32)
                ids = [hashlib.blake2b(values[at[i] : at[i + 1]].tobytes(), digest_size=16).digest() if n[i] else None for i in range(len(n))]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, COORDS, 0))]), pa.int32()), pa.array(least[full].ravel()))
                yield pa.RecordBatch.from_arrays([part["doc"], pa.array(n.astype(np.int64)), pa.array(ids, pa.binary()), lists], schema.names)

    return docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).mapInArrow(run, schema)


def _some(docs: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """node and text of the documents whose key is in ids (column node), which is broadcast if its counted size allows."""
    ids = F.broadcast(ids) if ids.count() * 16 <= BROADCAST_BYTES else ids
    return docs.select(F.col(key).alias("node"), F.col(text).alias("text")).join(ids, "node", "left_semi")


def confirmed(pairs: DataFrame, docs: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * |intersection| >= percent * |union|."""
    pairs = stored(pairs.select("a", "b").distinct())
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("met")))
    hot = small(stored(ids.where(F.col("met") > HOT_ROWS)), 24)
    texts = _some(docs, ids, key, text).join(hot, "node", "left").withColumn("met", F.coalesce("met", F.lit(1)))
    both = pairs
    for side, other in (("a", "b"), ("b", "a")):  # a leader with many followers is dealt over many tasks
        met, own = f"met_{side}", texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}"), F.col("met").alias(f"met_{side}"))
        both = both.join(hot.select(F.col("node").alias(side), F.col("met").alias(met)), side, "left").withColumn(met, F.coalesce(met, F.lit(1)))
        both = spread_join(both, own, side, met, other)
    both = both.select("a", "b", "text_a", "text_b")
    schema = pairs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_a"):
                one, at1 = sets_of(part["text_a"], k)
                names = part["b"].to_pylist()
                first = {}
                for i, b in enumerate(names):
                    first.setdefault(b, i)
                order = {b: j for j, b in enumerate(first)}
                two, at2 = sets_of(part["text_b"].take(pa.array(list(first.values()))), k)
                keep = []
                for i, b in enumerate(names):
                    x, y = one[at1[i] : at1[i + 1]], two[at2[order[b]] : at2[order[b] + 1]]
                    if not len(x) or not len(y):
                        continue
                    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    common = int((y[at] == x).sum())
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        keep.append(i)
                if keep:
                    yield pa.RecordBatch.from_arrays([part["a"].take(pa.array(keep)), part["b"].take(pa.array(keep))], ["a", "b"])

    return both.mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """node and comp (a node of its component) for every node of the edges (a, b).

    Each round links every node to its least neighbour in an order of hashes, follows the links, and keeps what edges
    there are between the merged nodes; their number falls by a constant factor at least.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    edges = stored(edges.where("a <> b").distinct())
    total = None
    while edges.limit(1).count():
        sides = edges.union(edges.select("b", "a"))
        links = sides.groupBy("a").agg(F.min(order("b")).alias("m")).select(F.col("a").alias("node"), F.least(order("a"), F.col("m"))["v"].alias("comp"))
        links = stored(links)
        for _ in range(3):
            up = links.select(F.col("node").alias("comp"), F.col("comp").alias("higher"))
            links = links.join(up, "comp").select("node", F.col("higher").alias("comp"))
        links = stored(links)
        if total is None:
            total = links
        else:
            up = links.select(F.col("node").alias("comp"), F.col("comp").alias("higher"))
            total = total.join(up, "comp", "left").select("node", F.coalesce("higher", "comp").alias("comp"))
        ends = [links.select(F.col("node").alias(x), F.col("comp").alias(f"{x}_comp")) for x in ("a", "b")]
        edges = stored(edges.join(ends[0], "a").join(ends[1], "b").where("a_comp <> b_comp").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")).distinct())
    return stored(total) if total is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))


def posting_lists(posted: DataFrame, total: Column, prefix: Column) -> DataFrame:
    """key, node, n, before, shared and count: each node's entries among its `prefix` rarest (of `total`) that another
    node has, too; before: how many of its entries are rarer; count: how many nodes have the entry. posted: node, n, key,
    distinct. A key's rows are counted and met in parts, so a frequent one isn't one task."""
    posted = posted.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int"))
    parts = posted.groupBy("key", "part").agg(F.count("*").alias("c"))
    common = parts.groupBy("key").agg(F.sum("c").alias("count"), F.collect_list("part").alias("parts")).where("count > 1")
    entries = posted.join(common.select("key", "count", F.explode("parts").alias("part")), ["key", "part"])
    held = entries.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("count", "key"))).alias("entries"))
    held = held.withColumn("own", total - F.size("entries")).withColumn("room", prefix - F.col("own"))  # its own come first
    held = held.where("room > 0").select("node", "n", "own", F.size("entries").alias("shared"), F.slice("entries", F.lit(1), F.col("room").cast("int")).alias("entries"))
    held = held.select("node", "n", "own", "shared", F.posexplode("entries").alias("at", "e"))
    return held.select("e.key", "node", "n", (F.col("own") + F.col("at")).cast("long").alias("before"), "shared", "e.count")


def leader_pairs(lists: DataFrame) -> DataFrame:
    """For each node the leader that it meets in most lists. A list's leader is its most central member."""
    central = F.struct((F.col("shared") - F.col("before")).alias("c"), F.xxhash64("node").alias("h"), F.col("node").alias("leader"))
    leaders = lists.groupBy("key").agg(F.max(central)["leader"].alias("leader"), F.max("count").alias("count"))
    met = spread_join(lists, leaders, "key", "count", "node").where("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("met"))
    return met.groupBy("node").agg(F.max(F.struct("met", F.xxhash64("leader"), "leader"))["leader"].alias("leader")).select(F.col("node").alias("a"), F.col("leader").alias("b"))


def shingle_rows(docs: DataFrame, ids: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """node, n and key: the distinct shingles of the documents in ids, and how many each has."""
    kind = ids.schema["node"].dataType
    schema = T.StructType([T.StructField("node", kind), T.StructField("n", T.LongType()), T.StructField("key", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                values, at = sets_of(part["text"], k)
                n = np.diff(at)
                rows = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_arrays([part["node"].take(rows), pa.array(np.repeat(n, n)), pa.array(values.view(np.int64))], schema.names)

    return _some(docs, ids, key, text).mapInArrow(run, schema).distinct()


def several_classes(lists: DataFrame, comps: DataFrame) -> DataFrame:
    """The members of lists that hold several classes, with comp (class) and size (of the list)."""
    members = lists.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = members.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count("*").alias("size"), F.max("count").alias("count")).where("least <> most")
    return spread_join(members, mixed.select("key", "size", "count"), "key", "count", "node")


def could_meet(members: DataFrame, percent: int) -> DataFrame:
    """Members of lists, less those that no member of another class in the list could be linked with; size is counted
    anew. In a list most members are of one class, which has to look at the few others only: these are judged first, by
    the extremes of the whole list, and the large class by the extremes of the others that are left."""
    slack = ((100 + percent) * (F.col("n") - F.col("before")) - percent * F.col("n")) / percent  # largest partner
    rows = members.withColumn("slack", slack)
    classes = rows.groupBy("key", "comp").agg(F.count("*").alias("c"), F.min("n").alias("low"), F.max("slack").alias("high"), F.max("size").alias("size"))
    lists = classes.groupBy("key").agg(F.max(F.struct("c", "comp"))["comp"].alias("main"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("size").alias("size"))
    rows = stored(spread_join(rows, lists, "key", "size", "node"))
    fits = (F.col("low") <= F.col("slack")) & (F.col("high") >= F.col("n"))
    others = rows.where((F.col("comp") != F.col("main")) & fits).drop("low", "high", "main")
    bounds = others.groupBy("key").agg(F.min("n").alias("low"), F.max("slack").alias("high"), F.max("size").alias("size"))
    mains = spread_join(rows.where(F.col("comp") == F.col("main")).drop("low", "high", "main"), bounds, "key", "size", "node").where(fits).drop("low", "high")
    left = stored(others.unionByName(mains))
    sizes = left.groupBy("key").agg(F.count("*").alias("left_size"), F.max("size").alias("size"))
    return spread_join(left, sizes, "key", "size", "node").withColumn("size", F.col("left_size")).drop("slack", "left_size")


def block_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of a list (key, node, comp, n, before, size) that have different classes and that could
    be linked if what stands before this list in either isn't shared: a linked pair passes in its first list. Large lists are cut into blocks, and each pair of blocks is a group of its own."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    at = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = at.select("key", "node", "comp", "n", "before", "block", other.alias("other"))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "comp", "n", "before")
    # As many tasks as asked for: a few bytes make much work here, so they aren't put together by size.
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    kind = members.schema["node"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def pairs(group: pa.RecordBatch) -> tuple[list, list]:
        names, comp, n, before, block = (group[x].to_pylist() if x == "node" else group[x].to_numpy() for x in ("node", "comp", "n", "before", "block"))
        a, b = np.triu_indices(len(n), 1)
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        ok = (comp[a] != comp[b]) & ((block[a] != block[b]) if i != j else True)
        most = np.minimum((n - before)[a], (n - before)[b])
        ok &= 100 * most >= percent * (n[a] + n[b] - most)
        found = np.flatnonzero(ok)
        return [names[x] for x in a[found]], [names[x] for x in b[found]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def out() -> Iterator[pa.RecordBatch]:
            group = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            if group.num_rows > 1:
                a, b = pairs(group)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, group["node"].type), pa.array(b, group["node"].type)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch[x].to_numpy().astype(np.int64) for x in ("key", "i", "j")])
            cuts = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1
            for begin, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                own = tuple(ids[:, begin].tolist())
                if own != last and held:
                    yield from out()
                    held = []
                last = own
                held.append(batch.slice(begin, end - begin))
        if held:
            yield from out()

    found = rows.mapInArrow(run, schema)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs: key, n_shingles, component_id (least key reachable over links), kept (its own key).

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of k-word shingles. A text of fewer
    words has its whole sequence as one shingle; null and empty texts and null keys are linked with nothing (a null key's
    component_id is null, and it is kept). Equal sets are one node from the start, whatever their number. Rows with equal
    keys count as one document. An empty table gives an empty one; other columns don't matter. A percentage under
    `LEAST_PERCENT` is an error: the signatures would lose links of it.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent has to be {LEAST_PERCENT} to 100: {percent}")
    ship(docs.sparkSession)
    rows = stored(signatures(docs, key, text, k))
    classes = stored(rows.where("doc is not null and set_id is not null").groupBy("set_id").agg(F.min("doc").alias("node")))
    nodes = rows.join(classes.select("set_id", F.col("node").alias("doc")), ["set_id", "doc"], "left_semi")
    nodes = stored(nodes.select(F.col("doc").alias("node"), F.col("n_shingles").alias("n"), "signature"))
    posted = nodes.select("node", "n", F.explode("signature").alias("key"))
    lists = stored(posting_lists(posted, F.lit(COORDS), F.lit(PREFIX)))
    edges = stored(confirmed(leader_pairs(lists), docs, key, text, k, percent))
    # Lists that hold several classes: small ones are compared as they are. For the members of large ones the shingles
    # themselves are posted, with a prefix that is exact for the threshold, and leaders are met once more.
    members = stored(several_classes(lists, components(edges)))
    columns = ["key", "node", "comp", "n", "before", "size"]
    few = members.where(F.col("size") <= BLOCK).withColumn("before", F.lit(0).cast("long")).select(columns)
    large = stored(members.where(F.col("size") > BLOCK).select("node").distinct())
    met = block_pairs(few, percent)
    if large.limit(1).count():
        prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
        lists = stored(posting_lists(shingle_rows(docs, large, key, text, k), F.col("n"), prefix))
        pairs = leader_pairs(lists)
        edges = stored(edges.union(confirmed(pairs, docs, key, text, k, percent)).distinct())
        met = met.union(block_pairs(could_meet(several_classes(lists, components(edges)), percent).select(columns), percent)).distinct()
    sides = [nodes.select(F.col("node").alias(x), F.col("signature").alias(f"signature_{x}")) for x in ("a", "b")]
    alike = stored(met).join(sides[0], "a").join(sides[1], "b").where(F.size(F.array_intersect("signature_a", "signature_b")) >= MATCHES)
    edges = edges.union(confirmed(alike, docs, key, text, k, percent))
    comps = components(edges)
    heads = comps.groupBy("comp").agg(F.min("node").alias("component_id"))
    reached = comps.join(heads, "comp").select("node", "component_id")
    found = classes.join(reached, "node", "left").select("set_id", F.coalesce("component_id", "node").alias("component_id"))
    out = rows.select("doc", "n_shingles", "set_id").join(found, "set_id", "left")
    component = F.coalesce(F.col("component_id"), F.col("doc"))
    out = out.select(F.col("doc").alias(key), "n_shingles", F.when(F.col("doc").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, less those in whose group another has a smaller key."""
    gone = stored(near_duplicates(docs, key, text, k, percent).where("not kept").select(F.col(key).alias(free_name(docs, "gone_key"))).distinct())
    name = gone.columns[0]
    gone = F.broadcast(gone) if gone.count() * 16 <= BROADCAST_BYTES else gone
    return docs.join(gone, docs[key] == gone[name], "left_anti")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents by shingles of four words, as the contract has them."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)


#: The definition itself: all pairs of different sets with a shingle in common, then reachability.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM words),
nodes AS (SELECT min(doc_id) AS node, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
rows_ AS (SELECT node, unnest(s) AS shingle FROM nodes),
shared AS (SELECT a.node AS a, b.node AS b, count(*) AS n FROM rows_ a JOIN rows_ b ON a.shingle = b.shingle AND a.node <> b.node GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN nodes x ON x.node = a JOIN nodes y ON y.node = b WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)),
reach(a, b) AS (SELECT node, node FROM nodes UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
heads AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
FROM sets LEFT JOIN nodes USING (s) LEFT JOIN heads ON a = node
"""

"""Alignment of two tokenizers' tokens of the same texts, on Arrow.

A task encodes a slice of texts with both tokenizers and keeps each side as one flat array of ids with each document's
offsets; the byte-level one is asked once for each stretch of text that its pattern cuts anyway. Byte lengths come from the vocabularies; a cumulative sum, less its value at the document's begin, gives each
token's end, and an Acero hash join of both sides on (document, end), packed into one key, gives the borders that both share.
Links between borders are counted with group_by in the task; Spark sums the partial counts, and brings each pair's count
back to the documents.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import free_name, kept, ship, slices, stored, table
from .bpe import Generations, vocabulary_path

BYTE_VOCAB, PIECE_VOCAB = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs whose counts are brought to the documents in a broadcast: the most frequent ones, as many as this at most.
BROADCAST_PAIRS = 1 << 19
#: Bytes of a slice of texts, and of id pairs a task gathers before it sums its counts.
SLICE, GATHERED = 1 << 19, 1 << 22
#: Stretches of each of the two generations of a cache, and characters of the longest that it keeps.
STRETCHES, KEPT_STRETCH = 150_000, 64
#: White space, and what follows up to the next, or up to a stop after letters; then what follows such letters. Stretches of
#: a space and letters, which are one word; and characters that may or may not be white space to the library.
_WHITE, _LETTERS = r"\t-\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000", r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_STRETCH = re.compile(f"[{_WHITE}]+(?:[{_LETTERS}]+(?=[,.;:!?])|[^{_WHITE}]*)|[^{_WHITE}]+")
_WORD = re.compile(f" [{_LETTERS}]+")
_UNSURE = re.compile("[\x1c-\x1f\x85\u180e\u200b\ufeff]")


class Side:
    """One tokenizer: how it encodes texts (all ids in a row, and how many each text has), and its entries' bytes and decimal
    ids."""

    def __init__(self, encode, entries: list[bytes]) -> None:  # noqa: ANN001
        self.encode = encode
        self.bytes = pa.array(entries, pa.large_binary())
        self.lengths = pa.array([len(x) for x in entries], pa.int64())
        self.names = pa.array([str(i) for i in range(len(entries))], pa.large_string())


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    count = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int32, count.sum()), count


class Stretches:
    """A byte-level tokenizer's ids of texts, each with a space before it. Its pattern begins a new word wherever white space
    follows something else, and where a stop follows letters, and no word depends on what stands beyond such a place; so
    ids are asked for a stretch from one such place to the next when that is first seen. Words of letters are passed to the
    vocabulary's merges alone. Texts with characters of which it isn't sure that they are white space are stretches as
    a whole, and so are all texts where the pattern, a normaliser or added tokens are others."""

    def __init__(self, tokenizer, config: dict, byte_names: dict[int, str], lengths: np.ndarray) -> None:  # noqa: ANN001
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer, self.known, self.lengths = tokenizer, Generations(STRETCHES), lengths
        model, usual = config["model"], {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        same = usual.items() <= (config.get("pre_tokenizer") or {}).items() and not config.get("normalizer")
        self.cuts = same and all(x["special"] for x in config.get("added_tokens", []))
        self.merger = None
        if self.cuts and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
            self.merger = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0))
            self.merger.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.names = byte_names | {32: " " + byte_names[32]}

    def learn(self, new: list[str]) -> Iterator[tuple[str, bytes]]:
        words = [x for x in new if _WORD.fullmatch(x)] if self.merger else []
        for i in range(0, len(words), 500):
            part = words[i : i + 500]
            text = "".join(part).encode().decode("latin-1").translate(self.names)
            ids = np.array(self.merger.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            last = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(x.encode()) for x in part]))
            data, ends = ids.tobytes(), (4 * last + 4).tolist()
            yield from zip(part, map(data.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True)
        rest = [x for x in new if not _WORD.fullmatch(x)] if self.merger else new
        for i in range(0, len(rest), 500):
            part = rest[i : i + 500]
            for x, one in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                yield x, np.array(one.ids, np.int32).tobytes()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        own = [_STRETCH.findall(" " + t) if self.cuts and not _UNSURE.search(t) else [" " + t] for t in texts]
        stretches = list(chain.from_iterable(own))
        found = list(map(self.known.new.get, stretches))
        missed = dict.fromkeys(x for x, ids in zip(stretches, found, strict=True) if ids is None)
        missed = {x: self.known.old.get(x) for x in missed}
        missed.update(self.learn([x for x, ids in missed.items() if ids is None]))
        for x, ids in missed.items():
            if len(x) <= KEPT_STRETCH:
                self.known.put(x, ids)
        found = [missed[x] if ids is None else ids for x, ids in zip(stretches, found, strict=True)]
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)])
        return np.frombuffer(b"".join(found), np.int32), np.diff(ends[np.cumsum([0, *map(len, own)])])


def byte_side(path: str) -> Side:
    """A byte-level tokenizer that gets a space before the text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one of many
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    tokenizer.no_truncation()
    tokenizer.no_padding()
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    odd = iter(range(256, 512))
    byte_of = {chr(b) if b in plain else chr(next(odd)): b for b in range(256)}
    entries = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    config = json.load(open(path, encoding="utf-8"))
    special = {x["id"] for x in config.get("added_tokens", [])}
    for word, i in tokenizer.get_vocab(with_added_tokens=True).items():
        entries[i] = word.encode() if i in special else bytes(byte_of[c] for c in word)
    lengths = np.array([len(x) for x in entries], np.int64)
    return Side(Stretches(tokenizer, config, {b: c for c, b in byte_of.items()}, lengths).encode, entries)


def piece_side(path: str) -> Side:
    """A sentence-piece tokenizer, which adds the space itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    entries = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return Side(lambda texts: _flat(model.encode(texts, num_threads=1)), entries)


class Encoded:
    """All tokens of some texts by one tokenizer, flat: ids, each token's document and its end in the document's bytes."""

    def __init__(self, side: Side, texts: list[str]) -> None:
        ids, self.count = side.encode(texts)
        offsets = np.concatenate([[0], np.cumsum(self.count)])
        lists = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(ids))
        self.ids, self.docs = pc.list_flatten(lists), pc.list_parent_indices(lists)
        total = pc.cumulative_sum(side.lengths.take(self.ids))
        self.before = np.concatenate([[0], total.to_numpy()])[offsets]  # bytes of all documents before each
        self.ends = pc.subtract(total, pa.array(self.before[:-1]).take(self.docs))
        self.data = _joined(side.bytes.take(self.ids))

    def same(self, texts: list[bytes]) -> np.ndarray:
        """Whether a document's joined token bytes are the text's."""
        return np.array([self.data[i:j] == t for t, i, j in zip(texts, self.before[:-1].tolist(), self.before[1:].tolist(), strict=True)], bool)

    def keyed(self, name: str, fine: pa.Array) -> pa.Table:
        """key (document and end in one number), id and place of the tokens of the documents that are fine."""
        keep = fine.take(self.docs)
        key = pc.bit_wise_or(pc.shift_left(self.docs.cast(pa.int64()), pa.scalar(36, pa.int64())), self.ends)
        rows = pa.table({"key": key, name: self.ids}).filter(keep)
        return rows.append_column(f"{name}_at", pa.array(np.arange(rows.num_rows)))


def _joined(column: pa.Array) -> bytes:
    """The bytes of all values in a row."""
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    return bytes(memoryview(data)[at[0] : at[-1]]) if data is not None and len(column) else b""


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _joined_lists(cuts: np.ndarray, values: pa.Array, mark: str) -> pa.Array:
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(cuts), values), pa.scalar(mark, values.type))


def align(texts: list[str], a: Side, b: Side) -> tuple[dict[str, np.ndarray], list[str], pa.LargeListArray]:
    """Numbers of tokens, groups and links of texts, digests of their groups, and their links (A's id << 32 | B's id)."""
    left, right = Encoded(a, texts), Encoded(b, texts)
    given = [(" " + t).encode() for t in texts]
    fine = np.array(list(map(bool, texts)), bool) & left.same(given) & right.same(given)
    tables = [x.keyed(name, pa.array(fine, pa.bool_())) for name, x in (("a", left), ("b", right))]
    borders = tables[0].join(tables[1], "key", join_type="inner", use_threads=False).sort_by("key")
    links = np.bincount(borders["key"].to_numpy() >> 36, minlength=len(texts))
    # A document that is fine ends in a common border, so the groups between borders cover all tokens of all of them.
    said = [_joined_lists(np.concatenate([[0], borders[f"{name}_at"].to_numpy() + 1]), side.names.take(_whole(own[name])), ",") for name, side, own in (("a", a, tables[0]), ("b", b, tables[1]))]
    of_doc = np.concatenate([[0], np.cumsum(links)])
    groups = _joined_lists(of_doc, pc.binary_join_element_wise(*said, pa.scalar("|", pa.large_string())), ";")
    digests = [hashlib.sha256(x.as_buffer()).hexdigest() if n else "" for x, n in zip(groups, links.tolist(), strict=True)]
    pairs = pc.bit_wise_or(pc.shift_left(_whole(borders["a"]).cast(pa.int64()), pa.scalar(32, pa.int64())), _whole(borders["b"]).cast(pa.int64()))
    counts = {"n_a": np.where(fine, left.count, 0), "n_b": np.where(fine, right.count, 0), "n_groups": links, "n_links": links}
    return counts, digests, pa.LargeListArray.from_arrays(pa.array(of_doc), pairs)


def aligned(docs: DataFrame, key: str, text: str, byte_vocab: str, piece_vocab: str) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, groups_sha256 and links (array of id pairs) of each row of docs."""
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    schema = T.StructType([T.StructField("doc", docs.schema[key].dataType), *(T.StructField(x, T.LongType()) for x in numbers), T.StructField("groups_sha256", T.StringType()), T.StructField("links", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = kept(f"alignment {byte_vocab} {piece_vocab}", lambda: (byte_side(byte_vocab), piece_side(piece_vocab)))
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                counts, digests, links = align(pc.fill_null(part["text"], "").to_pylist(), a, b)
                yield pa.RecordBatch.from_arrays([part["doc"], *(pa.array(counts[x].astype(np.int64)) for x in numbers), pa.array(digests), links.cast(pa.list_(pa.int64()))], schema.names)

    return docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).mapInArrow(run, schema)


def link_counts(rows: DataFrame) -> DataFrame:
    """pair and n: how many links all documents have of it. Tasks sum their own with group_by, bounded in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> pa.Table:
            whole = pa.concat_tables(held).group_by("pair", use_threads=False).aggregate([("n", "sum")])
            return whole.rename_columns({"n_sum": "n"}).select(["pair", "n"])

        for batch in batches:
            pairs = pc.list_flatten(batch["links"])
            held.append(pa.table({"pair": pairs, "n": pa.array(np.ones(len(pairs), np.int64))}).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["pair", "n"]))
            size += held[-1].num_rows
            if size > GATHERED // 4:
                held = [summed()]
                size = held[0].num_rows
                if size > GATHERED // 8:
                    yield from held.pop().to_batches()
                    size = 0
        if held:
            yield from summed().to_batches()

    return rows.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def token_alignment(docs: DataFrame, key: str = "doc_id", text: str = "text", byte_vocab: str | None = None, piece_vocab: str | None = None) -> DataFrame:
    """One row for each row of docs: key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    A link is a pair of tokens, one of each tokenizer, whose byte ranges end together. A pair's count is that of all links
    of all documents; a link is best if no other pair with its B id has a higher count. Null and empty texts, and texts
    that a tokenizer changes, have no tokens (zeros, no digest). Repeated rows, repeated keys and null keys are rows like
    others, and their links count each time. Texts of any length are encoded whole. An empty table gives an empty one;
    other columns don't matter. The vocabularies' paths are parameters; a worker has to be able to read them.
    """
    ship(docs.sparkSession)
    rows = aligned(docs, key, text, byte_vocab or vocabulary_path(BYTE_VOCAB), piece_vocab or vocabulary_path(PIECE_VOCAB))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    counts = stored(link_counts(rows))
    highest = counts.groupBy(F.expr("pair & 4294967295").alias("b")).agg(F.max("n").alias("most"))
    counts = counts.withColumn("b", F.expr("pair & 4294967295")).join(highest, "b")
    counts = stored(counts.select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best")))
    # Of all links, fewer than one in so many pairs can have a pair of over `hot`: what is broadcast is bounded, and a pair
    # that isn't has few links, so none is a hot key.
    links = counts.agg(F.sum("n")).first()[0] or 0
    hot = 0 if counts.count() <= BROADCAST_PAIRS else links // BROADCAST_PAIRS
    each = rows.select("row", F.explode("links").alias("pair"))
    found = each.join(F.broadcast(counts.where(F.col("n") > hot)), "pair", "left" if hot else "inner")
    if hot:
        cold = found.where("n is null").select("row", "pair").join(counts.where(F.col("n") <= hot), "pair")
        found = found.where("n is not null").unionByName(cold)
    sums = found.groupBy("row").agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
    out = rows.drop("links").join(sums, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select(F.col("doc").alias(key), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of a byte-level and a sentence-piece vocabulary over all documents."""
    return token_alignment(table(spark, sf_dir, "documents"))

"""Operators 11 to 13 against brute force: the n-gram join, hard negatives and token alignment."""

from __future__ import annotations

import collections
import hashlib
import itertools
import json
import re

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from barlake.llm import alignment, hard_negatives, ngram_join
from barlake.llm.bpe import vocabulary_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def classes(texts, k, percent):
    """Least id reachable over links, by comparing all pairs."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    head = {i: i for i in sets}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i, j in itertools.combinations(sorted(i for i, s in sets.items() if s), 2):
        common = len(sets[i] & sets[j])
        if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
            a, b = find(i), find(j)
            head[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


# op11


@pytest.mark.parametrize("percent", [50, 80, 90, 95])
def test_every_similar_pair_shares_a_signature(percent):
    rnd = np.random.default_rng(percent)
    for size in [1, 2, 5, 9, 10, 11, 19, 20, 37, 64, 150, 1000]:
        for _ in range(30):
            whole = rnd.integers(0, 2**63, size * 2, dtype=np.uint64)
            a = np.sort(whole[:size])
            cut, more = int(rnd.integers(0, size // 4 + 2)), int(rnd.integers(0, size // 4 + 2))
            b = np.sort(np.concatenate([a[: max(1, size - cut)], whole[size : size + more]]))
            common = len(np.intersect1d(a, b))
            if 100 * common >= percent * (len(a) + len(b) - common) and a.tobytes() != b.tobytes():
                found, at = ngram_join.enumerate_signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), percent)
                assert set(found[: at[1]].tolist()) & set(found[at[1] :].tolist()), (size, cut, more)
                bits = [ngram_join.bitmap(x, percent) for x in (a, b)]
                assert len(ngram_join.alike(np.array([len(a), len(b)]), np.array([0, 1]), bits, percent)[0]) == 1


def test_join_equals_all_pairs(spark):
    """Documents, and a group of near copies of which some are linked, some not, with all lists in small blocks."""
    rnd = np.random.default_rng(5)
    base = [f"w{x}" for x in rnd.integers(0, 5000, 90)]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(150).collect()}
    for i in range(260):
        words = list(base)
        for _ in range(int(rnd.integers(0, 6))):
            words[int(rnd.integers(0, 90))] = f"x{rnd.integers(0, 50)}"
        texts[100_000 + i] = " ".join(words)
    rows = [*texts.items(), (90_007, None), (90_008, ""), (90_009, " \n"), (90_011, "One two"), (90_012, "one  TWO"), (90_013, "one"), (None, "a b c"), (90_014, "long " * 60000), (90_015, "LONG " * 50000), *[(100_000, texts[100_000])] * 3]
    texts |= {i: t for i, t in rows if i is not None}
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n int, key string")
    want = classes(texts, 3, 90)
    old, ngram_join.BLOCK = ngram_join.BLOCK, 32
    try:
        got = ngram_join.similar_documents(df).collect()
    finally:
        ngram_join.BLOCK = old
    assert len(got) == len(rows)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert len({c for i, (_, c) in want.items() if i >= 100_000}) > 20
    assert ngram_join.similar_documents(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="percent"):
        ngram_join.similar_documents(df, percent=40)


# op12


def brute_negatives(rows, anchors):
    out = []
    for a, label, q in anchors:
        score = {i: sum(x * y for x, y in zip(q, v, strict=True)) for i, _, v in rows if i != a and len(v) == len(q)}
        kinds = {i: lab for i, lab, _ in rows}
        best = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in best if kinds[i] == label][:5]:
            found = [i for i in best if kinds[i] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]][:3]
            out += [(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(found)]
    return sorted(out)


def test_hard_negatives_equal_all_pairs(spark):
    rnd = np.random.default_rng(3)
    vectors = rnd.normal(0, 0.2, (700, 12)).round(2)
    vectors[100:300] = vectors[50]  # many ties
    vectors[350], vectors[400] = 0, -vectors[401]
    rows = [(i, [float(x) for x in v], int(rnd.integers(0, 4))) for i, v in enumerate(vectors)]
    odd = [(None, rows[0][1], 1), (1000, None, 1), (1001, rows[0][1], None), (1002, [None] * 12, 1), (1003, [float("nan")] * 12, 1), (1004, [float("inf")] * 12, 1), (1050, [0.5, 0.5], 1), (1051, [0.4, 0.5], 1), (1052, [0.3, 0.5], 2), (1100, [], 1), rows[3], rows[3]]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows + odd], "vec_id long, embedding array<double>, label int, chunk int, block string")
    plain = [(i, lab, [int(np.floor(256 * x)) for x in v]) for i, v, lab in [*rows, *odd[6:10]]]
    old, hard_negatives.BLOCK, hard_negatives.CHUNK = hard_negatives.BLOCK, 100, 5
    try:
        usable = hard_negatives.usable(df, "vec_id", "embedding", "label")
        got = hard_negatives.mine(usable, usable.where("id % 50 = 0")).collect()
        empty = hard_negatives.mine(usable.limit(0), usable.limit(0)).count()
    finally:
        hard_negatives.BLOCK, hard_negatives.CHUNK = old, 2048
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r[x] for x in names) for r in got) == brute_negatives(plain, [r for r in plain if r[0] % 50 == 0])
    assert empty == 0 and len(got) > 100


def test_threshold_stops_early():
    """Rows along the anchor come first in all lists, so most rows are never read."""
    rnd = np.random.default_rng(1)
    q = rnd.integers(-20, 20, (5000, 8))
    q[:10] = 100
    block = hard_negatives.Block(np.arange(5000), np.zeros(5000, int), q.astype(np.float32))
    reads = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            reads.append(np.size(at))
            return np.asarray(self)[at]

    block.q = block.q.view(Counted)
    ((at, score),) = block.best(-1, np.full(8, 100, np.float32), np.ones(5000, bool), 3, np.array([-np.inf]), np.array([np.inf]))
    assert at.tolist() == [0, 1, 2] and score.tolist() == [80000] * 3 and sum(reads) < 500


def test_scores_that_need_64_bits():
    big = np.array([[2**30, 1], [2**30, 2]])
    kind = hard_negatives.exact_kind(big, big)
    block = hard_negatives.Block(np.array([5, 6]), np.zeros(2, int), big.astype(kind))
    ((at, score),) = block.best(-1, big[0].astype(kind), np.ones(2, bool), 1, np.array([-np.inf]), np.array([np.inf]))
    assert kind is np.int64 and score.tolist() == [2**60 + 2] and at.tolist() == [1]
    with pytest.raises(ValueError, match="64 bits"):
        hard_negatives.exact_kind(big * 8, big * 8)


# op2


def test_bare_surnames(spark):
    """Where surnames follow without a given name, and thousands of them in one text."""
    import time

    from barlake.llm import pii

    text = "John Will met us. Will you come? We asked Will, and Will's son. Mr O'Neil and O'Neil's; Ms Stein-Berg, Stein. Mrs Doe-like. smith Smithson. Mr Smith: Smith-Jones, Smith!"
    got = pii.replace_entities(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k").first().text
    assert ". Will you come?" in got and " asked Will" not in got and "Will's" not in got and "smith Smithson" in got
    assert "O'Neil" not in got and "Stein-Berg" not in got and ", Stein." in got and "Smith:" not in got and "Smith-Jones" not in got and "-Jones" in got and "Smith!" not in got
    family = got.split("Mr ")[-1].split(":")[0]
    assert f"{family}-Jones, {family}!" in got
    names = [f"N{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}x" for i in range(1500)]
    long = " ".join(f"Mr {x} met {x}." for x in names)
    took = []
    for rows in ([(1, long)], [(i, f"Mr {x} met {x}.") for i, x in enumerate(names)]):
        begin = time.time()
        found = " ".join(r.text for r in sorted(pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect(), key=lambda r: r.doc_id))
        took.append(time.time() - begin)
        assert len(re.findall(r"Mr (\w+) met \1\.", found)) == 1500 and not set(names) & set(re.findall(r"\w+", found))
    assert took[0] < took[1] + 20, took


def test_surnames_stay_distinct(spark):
    """Surnames of women and of men, some borne with a given name, too: each has one surrogate, and none shares it."""
    from barlake.llm import pii

    names = [f"N{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}x" for i in range(4000)]
    rows = [(i, f"{('Mr', 'Ms')[i % 2]} {x} met {('Anna', 'Dr Peter', 'Dr')[i % 3]} {x}. {x}!") for i, x in enumerate(names)]
    got = {r.doc_id: r.text for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    found = [re.fullmatch(r"M[rs] (\w+) met (?:Dr )?(?:[\w-]+ )?\1\. \1!", got[i]) for i in range(4000)]
    assert all(found) and len({m[1] for m in found}) == 4000 and not {m[1] for m in found} & set(names)
    # Many given names for one surname: more than there are to draw from.
    people = [f"{g} Doe" for script, gender in pii.GIVEN if script == "latin" for g in pii.GIVEN[script, gender]]
    got = [r.text for r in pii.replace_entities(spark.createDataFrame([(x,) for x in people], "text string"), "k").collect()]
    assert len(set(got)) == len(people) and len({x.split()[-1] for x in got}) == 1


# op4 and op6

def test_counts_and_ids_equal_the_library_on_odd_strings():
    """All characters that lower-casing or composition changes in length, marks, and stops next to them."""
    import sys
    import unicodedata

    from tokenizers import Tokenizer

    from barlake.llm import bpe

    rnd = np.random.default_rng(11)
    every = [chr(i) for i in range(0x20, sys.maxunicode) if not 0xD800 <= i <= 0xDFFF and unicodedata.category(chr(i)) not in ("Cn", "Co")]
    special = [c for c in every if len(c.lower()) > 1 or len(c.upper()) > 1 or c.lower() != c or len(unicodedata.normalize("NFC", c)) != 1 or len(unicodedata.normalize("NFD", c)) > 1]
    marks = [c for c in every if unicodedata.category(c).startswith("M")]
    plain = list("aAzİIıΣσςßéÉкЁ漢가0９²'’`-_,.;:!?()\"<|> \t\n") + ["<|endoftext|>", "'s", "'LL"]
    texts = [f"{a}{c}{b}" for c in special for a in ("", "K") for b in (".", "!", "")]
    pools = [plain, plain, special, marks, every]
    for _ in range(100_000):
        texts.append("".join(pools[int(p)][int(x * len(pools[int(p)]))] for p, x in zip(rnd.integers(0, 5, 6), rnd.random(6), strict=True)))
    texts += ["TAKSİ.", "BİLGİ!", "ÜRÜNLERİ, EVET", "İ", "İ.", "ΣΑΣ.", "ΟΔΟΣ, ΣΣ"]
    path = bpe.vocabulary_path()
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    cache, counter = bpe.IdCache(path), bpe.TokenCounter(path)
    got = [x for i in range(0, len(texts), 5000) for x in cache.many(texts[i : i + 5000])]
    assert [t for t, a, b in zip(texts, got, want, strict=True) if a.tolist() != b] == []
    assert [t for t, b in zip(texts, want, strict=True) if counter.tokens(t) != len(b)] == []


# op13

TEXTS = ["Hello world, this is a test.", None, "", " ", "two  spaces", "<|endoftext|> <s> </s> <0x41>", "tab\tand\nline", "naïve café İstanbul ÄÖ", "漢字かな 한국어 😀", "under ▁ line", "ﬁ ligature ½", "x" * 5000, "word " * 3000, "Hello world, this is a test.", "'s don't I'LL", " nbsp", "á combining", "trailing ", "<unk>"]


def brute_alignment(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    path = vocabulary_path(alignment.BYTE_VOCAB)
    a = Tokenizer.from_file(path)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=vocabulary_path(alignment.PIECE_VOCAB))
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    odd = iter(range(256, 512))
    byte = {chr(x) if x in plain else chr(next(odd)): x for x in range(256)}
    special = {x["id"] for x in json.load(open(path))["added_tokens"]}
    words = {i: w.encode() if i in special else bytes(byte[c] for c in w) for w, i in a.get_vocab().items()}
    sides = []
    for t in texts:
        one = a.encode(" " + (t or ""), add_special_tokens=False).ids if t else []
        two = b.encode(t) if t else []
        ends = []
        for ids, of in ((one, words.get), (two, lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())):
            joined = [of(i) for i in ids]
            ends.append(list(itertools.accumulate(map(len, joined))))
            if t and b"".join(joined) != (" " + t).encode():
                one, two = None, None
        sides.append((one, two, ends) if one else ([], [], ([], [])))
    links, counts = [], collections.Counter()
    for one, two, ends in sides:
        at = [dict(zip(e, range(len(e)), strict=True)) for e in ends]
        own = [(at[0][e], at[1][e]) for e in sorted(set(at[0]) & set(at[1]))]
        links.append(own)
        counts.update((one[i], two[j]) for i, j in own)
    most = collections.Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for (one, two, _), own in zip(sides, links, strict=True):
        pairs = [(one[i], two[j]) for i, j in own]
        i = j = 0
        groups = []
        for x, y in own:
            groups.append(",".join(map(str, one[i : x + 1])) + "|" + ",".join(map(str, two[j : y + 1])))
            i, j = x + 1, y + 1
        said = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((len(one), len(two), len(own), len(own), sum(counts[p] == most[p[1]] for p in pairs), sum(counts[p] for p in pairs), said))
    return out


@pytest.mark.parametrize("most", [1 << 19, 40])
def test_alignment_equals_brute_force(spark, most):
    """With all counts in a broadcast, and with the most frequent ones only."""
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    df = spark.createDataFrame([(None if i == 5 else i // 2, t, 1, "r") for i, t in enumerate(texts)], "doc_id long, text string, n int, row string")
    old, alignment.BROADCAST_PAIRS = alignment.BROADCAST_PAIRS, most
    try:
        got = alignment.token_alignment(df).collect()
    finally:
        alignment.BROADCAST_PAIRS = old
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert collections.Counter(tuple(r[x] for x in names) for r in got) == collections.Counter(brute_alignment(texts))
    assert sum(r.n_a > 0 for r in got) > 60 and sum(r.n_a == 0 for r in got) >= 3
    assert alignment.token_alignment(df.limit(0)).count() == 0
    assert [f.dataType.simpleString() for f in alignment.token_alignment(df.select(F.col("doc_id").cast("int"), "text")).schema.fields][:2] == ["int", "bigint"]

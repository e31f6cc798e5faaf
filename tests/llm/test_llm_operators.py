"""The operators against brute force, exact round trips and held-out labels, with nulls, empty and odd rows."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from barlake.llm import _text, bpe, chat, decontamination, fingerprints, line_dedup, near_dedup, packing, pii, sharding, token_counts, toxicity
from barlake.llm import queries as llm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Nulls, empty and long texts, ties, repeated rows, and extra columns with names that the operators use themselves.
ODD = [(1, "a b c d e f"), (2, None), (3, ""), (4, "a B c D e f"), (4, "a B c D e f"), (None, "x y"), (5, "word " * 30000), (6, "\n\n"), (7, "İΣ <|endoftext|> 'S  x")]
EXTRA = "doc_id long, text string, source string, key string, n long, part_no int, rank int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, "k", 1, 2, 3) for i, t in ODD], EXTRA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


# op1


def test_toxicity_held_out(spark):
    folder = SF.replace("0.001", "0.1")
    got = {r.doc_id: r for r in toxicity.op1_toxicity(spark, folder).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    labels = [(r.toxic, got[r.doc_id].predicted) for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if got[r.doc_id].held_out]
    hits = sum(a and b for a, b in labels)
    assert hits >= 0.8 * sum(a for a, _ in labels) and hits >= 0.95 * sum(b for _, b in labels)


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (5, None), (1, 0)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_toxicity(odd.limit(0), labels.limit(0)).count() == 0
    assert toxicity.drop_toxic(odd, labels.limit(0)).columns == odd.columns


def brute_ratios(counts):
    """Log ratios of n-grams (bytes) from their counts in both classes, context by context."""
    levels, base = [collections.Counter({g: sum(n) for g, n in counts.items()})], {}
    for _ in range(toxicity.ORDER - 1):
        levels.append(collections.Counter(g[1:] for g in levels[-1] if len(g) > 1))
    level_sums = []
    for level in levels:
        total, kinds = collections.Counter(), collections.Counter()
        for g, n in level.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        level_sums.append((total, kinds))

    def p(g, k):
        if not g or k == toxicity.ORDER:
            return 1 / 256
        total, kinds = (x[g[:-1]] for x in level_sums[k])
        return (max(levels[k][g] - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * kinds * p(g[1:], k + 1)) / total

    logs = []
    for c in (0, 1):
        total, kinds = collections.Counter(), collections.Counter()
        for g, n in counts.items():
            total[g[:-1]] += n[c]
            kinds[g[:-1]] += n[c] > 0
        logs.append({g: np.log((max(n[c] - toxicity.DISCOUNT, 0) + (toxicity.DISCOUNT * kinds[g[:-1]] + toxicity.PRIOR) * p(g, 0)) / (total[g[:-1]] + toxicity.PRIOR)) for g, n in counts.items()})
    return {g: logs[1][g] - logs[0][g] for g in counts}


def test_toxicity_keeps_rare_grams(spark):
    """Nearly 300,000 n-grams, and a toxic word that stands once."""
    rnd = np.random.default_rng(1)
    words = ["".join(x) for x in rnd.choice(list("abcdefghijklmnopqrst"), (60_000, 7))]
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    rare = next(i for i in range(1, 120, 10) if fold(i))
    rows = [(i, " ".join(words[i % 60 :: 60]) + (" tttttaz" if i == rare else " tttttaa" * 5), int(i % 10 == 1)) for i in range(120)]
    assert {y for i, _, y in rows if fold(i) == toxicity.CALIBRATE} == {0, 1}
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    used = [(t, y) for i, t, y in rows if fold(i)]
    counts = collections.defaultdict(lambda: [0, 0])
    for t, y in used:
        for word in t.split():
            for j in range(len(word) + 1):
                counts[(b"\1" + word.encode() + b"\2")[max(0, j - 5) : j + 2]][y] += 1
    assert len(counts) > 1 << 18
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))[0]
    want = brute_ratios(counts)
    got = model.ratios(np.array([int.from_bytes(g, "big") for g in want], np.uint64))
    assert np.allclose(got, list(want.values()), atol=1e-4) and want[b"tttttaz"] > 2 and (got != 0).mean() > 0.99

    def evidence(text):
        parts = []
        for word in text.split():
            x = sum(want.get((b"\1" + word.encode() + b"\2")[max(0, j - 5) : j + 2], 0) for j in range(len(word) + 1))
            parts.append(np.log(1 + toxicity.TOXIC_WORDS * (np.exp(x) - 1)))
        return sum(parts) / max(1, len(parts))

    some = [rows[0][1], rows[1][1], rows[rare][1], "tttttaz", "", "unknown zzz tttttaz tttttaa"]
    data = "".join(some).encode()
    got = model.evidence(np.frombuffer(data, np.uint8), np.cumsum([0, *map(len, some)]))
    assert np.allclose(got, list(map(evidence, some)), atol=1e-4) and got[3] > got[5] > got[4] == 0


# op2


def test_surrogates(spark):
    rows = [(1, "Mail anna.B12@mail4.example.com or ANNA.b12@MAIL4.example.com, call +1 (632) 555-4827 or +1 632-555-4827."), (2, "card 4012 8888 8888 1881, ip 10.1.2.3 and anna.b12@mail4.example.com"), (3, "Ms. Anna Smith met Mr Smith; Анна Иванова"), (4, None), (5, ""), (6, "nothing 1.2.3 here 12-34")]
    got = {r.doc_id: r for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    assert [got[i].n_entities for i in range(1, 7)] == [4, 3, 3, 0, 0, 0]
    mails = re.findall(r"[\w.]+@\w+\.example", got[1].text + got[2].text)
    assert len(mails) == 3 and mails[0].lower() == mails[2].lower() and "anna" not in mails[0].lower()
    phones = re.findall(r"\+1[ ()0-9-]+", got[1].text)
    assert re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1]) and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phones[0].strip())
    card = re.search(r"(?:\d{4} ){3}\d{4}", got[2].text)[0].replace(" ", "")
    digits = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(card))]
    assert sum(d // 10 + d % 10 for d in digits) % 10 == 0 and card != "4012888888881881"
    a, b = re.match(r"Ms\. (\w+) (\w+) met Mr (\w+); [А-я]+ [А-я]+$", got[3].text).groups()[:2]
    assert a in pii.GIVEN["latin", "f"] and b in got[3].text.split("Mr ")[1]
    assert (got[4].text, got[5].text, got[6].text) == (None, "", rows[5][1])


def test_surrogates_stay_distinct(spark):
    """Two-digit entities would collide at once; all get different surrogates, none a real value."""
    hosts = [f"{a}{b}@x.example.com" for a in "abcdefghijklmn" for b in "abcdefghijklmnopqrst"]
    got = [r.text for r in pii.replace_entities(spark.createDataFrame([(x,) for x in hosts], "text string"), "k").collect()]
    assert len({x.lower() for x in got}) == len(hosts)


def test_surrogates_do_not_run_out(spark):
    """More entities than the first draw has surrogates for: single letters of a host, and 12,000 lone Greek surnames."""
    letters = "αβγδεζηθικλμνξοπρστυφχψω"
    names = [f"Mr Ζ{''.join(letters[n // 24**p % 24] for p in range(4))}" for n in range(12_000)]
    rows = [f"{i}@x.com" for i in range(10)] + names
    got = [r.text for r in pii.replace_entities(spark.createDataFrame([(x,) for x in rows], "text string"), "k").collect()]
    assert len({x.lower() for x in got}) == len(rows) and not set(got) & set(rows)


def luhn(number):
    digits = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
    return sum(d // 10 + d % 10 for d in digits) % 10 == 0


def test_surrogates_of_many_kinds(spark):
    """26 mailboxes of a host, numbers that aren't cards, a bare surname, repeats, other keys, and odd tables."""
    rows = [f"{c}@corp.org" for c in "abcdefghijklmnopqrstuvwxyz"] + ["id 9807915762804490", "Ms Anna Smith came. Smith's, Smithers and smith", "Ms Anna Smith came. Smith's, Smithers and smith", "x" * 200_000 + " a@corp.org", None, ""]
    df = spark.createDataFrame([(x, 7, i) for i, x in enumerate(rows)], "text string, n_entities int, entity_list int")
    got = pii.replace_entities(df, "k").orderBy("entity_list").collect()
    texts = [r.text for r in got]
    assert got[0].__fields__ == ["text", "n_entities", "entity_list", "_n_entities"] and {r.n_entities for r in got} == {7}
    by = dict(zip(rows, texts, strict=True))
    assert len({by[x] for x in rows[:26]}) == 26 and by["id 9807915762804490"] == "id 9807915762804490"
    assert by["x" * 200_000 + " a@corp.org"] == "x" * 200_000 + " " + by["a@corp.org"] and by[None] is None and by[""] == ""
    name = re.match(r"Ms (\w+) (\w+) came\. (\w+)'s, Smithers and smith$", by[rows[27]])
    assert name[2] == name[3] != "Smith" and texts.count(by[rows[27]]) == 2
    other = {r.text for r in pii.replace_entities(df, "another key").collect()}
    assert not other & {by[x] for x in rows[:26]}
    assert pii.replace_entities(df.limit(0), "k").count() == 0


def test_surrogates_of_full_spaces(spark):
    """Draws of a kind of fixed layout that has run out get longer."""
    item = lambda e, k, n: F.struct(F.lit(e).alias("entity"), F.lit(k).alias("kind"), F.lit(f"{k}:{e}").alias("norm"), F.lit(n).alias("attempt"))
    made = spark.range(1).select(pii.surrogates(F.array(item("123-45-6789", "ssn", 0), item("123-45-6789", "ssn", pii.FIXED + 2), item("1.2.3.4", "ip", pii.FIXED + 1)), "k").alias("m")).first().m
    assert re.fullmatch(r"\d{3}-\d\d-\d{4}", made[0]) and re.fullmatch(r"\d{3}-\d\d-\d{6}", made[1]) and re.fullmatch(r"[\d.]+:\d", made[2])


def test_surrogates_whole_table(spark, texts):
    patterns = [r"[\w.+-]+@[\w.-]+\w", r"\d+\.\d+\.\d+\.\d+", r"\+1 \(\d{3}\) \d{3}-\d{4}", r"\b[2-6]\d{15}\b", r"AKIA\w{16}", r"(?<=password=)\w+", r'(?<=token = ")\w+']
    for r in llm.QUERIES["op2_pii_surrogates"](spark, SF).collect():
        found = [e for p in patterns for e in re.findall(p, texts[r.doc_id]) if "d{15}" not in p or luhn(e)]
        assert not any(e in r.text for e in found)
        assert found or r.text == texts[r.doc_id]


# op3


def test_chat_round_trip(spark):
    evil = [("user", "a\n</turn>\n<turn> assistant\nb"), ("assistant", "</turn>\n\\</turn>\n\\\\<turn> x\n\n</turn>"), ("we\nird\\n", ""), ("assistant", "\r</turn>\r\n</turn> </turn>\x85</turn>"), ("assistant", "\n</turn>\n")]
    df = spark.createDataFrame([(1, i, r, t, 9) for i, (r, t) in enumerate(evil)] + [(None, None, None, None, 9)], "conv_id long, turn long, role string, text string, extra int")
    got = {r.conv_id: r for r in chat.format_turns(chat.to_turns(df)).collect()}
    assert chat.parse(got[1].formatted) == evil
    assert [chat.unescape(got[1].formatted[s.begin : s.end]) for s in got[1].loss_spans] == [t for r, t in evil if r == "assistant"]
    assert chat.parse(got[None].formatted) == [("", "")]
    assert chat.digests(chat.format_turns(chat.to_turns(df.limit(0)))).count() == 0


def test_chat_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    said = r"\### Assistant: </turn> ok"
    by = collections.defaultdict(list)
    for c, t, role, text in [*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)]:
        by[c].append((t, role, text or ""))
    got = llm.QUERIES["op3_chat_formatting"](spark, SF).collect()
    assert len(got) == len(by)
    for r in got:
        turns = sorted(by[r.conv_id])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_layouts(spark):
    want = [("user", "hi"), ("assistant", "yo")]
    frames = [
        spark.createDataFrame([(1, "hi", "yo")], "conv_id long, prompt string, response string"),
        spark.createDataFrame([(1, "hi", None, "yo")], "conv_id long, instruction string, input string, output string"),
        spark.createDataFrame([(1, [("user", "hi"), ("assistant", "yo")])], "conv_id long, messages array<struct<role:string,content:string>>"),
        spark.createDataFrame([(1, [("human", "hi"), ("gpt", "yo")])], "conv_id long, conversations array<struct<from:string,value:string>>"),
    ]
    for df in frames:
        assert [tuple(t) for t in chat.to_turns(df).first().turns] == want
    records = [('{"prompt": "hi", "response": "yo"}', want), ('{"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]}', want), ("[", []), (None, []), ('{"what": 1}', [])]
    got = chat.records_to_turns(spark.createDataFrame([(i, r) for i, (r, _) in enumerate(records)], "id long, record string"), "id", "record").orderBy("id").collect()
    assert [[tuple(t) for t in r.turns] for r in got] == [w for _, w in records]
    odd = ['{"prompt": 5, "Response": "yo"}', '{"messages": [{"Role": "user", "content": 1.5}, {"role": "gpt", "content": true}]}', "[" * 100_000, '{"prompt": "\\ud800", "response": null}', '{"messages": [5]}']
    got = [chat.record_turns(x)[1] for x in odd]
    assert got == [[("user", "5"), ("assistant", "yo")], [("user", "1.5"), ("assistant", "true")], [], [], []]
    assert chat.records_to_turns(spark.createDataFrame([(i, r) for i, r in enumerate(odd)], "id long, record string"), "id", "record").count() == len(odd)
    rows = spark.createDataFrame([(1, 0, "gpt", "b"), (1, 0, "gpt", "a"), (1, 0, "gpt", "a"), (1, None, "human", None)], "conv_id long, turn long, role string, text string")
    assert [tuple(t) for t in chat.to_turns(rows).first().turns] == [("human", ""), ("gpt", "a"), ("gpt", "a"), ("gpt", "b")]
    with pytest.raises(ValueError, match="no chat layout"):
        chat.to_turns(spark.createDataFrame([(1, 2)], "a long, b long"))


# op4, op6


def test_tokens_and_ids_equal_the_library(spark, odd, texts):
    path = bpe.vocabulary_path()
    counter, cache = bpe.TokenCounter(path), bpe.IdCache(path)
    more = ["it's 'S we'LL--'s ''s don't", "a<|endoftext|>b <|startoftext|>", "<|EndOfText|>", "Ünïcödé İSTANBUL ΣΑΣ", "日本語テキスト 123 4５六", "a\x1cb\x1f c\x85d", "é à", "x" * 200000, "ab " * 50000, "Åﬀ ǅ ẞ Ⅷ ²½", "J̌"]
    for text in [t or "" for _, t in ODD] + more + list(texts.values())[:60]:
        want = cache.library.encode(text, add_special_tokens=False).ids
        assert counter.tokens(text) == len(want)
        assert list(cache.ids(text)) == want
    got = token_counts.count_tokens(odd).collect()
    assert len(got) == len(ODD) and {r.n_tokens for r in got if r.doc_id in (2, 3, 6)} == {0}
    assert [r.over_limit for r in got if r.doc_id == 5] == [True]


def test_transducer_maps_compose(monkeypatch):
    """Long words are cut into pieces whose state maps compose to what one run gives, in any grouping."""
    import random

    rnd = random.Random(2)
    path = bpe.vocabulary_path()
    whole, counter, library = bpe.Transducer(path), bpe.TokenCounter(path), bpe.IdCache(path).library
    words = ["".join(rnd.choice(["the", "ing", "xx", "aa", "é", "ß", "q"]) for _ in range(9000)), "x" * 20_001, "-" * 9000, "=-" * 6000, "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))]
    monkeypatch.setattr(bpe, "PIECE", 1 << 60)
    want = [whole.tokens(w) for w in words]
    for piece in (97, 4096):
        monkeypatch.setattr(bpe, "PIECE", piece)
        assert [counter.tokens(w) for w in words] == want
    assert want[:4] == [len(library.encode(w, add_special_tokens=False).ids) for w in words[:4]]
    data = words[0].encode()
    parts = [(i, i + 500, counter.transducer.piece_map(data[i : i + 500], data[max(0, i - 60) : i])) for i in range(0, 1500, 500)]
    join = lambda a, b: counter.transducer.joined(data, a, b)
    left, right = join(join(parts[0], parts[1]), parts[2]), join(parts[0], join(parts[1], parts[2]))
    assert left == right and left[2][0] == counter.transducer.run(data[:1500])


def test_token_counts_odd_tables(spark, odd):
    assert token_counts.count_tokens(odd.limit(0)).count() == 0
    (r,) = token_counts.count_tokens(spark.createDataFrame([(1, "ab" * 100_000)], "doc_id long, text string")).collect()
    assert (r.n_bytes, r.over_limit) == (200_000, True)


def check_packing(rows, want):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    assert len(by) <= want * 1.02 + 1


def test_packing(spark, odd, texts):
    got = llm.QUERIES["op4_best_fit_packing"](spark, SF).collect()
    check_packing(got, sum(r.length for r in got) / packing.CAPACITY)
    cache = bpe.IdCache(bpe.vocabulary_path())
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert set(by) == set(texts)
    for i, rows in by.items():
        ids = [*cache.library.encode(texts[i], add_special_tokens=False).ids, packing.END_ID]
        for r in rows:
            own = ids[r.start : r.start + r.length]
            assert r.start == r.piece * packing.CAPACITY and zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own)) == r.ids_crc32
        assert sum(r.length for r in rows) == len(ids)
    odd_rows = packing.pack_documents(odd).collect()
    check_packing(odd_rows, sum(r.length for r in odd_rows) / packing.CAPACITY)
    assert len([r for r in odd_rows if r.doc_id == 4]) == 2 and len([r for r in odd_rows if r.doc_id == 5]) == 8
    assert packing.pack_documents(odd.limit(0)).count() == 0


def test_plan_is_near_the_bound():
    import random

    rnd = random.Random(3)
    lengths = collections.Counter(min(4096, int(rnd.lognormvariate(6.6, 1)) + 1) for _ in range(20000))
    chosen = packing.plan(dict(lengths))
    held = collections.Counter()
    for config, n in chosen:
        assert sum(a * b for a, b in config.items()) <= 4096
        for a, b in config.items():
            held[a] += n * b
    assert held == lengths
    assert sum(n for _, n in chosen) <= sum(a * b for a, b in lengths.items()) / 4096 * 1.005 + 1
    placed, left = packing.program({x: n for x, n in lengths.items() if x != 4096}, 4096)
    tokens = sum(n * sum(a * b for a, b in c.items()) for c, n in placed)
    assert tokens >= 0.95 * sum(a * b for a, b in lengths.items() if a != 4096) and sum(a * b for a, b in left.items()) > 0
    few = {700: 4000, 900: 2500, 1300: 1700, 2100: 900}
    assert sum(n for _, n in packing.plan(few)) <= sum(n for _, n in packing.best_fit(few, 4096))
    assert packing.plan({}) == [] and packing.plan({4096: 3}) == [({4096: 1}, 3)]


def test_price_is_the_best_sequence():
    import itertools

    sizes, worth, most = np.array([3, 4, 7]), np.array([2.0, 3.1, 5.0]), np.array([2, 5, 1])
    best = max(sum(n * w for n, w in zip(k, worth, strict=True)) for k in itertools.product(range(3), range(6), range(2)) if np.dot(k, sizes) <= 17)
    config = packing.price(sizes, worth, most, 17)
    assert abs(sum(n * worth[list(sizes).index(x)] for x, n in config.items()) - best) < 1e-5


# op5


def test_fingerprints(spark, odd, texts):
    order = sorted(texts.items(), reverse=True)
    got = {r.doc_id: r for r in llm.QUERIES["op5_document_fingerprints"](spark, SF).collect()}
    assert set(got) == set(texts)
    better = 0
    for i, (key, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        m = len(text) // 3
        edited = text[: len(text) - m] + following[:m]
        r = got[key]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprints.fingerprint(text), fingerprints.fingerprint(edited))
        better += r.near_edited > r.near_next
    assert better >= 0.95 * len(order)
    rows = fingerprints.fingerprint_edits(odd).collect()
    assert len(rows) == len(ODD)
    assert [r.near_next for r in rows if r.doc_id == 4].count(1.0) >= 1
    assert fingerprints.fingerprint_edits(odd.limit(0)).count() == 0
    assert fingerprints.fingerprints(odd).count() == len(ODD)


def plain_lanes(text):
    """Both kinds of lanes in plain integers, a paragraph and a run of bytes at a time."""
    whole, base, salt = 1 << 64, int(_text._BASE), [int(x) | 1 for x in _text._SALT]
    equal, like = [0] * fingerprints.WIDE, [0] * fingerprints.LANES
    for line in text.encode().split(b"\n") if text else []:
        digest = hashlib.blake2b(line).digest()
        equal = [(x + int.from_bytes(digest[8 * i : 8 * i + 8], "little")) % whole for i, x in enumerate(equal)]
        for i in range(len(line)):
            h = sum(salt[b] * pow(base, 7 - j, whole) for j, b in enumerate(line[i : i + 8])) % whole
            h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % whole
            h = (h ^ h >> 27) * 0x94D049BB133111EB % whole
            h ^= h >> 31
            like[h % fingerprints.LANES] += 1 if h >> 40 & 1 else -1
    return equal, like


def test_fingerprints_equal_plain_sums(spark):
    texts = ["", "a", "\n", "\n\n", "ab\n", "a\nb", "b\na", "x" * 7 + "\n" + "x" * 8 + "\n" + "x" * 9, "É\n\U0001f600 ü", "many words in a line " * 40, "a line\n" * 3000, "x" * 40000]
    equal, like = fingerprints.vectors(texts)
    plain = [plain_lanes(x) for x in texts]
    wrapped = [[(x + 32768) % 65536 - 32768 for x in own] for _, own in plain]
    for i, (own, _) in enumerate(plain):
        assert equal[i].tolist() == own and like[i].view(np.int16).tolist() == wrapped[i]
    alone = [fingerprints.vectors([x]) for x in texts]
    assert all((e[0] == equal[i]).all() and (k[0] == like[i]).all() for i, (e, k) in enumerate(alone))

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in fingerprints.fingerprint_edits(df).collect():
        text, following = texts[r.doc_id], texts[r.doc_id - 1]
        edited = text[: len(text) - len(text) // 3] + following[: len(text) // 3]
        for other, near in ((edited, r.near_edited), (following, r.near_next)):
            (e1, a), (e2, b) = plain_lanes(text), plain_lanes(other)
            a, b = ([(x + 32768) % 65536 - 32768 for x in v] for v in (a, b))
            apart = sum(((x - y + 32768) % 65536 - 32768) ** 2 for x, y in zip(a, b, strict=True))
            both = sum(x * x for x in a + b)
            want = 1.0 if e1 == e2 and not apart else min(1.0, max(0.0, 1 - apart / both)) if both else 0.0
            assert near == pytest.approx(want, abs=1e-12)


def test_fingerprint_is_homomorphic():
    a, b = "one line\nand another", "third\n\nthird"
    assert fingerprints.insert(fingerprints.fingerprint(a), b) == fingerprints.fingerprint(f"{b}\n{a}") == fingerprints.fingerprint(f"{a}\n{b}")
    assert fingerprints.delete(fingerprints.fingerprint(f"{a}\n{b}"), "third\nthird") == fingerprints.fingerprint(f"{a}\n")
    assert fingerprints.fingerprint("a\nb") != fingerprints.fingerprint("ab\n")


# op7


def test_decontamination(spark, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {(i, k) for i, t in texts.items() for k, x in items.items() if x.rstrip(".") in t}
    got = {(r.doc_id, r.item_id): r for r in llm.QUERIES["op7_benchmark_decontamination"](spark, SF).collect()}
    assert want and want <= set(got)
    for (i, k), r in got.items():
        words = re.findall(r"\w+", items[k].lower())
        near = set(words) & set(re.findall(r"\w+", texts[i][r.begin : r.end].lower()))
        assert len(near) >= 0.5 * len(set(words))


def test_decontamination_edited(spark):
    item = " ".join(f"w{i}" for i in range(40))
    edited = " ".join(f"w{i}" if i % 7 else f"other{i}" for i in range(40))
    rows = [(1, f"x y z {edited} end", 0), (2, " ".join(f"w{i}" for i in range(8)), 0), (3, None, 0), (None, item, 0), (4, item.upper().replace(" ", ", "), 0), (4, item.upper().replace(" ", ", "), 0), (5, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gram int")
    tests = spark.createDataFrame([(9, item), (8, None), (7, ""), (6, "short one")], "item_id long, text string")
    got = decontamination.find_copies(docs, tests).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 9), (4, 9)]
    assert decontamination.drop_contaminated(docs, tests).count() == 4
    assert decontamination.find_copies(docs, tests.limit(0)).count() == decontamination.find_copies(docs.limit(0), tests).count() == 0


def test_decontamination_of_edits_beside_copies(spark):
    words = {9: [f"w{i}" for i in range(40)], 8: [f"v{i}" for i in range(15)]}
    items = {k: " ".join(w) for k, w in words.items()}
    edited = {k: " ".join(x if i % 4 else "other" for i, x in enumerate(w)) for k, w in words.items()}
    texts = [items[9], items[8], edited[9], f"x y {edited[8]} z", f"{items[9]} and {edited[8]}", " ".join(words[9][:20])] + [edited[9]] * 5
    texts.append(" ".join("other" if i in (2, 5, 8, 11) else x for i, x in enumerate(words[8])))  # one n-gram is left
    rows = list(enumerate(texts))
    tests = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.find_copies(spark.createDataFrame(rows, "doc_id long, text string"), tests).collect()}
    code = lambda text: np.array([zlib.crc32(x.encode()) for x in text.split()])
    want = {(i, k): decontamination.align(code(x), code(t))[0] for i, t in rows for k, x in items.items()}
    assert got == {k: v for k, v in want.items() if v >= decontamination.SCORE} and (2, 9) in got and (11, 8) in got


def test_decontamination_equals_full_alignment(spark):
    """Every pair of a text and an item, aligned: edits of all kinds, short items, seeds broken everywhere, a repeated tie,
    and a very long text."""
    import random

    rnd = random.Random(4)
    known = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(rnd.choice(known) for _ in range(rnd.choice([1, 2, 3, 5, 6, 8, 12, 20, 45])))) for k in range(30)]
    items += [(100, "alpha bravo charlie delta echo"), (101, "one two three four five six seven eight")]
    rows = [(0, "alpha bravo XX delta echo"), (1, "one two nope four five six never eight"), (2, ("pad " * 50_000) + items[5][1] + " gap " + items[5][1])]
    for i in range(150):
        body = [rnd.choice(known + [f"x{j}" for j in range(200)]) for _ in range(rnd.randrange(100))]
        rate, edited = rnd.choice([0.1, 0.3, 0.45]), []
        for w in rnd.choice(items)[1].split():
            u = rnd.random()
            edited += ["zz"] if u < rate / 3 else [] if u < 2 * rate / 3 else [w, f"y{i}"] if u < 1.6 * rate else [w]
        at = rnd.randrange(len(body) + 1)
        rows.append((i + 3, " ".join(body[:at] + edited + body[at:])))
    code = lambda t: np.array([zlib.crc32(x.encode()) for x in t.lower().split()], np.int64)
    want = {(i, k): x for i, t in rows for k, item in items if (x := decontamination.align(code(item), code(t))[0]) >= decontamination.SCORE}
    found = decontamination.find_copies(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.score for r in found} == want and {(0, 100), (1, 101), (2, 5)} <= set(want)


# op8


def brute_components(rows, k, percent=80):
    sets = {i: shingles(t, k) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    names = sorted(sets)
    for n, a in enumerate(names):
        for b in names[:n]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                r, s = root(a), root(b)
                up[max(r, s)] = min(r, s)
    return {i: root(i) for i in sets}, sets


def test_near_duplicates(spark, texts):
    want, sets = brute_components(texts.items(), 4)
    for r in llm.QUERIES["op8_minhash_near_dedup"](spark, SF).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_near_duplicates_of_one_large_group(spark):
    import random

    rnd = random.Random(5)
    base = [f"w{rnd.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(260):
        words = list(base)
        for _ in range(rnd.randrange(14)):
            words[rnd.randrange(120)] = f"v{rnd.randrange(300)}"
        rows.append((i, " ".join(words)))
    want, _ = brute_components(rows, 4)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_near_duplicates_odd_rows(spark, odd):
    got = near_dedup.near_duplicates(odd, k=4).collect()
    assert len(got) == len(ODD)
    assert {r.component_id for r in got if r.doc_id in (1, 4)} == {1}
    assert [(r.n_shingles, r.kept) for r in got if r.doc_id in (2, 3, 6)] == [(0, True)] * 3
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert near_dedup.drop_near_duplicates(odd, k=4).count() == len(ODD) - 2
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0
    for percent in (50, 101):
        with pytest.raises(ValueError, match="percent"):
            near_dedup.near_duplicates(odd, percent=percent)


# SQL


def same(v):
    return v if isinstance(v, bool | None) else str(v)


@pytest.mark.parametrize("name", ["op3_chat_formatting", "op8_minhash_near_dedup"])
def test_query_equals_sql(spark, duck, name):
    df = llm.QUERIES[name](spark, SF)
    want = duck.sql(llm.ORACLE_SQL[name])
    rows = lambda names, found: sorted(tuple(same(r[names.index(c)]) for c in sorted(names)) for r in found)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_sql_is_text():
    import __spark_entry__ as entry

    assert all(isinstance(x, str) for x in entry.oracle_sql().values()) and set(llm.QUERIES) < set(entry.queries())


# op9


def test_line_dedup_query(spark, duck):
    want = {r[0]: r[1:] for r in duck.sql(llm.ORACLE_SQL["op9_line_dedup"]).fetchall()}
    got = {r.doc_id: (r.source, r.text, r.n_lines, r.n_dropped) for r in llm.QUERIES["op9_line_dedup"](spark, SF).collect()}
    assert got == want and any(x[3] for x in want.values())


def test_line_dedup_odd_rows(spark, odd):
    rows = [(i, f"top \n\nbody {i}\nbottom\ntop", "h", 0, 0) for i in range(5)] + [(9, "top\n", None, 0, 0), (10, None, "h", 0, 0), (11, "top", "h", 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines int, boilerplate int")
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(df, ratio=0.5).collect()}
    assert got[0].text == "\nbody 0" and (got[0].n_lines, got[0].n_dropped) == (5, 3)
    assert (got[9].text, got[10].text, got[11].text) == ("top\n", None, "")
    assert line_dedup.drop_boilerplate(odd).count() == len(ODD) and line_dedup.drop_boilerplate(odd.limit(0)).count() == 0
    urls = spark.createDataFrame([("https://u:p@WWW.a.org:80/x",), ("nothing",)], "url string")
    assert [r[0] for r in urls.select(line_dedup.host_of(F.col("url"))).collect()] == ["www.a.org", ""]


# op10


def jump(key, n):
    b, j = -1, 0
    key &= 2**64 - 1
    while j < n:
        b = j
        key = (key * sharding.STEP + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(spark, odd, texts):
    got = llm.QUERIES["op10_sharding"](spark, SF).collect()
    assert len(got) == len(texts)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.shard, r.grown_shard) == (len(data) + 1, zlib.crc32(data), jump(r.doc_id, 16), jump(r.doc_id, 17))
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    rows = sharding.shard_layout(odd).collect()
    assert len(rows) == len(ODD) and {r.shard for r in rows if r.doc_id is None} == {jump(-1, 16)}
    assert len({(r.shard, r.slot) for r in rows}) == len(ODD) and sharding.shard_layout(odd.limit(0)).count() == 0


def test_write_shards(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "shards"), shards=4, files=2)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == docs.count() and all(r.shard == jump(r.doc_id, 4) for r in back.select("doc_id", "shard").collect())

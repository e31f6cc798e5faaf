"""The cache of ids: what is used stays, and every text has the library's ids."""

from __future__ import annotations

import random

import pyarrow as pa
import pyarrow.compute as pc

from barlake.llm import bpe

ODD = ["", " ", "\x1f", "a\x1fb c", "\x85x\xa0y z​w", "İstanbul. Straße ǅ ŉ ĸ Ⱥ ß.", "Σίσυφος ΣΑΣ.", "é É é. İ.", "x<|endoftext|>y Z.", "don't 12,5. ÀÉÎÕÜ! ×÷ ªº", None]


def test_ids_are_the_librarys_while_generations_turn_over(monkeypatch):
    monkeypatch.setattr(bpe, "ID_RUNS", 50)
    cache = bpe.IdCache(bpe.vocabulary_path())
    draw, letters = random.Random(5), [chr(i) for i in range(0x21, 0x250)] + list("    \t　́中д")
    texts = ODD + ["".join(draw.choices(letters, k=draw.randrange(40))) for _ in range(400)] * 2
    for i in range(0, len(texts), 40):
        part = texts[i : i + 40]
        for text, ids in zip(part, cache.many(pa.array(part, pa.string())), strict=True):
            assert ids.tolist() == cache.library.encode(text or "", add_special_tokens=False).ids, text


def test_frequent_runs_are_asked_for_once_though_the_cache_fills(monkeypatch):
    monkeypatch.setattr(bpe, "ID_RUNS", 300, raising=False)
    monkeypatch.setattr(bpe, "RUNS", 600)
    cache = bpe.IdCache(bpe.vocabulary_path())
    asked, learn = [], cache.learn
    monkeypatch.setattr(cache, "learn", lambda runs: (asked.extend(runs), learn(runs)))
    often = [f"often{chr(97 + i)}" for i in range(20)]
    for i in range(40):
        cache.many([" ".join(often + [f"rare{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(100)])])
    assert [asked.count(x) for x in often] == [1] * 20


def test_arrow_lowers_and_splits_as_python_does():
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    space = pc.utf8_is_space(pa.array(every)).to_pylist()
    assert all(x.isspace() == got for x, got in zip(every, space, strict=True))
    usual = [x for x in every[:0x300] if x != "İ"]
    assert pc.utf8_lower(pa.array(usual)).to_pylist() == [x.lower() for x in usual]


def test_runs_that_come_again_after_200000_others_are_not_asked_for_again(monkeypatch):
    cache = bpe.IdCache(bpe.vocabulary_path())
    asked, learn = [], cache.learn
    monkeypatch.setattr(cache, "learn", lambda runs: (asked.extend(runs), learn(runs)))
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(200_000)]
    for _ in range(2):
        for i in range(0, len(words), 20_000):
            cache.many([" ".join(words[i : i + 20_000])])
    assert len(asked) == len(words)

"""What a packing worker keeps in memory is bounded, and handed back when another operator comes."""

from __future__ import annotations

from barlake.llm import _util, bpe


def test_a_cache_of_ids_holds_few_enough_runs_for_the_pipelines_executors():
    cache = bpe.IdCache(bpe.vocabulary_path())
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(5)) for i in range(600_000)]
    for i in range(0, len(words), 20_000):
        cache.many([" ".join(words[i : i + 20_000])])
    assert 250_000 < len(cache.index) + len(cache.old[0]) <= 2 * 270_000 + 2


def test_memory_is_given_back_when_an_operator_begins_and_ends(monkeypatch):
    calls = []
    monkeypatch.setattr(_util, "_kept", {})
    monkeypatch.setattr(_util, "give_back", lambda: calls.append(len(_util._kept)))
    assert _util.kept("one", lambda: 1) == 1 and calls == [0, 1]
    assert _util.kept("one", lambda: 2) == 1 and len(calls) == 2
    assert _util.kept("two") is None and calls[2:] == [0]

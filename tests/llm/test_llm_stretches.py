"""Ids of stretches of texts: those of the library for the whole text, which is asked for each stretch once."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from barlake.llm import alignment
from barlake.llm.bpe import vocabulary_path


def test_stretches_have_the_ids_of_whole_texts():
    path = vocabulary_path(alignment.BYTE_VOCAB)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    encode = alignment.byte_side(path).encode
    draw = random.Random(3)
    pieces = list("abZé1中!,.;:?'\"(  \t\n\r\x0b\xa0  　́ſ٣\x1c\x85​﻿") + ["'s", "'ll", "  ", "<|endoftext|>", " Straße.", " word,"]
    texts = ["", " ", "\n", *("".join(draw.choice(pieces) for _ in range(draw.randrange(16))) for _ in range(20_000)), "ab " * 9000 + "x" * 500]
    for part in (texts[:9000], texts[9000:], texts[:50]):
        ids, count = encode(part)
        want = [x.ids for x in library.encode_batch([" " + t for t in part], add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == want


def test_the_library_is_asked_once_for_a_stretch(monkeypatch):
    side = alignment.byte_side(vocabulary_path(alignment.BYTE_VOCAB))
    own = side.encode.__self__
    asked: Counter = Counter()
    learn = own.learn

    def counted(new):
        asked.update(new)
        return learn(new)

    monkeypatch.setattr(own, "learn", counted)
    for _ in range(3):
        side.encode(["some words, and some words again; " * 50, "again and again."])
    assert asked and set(asked.values()) == {1} and len(asked) < 12
    # Two generations bound what is kept.
    monkeypatch.setattr(own.known, "most", 10)
    side.encode([" ".join(f"w{i}" for i in range(200))])
    assert len(own.known.new) + len(own.known.old) <= 20

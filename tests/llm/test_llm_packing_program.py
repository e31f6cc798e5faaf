"""The configuration program prices every length and covers all of the demand."""

from __future__ import annotations

import collections

import numpy as np

from barlake.llm import packing


def sequences(chosen):
    return sum(n for _, n in chosen)


def check(chosen, demand, capacity):
    held = collections.Counter()
    for config, n in chosen:
        assert n > 0 and sum(x * k for x, k in config.items()) <= capacity
        for x, k in config.items():
            held[x] += k * n
    assert held == collections.Counter(demand)


def test_lengths_that_fit_one_partner_only():
    # Each length has one that fills its sequence; a round that sees a few lengths alone leaves most of them unmet.
    demand = dict.fromkeys(range(1, 1024), 40)
    chosen = packing.plan(demand, 1024)
    check(chosen, demand, 1024)
    assert sequences(chosen) <= sequences(packing.best_fit(demand, 1024)) * 1.002
    assert sequences(chosen) <= sum(x * n for x, n in demand.items()) / 1024 * 1.002 + 1


def test_most_pieces_are_longer_than_half():
    drawn = np.clip(np.random.default_rng(7).normal(2300, 600, 20000).astype(int), 1, 4096)
    demand = dict(collections.Counter(drawn.tolist()))
    chosen = packing.plan(demand)
    check(chosen, demand, 4096)
    assert sequences(chosen) <= sequences(packing.best_fit(demand, 4096)) * 1.001


def test_nothing_is_left():
    for demand in ({1: 5}, {4095: 3}, {3: 1, 5: 2, 4096: 4}, {2048: 7, 1: 9000}, dict.fromkeys(range(1, 60), 3)):
        check(packing.plan(demand), demand, 4096)
        below = {x: n for x, n in demand.items() if x < 4096}
        assert packing.program(below, 4096, rest=0.0)[1] == {}


def test_rounds_are_near_the_most_valuable_sequence():
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = np.sort(rng.choice(np.arange(1, 200), 60, replace=False))
        left = np.zeros(257, np.int64)
        left[lengths] = rng.integers(1, 4, 60)
        weight = np.full(257, -np.inf, np.float32)
        weight[lengths] = (lengths / 256) ** packing.LEAN
        config, best = packing.priced(lengths, weight[lengths], left[lengths], 256)
        exact = sum(n * float(weight[x]) for x, n in config.items())
        assert abs(exact - float(best[256])) < 1e-4
        led, value = packing.filled(best, weight, left, 256)
        assert sum(x * n for x, n in led.items()) <= 256 and all(n <= left[x] for x, n in led.items())
        assert abs(value - sum(n * float(weight[x]) for x, n in led.items())) < 1e-9 and value <= exact + 1e-4

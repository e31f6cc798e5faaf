"""Words and shingles of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_SALT = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Letters, digits and all bytes of longer characters: words without punctuation.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_WINDOW = 1 << 21
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        up, down = np.full(n, _BASE), np.full(n, _UNBASE)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.cumprod(up), np.cumprod(down)
    return _powers["up"], _powers["down"]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins (n + 1 offsets). Null counts as empty."""
    column = pa.compute.fill_null(column, "").cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def word_hashes(data: np.ndarray, at: np.ndarray, of: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word (A-Z lower-cased, runs of bytes but space and 9-13), its first and past-last byte, and
    where each text's words begin (n + 1 offsets). of: which bytes belong to words."""
    is_word = of[data]
    first, last = is_word.copy(), is_word.copy()
    first[1:] &= ~is_word[:-1]
    last[:-1] &= ~is_word[1:]
    full = np.flatnonzero(at[1:] > at[:-1])
    first[at[:-1][full]] = is_word[at[:-1][full]]
    last[at[1:][full] - 1] = is_word[at[1:][full] - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(begin), np.uint64)
    i = 0
    while i < len(begin):  # windows of whole words bound the memory for long texts
        j = max(i + 1, int(np.searchsorted(end, begin[i] + _WINDOW, side="right")))
        low, high = int(begin[i]), int(end[j - 1])
        up, down = _power(high - low)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_SALT[_LOWER[data[low:high]]] * up[: high - low], out=total[1:])
        b, e = begin[i:j] - low, end[i:j] - low
        hashes[i:j] = mix((total[e] - total[b]) * down[b] + (e - b).astype(np.uint64) * _M1)
        i = j
    return hashes, begin, end, np.searchsorted(begin, at)


def shingles(hashes: np.ndarray, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of k words of each text, with repeats, and where each text's begin. A text of fewer
    words has its whole sequence as one; one without words has none."""
    n = np.diff(words)
    counts = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    out = np.zeros(len(n) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    result = np.empty(out[-1], np.uint64)
    if len(hashes) >= k:
        run = hashes[: len(hashes) - k + 1].copy()
        for j in range(1, k):
            run = run * _BASE + hashes[j : len(hashes) - k + 1 + j]
        run = mix(run)
        long = np.flatnonzero(n >= k)
        take = np.repeat(words[:-1][long] - out[:-1][long], counts[long])
        where = np.concatenate([np.arange(out[i], out[i + 1]) for i in long]) if len(long) < 64 else np.flatnonzero(np.repeat(n >= k, counts))
        if len(long):
            result[where] = run[where + take]
    for i in np.flatnonzero((n > 0) & (n < k)):
        h = np.uint64(int(n[i]))
        with np.errstate(over="ignore"):
            for x in hashes[words[i] : words[i + 1]]:
                h = h * _M2 + x
            result[out[i]] = mix(np.array([h]))[0]
    return result, out


def distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and where each text's begin."""
    if not len(values):
        return values, np.zeros(len(at), np.int64)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    out = np.zeros(len(at), np.int64)
    np.cumsum(np.bincount(text[new], minlength=len(at) - 1), out=out[1:])
    return values[new], out

"""The public word-level BPE vocabulary, compiled for Spark tasks.

Two things are made from one vocabulary file: a deterministic finite transducer whose transitions carry the change of the
token count, with a cache of the counts of runs in front of it, and a cache of ids in front of the tokenizers library. Both work on runs of text without white space,
since white space always ends a token of this vocabulary and is itself dropped.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers.normalizers import NFC

from ._util import kept

VOCAB = "word_bpe_49k.json"
#: Fixed values of the vocabulary file: its pattern of words, special strings and word-end mark.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
MARKS, COMPOSER = regex.compile(r"\p{M}"), NFC()
SPECIALS = re.compile(r"<\|startoftext\|>|<\|endoftext\|>")
WORD_END = "</w>"
#: White space as the library has it: four control characters that Python's split() takes for white space are none.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_CONTROLS = re.compile("[\x1c-\x1f]")
#: Characters in a chunk of a text, states of the transducer and runs in a cache; beyond the last two they are made anew.
CHUNK = 1 << 16
#: Bytes of a piece of a long word, and characters of the longest run that a cache keeps.
PIECE, KEPT_RUN = 1 << 12, 256
STATES = 300_000
RUNS = 500_000
#: Runs of each of the two generations of a cache of ids: few enough for memory, and enough that runs are seldom asked for again.
ID_RUNS = 250_000
#: Letters that have one small form and no marks: words of them are passed to the library without its own normalisation.
_PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
#: Characters from which on lower-casing before normalisation might give other characters than after it.
_LATE = re.compile("[\u0130\u0300-\U0010ffff]")
_STOPS = frozenset(",.;:!?")


def vocabulary_path(name: str = VOCAB) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def lowered(text: str) -> str:
    """The text in lower case, where that changes nothing but the number of different runs."""
    return text if _LATE.search(text) else text.lower()


def normalised(run: str) -> str:
    """Composed and in lower case, as the library does it: a capital sigma has one small form wherever it stands. Runs with
    marks are left to its own composer, which knows fewer of them than Python does."""
    if run.isascii():
        return run.lower()
    composed = COMPOSER.normalize_str(run) if MARKS.search(run) else unicodedata.normalize("NFC", run)
    return composed.replace("Σ", "σ").lower()


def stem_of(run: str) -> str:
    """A run without its last character, if that is a lone stop after letters: a token of its own. What counts are the
    normalised letters: the small form of a capital I with a dot has a mark, which isn't one, and goes with the stop."""
    return run[:-1] if run[-1] in _STOPS and normalised(run[:-1]).isalpha() else run


class Generations:
    """A bounded map: when it is full, what was used since the last time stays."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.new: dict = {}
        self.old: dict = {}

    def get(self, key: str) -> object | None:
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value: object) -> None:
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[key] = value


def runs_of(text: str) -> list[str]:
    if _CONTROLS.search(text):
        return [x for x in _SPACE.split(text) if x]
    return text.split()


def words_of(run: str) -> list[str]:
    """The pre-tokens of a run, normalised."""
    run = normalised(run)
    return [run] if run.isalpha() else PATTERN.findall(run)


def _byte_names() -> list[str]:
    """Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    odd = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(odd)) for b in range(256)]


#: What a state of the transducer knows of each border at which its next tokens may begin: the bytes since, the token
#: that ends there, and how many tokens there are up to there, less those up to here.
Border = tuple[str, str, int]
#: An entry state's exit state, and the net count of tokens between.
StateMap = dict[int, tuple[int, int]]


class Transducer:
    """Counts the tokens of a word byte by byte, as a deterministic finite transducer whose transitions carry counts.

    BPE of a prefix is a prefix of BPE as long as the last token stands: the last token of each prefix is the longest
    vocabulary entry that ends there and is compatible with the last token before it. So a state is the list of borders
    whose bytes since then begin a vocabulary entry; what lies further back can't matter. There are finitely many, whatever
    the words; they and their transitions are made when first reached, and equal ones are one state.
    """

    def __init__(self, path: str) -> None:
        model = json.load(open(path, encoding="utf-8"))["model"]
        self.names = _byte_names()
        self.rank = {x: -1 for x in self.names} | {x + WORD_END: -1 for x in self.names}
        self.parts: dict[str, tuple[str, str]] = {}
        self.merges: dict[tuple[str, str], int] = {}
        for i, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[a, b] = i
            if a + b not in self.parts:
                self.parts[a + b], self.rank[a + b] = (a, b), i
        bodies = {x.removesuffix(WORD_END) for x in self.rank}
        self.longest = max(map(len, bodies))
        self.begins = {x[:i] for x in bodies for i in range(1, len(x))}
        self.reset()

    def reset(self) -> None:
        self.compatible: dict[tuple[str, str], bool] = {}
        self.next: dict[tuple[int, int], tuple[int, int]] = {}
        self.final: dict[tuple[int, int], int] = {}
        self.states: list[tuple[Border, ...]] = [(("", "", 0),)]
        self.ids = {self.states[0]: 0}

    def fits(self, left: str, right: str) -> bool:
        """Whether BPE keeps both tokens as they are when they stand side by side: undo the latest merges next to the
        border one by one; none of the pairs that met there may have merged before."""
        key = (left, right)
        if (known := self.compatible.get(key)) is not None:
            return known
        limit = len(self.merges) * 2
        a, b, answer = left, right, True
        while True:
            r = self.merges.get((a, b))
            if r is not None and r < limit:
                answer = False
                break
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                limit, a = ra, self.parts[a][1]
            else:
                limit, b = rb + 1, self.parts[b][0]
        self.compatible[key] = answer
        return answer

    def emitted(self, state: int, name: str, mark: str = "") -> tuple[str, int]:
        """The last token after one more byte, and the change of the count."""
        for since, last, count in self.states[state]:  # from the longest on
            token = since + name + mark
            if token in self.rank and (not last or self.fits(last, token)):
                return token, count + 1
        raise ValueError(f"no token ends in {name!r}")

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """The next state, and the change of the count."""
        found = self.next.get((state, byte))
        if found is None:
            name = self.names[byte]
            token, more = self.emitted(state, name)
            borders = tuple((u + name, last, n - more) for u, last, n in self.states[state] if u + name in self.begins)
            borders += (("", token, 0),)
            to = self.ids.setdefault(borders, len(self.states))
            if to == len(self.states):
                self.states.append(borders)
            found = self.next[state, byte] = (to, more)
        return found

    def end(self, state: int, byte: int) -> int:
        """The change of the count by a word's last byte."""
        found = self.final.get((state, byte))
        if found is None:
            found = self.final[state, byte] = self.emitted(state, self.names[byte], WORD_END)[1]
        return found

    def run(self, data: bytes, state: int = 0) -> tuple[int, int]:
        count, known = 0, self.next
        for b in data:
            found = known.get((state, b))
            state, more = found if found is not None else self.step(state, b)
            count += more
        return state, count

    def piece_map(self, data: bytes, before: bytes) -> StateMap:
        """What a piece of a word does to the states in which it may be entered: those that the end of what stands before
        it leads to, wherever tokens begin there. Runs that meet in one state at one byte go on as one."""
        entries = {self.run(before[-d:])[0] for d in range(1, 2 * self.longest + 1)} if before else {0}
        path: list[tuple[int, int]] = []  # of the first entry: state and count before each byte, and at the end
        out: StateMap = {}
        for entry in entries:
            state, count, first = entry, 0, not path
            for i, b in enumerate(data):
                if first:
                    path.append((state, count))
                elif path[i][0] == state:
                    state, count = path[-1][0], count + path[-1][1] - path[i][1]
                    break
                state, more = self.step(state, b)
                count += more
            if first:
                path.append((state, count))
            out[entry] = (state, count)
        return out

    def joined(self, data: bytes, a: tuple[int, int, StateMap], b: tuple[int, int, StateMap]) -> tuple[int, int, StateMap]:
        """The map of two neighbouring parts of a word (begin, end, map); associative. A state that the second part's map
        lacks is added to it by running it."""
        out: StateMap = {}
        for entry, (state, count) in a[2].items():
            if state not in b[2]:
                b[2][state] = self.run(data[b[0] : b[1]], state)
            to, more = b[2][state]
            out[entry] = (to, count + more)
        return a[0], b[1], out

    def tokens(self, word: str) -> int:
        data = word.encode()
        inner = len(data) - 1
        if inner <= PIECE:
            state, count = self.run(data[:-1])
        else:
            parts = [(i, min(i + PIECE, inner), self.piece_map(data[i : min(i + PIECE, inner)], data[max(0, i - 2 * self.longest) : i])) for i in range(0, inner, PIECE)]
            while len(parts) > 1:  # neighbours in pairs, as the up-sweep of a prefix scan
                parts = [self.joined(data, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
            state, count = parts[0][2][0]
        count += self.end(state, data[-1])
        if len(self.states) > STATES:
            self.reset()
        return count


class TokenCounter:
    """Token counts of whole texts by composing the state maps of their chunks."""

    def __init__(self, path: str) -> None:
        self.transducer = Transducer(path)
        self.known = Generations(RUNS)

    def run_tokens(self, run: str) -> int:
        n = self.known.get(run)
        if n is None:
            stem = stem_of(run)
            n = sum(map(self.transducer.tokens, words_of(run))) if stem == run else self.run_tokens(stem) + 1
            if len(run) <= KEPT_RUN:
                self.known.put(run, n)
        return n

    def chunk_map(self, chunk: str) -> tuple[str, int | None, str]:
        """What a chunk does to any state it is entered in: white space leads every state to the first one, so only the
        run that crosses the chunk's begin and the one that crosses its end stay open: (head, tokens between, tail). A
        chunk without white space is all head, with None; a run that is longer than a piece is counted by the state maps
        of its pieces."""
        runs = runs_of(chunk)
        if not runs:
            return ("", 0, "") if chunk else ("", None, "")
        head = "" if _SPACE.match(chunk[0]) else runs[0]
        if head and len(head) == len(chunk):
            return head, None, ""
        tail = "" if _SPACE.match(chunk[-1]) else runs[-1]
        inner = runs[bool(head) : len(runs) - bool(tail)]
        found = list(map(self.known.new.get, inner))
        if None in found:
            found = [self.run_tokens(x) if n is None else n for x, n in zip(inner, found, strict=True)]
        return head, sum(found), tail

    def join(self, a: tuple, b: tuple) -> tuple:
        """The map of two neighbouring chunks; associative."""
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        if b[1] is None:
            return a[0], a[1], a[2] + b[0]
        middle = a[2] + b[0]
        return a[0], a[1] + b[1] + (self.run_tokens(middle) if middle else 0), b[2]

    def part(self, text: str) -> int:
        text = lowered(text)
        maps = [self.chunk_map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:  # neighbours in pairs, as the up-sweep of a prefix scan
            maps = [self.join(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        if not maps:
            return 0
        head, n, tail = maps[0]
        return (self.run_tokens(head) if head else 0) + (n or 0) + (self.run_tokens(tail) if tail else 0)

    def tokens(self, text: str) -> int:
        """Special strings of the vocabulary count one each, as the library takes them by default."""
        if "<|" not in text:
            return self.part(text)
        return sum(map(self.part, SPECIALS.split(text))) + len(SPECIALS.findall(text))


def _gathered(pool: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of a pool in a row, and where each ends."""
    ends = np.cumsum(size)
    from_ = np.repeat(at - ends + size, size)
    from_ += np.arange(len(from_))
    return pool.take(from_, mode="clip"), ends


class IdCache:
    """Ids of whole texts as the tokenizers library gives them; it is asked for each run of characters when that is first
    seen. The different runs of a batch are found in Arrow; the cache has two generations, and what is used stays."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith(WORD_END)]] = True
        self.stops = {x: vocabulary[x + WORD_END] for x in _STOPS}
        # The vocabulary's own merges, for words that are normalised before.
        model = json.load(open(path, encoding="utf-8"))["model"]
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.merger = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=WORD_END, cache_capacity=0))
        self.merger.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.names = {i: x for i, x in enumerate(_byte_names()) if i != 32}
        self.reset()
        self.old = self.index, self.at, self.size, self.pool

    def reset(self) -> None:
        self.index: dict[str, int] = {"": 0}  # what Arrow finds before white space that begins a text
        self.at, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.pool, self.used = np.zeros(1 << 18, np.uint16), 0

    def _keep(self, runs: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        n = len(self.index)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n + len(runs) > len(self.at):
            self.at, self.size = np.concatenate([self.at, self.at]), np.concatenate([self.size, self.size])
        self.pool[self.used : self.used + len(ids)] = ids
        self.size[n : n + len(runs)] = size
        self.at[n : n + len(runs)] = self.used + np.cumsum(size) - size
        self.index.update(zip(runs, range(n, n + len(runs)), strict=True))
        self.used += len(ids)

    def learn(self, runs: list[str]) -> None:
        """Ask the library for many runs at once; the tokens that end a word tell where each run's ids end."""
        stems = [x for x in dict.fromkeys(map(stem_of, runs)) if x not in self.index]
        plain = [x for x in stems if _PLAIN.fullmatch(x)]
        for i in range(0, len(plain), 200):
            part = plain[i : i + 200]
            text = " ".join(part).lower()
            text = text if text.isascii() else text.encode().decode("latin-1").translate(self.names)
            ids = np.array(self.merger.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)
            self._keep(part, ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1))
        stems = [x for x in stems if x not in self.index]
        for i in range(0, len(stems), 1000):
            part = stems[i : i + 1000]
            ids = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint16)
            words = np.array([1 if x.isascii() and x.isalpha() else len(words_of(x)) for x in part])
            last = np.concatenate([[-1], np.flatnonzero(self.ends[ids])])[np.cumsum(words)]
            self._keep(part, ids, np.diff(last, prepend=-1))
        rest = [x for x in runs if x not in self.index]
        if rest:
            where = np.array([self.index[x[:-1]] for x in rest])
            ids, ends = self._gather(where, 1)
            ids[ends - 1] = [self.stops[x[-1]] for x in rest]
            self._keep(rest, ids, self.size[where] + 1)

    def _gather(self, where: np.ndarray, more: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The ids of runs in a row, with `more` places after each (of any content), and where each run's end."""
        return _gathered(self.pool, self.at[where], self.size[where] + more)

    def _places(self, runs: list[str]) -> np.ndarray:
        """Where different runs are in the cache, after learning those that it lacks."""
        if len(self.index) >= ID_RUNS:
            self.old = self.index, self.at, self.size, self.pool
            self.reset()
        found = list(map(self.index.get, runs))
        new = [i for i, n in enumerate(found) if n is None]
        if new:
            index, at, size, pool = self.old
            missed = [runs[i] for i in new]
            before = list(map(index.get, missed))
            known = [x for x, n in zip(missed, before, strict=True) if n is not None]
            if known:
                where = np.array([n for n in before if n is not None])
                self._keep(known, _gathered(pool, at[where], size[where])[0], size[where])
            self.learn([x for x, n in zip(missed, before, strict=True) if n is None])
            for i, n in zip(new, map(self.index.get, missed), strict=True):
                found[i] = n
        return np.array(found, np.int64)

    def _of_runs(self, runs: pa.ListArray) -> list[np.ndarray]:
        """The ids of texts that are given as lists of runs."""
        flat = runs.flatten().dictionary_encode()
        if not len(flat):
            return [np.zeros(0, np.uint16)] * len(runs)
        ids, ends = self._gather(self._places(flat.dictionary.to_numpy(zero_copy_only=False).tolist())[flat.indices.to_numpy()])
        last = np.cumsum(pc.list_value_length(runs).to_numpy())
        return np.split(ids, np.where(last > 0, ends[last - 1], 0)[:-1])

    def many(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts, "") if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(texts):
            return []
        special, control = pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, _CONTROLS.pattern)
        usual = pc.if_else(pc.or_(special, control), "", texts)
        usual = pc.if_else(pc.match_substring_regex(usual, _LATE.pattern), usual, pc.utf8_lower(usual))
        out = self._of_runs(pc.utf8_split_whitespace(usual))
        for i in np.flatnonzero(pc.or_(special, control).to_numpy(zero_copy_only=False)).tolist():
            text = texts[i].as_py()
            if "<|" in text:  # special strings may be in it
                out[i] = np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint16)
            else:
                out[i] = self._of_runs(pa.array([runs_of(lowered(text))], pa.list_(pa.string())))[0]
        return out

    def ids(self, text: str) -> np.ndarray:
        return self.many([text])[0]


def shared(kind: type, path: str):  # noqa: ANN201
    """One per Python worker, until another operator runs there."""
    return kept(f"{kind.__name__} {path}", lambda: kind(path))

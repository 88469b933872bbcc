"""Compiling a byte-level BPE vocabulary into deterministic finite-state machines.

Two machines work one after the other. ``Splitter`` walks over characters and marks where words begin; it has eight states,
so what a chunk of text does is a map of eight states, and the maps of all chunks compose by a parallel prefix scan.
``CountTransducer`` walks over the bytes of a word; its transitions say how many tokens they emit.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTER, NUMBER, OTHER, SPACE = range(4)
#: input symbols: a character's class, with what the next characters decide
_SHORT, _LONG, _LAST_BLANK, _LAST_SPACE = range(4, 8)
_FIRST = 8  # added to the symbol of the first character of a segment
#: states: nothing begun, inside a word of one class, after the blank that begins a word, in white space, in a contraction
_START, _LETTERS, _NUMBERS, _OTHERS, _BLANK, _SPACES, _ONE_LEFT, _TWO_LEFT = range(8)
_CHUNK = 64


def character_classes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Runs of code points of one class, as (first code point, class), read off the vocabulary's own word splitter.

    Runs of one Unicode category are shown to the splitter after a character of that class, between others: a run that it
    keeps whole has that class. Others are halved, as the splitter may know another version of Unicode; a single code point stands
    between a letter and a digit, and between two marks, and where the splitter cuts tells its class.
    """
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer

    def starts(text: str) -> np.ndarray:
        found = np.zeros(len(text) + 1, bool)
        found[[at for _, (at, _) in split.pre_tokenize_str(text)]] = True
        return found

    kinds = {"L": LETTER, "N": NUMBER}
    guess = np.array([SPACE if chr(p).isspace() else kinds.get(unicodedata.category(chr(p))[0], OTHER) for p in range(0x110000)], np.uint8)
    bounds = np.flatnonzero(np.diff(guess, prepend=255, append=255))
    valid = lambda a, b: [(x, y) for x, y in ((a, min(b, 0xD800)), (max(a, 0xE000), b)) if x < y]
    runs = [run for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True) for run in valid(a, b)]
    classes, single = np.full(0x110000, OTHER, np.uint8), []
    while runs:
        shown = ["".join(map(chr, range(a, b))) for a, b in runs]
        around = [{LETTER: ("1a", "1"), NUMBER: ("a1", "a")}.get(int(guess[a]), ("a!", "a")) for a, _ in runs]
        cut = starts("".join(f"{before}{s}{after}" for s, (before, after) in zip(shown, around, strict=True)))
        counts, at, halves = np.cumsum(cut), 0, []
        for a, b in runs:
            n = b - a
            if guess[a] != SPACE and cut[at + 1] and cut[at + 2 + n] and counts[at + 1 + n] == counts[at + 1]:
                classes[a:b] = guess[a]
            elif n == 1:
                single.append(a)
            else:
                halves += [(a, a + n // 2), (a + n // 2, b)]
            at += n + 3
        runs = halves
    cut = starts("".join(f"a{chr(p)}1!{chr(p)}!" for p in single))[:-1].reshape(-1, 6)
    classes[single] = np.select([~cut[:, 1], ~cut[:, 2], cut[:, 4]], [LETTER, NUMBER, SPACE], OTHER)
    classes[0x20] = SPACE  # the one kind of white space that belongs to the word after it
    first = np.flatnonzero(np.diff(classes, prepend=255))
    return first.astype(np.int32), classes[first]


def _split_tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a word begins here" by symbol and state."""
    begun = {LETTER: _LETTERS, NUMBER: _NUMBERS, OTHER: _OTHERS, SPACE: _SPACES, _SHORT: _ONE_LEFT, _LONG: _TWO_LEFT, _LAST_BLANK: _BLANK, _LAST_SPACE: _START}
    follow, begins = np.zeros((16, 8), np.uint8), np.ones((16, 8), bool)
    for symbol, state in begun.items():
        follow[symbol] = follow[symbol + _FIRST] = state
        going_on = {(_LETTERS, LETTER): _LETTERS, (_NUMBERS, NUMBER): _NUMBERS, (_SPACES, SPACE): _SPACES, (_BLANK, LETTER): _LETTERS, (_BLANK, NUMBER): _NUMBERS}
        going_on |= {(_TWO_LEFT, symbol): _ONE_LEFT, (_ONE_LEFT, symbol): _START}
        going_on |= {(s, mark): _OTHERS for s in (_OTHERS, _BLANK) for mark in (OTHER, _SHORT, _LONG)}
        for (before, at), after in going_on.items():
            if at == symbol:
                follow[symbol, before], begins[symbol, before] = after, False
    return follow, begins


class Splitter:
    """Marks where words begin; words are runs of letters, digits or marks with one blank before them, contractions, and white space."""

    follow, begins = _split_tables()

    def __init__(self, classes: tuple[np.ndarray, np.ndarray]) -> None:
        first, kind = classes
        self.classes = np.repeat(kind, np.diff(first, append=0x110000))

    def symbols(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The input symbols of code points, ``first`` of which begin a segment (no word spans two)."""
        n = len(points)
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        inside = np.ones(n + 2, bool)  # the character belongs to the segment of the one before
        inside[first] = False
        inside[n:] = False
        kind = self.classes[points].astype(np.uint8)
        space = kind == SPACE
        last = space & inside[1 : n + 1]
        last[:-1] &= ~space[1:]
        kind[last] = np.where(points[last] == 0x20, _LAST_BLANK, _LAST_SPACE)
        marks = np.flatnonzero(points == ord("'"))
        marks = marks[inside[marks + 1]]
        one, two = padded[marks + 1], padded[marks + 2]
        kind[marks[np.isin(one, [ord(c) for c in "stmd"])]] = _SHORT
        ends = [(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")]
        kind[marks[np.logical_or.reduce(ends) & inside[marks + 2]]] = _LONG
        kind[first] += _FIRST
        return kind

    def state_maps(self, symbols: np.ndarray) -> np.ndarray:
        """Per chunk (row of symbols) the state it leads to from each of the eight states."""
        flat, maps = self.follow.ravel(), np.tile(np.arange(8, dtype=np.uint8), (len(symbols), 1))
        for column in symbols.T:
            maps = flat[(column[:, None] << 3) | maps]
        return maps

    @staticmethod
    def scan(maps: np.ndarray) -> np.ndarray:
        """Inclusive prefix composition of state maps: row i leads through the chunks 0 to i."""
        step = 1
        while step < len(maps):
            maps = np.concatenate([maps[:step], np.take_along_axis(maps[step:], maps[:-step], 1)])
            step *= 2
        return maps

    def word_starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Places of the code points that begin a word."""
        n = len(points)
        if not n:
            return np.zeros(0, np.int64)
        rows = -(-n // _CHUNK)
        symbols = np.zeros(rows * _CHUNK, np.uint8)
        symbols[:n] = self.symbols(points, first)
        symbols = symbols.reshape(rows, _CHUNK)
        state = np.concatenate([[_START], self.scan(self.state_maps(symbols))[:-1, _START]]).astype(np.uint8)
        begins = np.empty((rows, _CHUNK), bool)
        for j, column in enumerate(symbols.T):
            at = (column << 3) | state
            begins[:, j], state = self.begins.ravel()[at], self.follow.ravel()[at]
        return np.flatnonzero(begins.ravel()[:n])


    def words(self, segments: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The words of strings (binary), the byte that each begins at, and the bytes that the strings begin and end at."""
        data, offsets = string_bytes(segments)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        begins = np.flatnonzero((data & 0xC0) != 0x80)
        starts = begins[self.word_starts(points, np.searchsorted(begins, offsets[:-1][np.diff(offsets) > 0]))]
        return cut_bytes(data, starts), starts, offsets


def string_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings one after another, and where they begin and end."""
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if offsets is not None else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def cut_bytes(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Bytes as binary values that begin at ``starts``, the first of which is 0."""
    ends = np.append(starts, len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class CountTransducer:
    """A deterministic transducer from the bytes of a word to the number of its tokens.

    A BPE reading is the one sequence of tokens whose neighbours all fit: no merge between the two comes before the merges
    that made them. So an automaton that guesses tokens reads every word in exactly one way, and its determinisation counts
    them. A state is the set of tokens that may be under way: (place in the tree of tokens, token before, tokens counted
    beyond the least of the set). A transition emits by how much that least count grows; a word's end emits the rest.

    States are compiled when text first needs them and forgotten together when there are ``most`` transitions, so memory is
    bounded and results don't depend on it.
    """

    def __init__(self, merges: Sequence[tuple[str, str]], ids: dict[str, int], most: int = 500_000) -> None:
        alphabet = byte_alphabet()
        self.most = most
        self.merged: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        made = [ids[c] for c in alphabet]
        self.rank = dict.fromkeys(made, -1)
        for rank, (a, b) in enumerate(merges):
            whole = ids[a + b]
            self.merged[ids[a] << 20 | ids[b]] = rank
            if whole in self.rank:
                raise ValueError(f"two merges make {a + b!r}")
            self.halves[whole], self.rank[whole] = (ids[a], ids[b]), rank
        self.children: dict[int, int] = {}
        self.token = [-1]
        inner = {0}
        text = {i: t for t, i in ids.items()}
        for token in self.rank:
            node = 0
            for c in text[token]:
                key = node << 8 | alphabet[c]
                inner.add(node)
                if (node := self.children.get(key, -1)) < 0:
                    node = self.children[key] = len(self.token)
                    self.token.append(-1)
            self.token[node] = token
        self.inner = inner
        self.edges: dict[int, tuple[tuple[tuple[int, int], ...], tuple[tuple[int, int], ...]]] = {}
        self.forget()

    def forget(self) -> None:
        self.fits: dict[int, bool] = {}
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.transitions: dict[int, int] = {}
        self.rest: list[int] = []
        self.number(((0, -1, 0),))

    def number(self, state: tuple) -> int:
        found = self.numbers.get(state)
        if found is None:
            found = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.rest.append(state[-1][2])
        return found

    def edge(self, token: int) -> tuple:
        """The parts of a token along its left and its right side, each with the rank of the merge that ends it."""
        found = self.edges.get(token)
        if found is None:
            sides = []
            for side in (0, 1):
                part, until, parts = token, 1 << 30, []
                while True:
                    parts.append((part, until))
                    if part not in self.halves:
                        break
                    until, part = self.rank[part], self.halves[part][side]
                sides.append(tuple(parts))
            found = self.edges[token] = tuple(sides)
        return found

    def fit(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens apart: no merge of parts at the seam comes while both parts exist.

        Of equal merges the left one comes first.
        """
        key = left << 20 | right
        found = self.fits.get(key)
        if found is None:
            found = True
            for a, a_until in self.edge(left)[1]:
                for b, b_until in self.edge(right)[0]:
                    rank = self.merged.get(a << 20 | b)
                    if rank is not None and rank < a_until and rank <= b_until:
                        found = False
            self.fits[key] = found
        return found

    def compile(self, key: int) -> int:
        """The transition of a state and a byte: the next state's number, and the tokens emitted in the low eight bits."""
        going, ended = [], None
        for place, before, count in self.states[key >> 8]:
            place = self.children.get(place << 8 | (key & 0xFF), -1)
            if place < 0:
                continue
            token = self.token[place]
            if ended is None and token >= 0 and (before < 0 or self.fit(before, token)):
                ended = (0, token, count + 1)
            if place in self.inner:
                going.append((place, before, count))
        going.append(ended)
        least = min(count for _, _, count in going)
        made = self.transitions[key] = self.number(tuple((p, t, c - least) for p, t, c in going)) << 8 | least
        return made

    def count(self, word: bytes) -> int:
        """How many tokens a word has."""
        if len(self.transitions) > self.most:
            self.forget()
        known, state, n = self.transitions.get, 0, 0
        for i, byte in enumerate(word):
            key = state << 8 | byte
            step = known(key)
            if step is None:
                step = self.compile(key)
                if len(self.transitions) > 2 * self.most:  # inside a very long word: keep the state, forget the others
                    now = self.states[step >> 8]
                    self.forget()
                    known = self.transitions.get
                    step = self.number(now) << 8 | (step & 0xFF)
            state = step >> 8
            n += step & 0xFF
        return n + self.rest[state]


class TokenCounter:
    """Counts the tokens of many texts at once."""

    def __init__(self, path: str, classes: tuple[np.ndarray, np.ndarray]) -> None:
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        model, split = described["model"], described["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space") or described["normalizer"] or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE without a prefix space or normaliser is compiled")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.splitter, self.transducer = Splitter(classes), CountTransducer(merges, model["vocab"])
        added = [t for t in described["added_tokens"] if t["content"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("only added tokens that stand for themselves are compiled")
        self.special = "|".join(r"\Q" + t["content"] + r"\E" for t in sorted(added, key=lambda t: -len(t["content"])))

    def words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The words of all texts (binary), how many each text has, and how many special strings stand between them."""
        texts = pc.fill_null(texts, "").cast(pa.string())
        parts = pc.split_pattern_regex(texts, self.special) if self.special else pc.split_pattern(texts, "\0\0")
        n_parts = pc.list_value_length(parts).to_numpy()
        words, starts, offsets = self.splitter.words(parts.flatten())
        of_text = np.concatenate([[0], np.cumsum(n_parts)])
        return words, np.diff(np.searchsorted(starts, offsets[of_text])), n_parts - 1

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; equal words are counted once."""
        if not len(texts):
            return np.zeros(0, np.int64)
        words, n_words, specials = self.words(texts)
        coded = words.dictionary_encode()
        tokens = np.fromiter(map(self.transducer.count, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        sums = np.concatenate([[0], np.cumsum(tokens[coded.indices.to_numpy()])])
        ends = np.cumsum(n_words)
        return sums[ends] - sums[ends - n_words] + specials


@functools.cache
def token_counter(path: str, first: bytes, kind: bytes) -> TokenCounter:
    """One a Python worker, compiled once; the character classes come as the bytes of ``character_classes``."""
    return TokenCounter(path, (np.frombuffer(first, np.int32), np.frombuffer(kind, np.uint8)))

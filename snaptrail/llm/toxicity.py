"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

Inputs of a word are the embedding of the word, if training met it often enough, and two character inputs: the mean
embedding of its trigrams and that of its first 3, 4 and 5 letters (hashed, word ends marked), so new inflections and
spellings are seen as well. Two gated recurrent layers, one a direction, read windows of ``WINDOW`` words; attention pools
their states to one logit. Windows start every ``STRIDE`` words, fewer than they are long, so they overlap, and all
windows of a text are scored. A text's score weighs its three highest windows and the share of toxic ones, as one odd
window in a long text means less than several in a short one. The network is trained here, in numpy.

Only a bounded sample is learned from: about ``per_label`` labelled texts of each label, of at most ``longest`` code
points, drawn by a hash of the id. As a toxic text is toxic in few places, training picks each toxic text's most telling
window (first by trigram log-odds, then by the network itself) and adds the clean windows that it takes for toxic.

Defined results: null text or text without words scores 0; repeated rows stay repeated; several labels of one id count
as toxic if one is; if there is nothing to learn from, or one label only, all score 0; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaptrail.llm.common import give_back, freed, parts_of

WINDOW, STRIDE = 24, 16
HIDDEN, WORD_SIZE, CHAR_SIZE = 8, 8, 16
TRIGRAMS = PREFIXES = 1 << 12
PREFIX_SIZES = (4, 5, 6)  # with the mark of the word's start
UPDATES = 150
KNOWN_ROWS = 200_000
TEXT_BYTES = 4 << 20
THRESHOLD = 0.7
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def normal(word: str) -> str:
    word = word.lower()
    return word if word.isalpha() else _EDGES.sub("", word)


def trigram_places(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all words one after another, and how many each word has (at least one)."""
    code = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    h = code * np.uint32(0x9E3779B1)
    two = np.append(code[1:], [0]).astype(np.uint32) * np.uint32(0x85EBCA6B)
    three = np.append(code[2:], [0, 0]).astype(np.uint32)[: len(code)] * np.uint32(0xC2B2AE35)
    h = (h ^ (two << np.uint32(1)) ^ (three << np.uint32(2))) * np.uint32(0x27D4EB2F)
    place = (h ^ (h >> np.uint32(15))) % np.uint32(TRIGRAMS)
    keep = np.ones(len(code), bool)
    keep[ends - 1] = False  # a trigram begins at all but a word's last two places; a word without letters keeps one
    long = sizes > 2
    keep[ends[long] - 2] = False
    return place[keep].astype(np.int64), np.where(long, sizes - 2, 1)


def prefix_places(words: list[str]) -> np.ndarray:
    """Hashed beginnings of every word, a column a length; a shorter word counts as a whole."""
    code = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.cumsum(sizes) - sizes
    h, out = np.full(len(words), 0x1234567, np.uint32), []
    for j in range(max(PREFIX_SIZES)):
        there = j < sizes
        step = (h ^ code[np.minimum(start + j, len(code) - 1)]) * np.uint32(0x9E3779B1)
        h = np.where(there, step ^ (step >> np.uint32(15)), h)
        if j + 1 in PREFIX_SIZES:
            out.append(h % np.uint32(PREFIXES))
    return np.stack(out, 1).astype(np.int64)


class Network:
    """Parameters, forward pass, gradients (Adam)."""

    def __init__(self, vocabulary: list[str], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.words = {w: i + 1 for i, w in enumerate(vocabulary)}
        d, h = WORD_SIZE + 2 * CHAR_SIZE, HIDDEN

        def init(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.p = {
            "word": init(len(vocabulary) + 1, WORD_SIZE, scale=0.03), "char": init(TRIGRAMS, CHAR_SIZE, scale=0.03), "start": init(PREFIXES, CHAR_SIZE, scale=0.03), "w": init(2, d, 3 * h, scale=d**-0.5), "b": np.zeros((2, 3 * h), np.float32),
            "u": init(2, h, 3 * h, scale=h**-0.5), "att": init(2 * h, scale=0.3), "out": init(2 * h, scale=0.5), "bias": np.full(1, -1, np.float32),
        }
        self.p["word"][0] = 0
        self.weights = np.array([1.0, 0, 0, 0, 0, 0])
        self.moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        self.steps = 0

    def inputs(self, words: list[str]) -> tuple[np.ndarray, ...]:
        ids = np.fromiter((self.words.get(w, 0) for w in words), np.int64, len(words))
        place, n = trigram_places(words)
        start = np.cumsum(n) - n
        chars = np.add.reduceat(self.p["char"][place], start, axis=0) / n[:, None].astype(np.float32)
        first = prefix_places(words)
        return np.concatenate([self.p["word"][ids], chars, self.p["start"][first].mean(1)], 1), ids, place, n, first

    def project(self, x: np.ndarray) -> np.ndarray:
        """Both directions' input parts of the gates: (2, words, 3 * hidden)."""
        return np.matmul(x[None], self.p["w"]) + self.p["b"][:, None, :]

    def forward(self, gates: np.ndarray, rows: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows. gates: input parts by word; rows: the words of each window (n, time)."""
        n, time, h = len(rows), rows.shape[1], HIDDEN
        u, state = self.p["u"], np.zeros((2, n, h), np.float32)
        states = np.zeros((time, 2, n, h), np.float32)
        kept = []
        m = mask.astype(np.float32)
        for t in range(time):
            back = time - 1 - t
            g = np.stack([gates[0][rows[:, t]], gates[1][rows[:, back]]])
            live = np.stack([m[:, t], m[:, back]])[:, :, None]
            a = np.matmul(state, u)
            rz = np.tanh((g[..., : 2 * h] + a[..., : 2 * h]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
            r, z = rz[..., :h], rz[..., h:]
            new = np.tanh(g[..., 2 * h :] + r * a[..., 2 * h :])
            nxt = new + z * (state - new)
            nxt = state + live * (nxt - state)
            if keep:
                kept.append((state, r, z, new, a[..., 2 * h :], live))
            state = nxt
            states[t, 0], states[back, 1] = state[0], state[1]
        att = states[:, 0] @ self.p["att"][:h] + states[:, 1] @ self.p["att"][h:]  # (time, n)
        att = np.where(mask.T, att, -1e9)
        att = np.exp(att - att.max(0))
        att /= att.sum(0)
        value = states[:, 0] @ self.p["out"][:h] + states[:, 1] @ self.p["out"][h:]
        logit = (att * value).sum(0) + self.p["bias"][0]
        return (logit, states, kept, att, value) if keep else logit

    def gradients(self, words: list[str], rows: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Gradients and value of the weighted mean loss of a batch of windows over the words given."""
        p, h, time = self.p, HIDDEN, rows.shape[1]
        x, ids, place, n_tri, first = self.inputs(words)
        gates = self.project(x)
        logit, states, kept, att, value = self.forward(gates, rows, mask, keep=True)
        prob = 1 / (1 + np.exp(-logit))
        d_logit = ((prob - y) * weight / len(y)).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["bias"][0] = d_logit.sum()
        d_value = att * d_logit
        pooled = logit - p["bias"][0]
        d_att = att * (value - pooled) * d_logit
        d_states = np.zeros_like(states)
        for side in (0, 1):
            part = slice(side * h, side * h + h)
            g["out"][part] = np.einsum("tn,tnh->h", d_value, states[:, side])
            g["att"][part] = np.einsum("tn,tnh->h", d_att, states[:, side])
            d_states[:, side] = d_value[..., None] * p["out"][part] + d_att[..., None] * p["att"][part]
        d_gates = np.zeros_like(gates)
        d_state = np.zeros((2, len(rows), h), np.float32)
        for t in range(time - 1, -1, -1):
            back = time - 1 - t
            state, r, z, new, a_n, live = kept[t]
            d = d_state + np.stack([d_states[t, 0], d_states[back, 1]])
            d_live, d_pass = d * live, d * (1 - live)
            d_new = d_live * (1 - z) * (1 - new * new)
            d_z = d_live * (state - new) * z * (1 - z)
            d_r = d_new * a_n * r * (1 - r)
            d_a = np.concatenate([d_r, d_z, d_new * r], 2)
            d_g = np.concatenate([d_r, d_z, d_new], 2)
            g["u"] += np.matmul(state.transpose(0, 2, 1), d_a)
            d_state = d_pass + d_live * z + np.matmul(d_a, p["u"].transpose(0, 2, 1))
            np.add.at(d_gates[0], rows[:, t], d_g[0])
            np.add.at(d_gates[1], rows[:, back], d_g[1])
        g["w"] = np.matmul(x.T[None], d_gates)
        g["b"] = d_gates.sum(1)
        d_x = np.matmul(d_gates, p["w"].transpose(0, 2, 1)).sum(0)
        np.add.at(g["word"], ids, d_x[:, :WORD_SIZE])
        g["word"][0] = 0
        np.add.at(g["char"], place, np.repeat(d_x[:, WORD_SIZE : WORD_SIZE + CHAR_SIZE] / n_tri[:, None].astype(np.float32), n_tri, axis=0))
        np.add.at(g["start"], first, d_x[:, None, WORD_SIZE + CHAR_SIZE :] / np.float32(first.shape[1]))
        return g, float((-(y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9)) * weight).mean())

    def step(self, words: list[str], rows: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float) -> float:
        """One update (Adam, clipped) on a batch of windows."""
        p = self.p
        g, loss = self.gradients(words, rows, mask, y, weight)
        self.steps += 1
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        scale = min(1.0, 1.0 / max(norm, 1e-9))
        for k, v in g.items():
            m1, m2 = self.moments[k]
            v *= scale
            m1 += 0.1 * (v - m1)
            m2 += 0.001 * (v * v - m2)
            p[k] -= (rate * (m1 / (1 - 0.9**self.steps)) / (np.sqrt(m2 / (1 - 0.999**self.steps)) + 1e-8)).astype(np.float32)
        return loss


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, words and text of every window, for texts of so many words."""
    n = np.where(sizes > 0, np.maximum(1, -(-(sizes - (WINDOW - STRIDE)) // STRIDE)), 0)
    text = np.repeat(np.arange(len(sizes)), n)
    at = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    return np.repeat(np.cumsum(sizes) - sizes, n) + at, np.minimum(WINDOW, sizes[text] - at), text


class Scorer:
    """Scores many texts; remembers the gates of the words it met, up to a bound.

    States are kept feature by feature (hidden, windows), so each operation runs over long rows. Row 0 of the gates is
    the word behind a text's end: its update gate is shut, so states pass it unchanged.
    """

    def __init__(self, network: Network) -> None:
        self.network = network
        h = HIDDEN
        # sigmoid(x) is (1 + tanh(x / 2)) / 2: halved here once
        self.half = np.repeat(np.array([0.5, 0.5, 1], np.float32), h)
        self.u = np.ascontiguousarray((network.p["u"] * np.float32(0.5)).transpose(0, 2, 1))
        self.read = np.stack([np.stack([network.p[k][:h], network.p[k][h:]]) for k in ("att", "out")], 1)
        self.reset()

    def reset(self) -> None:
        self.row: dict[str, int] = {}
        self.gates = np.zeros((2, 1 << 14, 3 * HIDDEN), np.float32)
        self.gates[:, 0, HIDDEN : 2 * HIDDEN] = 25

    def rows_of(self, words: list[str]) -> np.ndarray:
        if len(self.row) > KNOWN_ROWS:
            self.reset()
        get = self.row.get
        rows = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        if (missing := np.flatnonzero(rows == 0)).size:
            new, first = [words[i] for i in missing], len(self.row) + 1
            while first + len(new) > self.gates.shape[1]:
                self.gates = np.concatenate([self.gates, np.zeros_like(self.gates)], 1)
            for a in range(0, len(new), 20_000):
                some = [normal(w) for w in new[a : a + 20_000]]
                self.gates[:, first + a : first + a + len(some)] = self.network.project(self.network.inputs(some)[0]) * self.half
            self.row.update((w, first + i) for i, w in enumerate(new))
            rows[missing] = np.arange(first, first + len(new))
        return rows

    def forward(self, rows: np.ndarray) -> np.ndarray:
        """Logits of windows (n, WINDOW) of rows of the gates; 0 is behind the end."""
        n, h = len(rows), HIDDEN
        att, value = np.where(rows.T == 0, np.float32(-1e9), np.float32(0)), np.zeros((WINDOW, n), np.float32)
        for side in (0, 1):
            gates = np.ascontiguousarray(self.gates[side][rows].transpose(1, 2, 0))
            u, read, state = self.u[side], self.read[side], np.zeros((h, n), np.float32)
            for t in range(WINDOW - 1, -1, -1) if side else range(WINDOW):
                g, a = gates[t], u @ state
                rz = g[: 2 * h]
                rz += a[: 2 * h]
                np.tanh(rz, out=rz)
                rz += 1
                new = a[2 * h :]
                new *= rz[:h]
                new += g[2 * h :]
                np.tanh(new, out=new)
                state -= new
                state *= rz[h:]
                state *= np.float32(0.5)
                state += new
                both = read @ state
                att[t] += both[0]
                value[t] += both[1]
        att -= att.max(0)
        np.exp(att, out=att)
        return (att * value).sum(0) / att.sum(0) + self.network.p["bias"][0]

    def logits(self, texts: pa.Array, chunk: int = 2048) -> tuple[np.ndarray, np.ndarray, int]:
        """The logits of all windows of all texts, the text of each, and the number of texts."""
        flat, sizes = split_words(texts)
        coded = flat.dictionary_encode()
        rows = np.append(self.rows_of(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64), 0)
        start, n, text = windows(sizes)
        out = np.zeros(len(start), np.float32)
        steps = np.arange(WINDOW)
        for a in range(0, len(start), chunk):
            s = slice(a, a + chunk)
            at = np.where(steps < n[s][:, None], start[s][:, None] + steps, len(rows) - 1)
            out[s] = self.forward(rows[at])
        return out, text, len(sizes)

    def scores(self, texts: pa.Array) -> np.ndarray:
        x = features(*self.logits(texts))
        return np.where(x[:, 0] == 0, 0.0, 1 / (1 + np.exp(-np.clip(x @ self.network.weights, -50, 50))))


def features(logit: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Of every text: one (0 without windows), its three highest logits, share of toxic windows, log of their number."""
    count = np.bincount(text, minlength=n)
    order = np.lexsort((-logit, text))
    z, first = np.append(logit[order].astype(np.float64), 0.0), np.cumsum(count) - count
    tops = [np.where(count > i, z[np.minimum(first + i, len(z) - 1)], -4.0) for i in range(3)]
    share = np.bincount(text, 1 / (1 + np.exp(-logit.astype(np.float64))), n) / np.maximum(1, count)
    return np.stack([(count > 0).astype(np.float64), *tops, np.sqrt(share), np.log1p(count)], 1) * (count > 0)[:, None]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 40) -> np.ndarray:
    """Logistic regression; both labels weigh alike."""
    w = np.zeros(x.shape[1])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    keep = np.eye(x.shape[1]) * ridge
    keep[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + keep
        w -= np.linalg.solve(h + 1e-9 * np.eye(len(w)), x.T @ (weight * (p - y)) + keep @ w)
    return w


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts (no empty ones), and how many each has."""
    split = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.fill_null(texts, "")))
    sizes = np.diff(split.offsets.to_numpy())
    flat = split.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    if pc.all(full).as_py() is False:
        keep = full.to_numpy(zero_copy_only=False)
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes), keep, len(sizes)).astype(np.int64)
        flat = flat.filter(full)
    return flat, sizes.astype(np.int64)


def train(texts: list[str], toxic: list[int], rounds: int = 4, batch: int = 256, seed: int = 3) -> Network | None:
    """A network from labelled texts; a fifth of them is kept to place the threshold. None without both labels."""
    y = np.array(toxic)
    if not (y == 1).any() or not (y == 0).any():
        return None
    rng = np.random.default_rng(seed)
    flat, sizes = split_words(pa.array(texts, pa.string()))
    words = [normal(w) for w in flat.to_pylist()]
    distinct = list(dict.fromkeys(words))
    number = {w: i for i, w in enumerate(distinct)}
    coded = np.fromiter((number[w] for w in words), np.int64, len(words))
    start, n, text = windows(sizes)
    steps = np.arange(WINDOW)
    mask = steps < n[:, None]
    rows = coded[np.minimum(start[:, None] + steps, max(0, len(coded) - 1))] if len(coded) else np.zeros((0, WINDOW), np.int64)
    held = np.arange(len(y)) % 5 == 0
    of_word = np.repeat(np.arange(len(y)), sizes)
    df = np.bincount(np.unique(of_word * len(distinct) + coded) % len(distinct), minlength=len(distinct)) if len(coded) else np.zeros(0)
    net = Network([w for w, c in zip(distinct, df, strict=True) if c >= 5][:20_000], seed)
    # how telling a word is: the log-odds of its beginnings
    place = prefix_places(distinct) if distinct else np.zeros((0, 1), np.int64)
    seen = np.zeros((2, PREFIXES))
    for i in np.flatnonzero(~held):
        own = np.unique(coded[of_word == i]) if len(y) < 50 else np.unique(coded[np.searchsorted(of_word, i) : np.searchsorted(of_word, i + 1)])
        if len(own):
            seen[y[i], np.unique(place[own])] += 1
    odds = np.log((seen[1] + 0.5) / ((y[~held] == 1).sum() + 1)) - np.log((seen[0] + 0.5) / ((y[~held] == 0).sum() + 1))
    telling = odds[place].max(1)
    score = np.where(mask, telling[rows], -9).max(1) if len(rows) else np.zeros(0)
    learn_from = ~held[text]
    # a window that only repeats a clean word, or two by turns, is clean
    clean = np.flatnonzero(learn_from & (y[text] == 0))
    n_windows, dull = len(rows), min(len(clean), 400)
    if dull:
        source = rng.choice(clean, dull)
        few = rows[source][np.arange(dull)[:, None], rng.integers(0, n[source][:, None], (dull, 3))]
        rows = np.concatenate([rows, few[np.arange(dull)[:, None], rng.integers(0, 1 + np.arange(dull) % 3, (WINDOW, dull)).T]])
        mask, score = np.concatenate([mask, np.ones((dull, WINDOW), bool)]), np.append(score, np.zeros(dull))
        text, learn_from = np.append(text, text[source]), np.append(learn_from, np.ones(dull, bool))
        clean = np.append(clean, n_windows + np.arange(dull))
    for r in range(rounds):
        best: dict[int, int] = {}
        for i in np.flatnonzero(learn_from & (y[text] == 1)):
            if int(text[i]) not in best or score[i] > score[best[int(text[i])]]:
                best[int(text[i])] = i
        positive = np.fromiter(best.values(), np.int64, len(best))
        if r:  # and the others that the network takes for toxic
            positive = np.union1d(positive, np.flatnonzero(learn_from & (y[text] == 1) & (score > 1)))
        some = rng.choice(clean, min(len(clean), 4 * len(positive) + 500), replace=False)
        hard = clean[np.argsort(-score[clean], kind="stable")[: len(positive)]] if r else some[:0]
        chosen = np.unique(np.concatenate([positive, some, hard, np.arange(n_windows, n_windows + dull)]))
        label = y[text[chosen]].astype(np.float32)
        weight = np.where(label == 1, 0.5 * len(label) / max(1, len(positive)), 0.5 * len(label) / max(1, len(label) - len(positive))).astype(np.float32)
        # at least so many updates a round, in smaller batches, if there is little to learn from
        own_batch = batch if len(chosen) > 4000 else max(32, batch // 4)
        epochs = max(2, -(-UPDATES * own_batch // max(1, len(chosen))))
        for e in range(epochs):
            order = rng.permutation(len(chosen))
            for a in range(0, len(order), own_batch):
                b = order[a : a + own_batch]
                own, local = np.unique(rows[chosen[b]], return_inverse=True)
                net.step([distinct[w] for w in own], local.reshape(len(b), WINDOW), mask[chosen[b]], label[b], weight[b], 0.02 * 0.7**r if e else 0.01)
        gates = np.concatenate([net.project(net.inputs(distinct[a : a + 20_000])[0]) for a in range(0, len(distinct), 20_000)], 1)
        score = np.concatenate([net.forward(gates, rows[a : a + 4096], mask[a : a + 4096]) for a in range(0, len(rows), 4096)])
    x = features(score[:n_windows], text[:n_windows], len(y))
    judge = held if (y[held] == 1).sum() >= 5 else np.ones(len(y), bool)
    net.weights = fit(x[judge], y[judge])
    z = np.where(x[:, 0] == 0, -np.inf, x @ net.weights)
    net.weights[0] -= threshold(z[judge], y[judge]) - float(np.log(THRESHOLD / (1 - THRESHOLD)))
    net.moments = {}
    return net


def threshold(logit: np.ndarray, y: np.ndarray) -> float:
    """The middle of the logits between which the F1 score is highest."""
    ok = np.isfinite(logit)
    order = np.argsort(logit[ok], kind="stable")
    x, t = logit[ok][order], y[ok][order]
    caught = t.sum() - np.cumsum(t) + t  # if all from here on are called toxic
    called = len(t) - np.arange(len(t))
    f1 = 2 * caught / (called + t.sum())
    i = int(np.flatnonzero(f1 >= f1.max() - 1e-12)[0])
    return float((x[i] + x[i - 1]) / 2) if i else float(x[0]) - 1


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column, per_label: int = 1500, longest: int = 6000) -> Network | None:
    """A network from a bounded sample of the labelled rows whose id may be learned from."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(may_learn)
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    if len(counts) < 2:
        return None
    share = F.when(F.col("toxic") == 1, min(1.0, per_label / counts[1])).otherwise(min(1.0, 2 * per_label / counts[0]))
    drawn = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 30)) < share * (1 << 30))
    # about 3 * per_label ids, so they are sent to where the texts are
    sample = docs.filter(F.length("text") <= longest).select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    # of an id's several texts the least one is learned from
    sample = sample.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    sample.sort(key=lambda r: r["doc_id"])
    network = train([r["text"] for r in sample], [r["toxic"] for r in sample])
    give_back()  # training takes far more than the network
    return network


def score(docs: DataFrame, network: Network | None, keep: list[str]) -> DataFrame:
    """The columns to keep, and ``score``; every window of every text is read. No shuffle."""
    from pyspark.sql.types import StructType

    kept = docs.select(*keep)
    schema = StructType(kept.schema.fields + StructType.fromDDL("score double").fields)
    columns = [*keep] if "text" in keep else [*keep, "text"]
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(network) if network is not None else None
        for batch in batches:
            for part in parts_of(batch, at, TEXT_BYTES):
                values = scorer.scores(part.column(at)) if scorer is not None else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(values, pa.float64())], [*keep, "score"])

    return docs.select(*columns).mapInArrow(freed(run), schema)

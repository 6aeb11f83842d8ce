"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A text's words (parted by white space, lower-cased, outer punctuation dropped) each have a word input, a row of a hashed table, and a character
input, the rows of its hashed character n-grams (UTF-8 bytes) with word borders, pooled: the mean, and of the first component the greatest.
Every window of WINDOW consecutive words goes through a GRU each way; attention pools the states of a window, and a logistic unit scores it. A
text's score is its highest window's, so a few toxic words count in a text of any length.

Learning is by gradient steps on each text's highest window (multiple-instance learning). They go through the whole network, with the rows of all words
and n-grams in the window. The first component of a row begins as the log odds that the training texts give its word or n-gram, which also
choose the first windows; all others begin at random.
"""

from __future__ import annotations

import io
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm.common import _BYTE, forget, free_name, held, map_arrow, mix64

WINDOW = 12
DIM, HIDDEN, BUCKETS = 6, 6, 1 << 16
#: Labelled rows that are learnt from, at most of each label: those with the least crc32 of the id, so any order gives the same.
SAMPLE = 3000
#: Times that each text's highest window is chosen anew, and passes over them each time.
TURNS, EPOCHS = 3, 4
#: Words whose projections a worker remembers before it forgets all (144 bytes each, and those of one text more).
SLOTS = 60_000
#: New words whose n-grams are looked at at once.
STEP = 5_000
#: Windows that are run at once.
ROWS = 1 << 12
STRIP = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()) + "«»¿¡…“”"


def inputs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of each word; the buckets of its character n-grams (3 to 5 bytes, with ^ and $ for its borders), word after word, and where each
    word's begin. No word counts as one without letters."""
    own = [f"^{w or '$'}$".encode() for w in words]
    raw, n = _BYTE[np.frombuffer(b"".join(own), np.uint8)], np.array([len(w) for w in own], np.int64)
    ends = np.repeat(np.cumsum(n), n)
    of, place, h = np.repeat(np.arange(len(own)), n), np.arange(len(raw)), np.zeros(len(raw), np.uint64)
    found, words_of_grams = [], []
    for k in range(5):
        m = max(len(raw) - k, 0)
        h[:m] = h[:m] * np.uint64(0x9E3779B97F4A7C15) + raw[k:]
        if k >= 2:
            there = place + k < ends
            found.append(h[there])
            words_of_grams.append(of[there])
    order = np.argsort(np.concatenate(words_of_grams), kind="stable")
    grams = (mix64(np.concatenate(found)[order]) % np.uint64(BUCKETS)).astype(np.int32)
    starts = np.searchsorted(np.concatenate(words_of_grams)[order], np.arange(len(own)))
    return np.array([zlib.crc32(w, 1) % BUCKETS for w in own], np.int32), grams, starts


def words_of(text: str | None) -> list[str]:
    return [w.strip(STRIP) for w in (text or "").lower().split()]


def pooled(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The mean of each word's n-gram rows, but the greatest of the first component, which tells the strongest n-gram."""
    ends = np.append(starts[1:], len(rows))
    sums = np.zeros((len(rows) + 1, rows.shape[1]))
    np.cumsum(rows, 0, out=sums[1:])
    out = (sums[ends] - sums[starts]) / (ends - starts)[:, None]
    out[:, 0] = np.maximum.reduceat(np.ascontiguousarray(rows[:, 0]), starts)
    return out.astype(np.float32)


def _gate(x: np.ndarray) -> np.ndarray:
    """The piecewise linear sigmoid that gates use."""
    return np.clip(x / 4 + np.float32(0.5), 0, 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Parameters by name; a word's vector has DIM word and DIM character components."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    @staticmethod
    def fresh(seed: int = 7) -> Model:
        r = np.random.default_rng(seed)
        p = {name: r.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32) for name in ("word", "char")}
        p["word"][:, 0] = p["char"][:, 0] = 0
        for side in "fb":
            p[f"W{side}"] = r.normal(0, 0.3, (2 * DIM, 3 * HIDDEN)).astype(np.float32)
            p[f"U{side}"] = r.normal(0, 0.2, (HIDDEN, 3 * HIDDEN)).astype(np.float32)
            p[f"c{side}"] = np.zeros(3 * HIDDEN, np.float32)
        p["att"] = r.normal(0, 0.3, 2 * HIDDEN).astype(np.float32)
        p["out"] = r.normal(0, 0.3, 2 * HIDDEN).astype(np.float32)
        p["bias"] = np.full(1, -1.0, np.float32)
        return Model(p)

    def vectors(self, words: list[str]) -> np.ndarray:
        """Word row and pooled character rows of each word."""
        if not words:
            return np.zeros((0, 2 * DIM), np.float32)
        b, grams, starts = inputs(words)
        return np.concatenate([self.p["word"][b], pooled(self.p["char"][grams], starts)], 1)

    def logits(self, words: list[str]) -> np.ndarray:
        """Of all windows of a text's words, plainly; a Scorer gives the same faster."""
        v = self.vectors(words)
        x = np.zeros((max(len(v) - WINDOW, 0) + 1, WINDOW, 2 * DIM), np.float32)
        live = np.zeros(x.shape[:2], np.float32)
        for k in range(len(x)):
            part = v[k : k + WINDOW]
            x[k, : len(part)], live[k, : len(part)] = part, 1
        return self.windows(x, live)

    def windows(self, x: np.ndarray, live: np.ndarray, keep: bool = False):
        """Logits of windows: x (windows, WINDOW, 2 DIM) word vectors projected by nothing yet, live (windows, WINDOW). With keep, what the
        gradient needs too."""
        h, kept = {}, {}
        for side, order in (("f", range(x.shape[1])), ("b", range(x.shape[1] - 1, -1, -1))):
            h[side], kept[side] = self._gru(x @ self.p[f"W{side}"] + self.p[f"c{side}"], self.p[f"U{side}"], live, order, keep)
        return self._pool(h["f"], h["b"], live, kept if keep else None)

    @staticmethod
    def _gru(a: np.ndarray, u: np.ndarray, live: np.ndarray, order, keep: bool):
        n, t, _ = a.shape
        s = np.zeros((n, HIDDEN), np.float32)
        out = np.empty((n, t, HIDDEN), np.float32)
        steps = []
        for k in order:
            g = _gate(a[:, k, : 2 * HIDDEN] + s @ u[:, : 2 * HIDDEN])
            z, r = g[:, :HIDDEN], g[:, HIDDEN:]
            c = np.tanh(a[:, k, 2 * HIDDEN :] + (r * s) @ u[:, 2 * HIDDEN :])
            z = z * live[:, k, None]
            new = s + z * (c - s)
            if keep:
                steps.append((k, s, z, r, c))
            s = new
            out[:, k] = s
        return out, steps

    def _pool(self, hf: np.ndarray, hb: np.ndarray, live: np.ndarray, kept):
        h = np.concatenate([hf, hb], 2)
        e = np.where(live > 0, h @ self.p["att"], np.float32(-1e4))
        w = np.exp(e - e.max(1, keepdims=True))
        w /= w.sum(1, keepdims=True)
        pooled = (w[:, :, None] * h).sum(1)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return logit if kept is None else (logit, h, w, pooled, kept)

    def gradient(self, x: np.ndarray, live: np.ndarray, y: np.ndarray, weight: np.ndarray):
        """Of the mean weighted log loss: by parameter, and by x."""
        logit, h, w, pooled, kept = self.windows(x, live, True)
        p, n = self.p, len(y)
        dl = (_sigmoid(logit) - y) * weight / n
        g = {"out": pooled.T @ dl, "bias": np.array([dl.sum()], np.float32)}
        dpooled = dl[:, None] * p["out"]
        dh = w[:, :, None] * dpooled[:, None, :]
        de = w * ((h - pooled[:, None, :]) * dpooled[:, None, :]).sum(2)
        g["att"] = np.einsum("nt,ntd->d", de, h)
        dh += de[:, :, None] * p["att"]
        dx = np.zeros_like(x)
        for side, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            u, wm = p[f"U{side}"], p[f"W{side}"]
            gu, da = np.zeros_like(u), np.zeros((*x.shape[:2], 3 * HIDDEN), np.float32)
            back = np.zeros((n, HIDDEN), np.float32)
            for k, s, z, r, c in reversed(kept[side]):
                d = dh[:, k, part] + back
                dz, dc = d * (c - s), d * z
                dca = dc * (1 - c * c)
                drs = dca @ u[:, 2 * HIDDEN :].T
                dg = np.concatenate([dz * ((z > 0) & (z < 1)), drs * s * ((r > 0) & (r < 1))], 1) / 4
                da[:, k, : 2 * HIDDEN], da[:, k, 2 * HIDDEN :] = dg, dca
                gu[:, : 2 * HIDDEN] += s.T @ dg
                gu[:, 2 * HIDDEN :] += (r * s).T @ dca
                back = d * (1 - z) + drs * r + dg @ u[:, : 2 * HIDDEN].T
            g[f"U{side}"], g[f"c{side}"] = gu, da.sum((0, 1))
            g[f"W{side}"] = np.einsum("ntd,nte->de", x, da)
            dx += da @ wm.T
        return float((np.logaddexp(0, logit) - y * logit).mean()), g, dx


class Vocabulary:
    """Words by number, with their buckets, for learning."""

    def __init__(self):
        self.number: dict[str, int] = {}

    def ids(self, text: str | None) -> np.ndarray:
        number, out = self.number, array("i")
        for w in words_of(text):
            out.append(number.setdefault(w, len(number)))
        return np.array(out, np.int32)

    def close(self) -> None:
        """All words are known."""
        words = list(self.number)
        parts = [inputs(words[k : k + STEP]) for k in range(0, len(words), STEP)]
        self.word, self.grams = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        self.ends = np.cumsum([0, *chain.from_iterable(np.diff([*starts, len(grams)]).tolist() for _, grams, starts in parts)])

    def gather(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of the n-grams of some words, word after word, and where each word's begin."""
        n = self.ends[words + 1] - self.ends[words]
        starts = np.cumsum(n) - n
        return self.grams[np.repeat(self.ends[words] - starts, n) + np.arange(n.sum())], starts

    def vectors(self, p: dict[str, np.ndarray]) -> np.ndarray:
        """Of all words."""
        every, out = np.arange(len(self.word)), np.empty((len(self.word), 2 * DIM), np.float32)
        for k in range(0, len(every), STEP):
            grams, starts = self.gather(every[k : k + STEP])
            out[k : k + STEP, :DIM], out[k : k + STEP, DIM:] = p["word"][self.word[k : k + STEP]], pooled(p["char"][grams], starts)
        return out


class Rows:
    """Steps for the rows of a table, each row at a rate of its own that falls with what it has moved (Adagrad)."""

    def __init__(self, table: np.ndarray, rate: float):
        self.table, self.rate, self.sum = table, rate, np.full(len(table), 1e-4, np.float32)

    def step(self, at: np.ndarray, g: np.ndarray) -> None:
        rows, of = np.unique(at, return_inverse=True)
        total = np.stack([np.bincount(of, g[:, d], len(rows)) for d in range(g.shape[1])], 1).astype(np.float32)
        self.sum[rows] += (total * total).mean(1)
        self.table[rows] -= self.rate * total / np.sqrt(self.sum[rows])[:, None]


def log_odds(docs: list[np.ndarray], y: np.ndarray, vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """Of each bucket of words and of n-grams: how many toxic and other texts have it. Evidence seen in few texts counts less."""
    seen = {"word": np.zeros((2, BUCKETS), np.float32), "char": np.zeros((2, BUCKETS), np.float32)}
    for ids, label in zip(docs, y.astype(int).tolist()):
        own = np.unique(ids)
        if len(own):
            seen["word"][label, np.unique(vocabulary.word[own])] += 1
            seen["char"][label, np.unique(vocabulary.gather(own)[0])] += 1
    n1, n0, out = float(y.sum()), float(len(y) - y.sum()), {}
    for name, (neg, pos) in seen.items():
        odds = np.log((pos + 0.3) / (n1 + 1)) - np.log((neg + 0.3) / (n0 + 1))
        out[name] = np.clip(odds * (pos + neg) / (pos + neg + 2), -1, 5)
    return out


def fit(texts: Iterable[str | None], labels: list[int], seed: int = 7) -> Model:
    """Learns from whole texts. Without a row of each label the model stays as it begins and gives all texts about the same score."""
    m, r, vocabulary = Model.fresh(seed), np.random.default_rng(seed), Vocabulary()
    docs = [vocabulary.ids(t) for t in texts]
    y = np.array(labels, np.float32)
    keep = [i for i, ids in enumerate(docs) if len(ids)]
    docs, y = [docs[i] for i in keep], y[keep]
    if not len(y) or y.min() == y.max():
        return m
    vocabulary.close()
    for name, odds in log_odds(docs, y, vocabulary).items():
        m.p[name][:, 0] = odds
    weight = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))).astype(np.float32)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in m.p.items() if k not in ("word", "char")}
    tables = {k: Rows(m.p[k], 0.01) for k in ("word", "char")}
    step = 0
    for turn in range(TURNS):
        v = vocabulary.vectors(m.p)
        if turn:  # the network says which window is a text's highest
            best = Scorer(m).highest(v, docs)
        else:  # learning begins where the words' evidence is strongest
            strength = v[:, 0] + v[:, DIM]
            best = [max(0, min(int(strength[ids].argmax()) - int(b), len(ids) - WINDOW)) for ids, b in zip(docs, r.integers(0, WINDOW, len(docs)))]
        places = np.full((len(docs), WINDOW), -1, np.int32)
        for i, (ids, b) in enumerate(zip(docs, best)):
            part = ids[b : b + WINDOW]
            places[i, : len(part)] = part
        for _ in range(EPOCHS):
            order = r.permutation(len(y))
            for k in range(0, len(order), 128):
                at = order[k : k + 128]
                live = places[at] >= 0
                words, of = np.unique(places[at][live], return_inverse=True)
                grams, starts = vocabulary.gather(words)
                rows = m.p["char"][grams]
                top = pooled(rows, starts)
                x = np.zeros((*live.shape, 2 * DIM), np.float32)
                x[live] = np.concatenate([m.p["word"][vocabulary.word[words]], top], 1)[of]
                _, g, dx = m.gradient(x, live.astype(np.float32), y[at], weight[at])
                step += 1
                for name, (first, second) in moment.items():
                    first *= 0.9
                    first += 0.1 * g[name]
                    second *= 0.999
                    second += 0.001 * g[name] ** 2
                    m.p[name] -= 0.01 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
                by_word = np.stack([np.bincount(of, dx[live][:, d], len(words)) for d in range(2 * DIM)], 1).astype(np.float32)
                tables["word"].step(vocabulary.word[words], by_word[:, :DIM])
                n = np.diff([*starts, len(grams)])
                back = np.repeat(by_word[:, DIM:] / n[:, None], n, 0)
                back[:, 0] = np.repeat(by_word[:, DIM], n) * (rows[:, 0] == np.repeat(top[:, 0], n))
                tables["char"].step(grams, back)
    return m


class Scorer:
    """Scores all windows of texts with a model. A word's projections are remembered. Texts are laid out one after another, so the words of step k of
    consecutive windows are a slice; both directions run as one network of twice the width."""

    def __init__(self, model: Model):
        self.m, h = model, HIDDEN
        self.gates, self.candidate = np.zeros((2 * h, 4 * h), np.float32), np.zeros((2 * h, 2 * h), np.float32)
        for k, side in enumerate("fb"):
            u, at = model.p[f"U{side}"], slice(k * h, (k + 1) * h)
            self.gates[at, 2 * k * h : 2 * (k + 1) * h] = u[:, : 2 * h]
            self.candidate[at, at] = u[:, 2 * h :]
        self.w = np.concatenate([model.p["Wf"], model.p["Wb"]], 1)
        self.add = np.concatenate([model.p["cf"], model.p["cb"]])
        # attention and output of the states of both directions
        self.read = np.zeros((2 * h, 4), np.float32)
        for k in range(2):
            self.read[k * h : (k + 1) * h, 2 * k] = model.p["att"][k * h : (k + 1) * h]
            self.read[k * h : (k + 1) * h, 2 * k + 1] = model.p["out"][k * h : (k + 1) * h]
        self.gates /= 4  # as _gate does; its 0.5 is in the table
        self._forget()

    def _project(self, vectors: np.ndarray) -> np.ndarray:
        """The inputs of update and reset gates and the candidate, of both directions."""
        out = vectors @ self.w + self.add
        for k in (0, 3 * HIDDEN):
            gates = out[:, k : k + 2 * HIDDEN]
            gates /= 4
            gates += np.float32(0.5)
        return out

    def _forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.table = np.zeros((1 << 14, 6 * HIDDEN), np.float32)
        # row 0 stands for no word: its update gates are shut, so states pass by
        self.table[0, :HIDDEN] = self.table[0, 3 * HIDDEN : 4 * HIDDEN] = -60

    def _slots(self, texts: list[list[str]]) -> list[np.ndarray]:
        slot = self.slot
        if fresh := [w for w in dict.fromkeys(chain.from_iterable(texts)) if w not in slot]:
            begin = len(slot) + 1
            slot.update((w, begin + k) for k, w in enumerate(fresh))
            while len(self.table) <= len(slot):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            for k in range(0, len(fresh), STEP):
                self.table[begin + k : begin + k + len(fresh[k : k + STEP])] = self._project(self.m.vectors(fresh[k : k + STEP]))
        return [np.fromiter(map(slot.__getitem__, words), np.int32, len(words)) for words in texts]

    def highest(self, vectors: np.ndarray, docs: list[np.ndarray]) -> list[int]:
        """Where each text's highest window begins; texts are numbers of words, whose vectors are given."""
        self.table = np.concatenate([self.table[:1], self._project(vectors)])
        out = []
        for k in range(0, len(docs), 64):
            out += [int(x.argmax()) for x in self._windows([ids + 1 for ids in docs[k : k + 64]])]
        self._forget()
        return out

    def logits(self, words: list[str]) -> np.ndarray:
        """Of a text's windows, one from each word on that has WINDOW - 1 more after it; a shorter text is one window."""
        return self._windows(self._slots([words]))[0]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """0 to 1 for each text: its highest window's. A text without words has the score of an empty window."""
        out, part, n = [], [], 0
        for i, t in enumerate(texts):
            part.append(words_of(t))
            n += len(part[-1])
            if n > SLOTS // 4 or i + 1 == len(texts):
                out += [x.max() for x in self._windows(self._slots(part))]
                part, n = [], 0
                if len(self.slot) > SLOTS:
                    self._forget()
        return _sigmoid(np.array(out))

    def _windows(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        """The logits of each text's windows."""
        gap, begins, laid = np.zeros(WINDOW - 1, np.int32), [], []
        at = 0
        for ids in docs:
            begins.append(at)
            short = max(WINDOW - len(ids), 0)
            laid += [ids, np.zeros(short, np.int32)]
            at += len(ids) + short
        stream = np.concatenate([*laid, gap])
        every = np.concatenate([self._run(stream[k : k + ROWS + WINDOW - 1]) for k in range(0, at, ROWS)])
        return [every[b : b + max(len(ids) - WINDOW, 0) + 1] for b, ids in zip(begins, docs)]

    def _run(self, ids: np.ndarray) -> np.ndarray:
        """Of the windows that begin at each of the words but the last ones."""
        h, n = HIDDEN, len(ids) - WINDOW + 1
        # a row for each component, so that words of consecutive windows lie together
        a = np.ascontiguousarray(self.table[ids].T)
        gf, cf, gb, cb = a[: 2 * h], a[2 * h : 3 * h], a[3 * h : 5 * h], a[5 * h :]
        gates, candidate, read = (np.ascontiguousarray(x.T) for x in (self.gates, self.candidate, self.read))
        s, g, c, reset = np.zeros((2 * h, n), np.float32), np.empty((4 * h, n), np.float32), np.empty((2 * h, n), np.float32), np.empty((2 * h, n), np.float32)
        seen, got = np.empty((4, WINDOW, n), np.float32), np.empty((4, n), np.float32)
        for k in range(WINDOW):
            b = WINDOW - 1 - k
            np.matmul(gates, s, out=g)
            g[: 2 * h] += gf[:, k : k + n]
            g[2 * h :] += gb[:, b : b + n]
            np.clip(g, 0, 1, out=g)
            for side in (0, 1):
                np.multiply(g[(2 * side + 1) * h : (2 * side + 2) * h], s[side * h : (side + 1) * h], out=reset[side * h : (side + 1) * h])
            np.matmul(candidate, reset, out=c)
            c[:h] += cf[:, k : k + n]
            c[h:] += cb[:, b : b + n]
            np.tanh(c, out=c)
            c -= s
            c[:h] *= g[:h]
            c[h:] *= g[2 * h : 3 * h]
            s += c
            np.matmul(read, s, out=got)
            seen[:2, k], seen[2:, b] = got[:2], got[2:]
        e = seen[0] + seen[2]
        blank = ids == 0
        if blank.any():
            for k in range(WINDOW):
                e[k][blank[k : k + n]] = -1e4
        e -= e.max(0)
        w = np.exp(e, out=e)
        v = seen[1]
        v += seen[3]
        v *= w
        return (v.sum(0) / w.sum(0) + self.m.p["bias"][0]).astype(np.float64)


def crc_fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learns from labelled rows outside fold 0, at most `sample` of each label, in one task of an executor; only the model comes to the driver. Null labels
    are left out; ids with several labels count as toxic if one is; labels without a document, and documents without one, aren't used. Rows that repeat an
    id and its text count once; an id's other texts are rows of their own."""
    mark = labels.filter(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max((F.col(label) > 0).cast("int")).alias("y")).filter(crc_fold() != 0)
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    picked = mark.filter("y = 1").orderBy(crc, "doc_id").limit(sample).unionAll(mark.filter("y = 0").orderBy(crc, "doc_id").limit(sample))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(picked), "doc_id").select("doc_id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        labels: list[int] = []

        def texts() -> Iterator[str | None]:
            last, left = None, [sample, sample]
            for b in batches:
                for row in zip(*[c.to_pylist() for c in b.columns]):
                    if row != last and left[row[1]]:
                        left[row[1]] -= 1
                        labels.append(row[1])
                        yield row[2]
                    last = row

        buffer = io.BytesIO()
        np.savez(buffer, **fit(texts(), labels).p)
        yield pa.RecordBatch.from_arrays([pa.array([buffer.getvalue()])], ["model"])

    got = rows.repartition(1).sortWithinPartitions(crc, "doc_id", "text").mapInArrow(run, "model binary").first()
    if got is None:
        return Model.fresh()
    with np.load(io.BytesIO(bytes(got[0]))) as p:
        return Model({k: p[k] for k in p.files})


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the score, a double from 0 to 1. Null and empty texts get the score of a text without words; repeated rows and other columns stay;
    if the name is taken it gets underscores in front. Windows of very long texts run some at a time; of equal highest windows any gives the score; an
    empty table gives no rows."""
    at, name = docs.columns.index(text), free_name(docs, name)
    sent, key = docs.sparkSession.sparkContext.broadcast(model.p), uuid.uuid4().hex

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        scorer = held(("toxicity", key), lambda: Scorer(Model(sent.value)))
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(scorer.scores(b.column(at).to_pylist()))], [*b.schema.names, name])

    return map_arrow(docs, fn, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]), holds=True)

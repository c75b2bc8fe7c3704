"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

Trained in numpy on the driver from a bounded sample of labelled documents, then sent to the workers (its size is set
by the constants below), which score all windows of WINDOW words of every text, one at each word. A word's input is the
embedding of its hash and the mean of the embeddings of all its character trigrams' hashes; a document's score is that
of its worst window. What white space leaves long or holds scripts without spaces is several inputs (`pieces`).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ready

WINDOW = 16
WORD_BUCKETS, CHAR_BUCKETS, WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 1 << 16, 1 << 12, 12, 8, 8, 8
#: The training sample: so many labelled documents of each class at most, none of over MOST_CHARS.
SAMPLE_EACH, MOST_CHARS = 2048, 1 << 14
EPOCHS, STEPS, MOST_EPOCHS, BATCH, RATE, SEED = 5, 150, 60, 128, 4e-3, 7  # at least EPOCHS, or as many as make STEPS
#: The worst windows are looked for again after LOOK epochs. Weights shrink by DECAY times the rate in each step, a share
#: HIDE of the words of a window in training has no input, and words of fewer than LEAST_TEXTS texts have their
#: characters alone, so that no document is learnt by its rare words.
LOOK, DECAY, HIDE, LEAST_TEXTS = 3, 2.0, 0.2, 8
#: A word of more bytes than LONG is cut at punctuation, what is left of more characters than PIECE into overlapping
#: pieces: a word of up to PIECE // 2 characters in it is whole in one of them.
LONG, PIECE = 14, 24
CACHE_MOST = 1 << 18
CHUNK = 3400  # windows that numpy takes at once; with OMP_NUM_THREADS=1, as Spark's workers have it, its products stay on one thread
_PUNCTUATION = "\"'`.,;:!?()[]{}<>*%$&#@+=|/\\~^_-"


_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_JOINS = re.escape(_PUNCTUATION) + "\u2000-\u206f\u3000-\u303f\uff01-\uff0f"
_ALONE, _PARTS = re.compile(f"[{_UNSPACED}]"), re.compile(f"[{_UNSPACED}]|[^{_UNSPACED}{_JOINS}]+")


def pieces(word: str) -> list[str]:
    """The inputs that a word is read as: itself, if it is short; a character of a script without spaces is one."""
    if len(word.encode()) <= LONG and not _ALONE.search(word):
        return [word]
    out = []
    for x in _PARTS.findall(word):
        last = len(x) - PIECE
        out += [x] if last <= 0 else [x[i : i + PIECE] for i in (*range(0, last, PIECE // 2), last)]
    return out or [word[:1]]


def word_features(word: str) -> tuple[int, list[int]]:
    """The bucket of a word and those of all its character trigrams, 1 and up."""
    b = word.lower().strip(_PUNCTUATION).encode()
    edge = b"<" + b + b">"
    tri = [zlib.crc32(edge[i : i + 3]) % (CHAR_BUCKETS - 1) + 1 for i in range(len(edge) - 2)]
    return zlib.crc32(b) % (WORD_BUCKETS - 1) + 1, tri


#: A CRC of three bytes is the exclusive or of a number for each: that of the byte among zeros; the last has what zeros give.
_CRC = [np.array([zlib.crc32(bytes([0] * i + [x] + [0] * (2 - i))) ^ (zlib.crc32(bytes(3)) if i < 2 else 0) for x in range(256)], np.uint32) for i in range(3)]


class Trigrams:
    """Lists of trigrams' buckets of different lengths, one after another; an empty one has bucket 0."""

    def __init__(self, flat: np.ndarray, count: np.ndarray) -> None:
        self.flat, self.count = flat, count
        self.start = np.cumsum(count) - count

    def of(self, rows: np.ndarray) -> Trigrams:
        n = self.count[rows]
        return Trigrams(self.flat[np.repeat(self.start[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())], n)


class Vocabulary(dict):
    """Inputs as they are met, numbered from 1; the features of those numbered since the last call of features()."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []
        self.runs: list[list[int]] = []

    def __missing__(self, word: str) -> int:
        if len(word) > LONG or not word.isascii():  # others are one piece
            parts = pieces(word)
            if parts != [word]:  # not kept: such words are rare, and of any length
                self.runs.append([self[x] for x in parts])
                return -1
        self.new.append(word)
        n = self[word] = len(self) + 1
        return n

    def numbers(self, text: str) -> np.ndarray:
        """The inputs' numbers of a text."""
        self.runs = []
        words = text.split()
        ids = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        if not self.runs:
            return ids
        out, last = [], 0
        for at, run in zip(np.flatnonzero(ids < 0).tolist(), self.runs, strict=True):
            out += [ids[last:at], np.array(run, np.int32)]
            last = at + 1
        return np.concatenate([*out, ids[last:]])

    def features(self) -> tuple[np.ndarray, Trigrams]:
        """Those of word_features(), of all new words at once; words hold no white space, so that a line is a word."""
        if not self.new:
            return np.zeros(0, np.int32), Trigrams(np.zeros(0, np.int32), np.zeros(0, np.int64))
        plain = [w.strip(_PUNCTUATION).encode() for w in "\n".join(self.new).lower().split("\n")]
        self.new = []
        words = np.fromiter(map(zlib.crc32, plain), np.int64, len(plain)) % (WORD_BUCKETS - 1) + 1
        size = np.fromiter(map(len, plain), np.int64, len(plain))  # as many trigrams as bytes, with both edges
        edges = np.frombuffer(b"<" + b"><".join(plain) + b">", np.uint8)
        flat = _CRC[0][edges[:-2]] ^ _CRC[1][edges[1:-1]] ^ _CRC[2][edges[2:]] if len(edges) > 2 else np.zeros(0, np.uint32)
        flat = np.append(flat % (CHAR_BUCKETS - 1) + 1, [0, 0]).astype(np.int32)
        ends = np.cumsum(size + 2)
        none = size == 0
        keep = np.ones(len(flat), bool)
        keep[ends - 1], keep[ends - 2] = False, none
        flat[ends[none] - 2] = 0
        return words.astype(np.int32), Trigrams(flat[keep], np.maximum(size, 1))


class Stream:
    """The word numbers of texts, one after another; a text shorter than a window, or empty, is padded with 0.

    A text of n words has max(1, n - WINDOW + 1) windows, one at each word; starts: where they begin, by text."""

    def __init__(self, each: list[np.ndarray]) -> None:
        self.ids = np.concatenate([np.pad(x, (0, max(0, WINDOW - len(x)))) for x in each])
        size = np.array([max(WINDOW, len(x)) for x in each], np.int64)
        self.count = size - WINDOW + 1
        self.first = np.cumsum(self.count) - self.count
        self.starts = np.arange(self.count.sum()) + np.repeat(np.cumsum(size) - size - self.first, self.count)
        self.short = np.array([len(x) < WINDOW for x in each])

    def windows(self, which: np.ndarray) -> np.ndarray:
        return self.ids[self.starts[which][:, None] + np.arange(WINDOW)]

    def logits(self, net: Network, table: np.ndarray) -> np.ndarray:
        """Of all windows, in order. Padded texts have one each; those of the others are read along the stream."""
        out = np.empty(len(self.starts), np.float32)
        padded = self.first[self.short]
        for i in range(0, len(padded), 2048):
            out[padded[i : i + 2048]] = net.forward(table, self.windows(padded[i : i + 2048]))
        whole = np.flatnonzero(np.repeat(~self.short, self.count))
        if len(whole):
            at = self.starts[whole]
            reach = np.cumsum(np.bincount(at, minlength=len(self.ids) + 1) - np.bincount(at + WINDOW, minlength=len(self.ids) + 1))[:-1] > 0
            place = np.cumsum(reach) - 1  # without padded texts
            out[whole] = net.slide(table, self.ids[reach])[place[at]]
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters and the forward and backward passes."""

    def __init__(self, seed: int = SEED) -> None:
        r = np.random.default_rng(seed)
        draw = lambda *s, by=0.1: (r.standard_normal(s) * by).astype(np.float32)
        x = WORD_DIM + CHAR_DIM
        self.p = {"word": draw(WORD_BUCKETS, WORD_DIM), "char": draw(CHAR_BUCKETS, CHAR_DIM), "x": draw(x, 6 * HIDDEN, by=0.3), "bx": np.zeros(6 * HIDDEN, np.float32), "uf": draw(HIDDEN, 3 * HIDDEN, by=0.3), "ub": draw(HIDDEN, 3 * HIDDEN, by=0.3), "a": draw(2 * HIDDEN, ATTEND, by=0.3), "ba": np.zeros(ATTEND, np.float32), "v": draw(ATTEND, by=0.5), "o": draw(2 * HIDDEN, by=0.5), "bo": np.zeros(1, np.float32)}

    def inputs(self, words: np.ndarray, chars: Trigrams) -> np.ndarray:
        total = np.add.reduceat(self.p["char"][chars.flat], chars.start) if len(words) else np.zeros((0, CHAR_DIM), np.float32)
        return np.concatenate([self.p["word"][words], total / chars.count[:, None].astype(np.float32)], 1)

    def project(self, words: np.ndarray, chars: Trigrams) -> np.ndarray:
        """Both directions' gate inputs of each word."""
        return self.inputs(words, chars) @ self.p["x"] + self.p["bx"]

    def _run(self, g: np.ndarray, u: np.ndarray, keep: list | None) -> np.ndarray:
        """Hidden states by step, of gate inputs by step."""
        h = np.zeros((g.shape[1], HIDDEN), np.float32)
        out = np.empty((len(g), g.shape[1], HIDDEN), np.float32)
        for t in range(len(g)):
            gh = h @ u
            zr = _sigmoid(g[t, :, : 2 * HIDDEN] + gh[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(g[t, :, 2 * HIDDEN :] + r * gh[:, 2 * HIDDEN :])
            if keep is not None:
                keep.append((h, z, r, n, gh[:, 2 * HIDDEN :]))
            h = n + z * (h - n)
            out[t] = h
        return out

    def forward(self, table: np.ndarray, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; table has the gate inputs by word number."""
        g = table[ids.T]
        kf, kb = ([], []) if keep is not None else (None, None)
        hf = self._run(g[:, :, : 3 * HIDDEN], self.p["uf"], kf)
        hb = self._run(g[::-1, :, 3 * HIDDEN :], self.p["ub"], kb)[::-1]
        h = np.concatenate([hf, hb], 2)
        u = np.tanh(h @ self.p["a"] + self.p["ba"])
        s = u @ self.p["v"]
        mask = ids.T > 0
        mask[0] = True
        s = np.where(mask, s, np.float32(-1e9))
        a = np.exp(s - s.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tb,tbh->bh", a, h)
        if keep is not None:
            keep |= {"f": kf, "b": kb, "h": h, "u": u, "a": a, "pooled": pooled}
        return pooled @ self.p["o"] + self.p["bo"]

    def slide(self, table: np.ndarray, ids: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """Logits of the windows at every place of a run of word numbers without 0, as forward() gives them. A step of
        all windows reads one slice of the run, and has a row for each unit, so numpy works along windows.

        numpy's exp is several times as fast as its tanh, so states are kept as (1 - h) / 2 = s + z * (state - s) with
        s = 1 / (1 + exp(2 * x)) in place of tanh(x); the factors are in the weights, and a state's last row is 1 for
        what does not depend on it."""
        flip = np.r_[np.full(2 * HIDDEN, -1), np.full(HIDDEN, 2)].astype(np.float32)  # z, r: exp(-x); candidate: exp(2 * x)
        both = []
        for side, k in (("uf", 0), ("ub", 1)):
            part = slice(k * HIDDEN, (k + 1) * HIDDEN)
            w = np.concatenate([self.p[side] * flip, 2 * self.p["a"][part], self.p["o"][part, None]], 1)
            rest = w.sum(0)
            if k == 0:
                rest[3 * HIDDEN : -1] += 2 * self.p["ba"]
            both.append(np.ascontiguousarray(np.concatenate([-2 * w, rest[None]]).T))
        scale = np.r_[flip, flip]
        n, gates = len(ids) - WINDOW + 1, 2 * HIDDEN
        logits = np.empty(max(n, 0), np.float32)
        old = np.seterr(over="ignore")  # exp may reach infinity, whose inverse is 0 as it should be
        for at in range(0, n, chunk):
            m = min(chunk, n - at)
            g = np.ascontiguousarray((table[ids[at : at + m + WINDOW - 1]] * scale).T)
            seen, score = np.empty((WINDOW, ATTEND + 1, m), np.float32), np.empty((WINDOW, m), np.float32)
            zr, y = np.empty((gates, m), np.float32), np.empty((len(both[0]), m), np.float32)
            for k, order in ((0, range(WINDOW)), (1, range(WINDOW - 1, -1, -1))):
                x = g[3 * HIDDEN * k : 3 * HIDDEN * (k + 1)]
                state = np.full((HIDDEN + 1, m), 0.5, np.float32)
                state[-1] = 1
                h, z, new = state[:-1], zr[:HIDDEN], zr[HIDDEN:]
                for step, t in enumerate(order):
                    if step:
                        np.add(x[:gates, t : t + m], y[:gates], out=zr)
                        np.exp(zr, out=zr)
                        zr += np.float32(1)
                        np.divide(y[gates : 3 * HIDDEN], new, out=new)
                        new += x[gates:, t : t + m]
                        np.exp(new, out=new)
                    else:  # a state of 0 gives the gates nothing, and leaves nothing to reset
                        np.exp(x[:HIDDEN, t : t + m], out=z)
                        z += np.float32(1)
                        np.exp(x[gates:, t : t + m], out=new)
                    new += np.float32(1)
                    np.divide(np.float32(1), new, out=new)
                    h -= new
                    h /= z
                    h += new
                    rows = slice(0 if step < WINDOW - 1 else 3 * HIDDEN, None)  # the last state has no step after it
                    np.matmul(both[k][rows], state, out=y[rows])
                    if k == 0:
                        seen[t] = y[3 * HIDDEN :]
                        continue
                    seen[t] += y[3 * HIDDEN :]
                    u = seen[t, :ATTEND]
                    np.exp(u, out=u)
                    u += np.float32(1)
                    np.divide(np.float32(1), u, out=u)
                    score[t] = (-2 * self.p["v"]) @ u  # but for a number that is the same at all steps
            score -= score.max(0)
            np.exp(score, out=score)
            logits[at : at + m] = (score * seen[:, ATTEND]).sum(0) / score.sum(0) + self.p["bo"]
        np.seterr(**old)
        return logits

    def backward(self, d: np.ndarray, k: dict) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters, and those of the gate inputs by step and window; d: of the logits."""
        grad = {"o": k["pooled"].T @ d, "bo": d.sum(keepdims=True)}
        dp = d[:, None] * self.p["o"]
        h, a, u = k["h"], k["a"], k["u"]
        da = np.einsum("tbh,bh->tb", h, dp)
        ds = a * (da - (a * da).sum(0))
        grad["v"] = np.einsum("tb,tba->a", ds, u)
        du = ds[:, :, None] * self.p["v"] * (1 - u * u)
        grad["a"], grad["ba"] = np.einsum("tbh,tba->ha", h, du), du.sum((0, 1))
        dh = a[:, :, None] * dp + du @ self.p["a"].T
        gates = []
        for side, u_, states in (("uf", dh[:, :, :HIDDEN], k["f"]), ("ub", dh[::-1, :, HIDDEN:], k["b"])):
            w, back = self.p[side], np.zeros_like(u_[0])
            du_, dg = np.zeros_like(w), np.empty((len(u_), u_.shape[1], 3 * HIDDEN), np.float32)
            for t in range(len(u_) - 1, -1, -1):
                prev, z, r, n, ghn = states[t]
                now = u_[t] + back
                dz, dn = now * (prev - n) * z * (1 - z), now * (1 - z) * (1 - n * n)
                dr = dn * ghn * r * (1 - r)
                gh = np.concatenate([dz, dr, dn * r], 1)
                dg[t] = np.concatenate([dz, dr, dn], 1)
                du_ += prev.T @ gh
                back = now * z + gh @ w.T
            grad[side] = du_
            gates.append(dg if side == "uf" else dg[::-1])
        return grad, np.concatenate(gates, 2)

    def train(self, texts: list[str], labels: np.ndarray) -> None:
        """Multiple instances: each epoch takes every document's worst window, and another one of clean documents."""
        if len(set(labels.tolist())) < 2:
            share = (labels.sum() + 0.5) / (len(labels) + 10.0)
            self.p["o"][:], self.p["bo"][:] = 0, np.log(share / (1 - share))
            return
        vocabulary = Vocabulary()
        stream = Stream([vocabulary.numbers(t) for t in texts])
        words, chars = vocabulary.features()
        words, chars = np.r_[0, words], Trigrams(np.r_[0, chars.flat], np.r_[1, chars.count])
        doc = np.repeat(np.arange(len(texts)), stream.count)
        # The first word dimension starts at the log odds of its bucket among the documents.
        seen = np.zeros((2, WORD_BUCKETS))
        of_text = np.split(stream.ids, np.cumsum(stream.count + WINDOW - 1)[:-1])
        for x, y in zip(of_text, labels, strict=True):
            seen[y, np.unique(words[x])] += 1
        odds = np.log((seen[1] + 0.5) / (labels.sum() + 1)) - np.log((seen[0] + 0.5) / ((1 - labels).sum() + 1))
        rare = seen.sum(0) < LEAST_TEXTS
        odds[rare] = 0
        self.p["word"][rare] = 0  # and stay so: texts are not to be learnt by words of their own
        self.p["word"][:, 0] = np.clip(odds, -2, 6) / 2
        self.p["word"][0], self.p["char"][0] = 0, 0
        first = self.p["word"][words[stream.ids], 0]
        score = np.lib.stride_tricks.sliding_window_view(first, WINDOW).max(1)[stream.starts]
        r = np.random.default_rng(SEED)
        moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        step = 0
        ends = stream.first + stream.count
        weight = np.where(labels == 1, np.sqrt((1 - labels).sum() / labels.sum()), 1.0).astype(np.float32)
        a_round = -(-(len(texts) + int((labels == 0).sum())) // BATCH)
        for epoch in range(max(EPOCHS, min(MOST_EPOCHS, -(-STEPS // a_round)))):
            if epoch % LOOK == 1:
                score = stream.logits(self, self.project(words, chars))
            worst = np.array([a + int(score[a:e].argmax()) for a, e in zip(stream.first, ends, strict=True)])
            clean = np.flatnonzero(labels == 0)
            other = np.array([ends[i] - 1 - r.integers(stream.count[i]) for i in clean])
            pick = r.permutation(np.concatenate([worst, other]))
            for i in range(0, len(pick), BATCH):
                batch = stream.windows(pick[i : i + BATCH])
                of = doc[pick[i : i + BATCH]]
                batch = np.where((r.random(batch.shape) < HIDE) & (np.arange(WINDOW) > 0), 0, batch)
                used, local = np.unique(batch, return_inverse=True)
                local = local.reshape(batch.shape)
                tri = chars.of(used)
                x = self.inputs(words[used], tri)
                keep: dict = {}
                # `forward` tells padding by number 0; `used` is sorted, so 0 stays 0 where it occurs
                shift = 0 if used[0] == 0 else 1
                table = x @ self.p["x"] + self.p["bx"]
                table = np.concatenate([np.zeros((shift, table.shape[1]), np.float32), table])
                logit = self.forward(table, local + shift, keep)
                d = ((_sigmoid(logit) - labels[of]) * weight[of] / len(of)).astype(np.float32)
                grad, gates = self.backward(d, keep)
                dt = np.zeros_like(table)
                np.add.at(dt, (local + shift).T, gates)
                dt = dt[shift:]
                dx = dt @ self.p["x"].T
                grad["x"], grad["bx"] = x.T @ dt, dt.sum(0)
                grad["word"], grad["char"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["char"])
                np.add.at(grad["word"], words[used], dx[:, :WORD_DIM])
                grad["word"][rare] = 0
                np.add.at(grad["char"], tri.flat, np.repeat(dx[:, WORD_DIM:] / tri.count[:, None].astype(np.float32), tri.count, axis=0))
                step += 1
                for k, g in grad.items():
                    m, v = moment[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    if k not in ("bx", "ba", "bo"):
                        held = self.p[k][:, 0].copy() if k == "word" else None
                        self.p[k] *= np.float32(1 - RATE * DECAY)
                        if held is not None:
                            self.p[k][:, 0] = held
                    self.p[k] -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
                self.p["word"][0], self.p["char"][0] = 0, 0


class Scorer:
    """Scores texts; keeps the gate inputs of the words that it has met, up to CACHE_MOST."""

    def __init__(self, parameters: dict) -> None:
        self.net = Network.__new__(Network)
        self.net.p = parameters
        self.reset()

    def reset(self) -> None:
        self.words = Vocabulary()
        self.table = np.zeros((1 << 12, 6 * HIDDEN), np.float32)
        self.table[0] = self.net.p["bx"]
        self.filled = 1

    def scores(self, texts: list[str]) -> np.ndarray:
        if len(self.words) > CACHE_MOST:
            self.reset()
        stream = Stream([self.words.numbers(t) for t in texts])
        words, chars = self.words.features()
        need = self.filled + len(words)
        if need > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(need, 2 * len(self.table)) - len(self.table), 6 * HIDDEN), np.float32)])
        for i in range(0, len(words), 1 << 13):
            rows = np.arange(i, min(i + (1 << 13), len(words)))
            self.table[self.filled + i : self.filled + i + len(rows)] = self.net.project(words[rows], chars.of(rows))
        self.filled = need
        return _sigmoid(np.maximum.reduceat(stream.logits(self.net, self.table), stream.first).astype(np.float64))


def train_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """The network's parameters, learnt from labelled rows whose crc32 of the id as text is not divisible by 5.

    The sample holds at most SAMPLE_EACH ids of either class, in the order of a hash; it is all that the driver gets.
    Labels of one id that differ count as 1, and of its texts the least is learnt from; null labels and ids, and texts that are null or over MOST_CHARS, are not
    learnt from. With labels of one class only, or none, the score is one number for all texts.
    """
    mine = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    mine = mine.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    order = [F.xxhash64(F.lit(3), "_id"), "_id"]
    picked = [mine.where(f"_y = {y}").orderBy(*order).limit(SAMPLE_EACH) for y in (0, 1)]
    ids = docs.sparkSession.createDataFrame([tuple(r) for p in picked for r in p.collect()], mine.schema)  # bounded
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t")).where(F.length("_t") <= MOST_CHARS)
    one = texts.join(F.broadcast(ids), "_id").groupBy("_id", "_y").agg(F.min("_t").alias("_t"))  # of an id that repeats
    rows = sorted(one.select("_id", "_t", "_y").collect())
    net = Network()
    net.train([r[1] for r in rows], np.array([r[2] for r in rows], np.int64)) if rows else net.p["o"].fill(0)
    return net.p


def held_out(id_: Column) -> Column:
    """Rows without an id are not held out; as labels belong to ids, nothing is learnt from them either."""
    return F.coalesce(F.crc32(F.encode(id_.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, parameters: dict, text_col: str = "text", out: str = "score") -> DataFrame:
    """Adds out, 0 to 1, from the texts alone: higher, likelier toxic. Null texts are empty; empty ones have a score
    of their own. Equal texts have equal scores. Whole texts are scored. All columns of docs stay."""
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(parameters)  # about 3 MB, by the constants above

    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = Scorer(shared.value)
        for t in texts:
            t = t.fillna("").tolist()
            parts = [s.scores(t[i : i + 200]) for i in range(0, len(t), 200)]
            yield pd.Series(np.round(np.concatenate(parts), 5) if parts else np.zeros(0))

    return docs.withColumn(out, run(F.col(text_col).cast("string")))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """op1: scores of all documents, learnt from labels.toxic."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

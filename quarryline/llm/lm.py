"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class, history), and both factors are softmaxes of log-linear models.
The class has hashed features of the history: the word before, the pair before (an n-gram), and the words two and three
before (skips). The CODES most frequent words have features of their own, all others share EXTRA buckets by hash. It is
trained by rounds of distributed gradient updates: workers make AdaGrad steps on their documents from shared weights,
and the weights, a table of fixed size, are averaged by the executors in a tree. The word within its class has the
log of its share of the class's count as its own feature, and features of the n-gram with the word before, one for each
pair of the FOCUS most frequent words (other words before a word go by their class). As the other words of a class have
no such features, the softmax over all words of the class is normalised by a sum over at most FOCUS of them, so scoring
looks up the normaliser by class and word before. Workers gather how often pairs occur, and gradient steps on these sums
find the weights.

Frequent words, a table of bounded size, are in classes by the company they keep; every other word is in a class by its
last two bytes, where a part of the mass, by Good and Turing, is left to words that training has not seen. Of that part
LISTED is for as many words as, by Chao, have not been seen yet, an even share for each; the rest is for spellings: a word's
bytes, from its end, by a hashed model of what follows two bytes in the distinct words of training, divided by the mass of
all spellings of the class. Counts of words beyond the bounded table are joined, not sent to workers.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ready, written

#: Words that workers know with their counts; those of them in classes by company; classes of both kinds.
TABLE, COMPANY = 1 << 17, 1 << 14
CLUSTERS, SUFFIXES = 16, 6
CLASSES = 1 + CLUSTERS + SUFFIXES  # class 0: the end
SIGNS = 32  # the most frequent words, by which documents are told apart
CODES, EXTRA, PAIRS = 1 << 13, 1 << 12, 1 << 13  # words with a feature of their own; buckets of other words; of pairs
FOCUS, STEPS, PENALTY = 512, 40, 1.0  # words with n-gram features within their class; gradient steps for these
ROUNDS, RATE = 2, 0.25
BATCH = 256  # tokens of a step, for inputs of any size
FAN_IN = 32  # matrices that one task adds up
END = "\n"  # a key that no word has
STOP, CONTEXTS, BACK_OFF = 256, 1 << 12, 4.0  # the byte before a word; buckets of two bytes; what a shorter context counts for
LISTED = 0.25
CHUNK = 512  # rows of weights, or words, that are averaged together


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(id_.cast("string"), "UTF-8")) % 7 == 2, F.lit(False))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only


def suffix_class(word: bytes) -> int:
    return 1 + CLUSTERS + zlib.crc32(word[-2:]) % SUFFIXES


def suffix_column(word: Column) -> Column:
    return (F.lit(1 + CLUSTERS) + F.crc32(F.substring(F.encode(word, "UTF-8"), -2, 2)) % SUFFIXES).cast("int")


def counted(texts: DataFrame) -> DataFrame:
    """word, c, of all training tokens; workers add up before the shuffle, in tables of bounded size."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        ends = 0

        def out() -> Iterator[pd.DataFrame]:
            words, n = [w.decode() for w in c], list(c.values())
            for i in range(0, len(n), 1 << 15):
                yield pd.DataFrame({"word": words[i : i + (1 << 15)], "c": n[i : i + (1 << 15)]})
            c.clear()

        for f in frames:
            for t in f["t"]:
                c.update(tokens(t))
                ends += 1
            if len(c) > 1 << 18:
                yield from out()
        yield from out()
        if ends:
            yield pd.DataFrame({"word": [END], "c": [ends]})

    return texts.mapInPandas(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(vocabulary: DataFrame, most: int) -> list[tuple[str, int]]:
    """At most `most` words, those of the highest counts, most frequent first; by a histogram of bounded size."""
    step = F.floor(F.log2("c") * 16).cast("int")
    bins = vocabulary.where(F.col("word") != END).groupBy(step.alias("b")).count().collect()
    least, n = None, 0
    for r in sorted(bins, reverse=True):
        n += r["count"]
        if n > most:
            break
        least = r["b"]
    if least is None:
        return []
    rows = vocabulary.where((F.col("word") != END) & (step >= least)).collect()
    return sorted(((r["word"], r["c"]) for r in rows), key=lambda x: (-x[1], x[0]))


class Table:
    """What workers know of words: number by word (frequency rank), class by number; a few MB."""

    def __init__(self, words: list[tuple[str, int]]) -> None:
        self.words = [w for w, _ in words]
        self.counts = np.array([c for _, c in words], np.int64)
        self.classes = np.array([suffix_class(w.encode()) for w in self.words], np.int32)
        self.class_counts = np.zeros(CLASSES)  # of all training tokens

    def prepare(self) -> None:
        self.ids = _Ids((w.encode(), i) for i, w in enumerate(self.words))
        self.ids.base = len(self.words)
        self.number()

    def number(self) -> None:
        """Class and feature code by number. Numbers from n on: the end, then other words by bucket and suffix class."""
        n, other = len(self.words), np.arange(EXTRA * SUFFIXES)
        self.code_class = np.r_[self.classes, 0, 1 + CLUSTERS + other % SUFFIXES].astype(np.int32)
        own = np.array([i if i < CODES else CODES + bucket(w.encode()) for i, w in enumerate(self.words)], np.int64)
        self.code = np.r_[own, CODES + EXTRA, CODES + other // SUFFIXES].astype(np.int64)
        # what a word is as the word before another within the classes
        before = np.arange(len(self.code))
        self.before = np.where((before < FOCUS) & (before < n), before, FOCUS + self.code_class).astype(np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words))


def bucket(word: bytes) -> int:
    return zlib.crc32(word) % EXTRA


class _Ids(dict):
    base = 0

    def __missing__(self, word: bytes) -> int:
        return self.base + 1 + bucket(word) * SUFFIXES + zlib.crc32(word[-2:]) % SUFFIXES


START = CODES + EXTRA + 1
N_CODES = START + 1
BEFORE = FOCUS + CLASSES + 1  # the last: nothing is before


def features(code: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Codes of the three words before each token and the hashed pair; starts: each token's place in its document."""
    back = []
    for k in (1, 2, 3):
        c = np.full(len(code), START, np.int64)
        c[k:] = code[:-k]
        c[starts < k] = START
        back.append(c)
    pair = ((back[0] * 0x9E3779B1 ^ back[1] * 0x85EBCA77) & 0xFFFFFFFF) * 0xC2B2AE35 >> 17 & (PAIRS - 1)
    return back[0], N_CODES + back[1], 2 * N_CODES + back[2], 3 * N_CODES + pair


ROWS = 3 * N_CODES + PAIRS


def _logits(w: np.ndarray, bias: np.ndarray, feats: tuple[np.ndarray, ...]) -> np.ndarray:
    x = w.take(feats[0], axis=0)  # take is much faster than indexing by arrays
    for f in feats[1:]:
        x += w.take(f, axis=0)
    x += bias
    x -= x.max(1, keepdims=True)
    return x


def log_classes(w: np.ndarray, bias: np.ndarray, feats: tuple[np.ndarray, ...]) -> np.ndarray:
    x = _logits(w, bias, feats)
    x -= np.log(np.exp(x).sum(1, keepdims=True))
    return x


def classes(w: np.ndarray, bias: np.ndarray, feats: tuple[np.ndarray, ...]) -> np.ndarray:
    x = _logits(w, bias, feats)
    np.exp(x, out=x)
    x /= x.sum(1, keepdims=True)
    return x


def numbered(docs: DataFrame, shared) -> DataFrame:
    """row, doc_id, held_out, ids (numbers of the tokens with the end, 32 bits each), rare (the words beyond the table), spelt
    (for held-out rows, as only these have words that training hasn't seen, log10 of the chances of these spellings)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, spelling, unseen = shared.value
        table.prepare()
        end = np.int32(table.ids.base)
        for f in frames:
            if not len(f):
                continue
            ids, rare = [], []
            for t in f["t"]:
                words = tokens(t)
                n = table.numbers(words)
                ids.append(np.append(n, end).tobytes())
                rare.append([words[i] for i in np.flatnonzero(n > end).tolist()])
            held = [r if h else [] for r, h in zip(rare, f["held_out"], strict=True)]
            chances = np.split(spelling.logs([w for r in held for w in r], unseen), np.cumsum([len(r) for r in held])[:-1])
            rare = [[w.decode() for w in r] for r in rare]
            yield pd.DataFrame({"row": f["row"], "doc_id": f["doc_id"].astype("Int64"), "held_out": f["held_out"], "ids": ids, "rare": rare, "spelt": [c.tolist() for c in chances]})

    rows = docs.withColumn("row", F.monotonically_increasing_id()).withColumn("held_out", held_out(F.col("doc_id")))
    return rows.mapInPandas(run, "row long, doc_id long, held_out boolean, ids binary, rare array<string>, spelt array<double>")


def _batch(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token numbers of documents, each token's place in its document, each document's length."""
    n = np.array([len(b) // 4 for b in ids], np.int64)
    return np.frombuffer(b"".join(ids), np.int32), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), n


def previous(before: np.ndarray, place: np.ndarray) -> np.ndarray:
    out = np.full(len(before), BEFORE - 1, np.int64)
    out[1:] = before[:-1]
    out[place == 0] = BEFORE - 1
    return out


def _chunks(kind: str, m: np.ndarray, weight: float) -> pd.DataFrame:
    m = m.astype(np.float32)
    at = range(0, len(m), CHUNK)
    return pd.DataFrame({"kind": kind, "chunk": list(at), "weight": weight, "part": [m[i : i + CHUNK].tobytes() for i in at]})


_KINDS = "kind string, chunk long, weight double, part binary"


def _summed(parts: DataFrame, shapes: dict[str, tuple[int, int]]) -> tuple[dict[str, np.ndarray], float]:
    """The sums of matrices, by kind, that tasks sent as weighted chunks; and of the weights. Executors add them up in a
    tree, FAN_IN at a time, however many tasks there are."""

    def add(f: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(f["part"].iloc[0]) // 4)
        for p in f["part"]:
            total += np.frombuffer(p, np.float32)
        return pd.DataFrame({"kind": f["kind"].iloc[:1], "chunk": f["chunk"].iloc[:1], "weight": [f["weight"].sum()], "part": [total.astype(np.float32).tobytes()], "_k": f["_k"].iloc[:1]})

    left, level = parts.rdd.getNumPartitions(), parts.withColumn("_k", F.spark_partition_id())
    while left > 1:
        level = level.withColumn("_k", F.expr(f"_k div {FAN_IN}").cast("int")).groupBy("kind", "chunk", "_k").applyInPandas(add, _KINDS + ", _k int")
        left = -(-left // FAN_IN)
    out, weight = {k: np.zeros(s) for k, s in shapes.items()}, 0.0
    for r in level.collect():  # matrices of fixed size
        m = np.frombuffer(r["part"], np.float32).reshape(-1, shapes[r["kind"]][1])
        out[r["kind"]][r["chunk"] : r["chunk"] + len(m)] = m
        weight = r["weight"]
    return out, weight


def company(texts: DataFrame, n: int) -> np.ndarray:
    """For each of the n words in classes by company, the mean signature of the documents that it is in."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = np.zeros((n, SIGNS), np.float64)
        for f in frames:
            for b in f["ids"]:
                ids = np.frombuffer(b, np.int32)
                ids = ids[ids < n]
                sign = np.bincount(ids[ids < SIGNS], minlength=SIGNS).astype(np.float64)
                if sign.any():
                    m[np.unique(ids)] += sign / sign.sum()
        yield _chunks("m", m, 1.0)

    return _summed(texts.select("ids").mapInPandas(run, _KINDS), {"m": (n, SIGNS)})[0]["m"]


def clusters(m: np.ndarray, seed: int = 5) -> np.ndarray:
    """k-means by angle of square roots; the classes of frequent words, from 1."""
    x = np.sqrt(np.maximum(m, 0))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    k = min(CLUSTERS, len(x))
    r = np.random.default_rng(seed)
    centres = x[:1].copy()
    while len(centres) < k:
        far = np.maximum(1 - (x @ centres.T).max(1), 0)
        centres = np.r_[centres, x[[int(r.choice(len(x), p=far / far.sum())) if far.sum() > 0 else len(centres)]]]
    of = np.zeros(len(x), int)
    for _ in range(20):
        of = (x @ centres.T).argmax(1)
        for j in range(k):
            if (of == j).any():
                c = x[of == j].sum(0)
                centres[j] = c / max(np.linalg.norm(c), 1e-9)
    return of + 1


class Model:
    """The bounded table; the class's weights; share: the log share of each table word in its class; the weights of
    n-grams within classes, with their normalisers by word before and class."""

    def __init__(self, table: Table, w: np.ndarray, bias: np.ndarray, share: np.ndarray, pair: np.ndarray) -> None:
        self.table, self.w, self.bias = table, w.astype(np.float32), bias.astype(np.float32)
        self.share, self.pair = share, pair
        self.norm = np.log(normaliser(share, table.code_class, pair))

    def log_probabilities(self, ids: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of each token; of a word beyond the table, without its share in its class."""
        t = self.table
        feats, k = features(t.code[ids], place), t.code_class[ids]
        out = np.concatenate([log_classes(self.w, self.bias, tuple(x[a : a + 16384] for x in feats))[np.arange(min(16384, len(ids) - a)), k[a : a + 16384]] for a in range(0, len(ids), 16384)]).astype(np.float64)
        before = previous(t.before[ids], place)
        out += self.share[ids] - self.norm[before, k]
        at = np.flatnonzero(ids < self.pair.shape[1])
        out[at] += self.pair[before[at], ids[at]]
        return out


def normaliser(share: np.ndarray, classes: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """By word before and class: the sum of share * exp(weight) over all words of the class, of which only the first few
    have weights."""
    n = pair.shape[1]
    extra = np.exp(share[:n]) * np.expm1(pair)
    out = np.ones((len(pair), CLASSES))
    for k in range(CLASSES):
        out[:, k] += extra[:, classes[:n] == k].sum(1)
    return np.maximum(out, 1e-9)


def pair_weights(share: np.ndarray, classes: np.ndarray, pairs: np.ndarray, of_class: np.ndarray) -> np.ndarray:
    """Weights of n-grams within classes, by damped gradient steps on the penalised likelihood of all pairs."""
    n = pairs.shape[1]
    w, k = np.zeros(pairs.shape), classes[:n]
    for _ in range(STEPS if n else 0):
        expected = of_class[:, k] * np.exp(share[:n] + w) / normaliser(share, classes, w)[:, k]
        w += np.clip((pairs - expected - PENALTY * w) / (expected + PENALTY), -0.5, 0.5)
    return w


def trained(texts: DataFrame, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weights and biases of the classes after ROUNDS rounds, each over its share of all training documents (a document
    is in one); how often words of the focus, and classes, follow what is before them."""
    spark = texts.sparkSession
    even = table.class_counts + 1.0
    w, bias = np.zeros((ROWS, CLASSES), np.float32), np.log(even / even.sum()).astype(np.float32)
    focus = min(FOCUS, len(table.words))
    follow = np.zeros((BEFORE, focus + CLASSES))
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast((table.code, table.code_class, table.before, w, bias))  # of fixed size

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            codes, code_class, before, w0, b0 = shared.value
            w, b = w0.copy(), b0.copy()
            gw, gb = np.full((ROWS, CLASSES), 1e-2, np.float32), np.full(CLASSES, 1e-2, np.float32)
            seen, width = 0, focus + CLASSES
            pairs, held = np.zeros(BEFORE * width), []
            for f in frames:
                for i in range(0, len(f), 100):
                    ids, place, _ = _batch(f["ids"].iloc[i : i + 100].tolist())
                    code, y = codes[ids], code_class[ids]
                    prev = previous(before[ids], place) * width
                    inside = ids < focus
                    held += [prev[inside] + ids[inside], prev + focus + y]
                    if sum(map(len, held)) > 1 << 20:
                        pairs += np.bincount(np.concatenate(held), minlength=len(pairs))
                        held = []
                    feats = features(code, place)
                    for a in range(0, len(ids), BATCH):
                        part = tuple(x[a : a + BATCH] for x in feats)
                        n = len(part[0])
                        g = classes(w, b, part)
                        g[np.arange(n), y[a : a + n]] -= 1
                        # The kinds of features have rows of their own, so one sort serves all of them.
                        x = np.concatenate(part)
                        order = np.argsort(x)
                        s = x[order]
                        cut = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
                        d = np.add.reduceat(g.take(order % n, axis=0), cut, axis=0)
                        d /= n
                        at = s[cut]
                        h = gw.take(at, axis=0)
                        h += d * d
                        gw[at] = h
                        np.sqrt(h, out=h)
                        d /= h
                        d *= np.float32(RATE)
                        w[at] = w.take(at, axis=0) - d
                        d = g.mean(0)
                        gb += d * d
                        b -= RATE * d / np.sqrt(gb)
                    seen += len(ids)
            if seen:
                if held:
                    pairs += np.bincount(np.concatenate(held), minlength=len(pairs))
                yield _chunks("w", np.concatenate([w, b[None]]) * seen, float(seen))
                yield _chunks("pairs", pairs.reshape(BEFORE, width), float(seen))

        share = texts.where(F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(ROUNDS)) == turn).select("ids")
        got, weight = _summed(share.mapInPandas(run, _KINDS), {"w": (ROWS + 1, CLASSES), "pairs": follow.shape})
        if weight:
            w, bias = (got["w"][:-1] / weight).astype(np.float32), (got["w"][-1] / weight).astype(np.float32)
            follow += got["pairs"]
        shared.destroy()
    return w, bias, follow[:, :focus], follow[:, focus:]


def _spelt(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of words from their ends, with a STOP after each; the byte before (STOP: the word ends here), and the bucket
    of the two before."""
    n = np.array([len(w) for w in words], np.int64) + 1
    stop = np.cumsum(n) - 1
    x = np.full(n.sum(), STOP, np.int64)
    at = np.ones(len(x), bool)
    at[stop] = False
    x[at] = np.frombuffer(b"".join(w[::-1] for w in words), np.uint8)
    first = np.zeros(len(x), bool)
    first[stop + 1 - n] = True
    one = np.where(first, STOP, np.r_[STOP, x[:-1]])
    two = np.where(first | np.r_[True, first[:-1]], STOP, np.r_[STOP, STOP, x[:-2]])
    return x, one, context(one, two)


def context(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return ((one * (STOP + 1) + two) * 0x9E3779B1 & 0xFFFFFFFF) >> 20  # CONTEXTS buckets


class Spelling:
    """How likely words are spelt as they are, by counts of bytes after two, one and no bytes, from their ends."""

    def __init__(self, counts: np.ndarray) -> None:
        two, one = counts[:CONTEXTS], counts[CONTEXTS:]
        none = (one.sum(0) + 1.0) / (one.sum() + STOP + 1)
        short = (one + BACK_OFF * none) / (one.sum(1, keepdims=True) + BACK_OFF)
        self.two, self.whole, self.short = two.astype(np.float32), two.sum(1), short
        # a class depends on the last two bytes alone, so the mass of its spellings is a sum over these
        last = np.arange(STOP)
        p0 = self.chance(last, np.full(STOP, STOP), np.full(STOP, STOP))
        self.mass = np.zeros(CLASSES)
        for b in last:
            p1 = p0[b] * self.chance(np.arange(STOP + 1), np.full(STOP + 1, b), np.full(STOP + 1, STOP))
            for a in range(STOP + 1):
                self.mass[suffix_class(bytes([a, b]) if a < STOP else bytes([b]))] += p1[a]

    def chance(self, x: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self._chance(x, one, context(one, two))

    def _chance(self, x: np.ndarray, one: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return (self.two[bucket, x] + BACK_OFF * self.short[one, x]) / (self.whole[bucket] + BACK_OFF)

    def logs(self, words: list[bytes], unseen: np.ndarray) -> np.ndarray:
        """log10 of each word's chance among the words that training hasn't seen; unseen: how many a class has."""
        if not words:
            return np.zeros(0)
        n, k = np.array([len(w) for w in words], np.int64) + 1, [suffix_class(w) for w in words]
        each = np.add.reduceat(np.log(self._chance(*_spelt(words))), np.cumsum(n) - n) - np.log(self.mass[k])
        return np.log10((1 - LISTED) * np.exp(each) + LISTED / unseen[k])


def spelling(vocabulary: DataFrame) -> Spelling:
    """From the distinct words of training; tasks send tables of fixed size."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = np.zeros((CONTEXTS + STOP + 1) * (STOP + 1))
        for f in frames:
            words = [w.encode() for w in f["word"]]
            if words:
                x, one, bucket = _spelt(words)
                for row in (bucket, CONTEXTS + one):
                    m += np.bincount(row * (STOP + 1) + x, minlength=len(m))
        yield _chunks("m", m.reshape(-1, STOP + 1), 1.0)

    words = vocabulary.where(F.col("word") != END).select("word")
    return Spelling(_summed(words.mapInPandas(run, _KINDS), {"m": (CONTEXTS + STOP + 1, STOP + 1)})[0]["m"])


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    Null texts are empty: a document of its end alone. Rows of one id are scored one by one. Training takes all rows
    whose crc32 of the id as text is not 2 modulo 7 (rows without an id too). Without training rows, scores are those of
    an even model. A word that training has not seen has a share of the mass of all such words of its class. Scores depend on how rows are dealt over tasks, whose weights are averaged. Of the words of the
    history, the CODES most frequent have features of their own and all others share EXTRA buckets; within classes only
    pairs of the FOCUS most frequent words have features; no other number is a limit. Other columns are ignored; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    ready(spark)
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    vocabulary = written(counted(every.where(~held_out(F.col("doc_id")))), "vocabulary")
    words, total = vocabulary.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    table = Table(frequent(vocabulary, TABLE))
    by_suffix = vocabulary.where(F.col("word") != END).groupBy(suffix_column(F.col("word")).alias("k"))
    mass, once, twice = np.zeros(CLASSES), np.zeros(CLASSES), np.zeros(CLASSES)
    times = lambda n: F.sum((F.col("c") == n).cast("long"))
    for r in by_suffix.agg(F.sum("c").alias("c"), times(1).alias("once"), times(2).alias("twice")).collect():
        mass[r["k"]], once[r["k"]], twice[r["k"]] = r["c"], r["once"], r["twice"]
    unseen = np.maximum(once * (once - 1) / (2 * (twice + 1)), 1.0)
    shared = spark.sparkContext.broadcast((table, spelling(vocabulary), unseen))
    held = written(numbered(every, shared), "numbered")
    shared.destroy()
    train = held.where("not held_out")
    n = min(COMPANY, len(table.words))
    if n:
        table.classes[:n] = clusters(company(train, n))
    table.number()
    inside = np.array([suffix_class(w.encode()) for w in table.words[:n]], int)
    mass -= np.bincount(inside, weights=table.counts[:n], minlength=CLASSES)  # these have other classes
    new = np.maximum((once + 0.5) / (mass + 1.0), 1e-9)
    new = np.minimum(new, np.where(mass > 0, 0.9, 1.0))
    mass += np.bincount(table.classes[:n], weights=table.counts[:n], minlength=CLASSES)
    known = np.log(np.maximum(np.where(np.arange(CLASSES) > CLUSTERS, 1 - new, 1.0), 1e-12)) - np.log(np.maximum(mass, 1.0))
    none = np.zeros(EXTRA * SUFFIXES)
    share = np.r_[np.log(np.maximum(table.counts, 1)) + known[table.classes], 0.0, none]
    ends = vocabulary.where(F.col("word") == END).first()
    ends = ends["c"] if ends else 0
    table.class_counts = np.r_[ends, mass[1:]]
    w, bias, pairs, of_class = trained(train, table)
    model = Model(table, w, bias, share, pair_weights(share, table.code_class, pairs, of_class))
    base_word = np.r_[np.log10(table.counts + 1.0), np.log10(ends + 1.0), none]
    end, least = len(table.words), int(table.counts[-1]) if len(table.words) else None
    table.words = []  # numbers are all that is needed from here on
    shared = spark.sparkContext.broadcast((model, base_word))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, base_word = shared.value
        for f in frames:
            for i in range(0, len(f), 100):
                part = f.iloc[i : i + 100]
                ids, place, n = _batch(part["ids"].tolist())
                starts = np.cumsum(n) - n
                yield pd.DataFrame(
                    {
                        "row": part["row"],
                        "doc_id": part["doc_id"].astype("Int64"),
                        "score": np.add.reduceat(model.log_probabilities(ids, place), starts) / np.log(10),
                        "base": np.add.reduceat(base_word[ids], starts),
                        "n": n,
                        "known": np.add.reduceat((ids < end).astype(np.int64), starts) + bool(ends),
                    }
                )

    kinds = "row long, doc_id long, score double, base double, n long, known long"
    parts = held.select("row", "doc_id", "ids").mapInPandas(run, kinds)
    log_new = F.array(*[F.lit(float(x)) for x in np.log10(new)])
    log_known = F.array(*[F.lit(float(x)) for x in known / np.log(10)])
    k = suffix_column(F.col("word")) + 1
    counts = vocabulary.where(F.col("c") <= least if least is not None else F.lit(True))  # words of the table need no join
    rare = held.select("row", F.explode(F.arrays_zip("rare", "spelt")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.spelt").alias("spelt")).join(counts, "word", "left")
    rare = rare.select("row", F.lit(None).cast("long").alias("doc_id"), (F.when(F.col("c").isNull(), F.element_at(log_new, k) + F.col("spelt")).otherwise(F.log10("c") + F.element_at(log_known, k))).alias("score"), (F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("base"), F.lit(0).cast("long").alias("n"), F.when(F.col("c").isNotNull(), 1).otherwise(0).cast("long").alias("known"))
    sums = parts.union(rare).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("score").alias("score"), F.sum("base").alias("base"), F.sum("n").alias("n_tokens"), F.sum("known").alias("n_known"))
    return sums.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * float(np.log10(total + words + 1))).alias("base_score"), "score")


def op8_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """op8: all documents, by a model of those that are not held out."""
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))

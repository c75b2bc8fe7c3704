"""Substring dedup by fixed-block anchors.

Index: every document's words are cut into blocks of BLOCK words that do not overlap. Probe: the rolling window of
BLOCK words at every place of every document. A passage of at least 2 * BLOCK - 1 words that occurs twice holds a whole
indexed block of either occurrence, so both are found. Index and probes meet by hash range, packed by document; a
task keeps the index of its range in memory and lets the probes pass. Hits are then extended: of the windows around
them, those whose key starts earlier elsewhere, in both places word by word, run on into maximal repeats. The words of
each maximal repeat are held against those at its first place, by SHA-256 of both, before they are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, exclusive_sum, id_blocks, ready, release, salted_join, written

WINDOW = 20
#: Words whose windows meet in one hash range, about; ranges are a power of two.
WORDS_PER_RANGE = 1 << 23
_MUL = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_KNOWN_MOST = 1 << 18
#: Anchors that a task holds before it drops their repeats.
HELD_MOST = 1 << 22


class _Words(dict):
    def __missing__(self, w: bytes) -> int:
        if len(self) > _KNOWN_MOST:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


_words = _Words()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def rolling(h: np.ndarray, size: int, mul: int) -> np.ndarray:
    """A hash of each window of `size` consecutive words, from their hashes, with all bits mixed."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    m = np.uint64(mul)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out *= m
        out += h[i : i + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, t, doc_id: a number of the document in the order of ids, which is the id itself if no id has two texts. Else
    documents of one id are numbered in the order of a hash of their texts; a null id has no number."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    of = rows.select("id", F.xxhash64("t").alias("of")).where("id is not null")
    if of.groupBy("id").agg((F.min("of") != F.max("of")).alias("two")).where("two").isEmpty():
        return rows.withColumn("doc_id", F.col("id"))
    of = written(of.distinct().withColumn("one", F.lit(1).cast("long")), "ids")
    ranked = exclusive_sum(of.withColumn("block", id_blocks(of, of.count(), 4096, "id")), [], "block", ["id", "of"], "one", "doc_id")
    return rows.withColumn("of", F.xxhash64("t")).join(written(ranked.select("id", "of", "doc_id"), "numbers"), ["id", "of"], "left").select("id", "t", "doc_id")


def by_range(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows in the order of (range, place); the ranges that occur, and where each begins in that order."""
    top = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
    order = np.argsort(top, kind="stable")
    top = top[order]
    cut = np.flatnonzero(np.r_[True, top[1:] != top[:-1]])[: len(top)]
    return order, top[cut], cut


def _sliced(values: np.ndarray, cut: np.ndarray) -> list[bytes]:
    b, n = values.tobytes(), values.itemsize
    ends = [*cut[1:].tolist(), len(values)][: len(cut)]
    return [b[n * x : n * y] for x, y in zip(cut.tolist(), ends, strict=True)]


def _grouped(ranges: np.ndarray, doc: np.ndarray, *values: np.ndarray) -> dict[str, list]:
    """A row for each range: values, and the documents that they are of as runs, all packed. Keeps the order."""
    order = np.argsort(ranges, kind="stable")
    ranges, doc = ranges[order], doc[order]
    cut = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]])[: len(ranges)]
    run = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (ranges[1:] != ranges[:-1])])[: len(ranges)]
    of_range = np.searchsorted(run, cut)
    out = {"range": ranges[cut].tolist(), "docs": _sliced(doc[run], of_range), "runs": _sliced(np.diff(np.r_[run, len(ranges)]).astype(np.int32), of_range)}
    return out | {f"v{i}": _sliced(v[order], cut) for i, v in enumerate(values)}


def _docs_of(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of packed rows: range and document of each value, and the value's number in its run."""
    runs = np.frombuffer(b"".join(f["runs"]), np.int32).astype(np.int64)
    docs = np.repeat(np.frombuffer(b"".join(f["docs"]), np.int64), runs)
    per_row = [int(np.frombuffer(x, np.int32).sum()) for x in f["runs"]]
    nth = np.arange(len(docs)) - np.repeat(np.cumsum(runs) - runs, runs)
    return np.repeat(f["range"].to_numpy(np.int64), per_row), docs, nth


def _probes(texts: DataFrame, block: int, bits: int) -> DataFrame:
    """range, docs, runs, v0, v1, in two kinds of rows, each of many documents: the 32 bits after the range of all
    windows that fall into the range, in the order of documents and places (v1 null); and those of the indexed blocks,
    with their numbers in their document's run. A place is known by that number, which the document's text gives back."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            each: list[tuple[np.ndarray, ...]] = []
            for doc, t in zip(f["doc_id"], f["t"], strict=True):
                h = rolling(word_hashes(t.encode().split()), block, _MUL[0])
                if len(h):
                    order, ranges, cut = by_range(h, bits)
                    size = np.diff(np.r_[cut, len(h)])
                    each.append((np.repeat(ranges, size), np.full(len(h), doc, np.int64), (h >> np.uint64(32 - bits)).astype(np.uint32)[order], (np.arange(len(h)) - np.repeat(cut, size)).astype(np.int32), order % block == 0))
            if each:
                ranges, doc, low, nth, anchor = (np.concatenate(x) for x in zip(*each, strict=True))
                index = _grouped(ranges[anchor], doc[anchor], low[anchor], nth[anchor])
                every = _grouped(ranges, doc, low)
                yield pd.DataFrame(index)
                yield pd.DataFrame(every | {"v1": [None] * len(every["range"])})

    return texts.mapInPandas(run, "range int, docs binary, runs binary, v0 binary, v1 binary")


def hits(texts: DataFrame, block: int, bits: int) -> DataFrame:
    """doc_id, range, nth (packed): windows that equal an indexed block of another place, and blocks that a window
    elsewhere equals. Each range's index comes first and is kept, without its repeats; probes are read as they come."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []
        state: dict = {}
        size = 0

        def rows(k: np.ndarray, d: np.ndarray, n: np.ndarray) -> pd.DataFrame:
            r = k >> 32
            order = np.lexsort((n, d, r))
            r, d, n = r[order], d[order], n[order].astype(np.int32)
            cut = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (r[1:] != r[:-1])])[: len(d)]
            return pd.DataFrame({"doc_id": d[cut], "range": r[cut], "nth": _sliced(n, cut)})

        def once() -> tuple[np.ndarray, ...]:
            """What is held, one entry for each key: however often a passage occurs, its repeats are not kept."""
            k, d, n, many = (np.concatenate(x) for x in zip(*held, strict=True))
            key, first, of, times = np.unique(k, return_index=True, return_inverse=True, return_counts=True)
            held[:] = [(key, d[first], n[first], (times > 1) | (np.bincount(of, weights=many, minlength=len(key)) > 0))]
            return held[0]

        def probe(k: np.ndarray, d: np.ndarray, n: np.ndarray) -> pd.DataFrame | None:
            if not state:
                key, doc, nth, many = once() if held else (k[:0], d[:0], n[:0], np.zeros(0, bool))
                held.clear()
                state.update(key=key, doc=doc, nth=nth, many=many, hit=np.zeros(len(key), bool))
            key, many = state["key"], state["many"]
            if not len(key):
                return None
            at = np.minimum(np.searchsorted(key, k), len(key) - 1)
            same = np.flatnonzero(key[at] == k)
            a = at[same]
            same = same[many[a] | (state["doc"][a] != d[same]) | (state["nth"][a] != n[same])]
            state["hit"][at[same]] = True
            return rows(k[same], d[same], n[same]) if len(same) else None

        for f in frames:
            anchor = f["v1"].notna().to_numpy()
            for g, is_anchor in ((f[anchor], True), (f[~anchor], False)):
                for i in range(0, len(g), 50):
                    part = g.iloc[i : i + 50]
                    r, d, n = _docs_of(part)
                    k = r << 32 | np.frombuffer(b"".join(part["v0"]), np.uint32)
                    if is_anchor:
                        held.append((k, d, np.frombuffer(b"".join(part["v1"]), np.int32), np.zeros(len(k), bool)))
                        size += len(k)
                        if size > HELD_MOST + 2 * len(held[0][0]):
                            once()
                            size = len(held[0][0])
                        continue
                    out = probe(k, d, n)
                    if out is not None:
                        yield out
        if state:
            alone = state["hit"] & ~state["many"]
            if alone.any():
                yield rows(state["key"][alone], state["doc"][alone], state["nth"][alone])

    dealt = _probes(texts, block, bits).repartition(1 << bits, "range")
    return dealt.sortWithinPartitions(F.col("v1").isNull()).mapInPandas(run, "doc_id long, range int, nth binary")


def _around(texts: DataFrame, found: DataFrame, window: int, block: int, bits: int) -> DataFrame:
    """range, docs, runs, v0, v1: the windows that hold an anchor hit, by the range of one hash of their words, with 64
    bits of another as the key, and their places."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            each: list[tuple[np.ndarray, ...]] = []
            for doc, t, nths in zip(f["doc_id"], f["t"], f["nths"], strict=True):
                h = word_hashes(t.encode().split())
                n = len(h) - window + 1
                if n <= 0:
                    continue
                order, ranges, cut = by_range(rolling(h, block, _MUL[0]), bits)
                begin = dict(zip(ranges.tolist(), cut.tolist(), strict=True))
                at = [np.frombuffer(x["nth"], np.int32).astype(np.int64) + begin.get(x["range"], len(order)) for x in nths]
                at = np.concatenate(at)
                p = np.sort(order[at[at < len(order)]])
                p = p[np.r_[True, p[1:] != p[:-1]]] if len(p) else p
                mark = np.zeros(n + 1, np.int32)
                np.add.at(mark, np.maximum(0, np.minimum(p - (window - block), n)), 1)
                np.add.at(mark, np.minimum(p + 1, n), -1)
                at = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                if len(at):
                    top = rolling(h, window, _MUL[1])[at] >> np.uint64(64 - bits)
                    each.append((top.astype(np.int64), np.full(len(at), doc, np.int64), rolling(h, window, _MUL[0])[at], at.astype(np.int32)))
            if each:
                yield pd.DataFrame(_grouped(*(np.concatenate(x) for x in zip(*each, strict=True))))

    per_doc = found.groupBy("doc_id").agg(F.collect_list(F.struct("range", "nth")).alias("nths"))
    return texts.join(per_doc, "doc_id").mapInPandas(run, "range int, docs binary, runs binary, v0 binary, v1 binary")


def later_windows(packed: DataFrame, bits: int, chunk: int = 1 << 19) -> DataFrame:
    """doc_id, starts, first_docs, first_starts (packed): windows whose key has an earlier place, and that place. A range's
    task keeps the first place of each key so far, however often it occurs; a place that turns out later than another, or
    that another replaces, goes out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, tuple[np.ndarray, ...]] = {}

        def take(r: int, parts: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
            k, d, s = (np.concatenate(x) for x in zip(*([seen[r]] if r in seen else []), *parts, strict=True))
            order = np.lexsort((s, d, k))
            k, d, s = k[order], d[order], s[order]
            new = np.r_[True, k[1:] != k[:-1]]
            first = np.flatnonzero(new)
            of = np.repeat(first, np.diff(np.r_[first, len(k)]))
            late = (d != d[of]) | (s != s[of])
            seen[r] = (k[first], d[first], s[first])
            d, s, fd, fs = d[late], s[late], d[of][late], s[of][late]
            order = np.lexsort((s, d))
            d = d[order]
            cut = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])[: len(d)]
            return pd.DataFrame({"doc_id": d[cut], "starts": _sliced(s[order], cut), "first_docs": _sliced(fd[order], cut), "first_starts": _sliced(fs[order], cut)})

        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        size: dict[int, int] = {}
        for f in frames:
            for r, g in f.groupby("range", sort=False):
                _, d, _ = _docs_of(g)
                held.setdefault(r, []).append((np.frombuffer(b"".join(g["v0"]), np.uint64), d, np.frombuffer(b"".join(g["v1"]), np.int32)))
                size[r] = size.get(r, 0) + len(d)
                if size[r] >= chunk:
                    yield take(r, held.pop(r))
                    size[r] = 0
        for r, parts in held.items():
            yield take(r, parts)

    return packed.repartition(1 << bits, "range").mapInPandas(run, "doc_id long, starts binary, first_docs binary, first_starts binary")


def maximal(later: DataFrame) -> DataFrame:
    """doc_id, start, first_doc, first_start, n: runs of n windows that go on, one by one, in both places."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: list[tuple[np.ndarray, ...]] = []
            for doc, parts in zip(f["doc_id"], f["parts"], strict=True):
                s, d, p = (np.concatenate([np.frombuffer(x[c], t) for x in parts]) for c, t in (("starts", np.int32), ("first_docs", np.int64), ("first_starts", np.int32)))
                order = np.lexsort((p, d, s))
                s, d, p = s[order], d[order], p[order]
                new = np.r_[True, s[1:] != s[:-1]]  # of rows that repeat a document, the least first place
                s, d, p = s[new], d[new], p[new]
                cut = np.flatnonzero(np.r_[True, (s[1:] != s[:-1] + 1) | (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)])
                out.append((np.full(len(cut), doc, np.int64), s[cut], d[cut], p[cut], np.diff(np.r_[cut, len(s)]).astype(np.int32)))
            if out:
                yield pd.DataFrame(dict(zip(("doc_id", "start", "first_doc", "first_start", "n"), (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)))

    per_doc = later.groupBy("doc_id").agg(F.collect_list(F.struct("starts", "first_docs", "first_starts")).alias("parts"))
    return per_doc.mapInPandas(run, "doc_id long, start int, first_doc long, first_start int, n int")


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def with_first_words(texts: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """Adds digest, of the words at the first place. A first place that many runs have is read once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc, t, asked in zip(f["doc_id"], f["t"], f["asked"], strict=True):
                words = t.encode().split()
                rows += [(doc, x["first_start"], x["n"], _digest(words[x["first_start"] : x["first_start"] + x["n"] + window - 1])) for x in asked]
            yield pd.DataFrame(rows, columns=["first_doc", "first_start", "n", "digest"])

    asked = runs.select("first_doc", "first_start", "n").distinct().groupBy(F.col("first_doc").alias("doc_id")).agg(F.collect_list(F.struct("first_start", "n")).alias("asked"))
    found = texts.join(written(asked, "asked"), "doc_id").mapInPandas(run, "first_doc long, first_start int, n int, digest binary").distinct()
    return salted_join(runs, found, ["first_doc", "first_start", "n"], "inner", "doc_id")


def repeats(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, start, n, digest of texts(doc_id, t): runs of n windows of each document whose word sequence also starts
    earlier, and the digest of the words there."""
    texts = texts.where("doc_id is not null").select("doc_id", "t")
    block = (window + 1) // 2
    words = texts.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0] / 6
    bits = max(4, min(24, int(words / WORDS_PER_RANGE).bit_length()))
    found = written(hits(texts, block, bits), "hits")
    release(texts.sparkSession)
    later = written(later_windows(_around(texts, found, window, block, bits), bits), "later")
    discard(found)
    runs = written(maximal(later), "runs")
    discard(later)
    return with_first_words(texts, runs, window).select("doc_id", "start", "n", "digest")


def without_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, spans (of removed words, [from, to)), kept_text for each row of docs.

    A word goes if a window of `window` consecutive words of its document covers it whose word sequence also starts
    earlier: in a smaller doc_id, or in the same document before. Windows are judged on the input. Null and empty texts
    have no words; rows without an id are left as they are. Rows of one id and one text count as one document repeated
    (neither row's windows remove the other's); of one id with different texts, which is the earlier is by a hash of
    the texts. Windows are found by 64 bits and more of their words; if two with other words had the same, the job fails
    rather than remove words that do not repeat. Other columns are ignored; an empty table gives no rows.
    """
    ready(docs.sparkSession)
    texts = _texts(docs, id_col, text_col)
    runs = repeats(texts, window).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "digest")).alias("runs"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for doc, t, found in zip(f["id"], f["t"], f["runs"], strict=True):
                words = t.encode().split()
                spans: list[list[int]] = []
                for x in sorted(found, key=lambda x: x["start"]) if found is not None else ():
                    a, b = x["start"], x["start"] + x["n"] + window - 1
                    if _digest(words[a:b]) != x["digest"]:
                        raise ValueError("two windows of other words with one key")
                    if spans and a < spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                kept, at = [], 0
                for a, b in spans:
                    kept.extend(words[at:a])
                    at = b
                kept.extend(words[at:])
                out.append((doc, len(words), len(words) - len(kept), spans, b" ".join(kept).decode()))
            made = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "spans", "kept_text"])
            made["doc_id"] = made["doc_id"].astype("Int64")
            yield made

    joined = texts.join(runs, "doc_id", "left").select("id", "t", "runs")
    return joined.mapInPandas(run, "doc_id long, n_words long, n_removed long, spans array<array<int>>, kept_text string")


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """op7: windows of 20 words."""
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))

"""Periodic runs of words: a harmonic grid probed by longest common extensions.

For each period p the grid points jp and (j+1)p are compared. A run of p has at least four grid points, so where the words
at four neighbouring points are equal, the longest common extension of jp and (j+1)p is asked forward and backward: the
stretch between has period p and no neighbour extends it. Extensions come from a suffix array of the text, one of the
reversed text, and range minima over their common prefixes. Runs are complete: no period, run or word is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ready

#: A run has at least TIMES periods and LEAST words.
TIMES, LEAST = 4, 6
#: Words of texts that numpy takes at once (a longer text is taken alone), extensions asked at once, words a block of range minima.
AT_ONCE, ASK, BLOCK = 1 << 18, 1 << 20, 16


def numbered_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words `[^\\x20\\x09-\\x0D]+` of all texts in a row, their numbers, and where each text's words start."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, of = lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    flat = flat.filter(pa.array(real))
    starts = np.concatenate([[0], np.cumsum(np.bincount(of[real], minlength=len(lists)))]).astype(np.int64)
    return flat, flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), starts


class Extensions:
    """Longest common extensions to the right in a row of numbers: suffix array, common prefixes of neighbours, range minima.

    Ranks by prefixes of doubling length are kept until the suffixes differ, which takes 4 bytes a number and doubling of
    the longest repeat.
    """

    def __init__(self, codes: np.ndarray) -> None:
        n = len(codes)
        levels = [np.unique(codes, return_inverse=True)[1].astype(np.int32)]
        while n and (top := int(levels[-1].max())) < n - 1:
            step = 1 << (len(levels) - 1)
            key = levels[-1].astype(np.int64) * (top + 2)
            key[: max(n - step, 0)] += levels[-1][step:] + 1
            levels.append(np.unique(key, return_inverse=True)[1].astype(np.int32))
        self.rank = levels[-1]
        suffixes = np.empty(n, np.int64)
        suffixes[self.rank] = np.arange(n)
        a, b = suffixes[:-1].copy(), suffixes[1:].copy()
        common = np.zeros(n, np.int32)  # of a suffix with the one before it
        for k in range(len(levels) - 1, -1, -1):
            same = np.flatnonzero((a < n) & (b < n))
            same = same[levels[k][a[same]] == levels[k][b[same]]]
            # ranks of prefixes that the end cuts off are equal for no two suffixes, so a match is of 1 << k numbers
            common[1 + same] += 1 << k
            a[same] += 1 << k
            b[same] += 1 << k
        blocks = -(-n // BLOCK)
        grid = np.full(blocks * BLOCK, np.iinfo(np.int32).max, np.int32)
        grid[:n] = common
        self.common, grid = grid, grid.reshape(blocks, BLOCK)
        self.upto = np.minimum.accumulate(grid, 1).ravel()
        self.onward = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
        self.table = [grid.min(1)] if n else []
        while self.table and (step := 1 << (len(self.table) - 1)) * 2 <= blocks:
            self.table.append(np.minimum(self.table[-1][:-step], self.table[-1][step:]))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least common prefix in low..high, ends included."""
        first, last = low // BLOCK, high // BLOCK
        out = np.minimum(self.onward[low], self.upto[high])
        gap = last - first - 1
        far = np.flatnonzero(gap > 0)
        level = np.floor(np.log2(gap[far])).astype(np.int64)
        for k in np.unique(level):
            at = far[level == k]
            out[at] = np.minimum(out[at], np.minimum(self.table[k][first[at] + 1], self.table[k][last[at] - (1 << k)]))
        near = np.flatnonzero(gap < 0)
        if len(near):
            out[near] = self.common[low[near]]
            for s in range(1, BLOCK):
                near = near[low[near] + s <= high[near]]
                out[near] = np.minimum(out[near], self.common[low[near] + s])
        return out

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers from i and from j on are equal; i and j differ."""
        a, b = self.rank[i].astype(np.int64), self.rank[j].astype(np.int64)
        return self.least(np.minimum(a, b) + 1, np.maximum(a, b))


def grid_points(codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid points and periods up to `most` where the numbers at TIMES neighbouring points are equal."""
    places, periods = [], []
    for p in range(1, most + 1):
        at = codes[::p]
        same = at[1:] == at[:-1]
        if len(same) < TIMES - 1:
            break
        found = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        if len(found):
            places.append(found * p)
            periods.append(np.full(len(found), p, np.int64))
    none = np.zeros(0, np.int64)
    return (np.concatenate(places), np.concatenate(periods)) if places else (none, none)


def runs_of(numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Runs of all texts as rows text, start, length, period in this order; start counts from the text's first word."""
    sizes = np.diff(starts)
    text = np.repeat(np.arange(len(sizes)), sizes)
    codes = text * (int(numbers.max(initial=0)) + 1) + numbers  # words of two texts are never equal
    i, p = grid_points(codes, int(sizes.max(initial=0)) // TIMES)
    if not len(i):
        return np.zeros((0, 4), np.int64)
    keep = np.zeros(len(sizes), bool)  # only texts with points to ask about need suffix arrays
    keep[text[i]] = True
    chosen = keep[text]
    moved = np.cumsum(chosen) - 1
    codes, text, back = codes[chosen], text[chosen], np.flatnonzero(chosen)
    i = moved[i]
    n = len(codes)
    ahead, behind = Extensions(codes), Extensions(codes[::-1].copy())

    def asked(a: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, end = np.empty(len(a), np.int64), np.empty(len(a), np.int64)
        for s in range(0, len(a), ASK):
            b, d = a[s : s + ASK], q[s : s + ASK]
            left = np.zeros(len(b), np.int64)
            some = np.flatnonzero(b > 0)
            left[some] = behind.of(n - b[some], n - b[some] - d[some])
            start[s : s + ASK], end[s : s + ASK] = b - left, b + d + ahead.of(b, b + d)
        return start, end

    # neighbouring points are mostly of one run: the first of them is asked, then those that its run doesn't hold
    first = np.concatenate([[True], (p[1:] != p[:-1]) | (i[1:] != i[:-1] + p[1:])])
    start, end = asked(i[first], p[first])
    rest = np.flatnonzero(~first)
    rest = rest[i[rest] + p[rest] >= end[np.cumsum(first)[rest] - 1]]
    more = asked(i[rest], p[rest])
    start, end, period = np.concatenate([start, more[0]]), np.concatenate([end, more[1]]), np.concatenate([p[first], p[rest]])
    rows = np.stack([start, end - start, period], 1)[end - start >= np.maximum(LEAST, TIMES * period)]
    rows = rows[np.lexsort(rows.T[::-1])]
    # a stretch of several periods has its smallest first
    rows = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])] if len(rows) else rows
    of = text[rows[:, 0]]
    out = np.stack([of, back[rows[:, 0]] - starts[of], rows[:, 1], rows[:, 2]], 1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _portions(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Texts in the order of length, in portions of about AT_ONCE words."""
    order = np.argsort(sizes, kind="stable")
    ends = np.cumsum(sizes[order])
    first = 0
    while first < len(order):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + AT_ONCE, "right")))
        yield order[first:last]
        first = last


RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def _found(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Of each text its number of words, its runs, and the words that stay, joined by one space."""
    flat, numbers, starts = numbered_words(texts)
    sizes = np.diff(starts)
    parts = []
    for portion in _portions(sizes):
        at = np.concatenate([[0], np.cumsum(sizes[portion])])
        take = np.arange(at[-1]) + np.repeat(starts[portion] - at[:-1], sizes[portion])
        rows = runs_of(numbers[take], at)
        rows[:, 0] = portion[rows[:, 0]]
        parts.append(rows)
    rows = np.concatenate(parts) if parts else np.zeros((0, 4), np.int64)
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    cover = np.zeros(len(flat) + 1, np.int64)
    begin = starts[rows[:, 0]] + rows[:, 1]
    np.add.at(cover, begin + rows[:, 3], 1)
    np.add.at(cover, begin + rows[:, 2], -1)
    stays = np.cumsum(cover)[:-1] == 0
    ends = np.concatenate([[0], np.cumsum(stays)])[starts]
    kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.filter(pa.array(stays))), " ")
    counts = np.concatenate([[0], np.cumsum(np.bincount(rows[:, 0], minlength=len(sizes)))])
    structs = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
    return pa.array(sizes), pa.ListArray.from_arrays(pa.array(counts, pa.int32()), structs), kept


def with_runs(docs: DataFrame, text_col: str = "text", words: str = "n_words", runs: str = "runs", kept: str = "collapsed") -> DataFrame:
    """Adds the number of words, the runs by start and period, and the text without what repeats in them.

    A run is a stretch with smallest period q and at least max(LEAST, TIMES * q) words that no neighbouring word extends
    keeping q. Of a run its first q words stay; a word that another run drops goes nevertheless. Null texts have no
    words and no runs. All rows stay, and all columns but those with the names of new ones, which are replaced.
    """
    ready(docs.sparkSession)
    at, new = docs.columns.index(text_col), {words.lower(), runs.lower(), kept.lower()}
    old = [i for i, c in enumerate(docs.columns) if c.lower() not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = _found(b.column(at).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in old], *found], [f.name for f in fields])

    kinds = [*[docs.schema.fields[i].dataType for i in old], T.LongType(), RUNS, T.StringType()]
    fields = [T.StructField(f"c{i}", t) for i, t in enumerate(kinds)]  # mapInArrow can't take names with dots
    out = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).mapInArrow(run, T.StructType(fields))
    return out.toDF(*[docs.columns[i] for i in old], words, runs, kept)


def highest(runs: Column) -> Column:
    """The run with the greatest length over period, compared as whole numbers; the first of those that tie."""
    none = F.lit(None).cast(RUNS.elementType)
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, none, lambda best, r: F.when(better(best, r), r).otherwise(best))


def planted(text: Column, id_: Column) -> Column:
    """The text with its last words made periodic if the crc32 of the id as text ends in 0 (a null id: left as it is)."""
    h = F.crc32(F.encode(id_.cast("string"), "UTF-8"))
    g = F.floor(h / 10)

    def written(w: Column) -> Column:
        a = g % F.size(w)
        p = 1 + F.floor((F.size(w) - a) / (3 + g % 8))
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.when(F.size(w) > 0, F.array_join(F.transform(w, lambda _, i: F.get(w, at(i).cast("int"))), " "))

    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    once = F.get(F.transform(F.array(words), written), 0)  # as a lambda's variable words are split once
    return F.when(h % 10 == 0, F.coalesce(once, text)).otherwise(text)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """op13: runs of all documents, of which a tenth have their last words made periodic first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    out = with_runs(docs).withColumn("best", highest(F.col("runs")))
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

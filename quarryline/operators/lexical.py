"""A BM25 index in impact order, written once, and searches of it that stop reading a term where it can't matter any more.

Documents are dealt over shards of about SHARD of them by a hash. An index has a row for each shard and term: the term's
documents in the shard by falling impact, so that any slice of them has its first impact as bound. A search meets each shard
with each block of queries. It reads slices in the order of their bounds until what is left could not lift a new document
to the k-th sum; then only documents that may still get there are looked up in the terms that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import terms
from .retrieval import top

K1, B = 1.5, 0.75
#: Documents of a shard and its postings, about, at least so many shards; postings of a slice; queries of a block; terms
#: pushed down to the scan, and sent to all tasks.
SHARD, POSTINGS, LEAST_SHARDS, SLICE, QUERIES, PUSHED, SENT = 1 << 14, 1 << 21, 8, 128, 1024, 100, 100_000
#: Sums in other orders differ by less.
SLACK = 1e-6


def titled(title: Column, text: Column) -> Column:
    """What is indexed of a document: its title twice, and its text."""
    return F.concat_ws(" ", title, title, text)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row_id, terms with repeats) to (row_id, dl, terms, tfs)."""
    for b in batches:
        each = b.column(1)
        lengths = pc.fill_null(pc.list_value_length(each), 0).to_numpy(zero_copy_only=False)
        told = each.flatten().dictionary_encode()
        size = max(1, len(told.dictionary))
        pairs, tf = np.unique(np.repeat(np.arange(len(b)), lengths) * size + told.indices.to_numpy(zero_copy_only=False), return_counts=True)
        ends = pa.array(np.searchsorted(pairs, np.arange(len(b) + 1) * size).astype(np.int32))
        names = told.dictionary.take(pa.array(pairs % size))
        out = [b.column(0), pa.array(lengths.astype(np.int32)), pa.ListArray.from_arrays(ends, names), pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32)))]
        yield pa.RecordBatch.from_arrays(out, ["row_id", "dl", "terms", "tfs"])


def _lists(docs: pa.Table, k1: float, b: float, avgdl: float) -> pa.Table:
    """The lists of one shard's documents (shard, row_id, dl, terms, tfs), by term, each by falling share, then by row_id."""
    shard, flat = docs["shard"][0], lambda c: docs[c].combine_chunks().flatten()
    of = np.repeat(np.arange(len(docs)), pc.list_value_length(docs["terms"]).to_numpy())
    tf, dl, ids = flat("tfs").to_numpy(), docs["dl"].to_numpy()[of], docs["row_id"].to_numpy()[of]
    share = tf / (tf + k1 * (1 - b + b * dl / avgdl))
    told = flat("terms").dictionary_encode()
    place = np.empty(len(told.dictionary), np.int64)
    place[pc.sort_indices(told.dictionary).to_numpy()] = np.arange(len(place))
    term = place[told.indices.to_numpy()]
    order = np.lexsort((ids, -share, term))
    first = np.flatnonzero(np.diff(term[order], prepend=-1))
    ends = pa.array(np.append(first, len(order)).astype(np.int32))
    names = told.dictionary.take(pc.sort_indices(told.dictionary))
    rows, shares = (pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (ids, share))
    return pa.table([pa.array([shard.as_py()] * len(names), pa.int32()), names, pa.array(np.diff(ends.to_numpy())), rows, shares], ["shard", "term", "n", "rows", "shares"])


def build(docs: DataFrame, id_col: str, text: Column, path: str, k1: float = K1, b: float = B) -> None:
    """Writes an index of documents with unique ids below path: terms (row_id, dl, terms, tfs of every document), lists (shard,
    term, n, rows, shares) and totals. A document without terms counts in the number of documents, but not in the mean length.

    Terms are counted where a text is cut, and a document is shuffled once, to its shard, whose lists a task makes."""
    spark = docs.sparkSession
    t = docs.select(F.col(id_col).cast("long").alias("row_id"), terms(text).alias("_t"))
    t.mapInArrow(_counted, "row_id long, dl int, terms array<string>, tfs array<int>").write.parquet(f"{path}/terms")  # texts are cut once
    t = spark.read.parquet(f"{path}/terms")
    n_docs, avgdl, postings = t.agg(F.count("*"), F.avg(F.when(F.col("dl") > 0, F.col("dl"))), F.coalesce(F.sum(F.size("tfs")), F.lit(0))).first()
    shards = max(LEAST_SHARDS, -(-n_docs // SHARD), -(-postings // POSTINGS))
    dealt = t.where("dl > 0").withColumn("shard", F.pmod(F.xxhash64("row_id"), F.lit(shards)).cast("int"))
    mean = float(avgdl or 1.0)
    lists = dealt.groupBy("shard").applyInArrow(lambda d: _lists(d, k1, b, mean), "shard int, term string, n int, rows array<long>, shares array<double>")
    lists.write.parquet(f"{path}/lists")
    spark.createDataFrame([(n_docs, avgdl, k1, b, shards)], "n_docs long, avgdl double, k1 double, b double, shards int").write.parquet(f"{path}/totals")


class Shard:
    """The lists of a shard, its documents numbered in the order of ids. idf: that of all documents by term; without it a
    shard is taken as all there is."""

    def __init__(self, lists: pd.DataFrame, idf: dict[str, float] | None = None) -> None:
        self.rows, numbers = np.unique(np.concatenate([np.asarray(x) for x in lists.rows]), return_inverse=True) if len(lists) else (np.zeros(0, np.int64), None)
        ends = np.cumsum([len(x) for x in lists.rows])
        self.lists = {}
        for term, shares, end in zip(lists.term, lists.shares, ends, strict=True):
            n = len(shares)
            weight = np.log(1 + (len(self.rows) - n + 0.5) / (n + 0.5)) if idf is None else idf[term]
            self.lists[term] = numbers[end - n : end], weight * np.asarray(shares)
        self.ordered: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.read = self.left = 0  # postings that were read, and those that were not

    def _by_number(self, term: str) -> tuple[np.ndarray, np.ndarray]:
        if term not in self.ordered:
            numbers, impacts = self.lists[term]
            order = np.argsort(numbers)
            self.ordered[term] = numbers[order], impacts[order]
        return self.ordered[term]

    def best(self, query: dict[str, float], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row ids, scores) of the k best documents, ties by smaller id; query: how often it has each term."""
        mine = {t: f for t, f in query.items() if t in self.lists}
        if not mine:
            return np.zeros(0, np.int64), np.zeros(0)
        slices = [(f * self.lists[t][1][i], t, i) for t, f in mine.items() for i in range(0, len(self.lists[t][0]), SLICE)]
        slices.sort(key=lambda s: (-s[0], s[1], s[2]))
        sums = np.zeros(len(self.rows))
        rest = {t: f * self.lists[t][1][0] for t, f in mine.items()}  # the most that a document may still get from a term
        upto = dict.fromkeys(mine, 0)
        bound, kth = sum(rest.values()), 0.0
        for n, (_, t, i) in enumerate(slices):
            if n % 16 == 0 and n and len(sums) > k:
                kth = np.partition(sums, len(sums) - k)[len(sums) - k]
                if bound < kth - SLACK:
                    break
            numbers, impacts = self.lists[t]
            sums[numbers[i : i + SLICE]] += mine[t] * impacts[i : i + SLICE]
            upto[t] = min(i + SLICE, len(numbers))
            now = mine[t] * impacts[upto[t]] if upto[t] < len(numbers) else 0.0
            bound += now - rest[t]
            rest[t] = now
        can = np.flatnonzero(sums + bound >= kth - SLACK) if bound else np.flatnonzero(sums)
        scores = sums[can]
        for t in sorted((t for t in mine if rest[t] > 0), key=lambda t: -rest[t]):  # those that are left, for what may get there
            numbers, impacts = self._by_number(t)
            at = np.minimum(np.searchsorted(numbers, can), len(numbers) - 1)
            # what its slices gave is in the sums; a document has one place in a term
            late = (numbers[at] == can) & (impacts[at] * mine[t] <= rest[t])
            late &= ~np.isin(can, self.lists[t][0][: upto[t]]) if upto[t] else True
            scores[late] += mine[t] * impacts[at[late]]
            bound -= rest[t]
            if len(scores) > k:
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                stay = scores + max(bound, 0.0) >= kth - SLACK
                can, scores = can[stay], scores[stay]
        self.read += sum(upto.values())
        self.left += sum(len(self.lists[t][0]) - upto[t] for t in mine)
        scores = np.round(scores, 6)
        order = np.lexsort((can, -scores))[:k]
        order = order[scores[order] > 0]
        return self.rows[can[order]], scores[order]


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, fill: bool = False) -> DataFrame:
    """query_id, row_id, score, rank: the k best documents of positive score for each query (query_id, term, qtf), as
    exact scoring of all postings gives them, ties by smaller row_id.

    fill: a query with fewer has the smallest rows that it didn't find, with a score of 0, up to k."""
    lists = spark.read.parquet(f"{path}/lists")
    known = spark.read.parquet(f"{path}/totals").first()
    shards = known.shards
    distinct = queries.select("term").distinct()
    mine = [r[0] for r in distinct.limit(PUSHED + 1).collect()]
    few = len(mine) <= PUSHED  # else the terms meet the lists in a join
    n = 1 if few else max(1, -(-queries.select("query_id").distinct().count() // QUERIES))
    sent = F.broadcast if few or distinct.count() * n <= SENT else lambda d: d  # so that lists that nobody asks for are not shuffled
    block = F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int").alias("block")
    lists = lists.where(F.col("term").isin(mine)) if few else lists
    df = lists.select("term", "n").join(sent(distinct), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log(1 + (known.n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = queries.join(df, "term").select("query_id", block, "term", F.col("qtf").cast("double").alias("qtf"), idf.alias("idf"))
    lists = lists.drop("n")
    lists = lists.withColumn("block", F.lit(0)) if few else lists.join(sent(queries.select("term", block).distinct()), "term")
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))  # each block of queries meets each shard

    def run(queries: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
        shard, out = Shard(lists, dict(zip(queries.term, queries.idf, strict=True))), []
        for query, q in queries.groupby("query_id", sort=False):
            rows, scores = shard.best(dict(zip(q.term, q.qtf, strict=True)), k)
            out.append(pd.DataFrame({"query_id": query, "row_id": rows, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "row_id": [], "score": []})

    kind = dict(queries.dtypes)["query_id"]
    each = asked.groupBy("shard", "block").cogroup(lists.groupBy("shard", "block")).applyInPandas(run, f"query_id {kind}, row_id long, score double")
    out = top(each, ["query_id"], [F.desc("score"), "row_id"], k)
    return filled(spark, path, queries, out, k) if fill else out


def filled(spark: SparkSession, path: str, queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """found, with rows of score 0 after them up to k for each query: 2 k of the smallest rows are enough to choose from."""
    least = spark.read.parquet(f"{path}/terms").select("row_id").orderBy("row_id").limit(2 * k)
    free = queries.select("query_id").distinct().crossJoin(F.broadcast(least)).join(found.select("query_id", "row_id"), ["query_id", "row_id"], "left_anti")
    zeros = free.withColumns({"score": F.lit(0.0), "_n": F.row_number().over(Window.partitionBy("query_id").orderBy("row_id"))})
    zeros = zeros.join(found.groupBy("query_id").agg(F.count("*").alias("_have")), "query_id", "left")
    zeros = zeros.withColumn("rank", (F.coalesce("_have", F.lit(0)) + F.col("_n")).cast("int"))
    return found.unionByName(zeros.where(F.col("rank") <= k).select("query_id", "row_id", "score", "rank"))

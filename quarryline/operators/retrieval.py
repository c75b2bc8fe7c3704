"""Retrieval operators: postings and BM25, exact vector search, fusion, blending, selection."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import terms


def postings(docs: DataFrame, id_col: str, text: Column) -> tuple[DataFrame, DataFrame]:
    """(postings: term, row_id, dl, tf; lengths: row_id, dl, of documents with a term). A document's length goes with its
    terms, so neither a shuffle of all postings nor a join is needed for it."""
    t = docs.select(F.col(id_col).alias("row_id"), terms(text).alias("_t"))
    each = t.select("row_id", F.size("_t").alias("dl"), F.explode("_t").alias("term"))
    return each.groupBy("term", "row_id", "dl").agg(F.count("*").alias("tf")), t.select("row_id", F.size("_t").alias("dl")).where("dl > 0")


def indexed(docs: DataFrame, id_col: str, text: Column, path: str) -> None:
    """Writes the postings (sorted by term within files of a range of terms, so that a query reads the row groups of its
    terms alone) and the lengths below path, once for any number of queries."""
    post, lengths = postings(docs, id_col, text)
    post.repartitionByRange("term", "row_id").sortWithinPartitions("term", "row_id").write.parquet(f"{path}/postings")
    lengths.write.parquet(f"{path}/lengths")


def bm25(queries: DataFrame, post: DataFrame, lengths: DataFrame, n_docs: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, row_id, score, rank: the k best documents of positive score for each query (query_id, term, qtf).

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)). The queries' terms, which are few, first cut the postings down; document
    frequencies are counted over what is left, so only matching postings are shuffled."""
    mine = queries.select("term").distinct()
    hit = post.join(mine, "term", "left_semi")
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    stats = n_docs.crossJoin(lengths.agg(F.avg("dl").alias("avgdl")))  # one row each
    w = hit.join(df, "term").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    w = w.select("term", "row_id", (idf * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).alias("w"))
    s = queries.join(w, "term").groupBy("query_id", "row_id").agg(F.round(F.sum(F.col("w") * F.col("qtf")), 6).alias("score"))
    return top(s, ["query_id"], [F.desc("score"), "row_id"], k)


def top(df: DataFrame, by: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """The first k of each group with their rank, 1-based. row_number() <= k lets Spark keep k a group before it shuffles."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


#: Rows of a block of the corpus, and of queries; queries whose scores with a block are held at once.
ROWS, QUERIES, SCORED = 1 << 14, 1 << 14, 128


def _rounded(x: np.ndarray, places: int) -> np.ndarray:
    """Halves go away from zero, as in SQL."""
    y = x * 10.0**places
    whole = np.trunc(y)
    return (whole + np.copysign(np.abs(y - whole) >= 0.5, y)) / 10.0**places


def best_rows(q: np.ndarray, v: np.ndarray, k: int, places: int | tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k best rows of v for each of a few queries, as numbers; ties to the smaller row number.
    Several places, from many to few, are rounded to one after another, which is not the same as to the last alone.

    One matrix product tells what may be among the k; the scores of that are summed in the order of the elements."""
    places = (places,) if isinstance(places, int) else places
    rough = q @ v.T
    rough[np.isnan(rough)] = np.inf
    slack = sum(10.0**-p for p in places) * 1.01 + 1e-13 * q.shape[1] * np.abs(rough[np.isfinite(rough)]).max(initial=1.0)
    kth = np.partition(rough, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k] if rough.shape[1] > k else np.full(len(q), -np.inf)
    at, row = np.nonzero(rough >= (kth - slack)[:, None])
    score = np.zeros(len(at))
    for j in range(q.shape[1]):
        score += q[at, j] * v[row, j]
    for p in places:
        score = _rounded(score, p)
    order = np.lexsort((row, -np.where(np.isnan(score), np.inf, score), at))
    at, row, score = at[order], row[order], score[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    return at[place < k], row[place < k], score[place < k]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) % len(column) or len(set(pc.list_value_length(column).to_pylist())) > 1:
        raise ValueError("vectors of several lengths")
    return flat.reshape(len(column), -1)


def dense_top(queries: DataFrame, corpus: DataFrame, k: int, per_block: int = ROWS, places: int | tuple[int, ...] = 6, within: str | None = None) -> DataFrame:
    """query_id, row_id, score, rank: exact inner products of a stated query set against all rows, in blocks; within: only
    rows that have the query's value of this column. Rows without a vector come last, with a score of null.

    The corpus is dealt over blocks of about per_block rows, at least 16, and each block meets each block of queries; it
    keeps its k best for each query before the last selection. Number of scores: rows times queries, by matrix products."""
    blocks = max(1 if within else 16, -(-corpus.count() // per_block))
    parts = max(1, -(-queries.count() // QUERIES))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys = ["_block", "_part", *([within] if within else [])]
    whole = lambda c: F.when(~F.exists(c, lambda x: x.isNull()), F.col(c))
    q = queries.select("query_id", whole("q").alias("q"), *keys[2:], deal("query_id", parts).alias("_part")).withColumn("_block", every(blocks))
    c = corpus.select("row_id", whole("v").alias("v"), *keys[2:], deal("row_id", blocks).alias("_block")).withColumn("_part", every(parts))

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row_id")
        out = []
        known, asked = rows.filter(pc.is_valid(rows["v"])), queries.filter(pc.is_valid(queries["q"]))
        none = rows.filter(pc.is_null(rows["v"]))["row_id"].combine_chunks()
        if len(known) and len(asked):
            x, v = _matrix(asked["q"]), _matrix(known["v"])
            for i in range(0, len(x), SCORED):
                at, row, score = best_rows(x[i : i + SCORED], v, k, places)
                out.append((asked["query_id"].take(pa.array(at + i)), known["row_id"].take(pa.array(row)), pa.array(score)))
        for ids, free in ((asked["query_id"], none), (queries.filter(pc.is_null(queries["q"]))["query_id"], rows["row_id"].combine_chunks())):
            first = free[:k]
            n, m = len(ids), len(first)
            if n and m:
                out.append((ids.take(pa.array(np.repeat(np.arange(n), m))), first.take(pa.array(np.tile(np.arange(m), n))), pa.nulls(n * m, pa.float64())))
        kinds = queries.schema.field("query_id").type, rows.schema.field("row_id").type, pa.float64()
        chunks = [[c for x in part for c in (x.chunks if isinstance(x, pa.ChunkedArray) else [x])] for part in zip(*out, strict=True)] or [[], [], []]
        return pa.table([pa.chunked_array(c, t) for c, t in zip(chunks, kinds, strict=True)], ["query_id", "row_id", "score"])

    schema = f"query_id {dict(queries.dtypes)['query_id']}, row_id {dict(corpus.dtypes)['row_id']}, score double"
    if within:
        q, c = q.where(F.col(within).isNotNull()), c.where(F.col(within).isNotNull())
    best = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(run, schema)
    return top(best, ["query_id"], [F.desc("score"), "row_id"], k)


def fused(runs: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion of runs (query_id, variant, lane, lane_order, weight, rank, row_id, score):
    query_id, row_id, rrf_score, best scores by lane, hits, rank. Ties go to what came first."""
    first = F.min(F.struct("variant", "lane_order", "rank"))
    hit = F.concat(F.col("lane"), F.lit(":q"), F.col("variant").cast("string"), F.lit("@"), F.col("rank").cast("string"))
    f = runs.groupBy("query_id", "row_id").agg(
        F.round(F.sum(F.col("weight") / (rrf_k + F.col("rank"))), 9).alias("rrf_score"), first.alias("_f"),
        F.max(F.when(F.col("lane") == "dense", F.col("score"))).alias("best_dense"), F.max(F.when(F.col("lane") == "bm25", F.col("score"))).alias("best_bm25"),
        F.array_join(F.array_sort(F.collect_set(hit)), ",").alias("hits"),
    )
    return top(f, ["query_id"], [F.desc("rrf_score"), "_f", "row_id"], k).drop("_f")


def min_max(c: Column, by: list[str], flat: float, eps: float = 1e-9) -> Column:
    """Min-max within a group; `flat` where all values are equal."""
    w = Window.partitionBy(*by)
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(high - low < eps, F.lit(flat)).otherwise((c - low) / (high - low))


def blended(df: DataFrame, rerank: str, rrf: str, bonus: Column, by: list[str]) -> DataFrame:
    return df.withColumn("final_score", F.round(0.72 * min_max(F.col(rerank), by, 0.5) + 0.28 * min_max(F.col(rrf), by, 0.5) + bonus, 6))


def capped_bonus(parts: list[tuple[Column, float]], most: float = 0.18) -> Column:
    """Sum of count times weight, at most `most`."""
    return F.least(F.lit(most), sum((c * F.lit(w) for c, w in parts), F.lit(0.0)))


def diverse(candidates: DataFrame, k: int, title_cap: int = 2) -> DataFrame:
    """Per query: one candidate for each requested facet (but general, compare and time) of a title below title_cap, then
    by rank with at most title_cap of a title, then any; in the order of the score. Candidates (query_id, row_id, title_key, facets, wanted, score) are at most some tens for a
    query, and each choice depends on those before, so it is a function of a query's group."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["score", "row_id"], ascending=[False, True]).reset_index(drop=True)
        taken: list[int] = []
        titles: dict = {}

        def take(i: int) -> None:
            taken.append(i)
            titles[f.title_key[i]] = titles.get(f.title_key[i], 0) + 1

        asked = [x for x in f.wanted[0] if x not in ("general", "compare", "time")] if len(f) else []
        for facet in asked:
            i = next((i for i in f.index if i not in taken and facet in list(f.facets[i]) and titles.get(f.title_key[i], 0) < title_cap), None)
            if i is not None and len(taken) < k:
                take(i)
        for cap in (title_cap, math.inf):
            for i in f.index:
                if len(taken) < k and i not in taken and titles.get(f.title_key[i], 0) < cap:
                    take(i)
        out = f.loc[sorted(taken, key=lambda i: (-f.score[i], f.row_id[i])), ["query_id", "row_id", "score"]]
        out["rank"] = range(1, len(out) + 1)
        return out

    return candidates.groupBy("query_id").applyInPandas(run, "query_id long, row_id long, score double, rank int")


def balanced(candidates: DataFrame, k: int, least: float = 0.24) -> DataFrame:
    """Per query: places kept for both sides of a comparison, min(2, max(1, k // 3)) each for candidates with a
    relevance of at least `least` to that side, then the best by score + 0.12 times the better relevance. Candidates
    (query_id, row_id, score, relevance_a, relevance_b) are some tens a query, and each choice depends on those before."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        chosen: dict[int, str] = {}
        for side in ("a", "b"):
            r = f"relevance_{side}"
            fit = f[(f[r] >= least) & ~f.row_id.isin(list(chosen))].sort_values([r, "score", "row_id"], ascending=[False, False, True])
            chosen |= dict.fromkeys(fit.row_id.head(min(2, max(1, k // 3))), side)
        f = f.assign(adjusted=f.score + 0.12 * f[["relevance_a", "relevance_b"]].max(axis=1))
        rest = f[~f.row_id.isin(list(chosen))].sort_values(["adjusted", "row_id"], ascending=[False, True])
        chosen |= dict.fromkeys(rest.row_id.head(max(0, k - len(chosen))), "")
        rows = [(f.query_id.iloc[0], row, i + 1, side) for i, (row, side) in enumerate(list(chosen.items())[:k])]
        return pd.DataFrame(rows, columns=["query_id", "row_id", "rank", "reserved_for"])

    return candidates.groupBy("query_id").applyInPandas(run, "query_id long, row_id long, rank int, reserved_for string")


def merged_roles(runs: DataFrame, k: int) -> DataFrame:
    """query_id, row_id, rrf_score, roles: the best max(6, 3 k) of each role's own fusion, one row for each document."""
    each = runs.groupBy("query_id", "role", "row_id").agg(F.round(F.sum(F.col("weight") / (60 + F.col("rank"))), 9).alias("rrf_score"))
    each = top(each, ["query_id", "role"], [F.desc("rrf_score"), "row_id"], max(6, 3 * k))
    return each.groupBy("query_id", "row_id").agg(F.max("rrf_score").alias("rrf_score"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


def attached_merge(whole: DataFrame, attached: DataFrame, k: int, about_attached: Column) -> DataFrame:
    """Contexts of the corpus and of attachments (query_id, row_id, rerank, previous): one row for each document, the
    corpus's winning, by 0.85 rerank + 0.15 previous, and 0.08 more for attachments where the question is about them."""
    both = whole.withColumn("attached", F.lit(False)).unionByName(attached.withColumn("attached", F.lit(True)))
    one = both.groupBy("query_id", "row_id").agg(F.min_by(F.struct("rerank", "previous"), "attached").alias("_s"), F.min("attached").alias("attached"))
    extra = F.when(about_attached & F.col("attached"), 0.08).otherwise(0.0)
    scored = one.withColumn("score", F.round(0.85 * F.col("_s.rerank") + 0.15 * F.col("_s.previous") + extra, 6)).drop("_s")
    return top(scored, ["query_id"], [F.desc("score"), "row_id"], k)


def overlap_at(a: DataFrame, b: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """query_id, and of the first n of two rankings (query_id, row_id, rank, score) for each n: overlap (share of n),
    jaccard; max_delta: the largest difference of scores of documents in both."""
    x = a.select("query_id", "row_id", F.col("rank").alias("ra"), F.col("score").alias("sa"))
    j = x.join(b.select("query_id", "row_id", F.col("rank").alias("rb"), F.col("score").alias("sb")), ["query_id", "row_id"], "full")
    out = []
    for n in sizes:
        in_a, in_b = F.coalesce(F.col("ra") <= n, F.lit(False)), F.coalesce(F.col("rb") <= n, F.lit(False))
        out.append(F.round(F.count_if(in_a & in_b) / float(n), 6).alias(f"overlap_{n}"))
        out.append(F.round(F.count_if(in_a & in_b) / F.greatest(F.lit(1), F.count_if(in_a | in_b)), 6).alias(f"jaccard_{n}"))
    return j.groupBy("query_id").agg(*out, F.round(F.max(F.abs(F.col("sa") - F.col("sb"))), 6).alias("max_delta"))

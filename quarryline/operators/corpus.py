"""Corpus operators: classification, dedup, audits, profiles, samples, chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of_each(df: DataFrame, key: list[str | Column], order: list) -> DataFrame:
    """The first row of each key in the given order; a partial aggregate would not keep all columns, so it is a window
    over the key, which a key's copies share."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest_of_each(df: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """Each key's values at its largest order, by map-side aggregation."""
    best = F.max_by(F.struct(*cols), order)
    return df.groupBy(key).agg(best.alias("_s")).select(key, "_s.*")


def classified(df: DataFrame, rules: list[tuple[str, Column, int]], keep: int, review: int) -> DataFrame:
    """Adds score (0 to 10), reasons (in rule order) and decision KEEP, REVIEW or DROP. rules: (name, predicate,
    points); a rule of None points decides DROP outright."""
    reasons = F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p, _ in rules]))
    points = sum((F.when(p, F.lit(w)).otherwise(0) for _, p, w in rules if w is not None), F.lit(0))
    veto = F.lit(False)
    for _, p, w in rules:
        if w is None:
            veto = veto | p
    score = F.greatest(F.lit(0), F.least(F.lit(10), points))
    decision = F.when(veto, "DROP").when(score >= keep, "KEEP").when(score >= review, "REVIEW").otherwise("DROP")
    return df.withColumn("score", score).withColumn("reasons", reasons).withColumn("decision", decision)


def lower_rank_profile(df: DataFrame, by: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """count, min, mean, max and the value at rank 1 + floor((n - 1) f), from a histogram of values."""
    hist = df.groupBy(*by, value).agg(F.count("*").alias("_c"))
    up = Window.partitionBy(*by).orderBy(value)
    ranked = hist.withColumn("_hi", F.sum("_c").over(up)).withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))
    at = lambda f: F.min(F.when(F.col("_hi") >= 1 + F.floor((F.col("_n") - 1) * f), F.col(value)))
    return ranked.groupBy(*by).agg(
        F.sum("_c").alias("n"), F.min(value).alias("least"), F.round(F.sum(F.col(value) * F.col("_c")) / F.sum("_c"), 2).alias("mean"),
        *[at(f).alias(k) for k, f in fractions.items()], F.max(value).alias("most"),
    )


def hash_ranked(df: DataFrame, seed: str, group: str, id_col: str, n: int) -> DataFrame:
    """n rows of each group with the smallest SHA-256 of seed:group:id (hex order); ties: the larger id."""
    rank = F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col(group), F.col(id_col).cast("string")), 256), 1, 16)
    w = Window.partitionBy(group).orderBy("hash_rank", F.desc(id_col))
    return df.withColumn("hash_rank", rank).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def word_chunks(df: DataFrame, id_col: str, text: Column, words: int = 220, overlap: int = 40) -> DataFrame:
    """id, chunk_index, chunk_text: windows of `words` words, each `overlap` words into the one before."""
    step = words - overlap
    w = df.select(id_col, F.filter(F.split(text, "\\s+"), lambda x: x != "").alias("_w")).where(F.size("_w") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("_w") - words) / step)).cast("int")
    return w.select(id_col, "_w", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index")).select(
        id_col, "chunk_index", F.array_join(F.slice("_w", F.col("chunk_index") * step + 1, F.lit(words)), " ").alias("chunk_text")
    )


def budget_chunks(df: DataFrame, id_col: str, text_col: str, budget: int = 384, overlap: int = 48) -> DataFrame:
    """id, chunk_index, chunk_text, token_count: sentences packed into chunks of at most `budget` words, each beginning
    with the last sentences of the one before that fit in `overlap`; sentences over the budget are cut by words. Packing
    is sequential within a document, so it runs in Arrow batches of documents."""
    import re

    sentence = re.compile(r"(?<=[.!?])\s+(?=\S)")

    def pieces(text: str) -> list[tuple[str, int]]:
        out = []
        for p in re.split(r"\n\s*\n", text):
            for s in sentence.split(p.strip()):
                w = s.split()
                out.extend((" ".join(w[i : i + budget]), len(w[i : i + budget])) for i in range(0, len(w), budget))
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc, text in zip(f[id_col], f["_t"], strict=True):
                held: list[tuple[str, int]] = []
                size = index = fresh = 0
                for piece, n in pieces(text or ""):
                    if held and size + n > budget:
                        rows.append((doc, index, " ".join(x for x, _ in held), size))
                        index += 1
                        tail: list[tuple[str, int]] = []
                        while held and sum(k for _, k in tail) + held[-1][1] <= min(overlap, budget - n):
                            tail.insert(0, held.pop())
                        held, size, fresh = tail, sum(k for _, k in tail), 0
                    held.append((piece, n))
                    size += n
                    fresh += 1
                if fresh:
                    rows.append((doc, index, " ".join(x for x, _ in held), size))
            yield pd.DataFrame(rows, columns=[id_col, "chunk_index", "chunk_text", "token_count"])

    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("_t")).mapInPandas(run, f"{id_col} long, chunk_index int, chunk_text string, token_count int")


def neighbours(chunks: DataFrame, id_col: str, radius: int) -> DataFrame:
    """Pairs of chunks of one document at most `radius` apart: an equality on the exploded neighbour index, so that it
    is a plain equi-join."""
    a = chunks.select(id_col, F.col("chunk_index").alias("anchor"), F.explode(F.sequence(F.col("chunk_index") - radius, F.col("chunk_index") + radius)).alias("chunk_index"))
    return a.join(chunks, [id_col, "chunk_index"]).where("anchor <> chunk_index")

"""An inverted file of vectors: centres learnt in Spark, every row in the list of its nearest centre, and searches by lists.

A list knows its radius, so the inner product of a query with any of its rows is at most that with the centre and the query's
length times the radius. With that bound a search tells which of the lists it didn't probe may hold something better; they
are searched as well if the result has to be exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import SCORED, best_rows, top

#: Rows that centres are learnt from, in the order of a hash; rounds; rows of a list that meet queries in one task; most lists.
SAMPLE, ROUNDS, ROWS, MOST_LISTS = 100_000, 8, 1 << 15, 4096
SLACK = 1e-9


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, the first of those that tie."""
    return np.argmin((centres**2).sum(1)[None, :] - 2 * x @ centres.T, axis=1)


def centres_of(rows: DataFrame, lists: int, rounds: int = ROUNDS, sample: int = SAMPLE) -> np.ndarray:
    """Centres of rows (row_id, v) by rounds of k-means: tasks send sums of their rows by centre, at most `lists` of them.

    A sample of about `sample` rows at most is learnt from, chosen by a hash of the id; it starts with the vectors of its
    smallest hashes. A centre that loses all rows stays where it is."""
    if not 1 <= lists <= MOST_LISTS:
        raise ValueError(f"1 to {MOST_LISTS} lists")
    h = F.xxhash64(F.lit(17), "row_id")
    n = rows.count()
    part = rows.withColumn("_h", h)
    if n > sample:
        part = part.where(F.pmod(F.col("_h"), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    first = part.orderBy("_h", "row_id").limit(lists).collect()  # bounded by the number of lists
    centres = _matrix(pd.Series([r.v for r in first]))
    for _ in range(rounds if len(centres) else 0):

        def sums(batches: Iterator[pd.DataFrame], centres: np.ndarray = centres) -> Iterator[pd.DataFrame]:
            total, count = np.zeros_like(centres), np.zeros(len(centres), np.int64)
            for b in batches:
                x = _matrix(b.v)
                if len(x):
                    at = _nearest(x, centres)
                    np.add.at(total, at, x)
                    count += np.bincount(at, minlength=len(centres))
            met = np.flatnonzero(count)
            yield pd.DataFrame({"c": met, "n": count[met], "v": pd.Series(total[met].tolist(), dtype=object)})

        parts = part.select("v").mapInPandas(sums, "c long, n long, v array<double>")
        new = parts.groupBy("c").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("v", i)) for i in range(centres.shape[1])]).alias("v"))
        moved = centres.copy()
        for r in new.collect():  # a row for each centre
            moved[r.c] = np.asarray(r.v) / r.n
        if np.allclose(moved, centres, atol=1e-12):
            break
        centres = moved
    return centres


def build(rows: DataFrame, path: str, lists: int, rounds: int = ROUNDS, sample: int = SAMPLE) -> None:
    """Writes an index of rows (row_id, v), all of the same length, below path: members (list, part, row_id, v) and lists
    (list, n, parts, radius, centre). Rows without a vector are in no list. A list of more rows than a task should hold
    has several parts."""
    spark = rows.sparkSession
    rows = rows.where("v is not null").select("row_id", F.col("v").cast("array<double>").alias("v"))
    centres = centres_of(rows, lists, rounds, sample)
    shared = spark.sparkContext.broadcast(centres)  # MOST_LISTS vectors at most

    @F.pandas_udf("list int, far double")
    def nearest(v: pd.Series) -> pd.DataFrame:
        x, c = _matrix(v), shared.value
        at = _nearest(x, c) if len(x) else np.zeros(0, np.int64)
        return pd.DataFrame({"list": at.astype(np.int32), "far": np.sqrt(((x - c[at]) ** 2).sum(1)) if len(x) else np.zeros(0)})

    rows.withColumn("_n", nearest("v")).select("_n.list", "_n.far", "row_id", "v").write.parquet(f"{path}/assigned")
    found = spark.read.parquet(f"{path}/assigned")
    stats = found.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()  # a row for each list
    known = [(r.list, r.n, -(-r.n // ROWS), r.radius, [float(x) for x in centres[r.list]]) for r in stats]
    table = spark.createDataFrame(known, "list int, n long, parts int, radius double, centre array<double>")
    table.write.parquet(f"{path}/lists")
    parts = found.join(F.broadcast(table.select("list", "parts")), "list").withColumn("part", F.pmod(F.xxhash64("row_id"), F.col("parts")).cast("int"))
    parts.select("list", "part", "row_id", "v").repartition("list", "part").sortWithinPartitions("list", "part").write.parquet(f"{path}/members")


def _ranked_lists(queries: DataFrame, path: str) -> DataFrame:
    """query_id, q, and for each list its place by the inner product with the centre, its parts, and the most that one of
    its rows can have."""
    known = queries.sparkSession.read.parquet(f"{path}/lists").orderBy("list").collect()  # MOST_LISTS rows at most
    centres, radius = _matrix(pd.Series([r.centre for r in known])), np.array([r.radius for r in known])
    ids, parts = np.array([r.list for r in known], np.int32), np.array([r.parts for r in known], np.int32)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), SCORED):  # each query comes out once for each list
                b = batch.slice(i, SCORED)
                q = np.stack([np.asarray(v, np.float64) for v in b.column("q").to_pylist()])
                dots = q @ centres.T
                order = np.argsort(-dots, axis=1, kind="stable")
                bound = np.take_along_axis(dots + np.sqrt((q * q).sum(1))[:, None] * radius + SLACK, order, 1)
                again = pa.array(np.repeat(np.arange(len(b)), len(ids)))
                place = np.tile(np.arange(len(ids), dtype=np.int32), len(b))
                told = [ids[order].ravel(), place, parts[order].ravel(), bound.ravel()]
                yield pa.RecordBatch.from_arrays([b.column("query_id").take(again), b.column("q").take(again), *map(pa.array, told)], ["query_id", "q", "list", "place", "parts", "bound"])

    if not known:
        return queries.where("false").selectExpr("query_id", "q", "0 as list", "0 as place", "1 as parts", "0d as bound")
    kinds = dict(queries.dtypes)
    return queries.select("query_id", "q").mapInArrow(placed, f"query_id {kinds['query_id']}, q {kinds['q']}, list int, place int, parts int, bound double")


def _searched(pairs: DataFrame, path: str, k: int, places: int) -> DataFrame:
    """The k best rows of each pair's list for its query (query_id, row_id, score), by parts of lists."""
    members = pairs.sparkSession.read.parquet(f"{path}/members")
    asked = pairs.select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "query_id", "q")

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": [], "row_id": [], "score": []})
        rows = rows.sort_values("row_id")
        v, ids, asked, out = _matrix(rows.v), rows.row_id.to_numpy(), queries.query_id.to_numpy(), []
        for i in range(0, len(queries), SCORED):
            at, row, score = best_rows(_matrix(queries.q.iloc[i : i + SCORED]), v, k, places)
            out.append(pd.DataFrame({"query_id": asked[at + i], "row_id": ids[row], "score": score}))
        return pd.concat(out)

    kinds = dict(pairs.dtypes)
    schema = f"query_id {kinds['query_id']}, row_id {dict(members.dtypes)['row_id']}, score double"
    return asked.groupBy("list", "part").cogroup(members.groupBy("list", "part")).applyInPandas(run, schema)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int, exact: bool = False, places: int = 6) -> DataFrame:
    """query_id, row_id, score, rank: the k best rows by inner product, scores rounded, ties by smaller row_id, for queries
    (query_id, q) in the `probes` lists nearest to each. exact: lists that may hold a better row are searched too, so
    that the result is that of a search of all rows."""
    lists = _ranked_lists(queries, path)
    near = _searched(lists.where(F.col("place") < probes), path, k, places)
    if exact:
        best = top(near, ["query_id"], [F.desc("score"), "row_id"], k)
        kth = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
        may = lists.where(F.col("place") >= probes).join(kth, "query_id", "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth") - 10.0**-places))
        near = best.drop("rank").unionByName(_searched(may.drop("kth"), path, k, places))
    return top(near, ["query_id"], [F.desc("score"), "row_id"], k)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """query_id, common, recall: the share of the true rows (query_id, row_id) that were found."""
    hit = truth.select("query_id", "row_id").join(found.select("query_id", "row_id", F.lit(1).alias("_f")), ["query_id", "row_id"], "left")
    return hit.groupBy("query_id").agg(F.count("_f").alias("common"), F.round(F.count("_f") / F.count("*"), 6).alias("recall"))

"""Indexes against searches of everything: BM25 lists in impact order, inverted files of vectors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.operators import lexical as L
from quarryline.operators import retrieval as R
from quarryline.operators import vectors as V
from quarryline.operators import rules as U
from quarryline.plans import catalogue, indexes


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    pick = lambda: words[min(int(r.paretovariate(0.5)) - 1, 399)]
    rows = [(i * 3 + 1, " ".join(pick() for _ in range(r.choice([0, 1, 5, 30, 200])))) for i in range(600)]
    rows += [(5000 + i, "w0 w1 w2 same words") for i in range(40)] + [(6000, None), (6001, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.fixture(scope="module")
def queries(spark):
    r = random.Random(4)
    rows = [(q, f"w{min(int(r.paretovariate(0.3)) - 1, 399)}", r.randint(1, 3)) for q in range(30) for _ in range(r.choice([1, 3, 12]))]
    rows += [(90, "w0", 1), (90, "w1", 1), (91, "nowhere", 1), (92, "same", 2)]
    return spark.createDataFrame(rows, "query_id long, term string, qtf long").groupBy("query_id", "term").agg(F.max("qtf").alias("qtf"))


@pytest.fixture(scope="module")
def index(docs, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('index')}/bm25"
    L.build(docs, "doc_id", F.col("text"), path)
    return path


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.row_id, round(r.score, 5)) for r in df.collect())


@pytest.mark.parametrize(("k", "pushed"), [(1, 100), (7, 100), (50, 0), (2000, 100)])
def test_index_finds_what_all_postings_give(spark, docs, queries, index, k, pushed, monkeypatch):
    monkeypatch.setattr(L, "PUSHED", pushed)
    monkeypatch.setattr(L, "QUERIES", 10)
    monkeypatch.setattr(L, "SLICE", 16)
    exact = R.bm25(queries, *R.postings(docs, "doc_id", F.col("text")), docs.agg(F.count("*").alias("n_docs")), k)
    assert rows_of(L.search(spark, index, queries, k)) == rows_of(exact)


def test_index_leaves_postings_unread(spark, index, monkeypatch):
    monkeypatch.setattr(L, "SLICE", 8)
    shard = L.Shard(spark.read.parquet(f"{index}/lists").where("shard = 0").toPandas())
    common = {t: 1.0 for t in sorted(shard.lists, key=lambda t: -len(shard.lists[t][0]))[:12]}
    rare = dict.fromkeys([t for t in shard.lists if len(shard.lists[t][0]) == 1][:2], 3.0)
    rows, scores = shard.best(common | rare, 1)
    assert shard.left > 100 and shard.read > 0
    whole = np.zeros(len(shard.rows))
    for t, f in (common | rare).items():
        np.add.at(whole, shard.lists[t][0], f * shard.lists[t][1])
    assert round(float(whole.max()), 6) == scores[0] and shard.rows[np.argmax(np.round(whole, 6))] == rows[0]


def test_index_fills_with_zero_scores(spark, docs, queries, index):
    got = L.search(spark, index, queries, 60, fill=True).toPandas()
    assert set(got.query_id) == {r.query_id for r in queries.select("query_id").distinct().collect()}
    for q, g in got.groupby("query_id"):
        assert sorted(g["rank"]) == list(range(1, 61)) and g.row_id.is_unique, q
    nowhere = got[got.query_id == 91].sort_values("rank")
    assert list(nowhere.row_id) == sorted(r.doc_id for r in docs.collect())[:60] and (nowhere.score == 0).all()


def test_empty_index(spark, queries, tmp_path):
    L.build(spark.createDataFrame([], "doc_id long, text string"), "doc_id", F.col("text"), f"{tmp_path}/i")
    assert L.search(spark, f"{tmp_path}/i", queries, 5).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(300, 8)), np.repeat(r.normal(size=(1, 8)), 150, 0), np.zeros((3, 8))])
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "row_id long, v array<double>").repartition(3)


@pytest.mark.parametrize("lists", [1, 7, 40])
def test_vectors_exact(spark, vectors, lists, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "ROWS", 32)  # the list of the copies has several parts
    V.build(vectors.unionByName(spark.createDataFrame([(9999, None)], "row_id long, v array<double>")), f"{tmp_path}/i", lists)
    q = vectors.where("row_id % 30 = 0").select(F.col("row_id").alias("query_id"), F.col("v").alias("q"))
    for k in (1, 10, 600):
        assert rows_of(V.search(spark, f"{tmp_path}/i", q, k, 1, exact=True)) == rows_of(R.dense_top(q, vectors, k))
    members = spark.read.parquet(f"{tmp_path}/i/members")
    assert members.count() == vectors.count()  # every row is in a list


def test_vectors_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = indexes.QUERIES["ann_recall"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.lists for r in got) == [32, 64] and all(r.recall >= 0.9 for r in got), got
    assert all(r.queries == e.where("vec_id % 20 = 0").count() for r in got)


def test_no_vectors(spark, vectors, tmp_path):
    V.build(vectors.limit(0), f"{tmp_path}/i", 4)
    q = vectors.limit(2).select(F.col("row_id").alias("query_id"), F.col("v").alias("q"))
    assert V.search(spark, f"{tmp_path}/i", q, 3, 2, exact=True).count() == 0


def test_term_rules(spark):
    terms = spark.createDataFrame([("war", "civil war"), ("war", "Battle"), ("war", None), ("place", "city"), (None, "x"), ("place", "..")], "family string, term string")
    rows = [(1, "The Civil War, a battle"), (2, "civil, war"), (3, "civil  war"), (4, None), (5, ""), (6, "cityscape"), (7, "City! battle civil war civil war")]
    got = U.with_term_hits(spark.createDataFrame(rows, "id long, text string"), {"t": F.col("text")}, terms)
    assert {r.id: r.features for r in got.collect()} == {1: {"t.war": 2}, 2: {}, 3: {}, 4: {}, 5: {}, 6: {}, 7: {"t.war": 2, "t.place": 1}}
    rules = [U.Rule("DROP", "empty", some={"empty": 1}), U.Rule("KEEP", "", needs={"t.war": 2}, bars={"t.place": 1}), U.Rule("REVIEW", "both", needs={"t.war": 1}, some={"t.place": 1, "t.none": 1})]
    out = U.decided(got, rules, ("DROP", "nothing"), [("t.war", 2, 7), ("t.war", 1, 6), ("t.place", 1, -2)], [("war", "t.war", 1)], {"empty": F.length("text") == 0})
    assert {r.id: (r.decision, r.score, r.reasons) for r in out.collect()} == {
        1: ("KEEP", 10, ["war"]), 2: ("DROP", 0, ["nothing"]), 3: ("DROP", 0, ["nothing"]), 4: ("DROP", 0, ["nothing"]), 5: ("DROP", 0, ["empty"]), 6: ("DROP", 0, ["nothing"]), 7: ("REVIEW", 10, ["war", "both"]),
    }
    assert U.with_term_hits(got.drop("features"), {"t": F.col("text")}, terms.limit(0)).where("size(features) > 0").count() == 0


@pytest.mark.parametrize(("places", "within"), [(6, None), (1, None), (6, "label")])
def test_dense_top_against_every_product(spark, places, within, monkeypatch):
    """In several blocks of rows and of queries, with ties, rows and queries without a vector, and values that are no numbers."""
    monkeypatch.setattr(R, "QUERIES", 7)
    monkeypatch.setattr(R, "SCORED", 2)
    r = random.Random(8)
    rows = [(i, [r.choice([-1.0, 0.0, 0.5, r.random()]) for _ in range(5)], i % 3) for i in range(300)]
    rows += [(1000 + i, rows[3][1], 0) for i in range(60)] + [(500, None, 0), (501, [float("nan")] * 5, 1), (502, [1.0, None, 0.0, 0.0, 0.0], 2), (503, [1.0] * 5, None)]
    e = spark.createDataFrame(rows, "row_id long, v array<float>, label int")
    q = e.where("row_id % 20 = 0").select(F.col("row_id").alias("query_id"), F.col("v").alias("q"), F.col("label"))
    got = R.dense_top(q, e, 6, 40, places, within).collect()
    j = q.withColumnRenamed("label", "ql").join(e, F.lit(True) if within is None else F.col("ql") == F.col("label"))
    want = R.top(j.select("query_id", "row_id", F.round(X.dot(F.col("q"), F.col("v")), places).alias("score")), ["query_id"], [F.desc("score"), "row_id"], 6).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and any(x.score is None for x in got) and any(x.score != x.score for x in got if x.score is not None)


def test_only_paired_vectors_are_searched_for(spark, monkeypatch):
    """A few benchmark items stand for a few vectors, however many there are."""
    seen = []
    monkeypatch.setattr(R, "dense_top", lambda q, c, k, **kw: seen.append(q.count()) or q.select("query_id", F.lit(1).alias("rank"), F.lit(1).alias("row_id"), F.lit(0.0).alias("score")))
    items = spark.createDataFrame([(i, "x") for i in range(3)], "item_id long, text string")
    vectors = spark.createDataFrame([(i, [1.0]) for i in range(400)], "vec_id long, embedding array<float>")
    assert catalogue._paired(lambda n: items if n == "benchmark" else vectors).count() == 3 and seen == [3]


def test_lists_meet_few_queries_at_a_time(spark, vectors, tmp_path, monkeypatch):
    """A task holds the scores of SCORED queries with a part of a list, not those of all queries."""
    V.build(vectors, f"{tmp_path}/i", 3)
    rows = V._matrix(vectors.toPandas().v)
    monkeypatch.setattr(V, "SCORED", 2)
    pairs = V._ranked_lists(vectors.limit(5).select(F.col("row_id").alias("query_id"), F.col("v").alias("q")), f"{tmp_path}/i").collect()
    assert len(pairs) == 15 and {p.place for p in pairs} == {0, 1, 2}
    at, row, score = R.best_rows(rows[:5], rows, 4, 6)
    want = np.round(rows[:5] @ rows.T, 6)
    assert all(np.allclose(sorted(score[at == i]), np.sort(want[i])[-4:]) for i in range(5))


def test_scores_are_rounded_to_one_number_of_places_after_another(spark, tmp_path):
    """backend_overlap's coarse scores are those of six decimals: 1.2349996 is 1.235 and then 1.24, as 1.236 is, not 1.23."""
    import duckdb

    import __spark_entry__ as entry

    score = {0: 2.0, 11: 1.2349996, 12: 1.236}
    rows = [(i, [1.0, score.get(i, 5.0 if i < 9 else 0.0) - 1], 0) for i in range(20)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(entry.oracle_sql()["backend_overlap"]).fetchall()
    assert sorted(map(tuple, entry.queries()["backend_overlap"](spark, str(tmp_path)).collect())) == sorted(want) and want[0][1] == 0.9

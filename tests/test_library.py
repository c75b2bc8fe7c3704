"""Hand-made cases of the library's operators."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quarryline.functions import text as X
from quarryline.operators import analytics as A
from quarryline.operators import corpus as C
from quarryline.operators import evaluation as E
from quarryline.operators import retrieval as R
from quarryline.sources import files as S
from quarryline.streaming import telemetry as T


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first()["r"]


def test_text_functions(spark):
    assert one(spark, X.match_norm, "  Đường É-ß, 12\n") == "duong e 12"
    assert one(spark, X.clean_text, None) == "" and one(spark, X.clean_text, " a \t b\r\n\n\n\nc ") == "a b\n\nc"
    assert one(spark, X.years, "in 1945, 1789 and 1945; not 21000") == [1789, 1945]
    assert one(spark, X.without_hidden_markup, "a<think>x\ny</think>b") == "ab"
    assert one(spark, X.html_text, "<head><title>t</title></head><p>a &amp;lt; b<script>'</p>'</script>") == "a &lt; b"
    assert one(spark, X.safe_filename, "../x/a  b\x01.pdf") == "a b.pdf"


def test_ranked_metrics(spark):
    ranked = spark.createDataFrame([(1, 1, 7), (1, 2, 8), (1, 3, 9), (2, 1, 7), (3, 1, 7)], "query_id long, rank int, item long")
    gold = spark.createDataFrame([(1, [8, 9]), (2, []), (3, None)], "query_id long, items array<long>")
    m = {r.query_id: r for r in E.ranked_metrics(ranked, gold, 3).collect()}
    assert abs(m[1].ndcg - (1 / math.log2(3) + 1 / 2) / (1 + 1 / math.log2(3))) < 1e-5
    assert (m[1].hit, m[1].recall, m[1].mrr) == (1, 1, 0.5)
    assert (m[2].hit, m[2].precision, m[2].recall, m[2].mrr, m[2].ndcg) == (0, 0, None, None, None)
    assert (m[3].hit, m[3].precision, m[3].recall) == (None, None, None)


def test_token_overlap_and_rouge(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["a", "b", "c"]), (2, [], []), (3, ["a"], []), (4, ["a"], None)], "id long, p array<string>, g array<string>")
    got = {r.id: r for r in E.token_overlap(df, "id", F.col("p"), F.col("g")).collect()}
    assert (got[1].precision, got[1].recall, got[1].f1) == (1, 0.666667, 0.8)
    assert (got[2].f1, got[3].f1, got[4].f1) == (1, 0, None)
    r = random.Random(1)
    pairs = [([r.choice("abc") for _ in range(r.randrange(9))], [r.choice("abc") for _ in range(r.randrange(9))]) for _ in range(30)]

    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    df = spark.createDataFrame(pairs, "a array<string>, b array<string>").select("a", "b", E.rouge_l(F.col("a"), F.col("b")).alias("r"))
    for x in df.collect():
        assert abs(x.r - (2 * lcs(x.a, x.b) / (len(x.a) + len(x.b)) if x.a or x.b else 1)) < 1e-9


def test_min_max_and_fusion(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, 1.0), (2, 3.0)], "q long, s double").withColumn("m", R.min_max(F.col("s"), ["q"], 0.5))
    assert sorted(r.m for r in df.collect()) == [0, 0.5, 0.5, 1]
    runs = spark.createDataFrame([(1, 0, "dense", 0, 1.0, 1, 9, 0.5), (1, 0, "bm25", 1, 1.0, 3, 9, 7.0), (1, 0, "bm25", 1, 1.0, 1, 4, 8.0)], "query_id long, variant int, lane string, lane_order int, weight double, rank int, row_id long, score double")
    got = {r.row_id: r for r in R.fused(runs, 10).collect()}
    assert got[9].rrf_score == round(1 / 61 + 1 / 63, 9) and got[9].rank == 1 and got[9].hits == "bm25:q0@3,dense:q0@1"


def test_diverse_selection(spark):
    rows = [(1, i, "t" if i < 5 else f"u{i}", ["f2"] if i == 7 else ["f1"], ["f1", "f2"], 1.0 - i / 10) for i in range(9)]
    df = spark.createDataFrame(rows, "query_id long, row_id long, title_key string, facets array<string>, wanted array<string>, score double")
    assert [r.row_id for r in R.diverse(df, 5).orderBy("rank").collect()] == [0, 1, 5, 6, 7]


def test_citations(spark):
    df = spark.createDataFrame([(1, "a [x, y; z] b [1945] [ x ]")], "id long, t string")
    assert [r.target for r in E.citations(df, "id", F.col("t")).orderBy("pos").collect()] == ["x", "y", "z", "x"]


def test_budget_chunks(spark):
    r = random.Random(1)
    text = " ".join(" ".join(["w"] * r.randint(1, 30)) + "." for _ in range(60)) + " " + "long " * 900
    got = C.budget_chunks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string"), "doc_id", "text").collect()
    assert {x.doc_id for x in got} == {1} and [x.chunk_index for x in got] == list(range(len(got)))
    assert all(x.token_count == len(x.chunk_text.split()) <= 384 for x in got)
    assert sum(x.token_count for x in got) >= len(text.split())


def test_quotas_and_pairs(spark):
    df = spark.createDataFrame([("a", 22), ("b", 22), ("c", 21)], "k string, w long")
    assert {r.k: r.quota for r in A.largest_remainder(df, "k", "w", 10).collect()} == {"a": 4, "b": 3, "c": 3}
    cells = spark.createDataFrame([(1, "x", 1.0), (1, "y", 2.0), (2, "x", 1.0), (2, "y", 1.0), (3, "x", 5.0)], "q long, e string, m double")
    r = A.win_tie_loss(cells, "q", "e", "m").first()
    assert (r.wins, r.ties, r.losses, r.mean_delta) == (1, 1, 0, 0.5)


def test_classifier_takes_the_veto_first(spark):
    df = spark.createDataFrame([("good text",), ("bad",)], "text string")
    got = C.classified(df, [("short", F.length("text") < 5, None), ("good", F.col("text").contains("good"), 20)], 6, 3).collect()
    assert [(r.score, r.reasons, r.decision) for r in got] == [(10, ["good"], "KEEP"), (0, ["short"], "DROP")]


def test_files(spark, tmp_path):
    schema = StructType([StructField("id", LongType()), StructField("t", StringType())])
    (tmp_path / "x.jsonl").write_text('{"id": 1, "t": "a"}\n\n{"id": 2, "t": "b"}\n')
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n{oops\n')
    assert S.jsonl_blank_tolerant(spark, f"{tmp_path}/x.jsonl", schema).count() == 2
    good, bad = S.jsonl_counting(spark, f"{tmp_path}/bad.jsonl", schema)
    assert (good.count(), bad.count()) == (1, 1)
    with pytest.raises(Exception):  # noqa: B017
        S.jsonl_strict(spark, f"{tmp_path}/bad.jsonl", schema).collect()
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], schema)
    S.write_sharded(df, f"{tmp_path}/s", ["t"])
    assert S.read_sharded(spark, f"{tmp_path}/s", schema).count() == 3
    S.write_frozen(df, f"{tmp_path}/f", schema)
    S.write_frozen(df, f"{tmp_path}/f", schema)
    with pytest.raises(ValueError):
        S.write_frozen(df.limit(1), f"{tmp_path}/f", schema)
    assert S.resolve_fields(["Body", "ID"], {"text": ["text", "body"], "id": ["id"]}) == {"text": "Body", "id": "ID"}


def test_stream_equals_batch(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, at + dt.timedelta(seconds=37 * i), "ab"[i % 2], float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, k string, v double")
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    batch = T.windowed_stream(df, "ts", "k", "v")
    stream = T.windowed_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "ts", "k", "v")
    T.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination(120)
    got = set(map(tuple, spark.read.schema(batch.schema).parquet(f"{tmp_path}/out").collect()))
    want = set(map(tuple, batch.collect()))
    assert got <= want and len(want) - len(got) <= 6  # windows that the watermark has not closed stay open
    T.totals_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), ["k"], f"{tmp_path}/tot", f"{tmp_path}/c2").awaitTermination(120)
    assert {r.k: r["count"] for r in spark.read.parquet(f"{tmp_path}/tot").collect()} == {"a": 100, "b": 100}

"""Hand-made cases of question planning, balanced selection, answers' scores, comparisons and streams."""

import pytest
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.operators import analytics as A
from quarryline.operators import curation as U
from quarryline.operators import evaluation as E
from quarryline.operators import questions as Q
from quarryline.operators import retrieval as R
from quarryline.streaming import telemetry as T


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first()["r"]


def test_facets_and_variants(spark):
    assert one(spark, Q.facets, "Phe nào thắng trận đó, và vì sao?") == ["winner", "cause", "outcome"]
    assert one(spark, Q.facets, None) == ["general"] and one(spark, Q.facets, "x") == ["general"]
    v = one(spark, lambda c: Q.variants(c, Q.facets(c)), " Nguyên nhân,  kết quả và ý nghĩa ")
    assert v == ["Nguyên nhân, kết quả và ý nghĩa"] + [f"Nguyên nhân, kết quả và ý nghĩa {Q.FACETS[f][1]}" for f in ("cause", "outcome")]


@pytest.mark.parametrize(
    "question, targets",
    [
        ("So sánh trận A và trận B", ["trận A", "trận B"]), ("Hãy so sánh A với B như thế nào?", ["A", "B"]), ("A, B, C; D khác nhau ra sao?", ["A", "B"]),
        ("A và B giống nhau như thế nào", ["A", "B"]), ("so sánh A", []), ("A và B", []), ("", []), ("So sánh ?!", []),
    ],
)
def test_comparison_targets(spark, question, targets):
    assert one(spark, Q.comparison_targets, question) == targets


def test_comparison_plan(spark):
    df = spark.createDataFrame([(1, "So sánh A và B"), (2, "Vì sao?"), (3, "So sánh nguyên nhân, kết quả")], "id long, q string")
    got = [tuple(r) for r in Q.comparison_plan(df, "id", F.col("q")).orderBy("id", "role").collect()]
    assert got[:3] == [(1, "global", 0.7, "So sánh A và B"), (1, "target_a", 1.0, "A " + Q.COMPARED_BY_DEFAULT), (1, "target_b", 1.0, "B " + Q.COMPARED_BY_DEFAULT)]
    assert got[4] == (3, "target_a", 1.0, f"nguyên nhân {Q.FACETS['cause'][1]} {Q.FACETS['outcome'][1]}") and len(got) == 6


def test_domain_gate(spark):
    rows = [(True, True, True, -1.0), (False, True, True, -1.0), (None, None, True, 1.0), (None, None, None, -0.061), (False, False, False, -0.06), (False, False, False, 0.019), (False, False, False, 0.02)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, m boolean, s boolean, o boolean, d double")
    got = [r[0] for r in df.orderBy("i").select(Q.domain_gate(F.col("m"), F.col("s"), F.col("o"), F.col("d"))["reason"]).collect()]
    assert got == ["meta_request", "domain_signal", "explicit_ood", "anchor_guard", "domain_anchor", "low_domain_margin", "domain_anchor"]


def test_target_score_and_cover(spark):
    df = spark.createDataFrame([("Trận Alpha Beta", "", "alpha beta"), ("Alpha", "nothing", "alpha beta gamma"), ("", "of alpha beta", "alpha beta"), ("", "beta and alpha", "alpha beta"), ("x", "y", "")], "title string, body string, target string")
    got = [r[0] for r in df.select(Q.target_score(F.col("title"), F.col("body"), F.col("target"))).collect()]
    assert got == [1.0, 0.0, 0.42, 0.32, 0.0]
    assert one(spark, lambda c: Q.covers(c, ["ket qua", "dau"]), "Kết quả") and not one(spark, lambda c: Q.covers(c, ["ket qua"]), None)


def test_balanced(spark):
    rows = [(1, 10, 0.9, 0.0, 0.0), (1, 11, 0.8, 0.0, 0.0), (1, 12, 0.2, 0.5, 0.0), (1, 13, 0.1, 0.0, 0.3), (1, 14, 0.1, 0.0, 0.2), (1, 15, 0.1, 0.4, 0.9)]
    got = R.balanced(spark.createDataFrame(rows, "query_id long, row_id long, score double, relevance_a double, relevance_b double"), 6).orderBy("rank").collect()
    assert [(r.row_id, r.reserved_for) for r in got] == [(12, "a"), (15, "a"), (13, "b"), (10, ""), (11, ""), (14, "")]


def test_citation_scores(spark):
    df = spark.createDataFrame([(1, "x [a, b] y [a; z]", ["a", "b"], ["a"]), (2, "none [1999]", ["a"], []), (3, None, ["a"], ["a"])], "id long, t string, k array<string>, g array<string>")
    got = {r.id: tuple(r)[1:] for r in E.citation_scores(df, "id", F.col("t"), F.col("k"), F.col("g")).collect()}
    assert got == {1: (4, 0.75, 0.333333, 1.0), 2: (0, None, None, None), 3: (0, None, None, 0.0)}


def test_grounding(spark):
    rows = [(1, "In 1945 and 1789, NO  doubt", "it was 1945", ["no doubt", "never"], True), (2, "Insufficient evidence", None, [], False), (3, None, "", None, None)]
    df = spark.createDataFrame(rows, "id long, a string, e string, f array<string>, ok boolean")
    got = {r.id: tuple(r)[1:] for r in E.grounding(df, "id", F.col("a"), F.col("e"), F.col("f"), F.col("ok")).collect()}
    assert got == {1: (0.5, 1, 0.5, None, 0.0), 2: (None, None, None, 1.0, None), 3: (None, None, None, None, None)}


def test_citations_in_and_out(spark):
    facts = F.array(*[F.struct(F.lit(f).alias("fact"), F.lit(i).alias("id")) for f, i in (("bc", "2"), ("a", "1"), ("zz", "3"), ("d", "4"))])
    assert one(spark, lambda c: X.cited(c, facts), "abcda") == "a [1]bc [2]d [4]a"
    assert one(spark, lambda c: X.uncited(c, F.array(F.lit("1"), F.lit("2"))), "a [1]bc [2]d [4]") == "abcd [4]"


def test_urls_and_names(spark):
    assert one(spark, lambda c: X.without_secret_parameters(c), "http://x/y?a=1&token=q&b=2#f") == "http://x/y?a=1&b=2#f"
    assert one(spark, lambda c: X.without_secret_parameters(c), "http://x/y?key=1") == "http://x/y"
    assert [one(spark, X.public_url, u) for u in ("https://a.b/c", "http://u@a/", "ftp://a/", None)] == [True, False, False, False]
    assert one(spark, lambda c: X.without_names(c, ["Al", "Alpha.1"]), "ALPHA.1 and al") == "[hidden] and [hidden]"
    row = lambda u, i, n: spark.createDataFrame([(u, i, n)], "u string, i string, n string").select(X.article_url(F.col("u"), F.col("i"), F.col("n"), "http://w")).first()[0]
    assert [row("http://q", "1", "x"), row(" ", "1", "x"), row(None, "", "a bé")] == ["http://q", "http://w?curid=1", "http://w/a_b%C3%A9"]


def test_points_and_phases(spark):
    a = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [1.0]), (5, None)], "id long, v array<double>")
    b = spark.createDataFrame([(1, [1.000001, 2.0]), (2, [1.1]), (4, [1.0]), (5, [1.0])], "id long, v array<double>")
    assert {r.id: r.state for r in A.compared_points(a, b, "id", "v").collect()} == {1: "same", 2: "different", 3: "missing", 4: "unexpected", 5: "different"}
    p = A.phase_summary(spark.createDataFrame([("cold", 1.0), ("cold", float("inf")), ("odd", 1.0)], "phase string, v double"), "phase", "v", ["cold", "warm"])
    assert {r.phase: (r.n, r.mean) for r in p.collect()} == {"cold": (1, 1.0), "warm": (0, None)}


def test_import_plan(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b"), (4, None)], "k long, h string"), spark.createDataFrame([(1, "a"), (2, "c"), (3, "d"), (4, None)], "k long, h string")
    assert {r.k: r.action for r in U.import_plan(old, new, "k", "h", "skip").collect()} == {1: "unchanged", 2: "skip", 3: "insert", 4: "unchanged"}
    with pytest.raises(ValueError):
        U.import_plan(old, new, "k", "h", "other")


def test_sse_frames(spark):
    lines = [":c", "event: a", "data: 1", "data:2", "", "event: lost", "", "data:  x: y", "", "id: 3", "data"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "s long, i int, l string")
    got = [tuple(r) for r in T.sse_frames(df, "s", "i", "l").orderBy("frame").collect()]
    assert got == [(1, 1, "a", "1\n2"), (1, 2, "message", " x: y"), (1, 3, "message", "")]


def test_stratum_quotas_against_one_at_a_time(spark):
    import random

    r = random.Random(5)
    for sizes, count in ([[r.randint(1, 30) for _ in range(6)], 20], [[1, 1, 1, 50], 10], [[3, 2], 5], [[9] * 5, 3]):
        rows = [(f"s{i}", n, f"{r.random():.9f}") for i, n in enumerate(sizes)]
        quota = {k: int(len(rows) <= count) for k, _, _ in rows}
        for _ in range(count - sum(quota.values())):
            k = max((x for x in rows if quota[x[0]] < x[1]), key=lambda x: (round(count * x[1] / sum(sizes) - quota[x[0]], 9), x[2]))[0]
            quota[k] += 1
        got = U.stratum_quotas(spark.createDataFrame(rows, "k string, n long, r string"), "k", "n", count, F.col("r")).collect()
        assert {x.k: x.quota for x in got} == quota


def test_balanced_subset_against_all_rows(spark):
    import hashlib
    import random

    r = random.Random(2)
    rows = [(i, r.choice("aaaab"), r.choice(["x", "y", None])) for i in range(120)]
    pool, seen, want = list(rows), {}, []
    while pool and len(want) < 30:
        best = max(pool, key=lambda x: (round(sum(1 / (1 + seen.get(f, 0)) for f in (("f", x[1]), ("g", x[2]))), 12), hashlib.sha256(str(x[0]).encode()).hexdigest()))
        pool.remove(best)
        want.append(best[0])
        for f in (("f", best[1]), ("g", best[2])):
            seen[f] = seen.get(f, 0) + 1
    got = U.balanced_subset(spark.createDataFrame(rows, "i long, f string, g string"), ["f", "g"], "i", 30).orderBy("pick").collect()
    assert [x.id for x in got] == want


def test_behavior_checks(spark):
    calls = [("a", "1"), ("a", "1"), ("b", "2")]
    df = spark.createDataFrame([(1, True, calls), (2, False, calls), (3, None, None), (4, True, [("a", None)]), (5, True, [])], "id long, k boolean, c array<struct<name:string,fingerprint:string>>")
    names = lambda *n: F.array(*[F.lit(x) for x in n])
    got = E.behavior_checks(df, "id", F.col("k"), F.col("c"), names("a", "z"), F.array(names("b", "q")), names("z"), F.lit(None).cast("array<string>"), F.lit(2), F.lit(1))
    got = {r.id: tuple(r)[1:] for r in got.collect()}
    assert got[1] == (3, 1, 0.333333, False, True, True, None, False, True)
    assert got[2] == got[3] == (None,) * 9
    assert got[4][:3] == (1, None, None) and got[4][-2:] == (True, None)
    assert got[5] == (0, 0, None, False, False, True, None, True, True)


def test_retrieval_behavior(spark):
    rows = [(1, ["g"], ["g"], [], ["g"], False), (2, ["g"], [], ["g"], ["g"], None), (3, ["g"], ["g"], ["g"], ["g"], False), (4, ["g"], ["g"], ["g"], ["a"] * 5 + ["g"], False), (5, None, None, None, None, True), (6, ["g"], None, None, None, False)]
    df = spark.createDataFrame(rows, "i int, g array<string>, d array<string>, b array<string>, f array<string>, n boolean")
    got = [r[0] for r in df.orderBy("i").select(E.retrieval_behavior(F.col("g"), F.col("d"), F.col("b"), F.col("f"), F.col("n"))).collect()]
    assert got == ["dense_only_hit", "bm25_only_hit", "shared_hit", "final_miss", "negative_edge", "final_miss"]


def test_table_states(spark):
    from quarryline.sources import files as S

    a, b = spark.range(3), spark.range(4)
    assert S.table_states({"x": a, "y": a, "z": a}, {"x": spark.range(2, -1, -1), "y": b, "w": a}) == {"w": "unexpected", "x": "same", "y": "different", "z": "missing"}


def test_ranks_and_citations_in_text(spark):
    assert one(spark, lambda c: X.first_rank(c, "dense"), "bm25:q0@1,dense:q0@7,dense:q2@3") == 3 and one(spark, lambda c: X.first_rank(c, "dense"), "bm25:q0@1") is None
    assert one(spark, lambda c: X.only_known_citations(c, F.array(F.lit("a"))), "x [a] [b] [a b]") == "x [a]  [a b]"


def test_dealt_is_even(spark):
    rows = [(i, "hot" if i % 3 else None) for i in range(500)]
    got = U.dealt(spark.createDataFrame(rows, "i long, g string"), "g", "i", "s", ["a", "b", "c"]).groupBy("g", "mode").count().collect()
    for g in ("hot", None):
        counts = [x["count"] for x in got if x.g == g]
        assert len(counts) == 3 and max(counts) - min(counts) <= 1
    assert sum(x["count"] for x in got) == 500


def test_deduplicated_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:01"), (1, "2024-01-01 00:00:02"), (2, "2024-01-01 00:00:03")]
    spark.createDataFrame(rows, "k long, ts string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, ts string").parquet(str(tmp_path / "in"))
    T.run_available(T.deduplicated_stream(stream, ["k"], "ts"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_normalized_text(spark):
    from quarryline.functions import unicode as N

    assert one(spark, N.normalized_text, " e\u0301 \x07a\t b \r\n \n\n\r\u1100\u1161 \n") == "\u00e9 a b\n\n\uac00"
    assert one(spark, N.normalized_text, None) == "" and one(spark, lambda c: N.normal_form(c, "NFKC"), "ﬁ①") == "fi1"
    assert one(spark, N.normal_form, None) is None

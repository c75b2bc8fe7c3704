"""Record operators: guards that must fail, and outcomes by hand."""

import re

import pytest
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.operators import records as K


def test_guards(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k long, v string")
    with pytest.raises(ValueError, match="repeats"):
        K.with_unique(df, "k")
    assert K.with_unique(df.where("v <> 'c'"), "k").count() == 2
    for wanted in ("a,a", "x"):
        with pytest.raises(ValueError, match="each once"):
            K.selected_splits(df, "v", wanted, ["a", "b"])
    assert K.selected_splits(df, "v", "all", ["a", "b"]).count() == 2
    with pytest.raises(Exception, match="no row for a position"):
        K.strict_zip(df.where("v = 'a'"), df.where("v = 'b'").withColumnRenamed("v", "w"), ["k"]).collect()
    joined, unknown = K.joined_or_unknown(df, df.where("k = 1").select("k"), "k")
    assert joined.count() == 1 and {r.v for r in unknown.collect()} == {"b", "c"}


def test_decomposed_text_is_folded_as_composed(spark):
    row = spark.createDataFrame([("éa b Ð được", "éa b")], "x string, y string")
    got = row.select(X.match_norm(F.col("x")).alias("x"), X.match_norm(F.col("y")).alias("y")).first()
    assert got.y == "ea b" and got.x.startswith("ea b") and got.x.endswith("duoc")


def test_citations_follow_aliases(spark):
    s = "array<struct<source_id:string,chunk_id:string,display_index:int>>"
    rows = [(1, "[1200] [12] [1945] [S1;s-9] [a b] [" + "x" * 129 + "]", [("1945", "c1", 1), (None, "c2", 2)]), (2, None, [])]
    df = spark.createDataFrame(rows, f"id long, t string, s {s}")
    got = {r.id: r for r in K.resolved_citations(df, "id", F.col("t"), F.col("s"), F.array(F.lit("1945")), F.array(F.lit("s-9"))).collect()}
    assert got[1].cited == "12|1945|S1|s-9" and got[1].sources == "1945" and got[1].invalid == "12|s-9"
    assert (got[1].validity, got[1].recall) == (0.5, 1.0) and abs(got[1].precision - 1 / 3) < 1e-5
    assert got[2].cited == "" and got[2].validity is None


def test_sections_and_offsets(spark):
    df = spark.createDataFrame([(1, "a\n== H ==\nb\n\n# K\n"), (2, None), (3, "# only")], "id long, t string")
    got = {(r.id, r.section): r.body for r in K.sections(df, "id", F.col("t")).collect()}
    assert got == {(1, ""): "a", (1, "H"): "b", (2, ""): ""}
    n = spark.range(20).withColumn("n", F.col("id") + 1)
    start = {r.id: r.start for r in K.running_offset(n, "id", F.col("n"), 3).collect()}
    assert start == {i: sum(range(1, i + 1)) for i in range(20)}


def test_temporary_corpus_without_rerank_scores(spark):
    df = spark.createDataFrame([(1, i, i / 10, None) for i in range(20)] + [(2, i, i / 10, 1.0 - i / 20) for i in range(20)], "query_id long, row_id long, dense double, rerank double")
    got = [(r.query_id, r.row_id) for r in K.temporary_top(df, 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 19), (1, 18), (2, 8), (2, 9)]


def test_differing_vectors(spark):
    r = spark.createDataFrame([([1.0, 2.0], [1.0, 2.5]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [x.d for x in r.select(K.max_difference(F.col("a"), F.col("b")).alias("d")).collect()] == [0.5, None]


def test_gold_of_short_and_long_items(spark):
    from quarryline.plans.catalogue import _gold

    docs = spark.createDataFrame([(1, "the red fox jumps over it and runs far away"), (2, "nothing"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "red fox jumps"), (2, "he red fox jumps over it an"), (3, "blue fox"), (4, "x")], "item_id long, text string")
    got = {r.query_id: r["items"] for r in _gold(lambda n: docs if n == "documents" else items).collect()}
    assert got == {1: [1], 2: [1], 3: None, 4: [1]}


def test_index_once_and_query(spark, tmp_path):
    from quarryline.operators import retrieval as R

    docs = spark.createDataFrame([(1, "red fox red"), (2, "blue fox"), (3, "")], "doc_id long, text string")
    q = spark.createDataFrame([(9, "red", 1), (9, "fox", 1)], "query_id long, term string, qtf long")
    n = docs.agg(F.count("*").alias("n_docs"))
    direct = R.bm25(q, *R.postings(docs, "doc_id", F.col("text")), n, 5).collect()
    R.indexed(docs, "doc_id", F.col("text"), f"{tmp_path}/index")
    again = R.bm25(q, spark.read.parquet(f"{tmp_path}/index/postings"), spark.read.parquet(f"{tmp_path}/index/lengths"), n, 5).collect()
    assert direct == again and [r.row_id for r in direct] == [1, 2]


def test_diverse_keeps_the_title_cap_for_facets(spark):
    from quarryline.operators import retrieval as R

    rows = [(1, i, "a", ["cause"] if i == 2 else ["other"], ["time", "other", "cause"], 1.0 - i / 10) for i in range(3)] + [(1, 5, "b", ["cause"], ["x"], 0.1)]
    df = spark.createDataFrame(rows, "query_id long, row_id long, title_key string, facets array<string>, wanted array<string>, score double")
    assert [r.row_id for r in R.diverse(df, 2, 1).orderBy("rank").collect()] == [0, 5]


def test_words_end_at_letters_beyond_ascii_as_in_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    texts = ["die chau auß der", "ßeurope", "nhà lêß", "im Jahr ß1990 und 2001é", "ßapi-abcdefgh1234", "europes", "x1990", "un été", "éun the", None]
    rows = [(7 * i + 6, x, "en", "s", len(x or "")) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("question_domain", "doc_years", "category_tags", "secret_flags"):
        got = entry.queries()[name](spark, str(tmp_path)).toPandas()
        want = con.sql(entry.oracle_sql()[name]).df()
        plain = lambda d: sorted(str([v.tolist() if hasattr(v, "tolist") else v for v in r]) for r in d[sorted(d.columns)].values.tolist())
        assert plain(got) == plain(want), name


def _spelt(parsed):
    """All texts that a parsed pattern of letters, choices and optional parts matches, white space as one space."""
    out = [""]
    for op, arg in parsed:
        kind = str(op)
        if kind == "LITERAL":
            each = [chr(arg)]
        elif kind == "IN":
            each = [" "]
        elif kind == "SUBPATTERN":
            each = _spelt(arg[-1])
        elif kind == "BRANCH":
            each = [x for b in arg[1] for x in _spelt(b)]
        else:  # a repeat
            each = ([""] if arg[0] == 0 else []) + _spelt(arg[2])
        out = [a + b for a in out for b in each]
    return out


def test_every_injected_instruction_has_a_sign(spark):
    """What is told before the pattern leaves out nothing that the pattern matches."""
    every = _spelt(re._parser.parse(K.INJECTION))
    assert len(every) > 300 and all(any(s in x for s in K.SIGNS) for x in every)
    df = spark.createDataFrame([(x,) for x in every] + [(x.upper().replace(" ", " \n\t"),) for x in every], "t string")
    spaced = ("api", "system", "khau", "lenh", "dan", "mat", "qua", "ghi", "tiet", "in ra", "tat")  # of those, some have a space that is no other white space
    assert df.limit(len(every)).where(~K.suspicious(F.col("t"))).count() == 0
    missed = [r.t for r in df.where(~K.suspicious(F.col("t"))).collect()]
    assert all(any(s in x.lower() for s in spaced) for x in missed)
    quiet = spark.createDataFrame([("the message of an api",), ("[system] think>",), ("",), (None,), ("ignore it; instructions",)], "t string")
    assert quiet.where(K.suspicious(F.col("t"))).count() == 0


def test_letters_are_folded_in_one_pass(spark):
    """One map, told once, in place of two and a pass for each ligature; every letter as by those."""
    signs = [chr(i) for i in (*range(1, 0xD800), *range(0xE000, 0x20000))]
    df = spark.createDataFrame([(x,) for x in signs] + [("".join(signs[i : i + 97]),) for i in range(0, len(signs), 97)], "t string")
    slow = F.translate(F.translate(F.lower("t"), X._SRC + X._UNSEEN, X._DST), X._COMPATIBLE, X._PLAIN)
    for sign, letters in X._LONGER.items():
        slow = F.replace(slow, F.lit(sign), F.lit(letters))
    assert df.where(~X.folded(F.col("t")).eqNullSafe(slow)).count() == 0
    plan = df.select(X.folded(F.col("t")).alias("f"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("translate(") == 1 and plan.count("replace(") == 1
    blank = spark.createDataFrame([("",), (" \t\n\x0b\f\r",), (None,), (" ",), (" a",)], "t string").select(K.present(F.col("t")).alias("p"))
    assert [r.p for r in blank.collect()] == [False, False, False, True, True]

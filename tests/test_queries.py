"""Every query with SQL against DuckDB on the smallest tables, and the others against hand-made cases."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from quarryline.operators import curation as U
from quarryline.plans import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def value(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, float):
            return "null" if v != v else f"{v:.5f}"
        if v is None or v is pd.NA or v is pd.NaT:
            return "null"
        return f"{v:.5f}" if isinstance(v, int) and not isinstance(v, bool) else str(v)

    return sorted(tuple(value(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_duckdb(spark, duck, name):
    got = entry.queries()[name](spark, DIR).toPandas()
    want = duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_similar_pairs_against_brute_force(spark):
    import random

    from pyspark.sql import functions as F

    r = random.Random(3)
    base = [[r.choice("abcdefghijklmnop") for _ in range(r.randint(0, 12))] for _ in range(40)]
    rows = [(i, [x if r.random() < 0.9 else "z" for x in b]) for i, b in enumerate(base * 3)]
    sets: dict = {}
    for i, b in rows:
        if b:
            sets.setdefault(frozenset(b), i)
    want = {(min(i, j), max(i, j)) for a, i in sets.items() for b, j in sets.items() if i != j and len(a & b) / len(a | b) >= 0.75}
    got = U.similar_pairs(spark.createDataFrame(rows, "id long, t array<string>"), "id", F.col("t"), 0.75).collect()
    assert {(x.a, x.b) for x in got} == want


def test_pairs_of_a_neighbourhood_share_the_rows_that_they_compare(spark, monkeypatch):
    """A value goes to a part of the work once, not once for each pair; a large neighbourhood is several parts."""
    from quarryline.sources import scratch as S

    monkeypatch.setattr(U, "PART", 64)
    monkeypatch.setattr(U, "TOGETHER", 8)
    want = {(a, b) for a in range(40) for b in range(a + 1, 40)}
    pairs = S.written(spark.createDataFrame(sorted(want), "a long, b long"), "test-pairs")
    values = spark.createDataFrame([(i, f"v{i}") for i in range(50)], "id long, v string")

    def told(a, b):
        import pandas as pd

        return pd.DataFrame({"x": a, "y": b, "values": len({*a, *b}), "pairs": len(a)})

    got = U.compared(pairs, values, told, "x string, y string, values int, pairs int").collect()
    assert sorted((r.a, r.b) for r in got) == sorted(want) and all((r.x, r.y) == (f"v{r.a}", f"v{r.b}") for r in got)
    parts = {(r["values"], r["pairs"]) for r in got}
    assert len(parts) > 1 and all(v <= 40 and v < 2 * p for v, p in parts)


def test_near_dup_jaccard_against_all_pairs_of_rows(spark, tmp_path):
    """Every link of two documents follows from the class pairs and the membership."""
    import random
    from collections import Counter

    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "rho", "sigma", "kappa", "zeta", "eta", "theta"]
    texts = [" ".join(r.sample(words, r.randint(1, 9))) for _ in range(40)]
    texts += ["Beta alpha", "alpha  alpha, beta!", "álpha beta", "one two three", "three two one", "One; two. Three", "x", "", None, "one two three"]
    docs = [(i * 2 + 1, x) for i, x in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = {i: {w for w in "".join(c if c.isalnum() else " " for c in (x or "").lower().replace("á", "a")).split() if len(w) > 1} for i, x in docs}
    want = {(i, j): len(a & b) / len(a | b) for i, a in sets.items() for j, b in sets.items() if i < j and a and b and len(a & b) / len(a | b) >= 0.75}
    got = entry.queries()["near_dup_jaccard"](spark, str(tmp_path)).collect()
    of = {x.id: x.class_id for x in got if x.kind == "member"}
    pairs = {(x.a, x.b): x.similarity for x in got if x.kind == "pair"}
    assert set(of) == set(sets) and {i for i, c in of.items() if c is None} == {i for i, s in sets.items() if not s}
    similarity = lambda i, j: 1.0 if of[i] is not None and of[i] == of[j] else pairs.get((of[i], of[j]), pairs.get((of[j], of[i])))
    links = {(i, j): similarity(i, j) for i in of for j in of if i < j and similarity(i, j) is not None}
    assert links == pytest.approx(want, abs=1e-6)
    assert {x.id: x.links for x in got if x.kind == "member"} == dict.fromkeys(sets, 0) | Counter(i for p in want for i in p)


def test_near_dup_ratio_against_all_pairs_of_rows(spark, tmp_path):
    """Documents, not benchmark items; texts of one token set are compared one by one."""
    import random
    from difflib import SequenceMatcher

    r = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "rho", "sigma", "kappa", "zeta", "eta", "theta", "iota", "chi"]
    base = [r.sample(words, 8) for _ in range(6)]
    texts = [" ".join(b) for b in base] + [" ".join(b[:7] + ["omega"]) for b in base] + [" ".join([b[1], b[0], *b[2:]]) for b in base] + [" ".join(b[::-1]) for b in base]
    texts += [texts[0].upper() + "!", texts[-1] + " " + texts[-1].split()[0], texts[12], "", None]
    docs = [(i * 3 + 2, x) for i, x in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    norm = {i: " ".join((x or "").lower().replace("!", " ").split()) for i, x in docs}
    like = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split())) >= 0.75 and SequenceMatcher(None, a, b).ratio() >= 0.88
    least = {n: min(i for i in norm if norm[i] == n) for n in norm.values()}
    by = lambda i, j: (norm[i], norm[j]) if least[norm[i]] < least[norm[j]] else (norm[j], norm[i])
    want = {(i, j) for i in norm for j in norm if i < j and (norm[i] == norm[j] or norm[i] and norm[j] and like(*by(i, j)))}
    got = entry.queries()["near_dup_ratio"](spark, str(tmp_path)).collect()
    of = {x.id: x.class_id for x in got if x.kind == "member"}
    pairs = {(x.a, x.b) for x in got if x.kind == "pair"}
    assert {(i, j) for i in of for j in of if i < j and (of[i] == of[j] or (min(of[i], of[j]), max(of[i], of[j])) in pairs)} == want
    assert {x.id: x.links for x in got if x.kind == "member"} == {i: sum(i in p for p in want) for i in norm}
    assert any(set(norm[a].split()) == set(norm[b].split()) for a, b in pairs) and len(want) > len(pairs)


def test_rouge_l_of_long_answers_against_dynamic_programming(spark):
    """Also of thousands of tokens, where a copy of a row for each of its places takes minutes."""
    import random
    import time

    from pyspark.sql import functions as F

    from quarryline.operators import evaluation as E

    r = random.Random(9)
    rows = [(i, [r.choice("abcdefgh") for _ in range(r.randint(0, 30))], [r.choice("abcdefgh") for _ in range(r.randint(0, 30))]) for i in range(60)]
    rows += [(60, [], []), (61, None, ["a"]), (62, ["a", None, "b"], [None, "b"])]
    rows += [(63 + i, [r.choice("abcdefgh") for _ in range(3000)], ["z", "a"] * 1500) for i in range(4)]

    def brute(x, y):
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                t[i + 1][j + 1] = t[i][j] + 1 if a == b and a is not None else max(t[i][j + 1], t[i + 1][j])
        return 1.0 if not x and not y else 2 * t[-1][-1] / (len(x) + len(y))

    d = spark.createDataFrame(rows, "i int, x array<string>, y array<string>").repartition(4)
    began = time.time()
    got = {g.i: g.r for g in d.select("i", E.rouge_l(F.col("x"), F.col("y")).alias("r")).collect()}
    assert time.time() - began < 30
    for i, x, y in rows[:63] + rows[63:64]:
        assert got[i] == (None if x is None else pytest.approx(brute(x, y), abs=1e-12))


def test_ratios_are_those_of_difflib():
    """Also with more places of equal letters than are looked through at once; long texts that match nowhere take no time."""
    import random
    import time
    from difflib import SequenceMatcher

    from quarryline.functions import matching

    r = random.Random(3)
    for n in range(300):
        words = ["".join(r.choice(("ab", "abcdefghijklmnopqrstuvwxyz0123456789", "aé漢😀bc ")[n % 3]) for _ in range(r.randint(1, 9))) for _ in range(r.choice([5, 60, 300]))]
        a = [r.choice(words) for _ in range(r.choice([0, 1, 5, 30, 120, 400]))]
        b = [w for w in a if r.random() > 0.04 * (n % 4)]
        b = b[len(b) // 7 :] + b[: len(b) // 7] if n % 5 == 0 else b
        a, b = " ".join(a), " ".join(b)
        want = SequenceMatcher(None, a, b).ratio()
        assert [matching.ratio(a, b, least) for least in (0.0, 0.5, 0.88)] == [want if want > least - 1e-6 else 0.0 for least in (0.0, 0.5, 0.88)]
    points, matching.POINTS = matching.POINTS, 0
    assert matching.ratio(a, b, 0.0) == want
    matching.POINTS = points
    words = ["".join(r.choice("etaoinshrdlu" * 4 + "bcfgjkmpqvwxyz") for _ in range(6)) for _ in range(1500)]
    pairs = [(" ".join(words), " ".join(r.sample(words, len(words)))) for _ in range(20)]
    began = time.time()
    got = U._ratios(0.88)([a for a, _ in pairs], [b for _, b in pairs])
    assert time.time() - began < 4 and not got["ratio"].any()


def test_terms_of_one_pass_are_those_of_the_columns(spark):
    from pyspark.sql import functions as F

    from quarryline.functions import text as X
    from quarryline.functions import unicode as W

    texts = ["Álpha  beta, a B2-x đường ŒUVRE ﬁn K", "", None, "  ", "a b", "ΑΒΓ άλφα é", "x́yz İstanbul ퟿𝐀 ok\x00ok"]
    d = spark.createDataFrame([(x,) for x in texts], "text string").withColumn("w", W.norm_and_terms(F.col("text")))
    terms = F.array_sort(F.array_distinct(X.terms(F.col("text"))))
    got = d.select("w.*", X.match_norm(F.col("text")).alias("n"), F.to_json(terms).alias("t"), U.set_key(X.terms(F.col("text"))).alias("k")).collect()
    assert all((x.norm, x.tokens, x.key) == (x.n, x.t, x.k) for x in got), got

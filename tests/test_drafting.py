"""Choices made in rounds against the same choices made one after another."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarryline.operators import drafting as D


@pytest.mark.parametrize("view", [4, 1024])
def test_greedy_equals_one_after_another(spark, view, monkeypatch):
    monkeypatch.setattr(D, "VIEW", view)
    r = random.Random(1)
    rows = [(i, r.choice("ab") + "x", r.choice(["s", "t", "u", None])) for i in range(120)]
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(60)]
    df = spark.createDataFrame(rows, "id long, lang string, source string").repartition(3)
    got = D.greedy(df, "id", [F.sha2(F.col("id").cast("string"), 256)], {"lang": 9, "source": 5}, spark.createDataFrame(edges, "a long, b long")).collect()
    near, taken, n = {i: set() for i in range(120)}, set(), Counter()
    for a, b in edges:
        near[a] |= {b} - {a}
        near[b] |= {a} - {b}
    for i, lang, source in sorted(rows, key=lambda x: hashlib.sha256(str(x[0]).encode()).hexdigest()):
        if n["l", lang] < 9 and (source is None or n["s", source] < 5) and not near[i] & taken:
            taken.add(i)
            n["l", lang] += 1
            n["s", source] += 1
    assert len(got) == 120 and {x.id for x in got if x.accepted} == taken


def test_greedy_of_nothing(spark):
    none = spark.createDataFrame([], "id long, k string")
    assert D.greedy(none, "id", [], {"k": 1}, spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("exact", [4096, 8])
def test_group_split(spark, exact, monkeypatch):
    monkeypatch.setattr(D, "EXACT", exact)  # 8: most groups are dealt by bins
    r = random.Random(2)
    rows = [(f"g{min(int(r.paretovariate(0.8)), 300)}", r.choice(["x", "x", "y", None])) for _ in range(4000)] + [(None, "x")] * 7
    df = spark.createDataFrame(rows, "g string, label string").repartition(3)
    ratios = {"train": 0.8, "validation": 0.1, "test": 0.1}
    got = D.group_split(df, "g", {"label": 1.5}, ratios).collect()
    of = {x.g: x.split for x in got}
    assert len(of) == len(got) == len({g for g, _ in rows})  # each group once, null too
    sizes = Counter(g for g, _ in rows)
    largest = max(n for g, n in sizes.items() if g != "g1")
    n = Counter((of[g], x) for g, x in rows)
    for label in ("x", "y", None):
        whole = sum(n[s, label] for s in ratios)
        for s, share in ratios.items():
            assert abs(n[s, label] - share * whole) <= largest, (s, label)
    assert D.group_split(df.limit(0), "g", {"label": 1.0}, ratios).count() == 0


def test_drafts_by_first_rows_are_those_of_all(spark, tmp_path, monkeypatch):
    """Looking at the first rows, and then at what full groups leave, takes what looking at all rows takes; null groups too."""
    import random

    import __spark_entry__ as entry
    from quarryline.plans import drafts

    r = random.Random(6)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(r.sample(words, r.randint(0, 8))), r.choice(["en", "fr", None]), r.choice(["a", "b", "c", None])) for i in range(150)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda: sorted(map(str, entry.queries()["drafted"](spark, str(tmp_path)).collect()))
    whole = run()
    monkeypatch.setattr(drafts, "_FIRST", 60)
    assert run() == whole and len(whole) > 12

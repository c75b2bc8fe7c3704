"""Open JSON, batches and imports, and checks of answers, by hand."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quarryline.operators import batches as B
from quarryline.operators import checks as K
from quarryline.operators import jsonwalk as J


def test_bounded_and_canonical(spark):
    texts = [
        '{"b": 1, "a": {"z": [1, {"y": "é", "x": null}]}}', '{"Token": "x", "n": {"My-Password": 1, "ok": "Bearer abc d"}}', "[" * 7 + "1" + "]" * 7,
        json.dumps({f"k{i:02}": i for i in range(30)}), json.dumps(list(range(20))), "no json", None, '"' + "x" * 2000 + '"', json.dumps([[i] * 16 for i in range(16)]), "[" * 3000,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [(r.c, r.b) for r in df.orderBy("i").select(J.canonical(F.col("t")).alias("c"), J.bounded(F.col("t")).alias("b")).collect()]
    assert got[0] == ('{"a":{"z":[1,{"x":null,"y":"é"}]},"b":1}',) * 2
    assert got[1][1] == '{"n":{"ok":"Bearer=[redacted] d"}}' and got[2][1] == '[[[[["[bounded]"]]]]]'
    assert json.loads(got[3][1]) == {f"k{i:02}": i for i in range(24)} and json.loads(got[4][1]) == list(range(16))
    assert got[5] == (None, None) and got[6] == (None, None) and len(json.loads(got[7][1])) == 1000
    assert got[8][1].count("[") + sum(len(x) for x in json.loads(got[8][1])) <= J.NODES + 2 and got[9][1] is None


def test_credentials_at_any_depth(spark):
    deep = json.dumps({"a": [{"b": 'he said "api_key": "abcdefghijklmnop"'}]})
    escaped = '{"a": "sk-\\u0061bcdefghijklmnopqrs"}'
    rows = [(deep, True), (escaped, True), ('{"a": "Bearer abcdefghijklmnopq"}', True), ("https://u:p@host/x", True), ('{"a": "sk-short"}', False), (None, False), ('{"a":1} sk-abcdefghijklmnopq', True)]
    got = spark.createDataFrame(rows, "t string, want boolean").select("want", J.has_credential(F.col("t")).alias("got")).collect()
    assert all(r.want == r.got for r in got), got


def test_batches_find_what_one_run_finds(spark, tmp_path):
    r = random.Random(2)
    base = [[r.choice("abcdefghijkl") for _ in range(10)] for _ in range(12)]
    rows = []
    for i in range(60):
        w = list(r.choice(base))
        if r.random() < 0.6:
            w[r.randrange(10)] = r.choice("xyz")
        rows.append((i, " ".join(w) if r.random() < 0.95 else None))
    rows += [(60, ""), (61, ""), (62, "Q"), (63, "q")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    tokens = F.filter(F.split(F.lower("text"), " "), lambda x: x != "")
    run = lambda store, part: [tuple(x) for x in B.merge_batch(store, part, "id", F.col("text"), tokens, 0.8).collect()]
    whole = run(f"{tmp_path}/one", df)
    parts = [x for i in range(4) for x in run(f"{tmp_path}/many", df.where(F.col("id").between(16 * i, 16 * i + 15)))]
    first, sets, want = {}, {}, []
    for i, t in rows:
        if t is None:
            continue
        if t in first:
            want.append((i, first[t], "exact", 1.0))
            continue
        first[t] = i
        mine = {x for x in t.lower().split(" ") if x}
        want += [(i, j, "near", round(len(mine & s) / len(mine | s), 6)) for j, s in sets.items() if mine and s and len(mine & s) / len(mine | s) >= 0.8]
        sets[i] = mine
    assert sorted(whole) == sorted(parts) == sorted(want)


def test_import_needs_the_previewed_rows(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (9, "z", 0)], "id long, d string, n int")
    new = spark.createDataFrame([(2, "B", 3), (3, "c", 4)], "id long, d string, n int")
    token = {p: B.import_token(old, new, "id", "d", p) for p in ("reject", "skip", "overwrite")}
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(B.apply_import(old, new, "id", "d", "overwrite", token["overwrite"])) == [(1, "a", 1), (2, "B", 3), (3, "c", 4), (9, "z", 0)]
    assert rows(B.apply_import(old, new, "id", "d", "skip", token["skip"])) == [(1, "a", 1), (2, "b", 2), (3, "c", 4), (9, "z", 0)]
    for args in ((old, new, "reject", token["reject"]), (old, new, "skip", token["overwrite"]), (old, new.unionByName(new), "skip", B.import_token(old, new.unionByName(new), "id", "d", "skip"))):
        with pytest.raises(ValueError):
            B.apply_import(args[0], args[1], "id", "d", *args[2:])
    with pytest.raises(ValueError):  # the target has changed
        B.apply_import(old.withColumn("d", F.concat("d", F.lit("!"))), new, "id", "d", "skip", token["skip"])
    same = B.import_token(old.where("id <> 9"), new, "id", "d", "skip")
    assert same == token["skip"]  # rows that the import doesn't meet don't matter
    empty = new.limit(0)
    assert rows(B.apply_import(old, empty, "id", "d", "reject", B.import_token(old, empty, "id", "d", "reject"))) == rows(old)


def test_checks(spark):
    rows = [("x [a] y [b]", []), ("x [a] [a]", ["adjacent"]), ("[a b]", ["malformed", "unknown"]), ("[1999]", ["malformed", "unknown"]), ("[2000]", []), ("[c]", ["unknown"]), (None, []), ("[a][a]", [])]
    got = spark.createDataFrame(rows, "t string, want array<string>").select("want", K.citation_faults(F.col("t"), F.array(F.lit("a"), F.lit("b"), F.lit("2000"))).alias("got")).collect()
    assert all(r.want == r.got for r in got), got
    rows = [("không đúng", "false_premise", True, 1), ("khôngx", "false_premise", True, 0), (None, "false_premise", True, 0), ("sai", "fact", True, None), ("sai", "false_premise", False, None)]
    df = spark.createDataFrame(rows, "t string, k string, ok boolean, want int")
    got = df.select("want", K.premise_corrected(F.col("t"), F.col("k"), F.col("ok"), "không|sai").alias("got")).collect()
    assert all(r.want == r.got for r in got), got


def test_leases_as_table_and_stream(spark, tmp_path):
    from quarryline.streaming import leases as L
    from quarryline.streaming.telemetry import run_available

    r = random.Random(8)
    at, rows = 0, []
    for i in range(200):
        at += r.randint(1, 40)
        rows.append((i, r.choice("abc") if i % 50 else None, at, r.random() < 0.15))
    rows.append((999, "z", at + 10_000, False))  # moves the watermark on
    df = spark.createDataFrame(rows, "n long, k string, s long, out boolean").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    want = [tuple(x) for x in L.lease_intervals(df, "k", "ts", "n", F.col("out"), 60).collect()]
    live, by_hand = {}, []
    for _, k, s, out in rows:
        if k is None:
            continue
        if k in live and s - live[k][1] >= 60:
            a, b, n = live.pop(k)
            by_hand.append((k, a * 10**6, (b + 60) * 10**6, n, "expired"))
        if out:
            if k in live:
                a, _, n = live.pop(k)
                by_hand.append((k, a * 10**6, s * 10**6, n + 1, "released"))
        else:
            a, _, n = live.get(k, (s, s, 0))
            live[k] = (a, s, n + 1)
    by_hand += [(k, a * 10**6, (b + 60) * 10**6, n, "expired") for k, (a, b, n) in live.items()]
    assert sorted(want) == sorted(by_hand)
    steps = [(x.at_us, x.live) for x in L.in_flight(L.lease_intervals(df, "k", "ts", "n", F.col("out"), 60)).orderBy("at_us").collect()]
    assert all(n == sum(a <= t < b for _, a, b, _, _ in by_hand) for t, n in steps) and steps[-1][1] == 0
    for i in range(3):
        df.where(F.col("n").between(i * 70, i * 70 + 69) | ((F.col("n") == 999) & F.lit(i == 2))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        run_available(L.lease_stream(stream, "k", "ts", F.col("out"), 60), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = [tuple(x) for x in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(got) == sorted(x for x in by_hand if x[0] != "z")


def test_bounded_json_is_dealt_over_tasks(spark, tmp_path, monkeypatch):
    """Events of one small file become texts of hundreds of times its size, which are many tasks' work."""
    import __spark_entry__ as entry
    from quarryline.plans import ingest

    monkeypatch.setattr(ingest, "_ROWS", 10)
    rows = [(i, i % 50, '{"k": 1}', "click") for i in range(100)]
    spark.createDataFrame(rows, "event_id long, user_id long, props string, event_type string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    out = entry.queries()["bounded_json"](spark, str(tmp_path))
    assert out.count() == 100 and out.select(F.spark_partition_id().alias("p")).distinct().count() > 3


def test_batches_of_texts_with_a_common_word(spark, tmp_path):
    """Rare words are met first: a word that all texts have makes no pairs of all of them, and the links are those of all pairs."""
    r = random.Random(2)
    texts = [(i, "the " + " ".join(r.choice("abcdefgh") + str(r.randint(0, 3)) for _ in range(6))) for i in range(120)] + [(200, "the"), (201, "the the"), (202, "")]
    d = spark.createDataFrame(texts, "id long, text string")
    got = set()
    for i in range(3):
        links = B.merge_batch(f"{tmp_path}/store", d.where(F.col("id") % 3 == i), "id", F.col("text"), F.filter(F.split("text", " "), lambda x: x != ""), 0.6)
        got |= {(x.id, x.of, x.similarity) for x in links.collect()}
    sets = {i: set(x.split()) for i, x in texts}
    want = set()
    for i, a in sets.items():
        for j, b in sets.items():
            before = (j % 3, j) < (i % 3, i)
            if before and a and b and len(a & b) / len(a | b) >= 0.6:
                want.add((i, j, round(len(a & b) / len(a | b), 6)))
    assert got == want


def test_merged_batches_compare_whole_texts(spark, tmp_path):
    """Texts that begin alike and go on differently are no near copies; those that differ at the beginning alone are."""
    import duckdb

    import __spark_entry__ as entry

    head, rest = [f"h{i}" for i in range(12)], [f"w{i}" for i in range(60)]
    texts = [head + rest, head + [f"x{i}" for i in range(60)], [f"g{i}" for i in range(12)] + rest, ['say "a"\\', *rest, *rest], ['say "a"\\', *rest], head[:9] + head]
    rows = [(i, "\x0b".join([" ".join(x), "end"]), "en", "src0") for i, x in enumerate([*texts, None, texts[1], [""]]) if x is not None]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = [(a, b, kind, float(s)) for a, b, kind, s in con.execute(entry.oracle_sql()["merged_batches"]).fetchall()]
    got = sorted(map(tuple, entry.queries()["merged_batches"](spark, str(tmp_path)).collect()))
    assert got == sorted(want) and {(2, 0), (3, 0), (3, 2), (4, 3)} <= {(x[0], x[1]) for x in got} and (1, 0) not in {(x[0], x[1]) for x in got}


def test_bounded_json_has_like_lists_side_by_side(spark, tmp_path):
    """What is written shrinks by a quarter where texts with the same beginnings follow one another."""
    import __spark_entry__ as entry

    rows = [(i, i * 37 % 50, '{"k": 1}', "click") for i in range(200)]
    spark.createDataFrame(rows, "event_id long, user_id long, props string, event_type string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    out = entry.queries()["bounded_json"](spark, str(tmp_path)).select(F.spark_partition_id().alias("p"), F.size(F.from_json("canonical", "list array<int>")["list"]).alias("n")).collect()
    assert len(out) == 200 and all(a.p != b.p or a.n <= b.n for a, b in zip(out, out[1:], strict=False))

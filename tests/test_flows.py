"""Running answers, shards, matched calls and guards, by hand and against step-by-step versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarryline.operators import runs as G
from quarryline.sources import files, shards
from quarryline.streaming import pieces as P


def whole(text: str, ids: set) -> str:
    """What a reader sees of a whole answer, a character at a time."""
    seen, i, low = "", 0, text.lower()
    while i < len(text):
        tag = next((t for t in P.HIDDEN_TAGS if low.startswith(f"<{t}>", i)), None)
        if tag:
            end = low.find(f"</{tag}>", i + len(tag) + 2)
            i = len(text) if end < 0 else end + len(tag) + 3
        else:
            seen, i = seen + text[i], i + 1
    out = ""
    while "[" in seen:
        at = seen.index("[")
        end = seen.find("]", at)
        out += seen[:at]
        if end < 0:
            return out + seen[at + 1 :]
        out, seen = out + (seen[at : end + 1] if seen[at + 1 : end] in ids else ""), seen[end + 1 :]
    return out + seen


def answers(n: int = 60):
    r = random.Random(3)
    parts = ["<think>", "</think>", "<TOOL_CALL>", "</tool_call>", "[c1]", "[c2]", "[zz]", "[", "]", "<", ">", "a b ", "<thi", "nk>", "x[c1", "</"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(n)]


def cut(texts):
    r, rows = random.Random(4), []
    for i, t in enumerate(texts):
        at = sorted(r.sample(range(len(t) + 1), min(len(t), 5)))
        bits = [t[a:b] for a, b in zip([0, *at], [*at, len(t)], strict=True)]
        rows += [(i, k, b, k == len(bits) - 1, ["c1", "c2"]) for k, b in enumerate(bits)]
    return rows


PIECE = "id long, seq int, piece string, last boolean, ids array<string>"


def joined(rows):
    out = {}
    for x in sorted(rows, key=lambda x: (x.id, x.seq)):
        out[x.id] = out.get(x.id, "") + x.shown
    return out


def test_pieces_show_what_the_whole_answer_shows(spark):
    texts = answers()
    got = joined(P.filtered_pieces(spark.createDataFrame(cut(texts), PIECE), "id", "seq", "piece", "last", "ids").collect())
    assert got == {i: whole(t, {"c1", "c2"}) for i, t in enumerate(texts)}
    assert len({x for x in got.values()}) > 20


def test_pieces_leave_as_soon_as_they_can(spark):
    feed, held = P._filter(), ("", "")
    shown = []
    for piece in ["a [c", "1] b <thi", "s> [", "x" * 600, None]:
        out, held = feed(held, piece, False, ["c1"])
        shown.append(out)
    assert shown == ["a ", "[c1] b ", "<this> ", "x" * 600, ""] and held == ("", "")
    _, held = feed(("", ""), "<think>" + "y" * 9999, False, None)
    assert len(held[1]) < 20  # hidden text is not kept
    rows = [(None, 0, "[", False, None), (None, 1, "c1]", True, ["c1"]), (7, 0, None, None, None)]
    got = P.filtered_pieces(spark.createDataFrame(rows, PIECE), "id", "seq", "piece", "last", "ids").collect()
    assert {(x.id, x.seq): x.shown for x in got} == {(None, 0): "", (None, 1): "[c1]", (7, 0): ""}


def test_pieces_as_a_stream(spark, tmp_path):
    texts = answers(20)
    rows = cut(texts)
    for part in range(3):  # a batch for each file: pieces of an answer are in several
        some = [x for x in rows if min(x[1], 2) == part]
        spark.createDataFrame(some, PIECE).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    out = []
    for part in range(3):
        import os
        import shutil

        os.makedirs(f"{tmp_path}/feed", exist_ok=True)
        for n in os.listdir(f"{tmp_path}/in/{part}"):
            if n.endswith(".parquet"):
                shutil.copy(f"{tmp_path}/in/{part}/{n}", f"{tmp_path}/feed/{part}-{n}")
        s = P.filtered_stream(spark.readStream.schema(PIECE).parquet(f"{tmp_path}/feed"), "id", "seq", "piece", "last", "ids")
        q = s.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    out = joined(spark.read.parquet(f"{tmp_path}/out").collect())
    assert out == {i: whole(t, {"c1", "c2"}) for i, t in enumerate(texts)}


def test_last_samples_as_a_stream(spark, tmp_path):
    rows = [(i % 2, i, float(i) if i % 10 else None) for i in range(100)]
    got = {}
    for part in range(2):
        spark.createDataFrame([x for x in rows if x[1] // 50 == part], "k long, seq long, v double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        s = P.last_n_stream(spark.readStream.schema("k long, seq long, v double").parquet(f"{tmp_path}/in"), "k", "seq", "v", 20)
        keep = lambda df, _: got.update({x.k: x for x in df.collect()})  # noqa: E731  two keys
        q = s.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    last = [v for k, _, v in rows if k == 1][-20:]
    assert got[1].n == 20 and got[1].p50 == pytest.approx((last[9] + last[10]) / 2) and got[0].n == 20


def test_shards_resume_and_are_verified(spark, tmp_path):
    source = spark.range(25).withColumn("t", F.concat(F.lit("x"), F.col("id").cast("string")))
    make = lambda d: {"rows": d, "keys": d.select("id")}
    s = shards.Shards(spark, f"{tmp_path}/s", "f1")
    assert s.completed() == []
    s.commit(make(source.where("id < 10")), 0, 10)
    source.where("id < 3").write.parquet(f"{tmp_path}/s/part-000001/rows")  # stopped before its manifest
    with pytest.raises(ValueError, match="not committed"):
        s.build(source, "id", 10, make)
    done = s.build(source, "id", 10, make, resume=True)
    assert [(m["start"], m["end"]) for m in done] == [(0, 10), (10, 20), (20, 25)]
    assert sorted(x.id for x in s.table("rows").collect()) == list(range(25)) and len(s.build(source, "id", 10, make)) == 3
    s.joined("keys", f"{tmp_path}/all")
    s.joined("keys", f"{tmp_path}/all")
    with pytest.raises(ValueError, match="frozen"):
        s.joined("rows", f"{tmp_path}/all") if False else files.write_frozen(source.select("id").where("id < 9"), f"{tmp_path}/all", source.select("id").schema)
    with pytest.raises(ValueError, match="configuration"):
        shards.Shards(spark, f"{tmp_path}/s", "f2").completed()
    source.limit(1).select("id").write.mode("append").parquet(f"{tmp_path}/s/part-000002/keys")
    with pytest.raises(ValueError, match="keys of shard 2"):
        s.completed()
    (tmp_path / "s" / "part-000001.manifest.json").unlink()
    with pytest.raises(ValueError, match="shard 1 is missing"):
        s.completed()


def test_imports_are_typed(spark, tmp_path):
    rows = [(2, "q", "TRUE", "a, b,,"), (3, "", "0", ""), (4, "r", "maybe", "a"), (5, "s", "", "c")]
    good, errors = shards.typed_import(spark.createDataFrame(rows, "line int, question string, smoke string, tags string"), "line", ["smoke"], ["tags"])
    assert {(x.line, x.question, x.smoke, tuple(x.tags or ())) for x in good.collect()} == {(2, "q", True, ("a", "b")), (3, None, False, ()), (5, "s", None, ("c",))}
    assert [tuple(x) for x in errors.collect()] == [(4, "Invalid smoke")]
    shards.write_csv(good.orderBy("line"), f"{tmp_path}/csv")
    assert {x.tags for x in spark.read.csv(f"{tmp_path}/csv", header=True).collect()} == {"a,b", None, "c"}
    bad = spark.createDataFrame([(f"line {i:02}",) for i in range(40)], "x string")
    got = shards.bad_examples(bad).first()
    assert got.rows == 40 and got.examples == [f"line {i:02}" for i in range(30)]
    none = shards.bad_examples(bad.limit(0)).first()
    assert none.rows == 0 and none.examples == []


def test_calls_go_by_id_before_name(spark):
    schema = "run long, name string, seq int, id string"
    calls = spark.createDataFrame([(1, "a", 1, None), (1, "a", 2, "x"), (1, "b", 3, "y"), (1, "b", 4, "y"), (2, "a", 1, None)], schema)
    results = spark.createDataFrame([(1, "a", 5, "x"), (1, "a", 6, None), (1, "c", 7, "y"), (1, "d", 8, None)], schema)
    got = {(x.run, x.call, x.result, x.name, x.matched) for x in G.matched_calls(calls, results, "run", "name", "seq", "id").collect()}
    assert got == {(1, 1, 6, "a", "name"), (1, 2, 5, "a", "id"), (1, 3, 7, "b", "id"), (1, 4, None, "b", None), (1, None, 8, "d", None), (2, 1, None, "a", None)}


def test_splits_stay_apart(spark):
    k = lambda *xs: spark.createDataFrame([(x,) for x in xs], "k long")
    parts, frozen = {"a": k(1, 2), "b": k(3)}, {"a": k(1, 2, 9), "b": k(3)}
    assert G.isolated(parts, frozen, "k", k(8)) == parts
    for p, f, never, why in (({"a": k(1), "b": k(1)}, {"a": k(1), "b": k(1)}, k(8), "share"), ({"a": k(1, 5), "b": k(3)}, frozen, k(8), "not all"), (parts, frozen, k(3), "kept out")):
        with pytest.raises(ValueError, match=why):
            G.isolated(p, f, "k", never)


def test_items_are_named_as_whole_words(spark):
    texts = [(1, "The Siege of Orléans, again; sieged"), (2, "orleans"), (3, None), (4, "")]
    items = spark.createDataFrame([("siege of ORLEANS",), ("Orléans",), ("sie",), ("of",), ("sieg",), (None,)], "item string")
    d = spark.createDataFrame(texts, "id long, t string")
    got = {(x.id, x["item"]) for x in G.contained_items(d, "id", F.col("t"), items, "item").collect()}
    assert got == {(1, "siege of ORLEANS"), (1, "Orléans"), (2, "Orléans")}
    assert G.contained_items(d, "id", F.col("t"), items.limit(0), "item").count() == 0


def test_surface_of_formats(spark):
    rows = [("# a", True), ("1. a", True), ("[a](b)", True), ("plain", False), ("x **b** y", True), ("2.5", False)]
    got = spark.createDataFrame(rows, "t string, want boolean").select("want", G.looks_markdown(F.col("t")).alias("got")).collect()
    assert all(x.want == x.got for x in got)
    assert re.search(G.MARKDOWN, "- a")

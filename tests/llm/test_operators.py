"""Operators of quarryline.llm against brute force on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarryline.llm import common, exactdedup, fingerprint, linededup, lm, mixing, packing, sharding, simhash, substring, toxicity
from quarryline.llm.components import components

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row long, block int, size int, h long"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def made(seed: int = 1, n: int = 90) -> list[tuple]:
    """Texts with copies, near copies, shared passages and lines, nulls, blanks and one long text; columns that clash."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeÄéz") for _ in range(r.randint(1, 6)))
    passage = " ".join(word() for _ in range(60))
    line = "this line is found in Many Documents of the table, and is long"
    rows = []
    for i in range(n):
        words = [word() for _ in range(r.choice([0, 1, 3, 8, 40, 120]))]
        text = " ".join(w.capitalize() if r.random() < 0.1 else w for w in words)
        if i % 7 == 0:
            text = text + " " + passage + "\n" + "tail " * (i % 3)
        if i % 5 == 0:
            text = (line if i % 2 else "  " + line.upper() + "\t") + "\n" + text
        if i % 6 == 1 and rows:
            text = (r.choice(rows)[1] or "").upper() if i % 4 == 1 else (r.choice(rows)[1] or "") + " x"
        if i == 20:
            text = " ".join(word() for _ in range(6000))
        rows.append((i * 3, text, "en", r.choice(["a", "b", "b", "b", "é", ""]), len(text)))
    rows += [(1000, None, None, None, None), (1001, "", "en", None, 0), (1002, " \t\n", "en", "b", 3), (1003, None, "en", "z", None), (1004, "<|endoftext|> a  <|endoftext|>", "en", "b", 30)]
    return [(*row, "k", 5, 6, 7, 8) for row in rows]


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(UPPER)].append(r[0])
    got = {r.doc_id: r for r in exactdedup.exact_dedup(docs).collect()}
    assert len(got) == len(rows)
    for t, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(ids), len(ids), i == max(ids))
            assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert {r.doc_id for r in exactdedup.exact_dedup(docs, keep="min").where("kept").collect()} == {min(x) for x in groups.values()}


def test_exact_dedup_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "A"), (2, "a"), (None, "b")], "doc_id long, text string").repartition(3)
    got = exactdedup.exact_dedup(df).collect()
    assert sorted(r.kept for r in got) == [False] * 3 + [True] * 2
    assert exactdedup.deduplicated(df).count() == 2


def test_exact_dedup_merges_sorted_runs(spark):
    """Every level is in the order of the digest in each task, has an eighth of the runs, and is made by sort aggregation."""
    df = spark.range(3000).select("id", F.concat(F.lit("t"), F.col("id") % 700).alias("text")).repartition(70)
    rows = exactdedup.digests(df, "id")
    level = rows.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("size"), F.struct("check", "n").alias("lo"), F.struct("check", "n").alias("hi"), "run")
    runs = [70]
    while runs[-1] > 1:
        level = exactdedup.merged(exactdedup.sorted_runs(level.withColumn("run", F.shiftright("run", exactdedup.FAN_BITS))), "max")
        got = level.withColumn("_task", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()).collect()
        runs.append(len({r.run for r in got}))
        by_task = defaultdict(list)
        for r in sorted(got, key=lambda r: r._at):
            by_task[r._task].append((r.run, bytes(r.digest)))
        assert all(x == sorted(x) and len(set(x)) == len(x) for x in by_task.values())
    assert runs == [70, 9, 2, 1] and len(got) == 700 and sum(r.size for r in got) == 3000
    assert {r.keep_id for r in got} == set(range(2300, 3000))
    plan = level._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortAggregate") >= 6 and "HashAggregate" not in plan
    bad = rows.withColumn("n", F.when(F.col("doc_id") == 5, 0).otherwise(F.col("n")))
    with pytest.raises(Exception, match="two texts with one SHA-256 digest"):
        exactdedup.merged_runs(bad, 70).collect()


CLASHES = ["_key", "_nth", "_tie", "_stay", "_toxicity", "_row", "_start", "_length", "_words", "_w", "_h", "_d", "_full", "t", "row", "digest", "h", "block", "Block", "run"]


def test_columns_of_any_name(spark, tmp_path):
    """The operators that return the columns of documents keep those that are named as their own."""
    import corpus_pipeline as P

    names = [c for i, c in enumerate(CLASHES) if c.lower() not in {x.lower() for x in CLASHES[:i]}]
    rows = [(i, f"some text of {i % 9} words and {'more of it ' * (i % 9)}", "en", "a", 9, *range(len(names))) for i in range(30)] + [(None, None, None, None, None, *range(len(names)))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in names))
    spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns, name
        for r in out.collect():
            assert list(r)[5:] == list(range(len(names))), name
    for f in (exactdedup.exact_dedup, simhash.near_duplicates, fingerprint.fingerprints, linededup.line_dedup, substring.without_repeats, lm.lm_scores, sharding.shard):
        assert f(df).count() == 31
    assert packing.pack(df, PATH).agg(F.countDistinct("doc_id")).first()[0] == 30


def test_rows_that_repeat_an_id_but_differ_elsewhere(spark):
    rows = [(7, "same text", i) for i in range(40)] + [(3, "SAME text", 1), (4, "other", 2), (4, "other", 2)]
    got = [sorted(map(tuple, exactdedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, x int").repartition(n)).collect())) for n in (2, 5)]
    assert got[0] == got[1] and [r[0] for r in got[0]] == [4, 7]


def _fingerprint(t):
    w = (t or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def _components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(docs, rows):
    fp = {r[0]: _fingerprint(r[1]) for r in rows}
    ids = sorted(fp)
    want = _components([(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 4], ids)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert {i: r.fp & (1 << 64) - 1 for i, r in got.items()} == fp
    assert {i: r.component_id for i, r in got.items()} == want
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == set(want.values())


@pytest.mark.parametrize("node_max", [1 << 18, 40])
def test_simhash_index_against_all_pairs(spark, node_max):
    """Dense and sparse fingerprints, under nodes of any size."""
    r = random.Random(4)
    codes = {r.getrandbits(64) for _ in range(600)}
    for c in list(codes)[:40]:
        for _ in range(8):
            for b in r.sample(range(64), r.randint(1, 6)):
                c ^= 1 << b
            codes.add(c)
    base = r.getrandbits(64)
    codes |= {base ^ 1 << a ^ 1 << b for a in range(30) for b in range(a)}
    codes = sorted(simhash._signed(c) for c in codes)
    a = np.array(codes).view(np.uint64)
    x, y = np.nonzero(np.triu(np.bitwise_count(a[:, None] ^ a[None]) <= 4, 1))
    want = _components([(codes[i], codes[j]) for i, j in zip(x, y, strict=True)], codes)
    df = spark.createDataFrame([(c,) for c in codes], "fp long")
    found = simhash.links(simhash.upper_nodes(df, len(codes), node_max)).collect()
    assert _components([(e.a, e.b) for e in found], codes) == want


def test_components(spark):
    r = random.Random(2)
    e = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(40)] + [(5, 5), (None, 3)]
    nodes = {x for p in e for x in p if x is not None}
    want = _components([p for p in e if None not in p], nodes)
    got = {r.node: r.root for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert all(got.get(n, n) == want[n] for n in nodes)


@pytest.mark.parametrize("weights", [None, {"0a": 3, "0b": 1, "0é": 1, "0": 1, "1": 1, "0z": 1}])
def test_packing_round_trip(docs, rows, weights):
    t = Tokenizer.from_file(PATH)
    want = {r[0]: [*t.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows}
    got = packing.pack(docs, PATH, weights=weights, with_ids=True).collect()
    at, seqs = defaultdict(int), defaultdict(int)
    for p in sorted(got, key=lambda p: (p.doc_id, p.start)):
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert ids == want[p.doc_id][p.start : p.start + p.length] and p.start == at[p.doc_id]
        assert p.ids_crc32 == zlib.crc32(p.ids) and p.doc_tokens == len(want[p.doc_id])
        at[p.doc_id] += p.length
    assert at == {k: len(v) for k, v in want.items()}
    for p in sorted(got, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == seqs[p.sequence_id]
        seqs[p.sequence_id] += p.length
    assert all(seqs[s] == 2048 for s in range(len(seqs) - 1)) and seqs[len(seqs) - 1] <= 2048


def test_packing_keeps_the_mixture(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("abcdefgh") for _ in range(r.randint(5, 60))), "s" + str(min(2, i % 6))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack(df, PATH).collect()
    source = {i: s for i, _, s in rows}
    every = Counter()
    per = defaultdict(Counter)
    for p in got:
        every[source[p.doc_id]] += p.length
        per[p.sequence_id][source[p.doc_id]] += p.length
    total = sum(every.values())
    for s in range(len(per) - 1):
        assert all(abs(per[s][k] / 2048 - every[k] / total) < 0.08 for k in every)


@pytest.mark.parametrize("sources", [3, 40])
def test_packing_keeps_the_mixture_of_long_documents(spark, sources):
    """Documents of several windows, and one of many: every window but the last still holds every source's share."""
    r = random.Random(4)
    rows = [(i, " ".join(r.choice("abcdefgh") for _ in range(r.choice([50, 3000, 9000]))), f"s{min(sources - 1, r.randrange(2 * sources))}") for i in range(60 + sources)]
    rows.append((1000, "a b " * 40000, "s1"))
    source = {i: s for i, _, s in rows}
    every, per = Counter(), defaultdict(Counter)
    for p in packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), PATH).collect():
        every[source[p.doc_id]] += p.length
        per[p.sequence_id][source[p.doc_id]] += p.length
    total = sum(every.values())
    distance = [sum(abs(per[w][k] / 2048 - every[k] / total) for k in every) / 2 for w in range(len(per) - 1)]
    assert len(distance) > 100 and max(distance) < 2 * sources / 2048 + 0.005


def test_mixing(docs, rows):
    measured, sources, pieces = mixing.mix(docs, block_words=4)
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    by = defaultdict(int)
    for r in rows:
        by[("1" if r[3] is None else "0" + r[3])] += size[r[0]]
    order = sorted(by)
    cap, w, target, left = {k: 2.0 * by[k] for k in order}, {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}, {}, 1.5 * sum(by.values())
    open_ = set(order)
    while True:
        share = {k: left * w[k] / sum(w[j] for j in open_) for k in open_}
        over = {k for k in open_ if share[k] > cap[k]}
        if not over:
            target |= share
            break
        for k in over:
            target[k] = cap[k]
            left -= cap[k]
        open_ -= over
    got = {r.source_key: r for r in sources.collect()}
    assert {k: r.source_size for k, r in got.items()} == dict(by)
    assert all(abs(got[k].target - target[k]) < 1e-6 for k in order)
    taken, at = defaultdict(int), defaultdict(int)
    for p in pieces.collect():
        assert 0 <= p.start and p.length > 0 and p.start + p.length <= size[p.doc_id]
        taken[p.source_key] += p.length
        at[p.doc_id] += p.length
    # A source gives a block for each slot that it was dealt, and no more than twice its size.
    slots = Counter(p.source_key for p in pieces.select("source_key", "slot").distinct().collect())
    assert all(abs(taken[k] - target[k]) <= 4 * 4 for k in order)
    assert all(taken[k] == min(4 * slots[k], 2 * by[k]) or slots[k] == 1 for k in order)
    assert all(at[i] <= 2 * size[i] for i in size)
    again = mixing.mix(docs, block_words=4)[2]
    cols = ["slot", "source_key", "round", "doc_id", "start", "length"]
    assert sorted(map(tuple, again.select(*cols).collect())) == sorted(map(tuple, pieces.select(*cols).collect()))


def test_mixing_follows_its_schedule(docs, monkeypatch):
    """The slots that a schedule deals to a source decide its words: a schedule that is off changes them."""
    words = lambda: {r.source_key: r.n for r in mixing.mix(docs, block_words=8)[2].groupBy("source_key").agg(F.sum("length").alias("n")).collect()}
    right = words()
    monkeypatch.setattr(mixing, "point", lambda slot, sequence="golden": F.pmod(slot, F.lit(2)) * (1 << 30))  # two points only
    wrong = words()
    assert sum(abs(right[k] - wrong.get(k, 0)) for k in right) > sum(right.values()) / 4


def test_blocks_of_rows_with_one_id(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit(1).alias("size"), F.col("id").alias("row"))
    got = [r.n for r in common.spread_hash(df, 1, ["doc_id", "size"], 100).groupBy("h").agg(F.count("*").alias("n")).collect()]
    assert sum(got) == 9000 and max(got) < 200


def test_low_discrepancy_points(spark):
    for sequence in ("golden", "van_der_corput"):
        u = [r.u for r in spark.range(5000).select(mixing.point(F.col("id"), sequence).alias("u")).collect()]
        if sequence == "golden":
            assert u == [(i * mixing.GOLDEN % 2**64) >> 32 for i in range(5000)]
        else:
            assert u == [int(f"{i:032b}"[::-1], 2) for i in range(5000)]
    big = spark.range(2**40, 2**40 + 50).select("id", mixing.point(F.col("id")).alias("u")).collect()
    assert all(r.u == (r.id * mixing.GOLDEN % 2**64) >> 32 for r in big)


def test_mixed_rows(docs, rows):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    text = {r[0]: r[1] for r in rows}
    for r in out.collect():
        assert r.n_chars == len(r.text) and (r.text == text[r.doc_id] or set(r.text.split()) <= set(text[r.doc_id].split()))


def test_fingerprints(docs, rows):
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    near = docs.sparkSession.createDataFrame([(got[a[0]].fingerprint, got[b[0]].fingerprint, a[0], b[0]) for a in rows for b in rows if a[0] < b[0]], "a string, b string, x long, y long")
    near = {(r.x, r.y): r.s for r in near.select("x", "y", fingerprint.likeness(F.col("a"), F.col("b")).alias("s")).collect()}
    shingles = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        shingles[r[0]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    errors = []
    for (x, y), s in near.items():
        a, b = shingles[x], shingles[y]
        errors.append(s - (len(a & b) / len(a | b) if a | b else 1.0))
    assert np.abs(errors).max() < 0.2 and abs(np.mean(errors)) < 0.02
    assert len(got[0].fingerprint) == 256 and got[1000].fingerprint == got[1001].fingerprint == "0" * 256


def _likeness(a, b):
    same = sum(x == y for x, y in zip(a, b, strict=True)) / len(a)
    return min(1.0, max(0.0, (same - 1 / 16) / (1 - 1 / 16)))


@pytest.mark.parametrize("per_block", [256, 7])
def test_edited_fingerprints(docs, rows, spark, monkeypatch, per_block):
    """The next document is found over borders of blocks, over gaps and an outlying id, and from the last to the first."""
    monkeypatch.setattr(fingerprint, "BLOCK", per_block)
    far = (1 << 60, "the last of all " * 9, "en", "a", 9, "k", 5, 6, 7, 8)
    every = spark.createDataFrame([*rows, far], SCHEMA).repartition(4)
    order = sorted([*rows, far])
    texts = {r[0]: r[1] or "" for r in order}
    fp = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(every).collect()}
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(every).collect()}
    assert len(got) == len(order)
    edited = {}
    for r, after in zip(order, [*order[1:], order[0]], strict=True):
        t, n = texts[r[0]], len(texts[r[0]]) // 4
        edited[r[0]] = t[: len(t) - n] + texts[after[0]][:n]
        x = got[r[0]]
        assert (x.n_chars, x.edited, x.fingerprint, x.next_fingerprint) == (len(t), edited[r[0]], fp[r[0]], fp[after[0]])
    of = fingerprint.fingerprints(spark.createDataFrame(list(edited.items()), "doc_id long, text string"))
    assert {r.doc_id: r.fingerprint for r in of.collect()} == {i: r.edited_fingerprint for i, r in got.items()}


def test_blocks_of_ids(spark):
    """In the order of ids and of nearly equal size, whatever the gaps between ids."""
    ids = [*range(3000), *range(10**9, 10**9 + 3000), 1 << 61, -(1 << 61), None]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    got = sorted((r.doc_id, r.block) for r in df.withColumn("block", common.id_blocks(df, len(ids), 20)).collect() if r.doc_id is not None)
    assert [b for _, b in got] == sorted(b for _, b in got)
    assert max(Counter(b for _, b in got).values()) <= 60


def test_queries_of_the_operators(spark, docs, rows, tmp_path):
    """The registered queries: one row a document (a piece for packing), with the contract's columns."""
    from quarryline.llm import queries as Q

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], i % 2) for i, r in enumerate(rows)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = {k: f(spark, str(tmp_path)).collect() for k, f in Q.QUERIES.items()}
    for k, got in out.items():
        assert sorted({r.doc_id for r in got}) == sorted(r[0] for r in rows) and (k == "op2_packing" or len(got) == len(rows)), k
    text = {r[0]: r[1] or "" for r in rows}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in out["op1_toxicity"]:
        assert r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    assert {r.doc_id: r.fingerprint for r in out["op3_simhash"]} == {i: f"{_fingerprint(t):016x}" for i, t in text.items()}
    for r in out["op4_mixing"]:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id])) and 0 <= r.taken <= 2 * r["size"] and r.target <= 2 * r.source_size
    fp = {r.doc_id: r for r in out["op5_fingerprints"]}
    order = sorted(fp)
    for i, after in zip(order, [*order[1:], order[0]], strict=True):
        n = len(text[i]) // 4
        assert fp[i].edited_sha256 == sha(text[i][: len(text[i]) - n] + text[after][:n])
        assert abs(fp[i].near_edited - _likeness(fp[i].fingerprint, fp[i].edited_fingerprint)) < 1e-9
        assert abs(fp[i].near_next - _likeness(fp[i].fingerprint, fp[after].fingerprint)) < 1e-9
    whole = lambda t: t.encode().decode()
    assert all(r.kept_sha256 == sha(whole(text[r.doc_id])) for r in out["op6_line_dedup"] if r.n_dropped == 0)
    words = {i: t.encode().split() for i, t in text.items()}
    assert all(r.kept_sha256 == hashlib.sha256(b" ".join(words[r.doc_id])).hexdigest() for r in out["op7_substring_dedup"] if r.n_removed == 0)
    assert all(r.law == "bytes" and 0 <= r.shard < 24 and r.grown_shard is None and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in out["op9_sharding"])
    assert sum(p.length for p in out["op2_packing"]) == sum({p.doc_id: p.doc_tokens for p in out["op2_packing"]}.values())


def test_rows_of_one_id_with_different_texts(spark):
    """Each row loses what repeats in its own text."""
    line = "a line of more than forty characters, found in many documents"
    rows = [(0, f"other first\nsecond {line}"), (0, f"{line}\nkept"), *[(i, line) for i in range(1, 7)], (None, line)]
    got = linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = sorted(r.kept_text for r in got if r.doc_id == 0)
    assert kept == ["kept", f"other first\nsecond {line}"]
    assert [r.kept_text for r in got if r.doc_id is None] == [line] and [r.n_dropped for r in got if r.doc_id == 6] == [0]
    passage = " ".join(f"w{i}" for i in range(30))
    rows = [(5, "a b c " + passage), (5, "another text " + passage), (7, passage + " end"), (9, "x " * 4), (None, passage)]
    got = substring.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(r.n_removed for r in got if r.doc_id == 5) == [0, 30]
    assert [r.kept_text for r in got if r.doc_id == 7] == ["end"] and [r.n_removed for r in got if r.doc_id is None] == [0]


def test_windows_with_one_key_and_other_words_are_not_removed(spark, monkeypatch):
    """The words of a repeat are held against those of its first place."""
    passage = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, passage), (2, "y " + passage)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.without_repeats(df).collect()} == {1: 0, 2: 40}
    runs = df.select(F.lit(2).cast("long").alias("doc_id"), F.lit(0).alias("start"), F.lit(1).cast("long").alias("first_doc"), F.lit(0).alias("first_start"), F.lit(2).alias("n")).distinct()
    texts = df.withColumnRenamed("text", "t")
    wrong = substring.with_first_words(texts, runs, 20).select("doc_id", "start", "n", "digest")
    monkeypatch.setattr(substring, "repeats", lambda *_: wrong)
    with pytest.raises(Exception, match="other words"):
        substring.without_repeats(df).collect()


def test_line_dedup(docs, rows):
    holders = defaultdict(set)
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    for r in rows:
        for s in (r[1] or "").split("\n"):
            holders[key(s)].add(r[0])
    got = {r.doc_id: r for r in linededup.line_dedup(docs).collect()}
    dropped = 0
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [s for s in lines if not (len(key(s)) >= 40 and len(holders[key(s)]) >= 5 and r[0] != max(holders[key(s)]))]
        assert (got[r[0]].n_lines, got[r[0]].n_dropped, got[r[0]].kept_text) == (len(lines), len(lines) - len(kept), "\n".join(kept))
        dropped += len(lines) - len(kept)
    assert dropped > 5


def test_substring_dedup(docs, rows):
    seen, removed = set(), 0
    got = {r.doc_id: r for r in substring.without_repeats(docs).collect()}
    for r in sorted(rows):
        w = (r[1] or "").encode().split()
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            gone[s : s + 20] |= k in seen
            seen.add(k)
        want = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()
        assert (got[r[0]].n_words, got[r[0]].n_removed, got[r[0]].kept_text) == (len(w), gone.sum(), want)
        removed += gone.sum()
    assert removed > 100


def test_lm_counts_and_distribution(docs, rows):
    c, tokens = Counter(), {}
    for r in rows:
        tokens[r[0]] = [*(r[1] or "").encode().lower().split(), b"\n"]
        if zlib.crc32(str(r[0]).encode()) % 7 != 2:
            c.update(tokens[r[0]])
    total, kinds = sum(c.values()), len(c)
    for r in lm.lm_scores(docs).collect():
        t = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(x in c for x in t), total)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert abs(r.base_score - sum(np.log10((c[x] + 1) / (total + kinds + 1)) for x in t)) < 1e-6
        assert -1e9 < r.score < 0


def _model(n_words: int, seed: int = 3) -> lm.Model:
    r = np.random.default_rng(seed)
    table = lm.Table([(f"w{i}", int(c)) for i, c in enumerate(sorted(r.integers(1, 500, n_words), reverse=True))])
    table.classes[: n_words // 2] = 1 + r.integers(0, lm.CLUSTERS, n_words // 2)
    table.prepare()
    mass = np.bincount(table.classes, weights=table.counts, minlength=lm.CLASSES)
    share = np.r_[np.log(table.counts / mass[table.classes]), np.zeros(1 + lm.EXTRA * lm.SUFFIXES)]
    w, bias = r.standard_normal((lm.ROWS, lm.CLASSES)), np.where(np.r_[True, mass[1:] > 0], r.standard_normal(lm.CLASSES), -1e9)
    return lm.Model(table, w, bias, share, r.standard_normal((lm.BEFORE, min(lm.FOCUS, n_words))))


@pytest.mark.parametrize("n_words", [40, 700])
def test_lm_probabilities_add_up_to_one(n_words):
    """Over all words and the end, after any history; both factors depend on the history."""
    model = _model(n_words)
    every = np.arange(n_words + 1, dtype=np.int32)  # the words and the end
    seen = []
    for history in ([], [0], [5, 0], [n_words - 1, 7], [3, 9, n_words - 2], [n_words + 5, 2, 2, 4]):
        ids = np.array([[*history, x] for x in every], np.int32).ravel()
        place = np.tile(np.arange(len(history) + 1), len(every))
        p = np.exp(model.log_probabilities(ids, place).reshape(len(every), -1)[:, -1])
        assert abs(p.sum() - 1) < 1e-4
        seen.append(p)
    within = [p[:20] / np.array([p[:n_words][model.table.classes == k].sum() for k in model.table.classes[:20]]) for p in seen]
    assert np.abs(within[1] - within[3]).max() > 1e-3


def test_lm_weights_of_pairs_fit_their_counts():
    """After the gradient steps a pair that occurs often in a class has about its share of what follows the word before."""
    n, classes = 6, np.array([1, 1, 1, 1, 2, 2])
    share = np.log(np.array([0.25, 0.25, 0.25, 0.25, 0.5, 0.5]))
    pairs, of_class = np.zeros((lm.BEFORE, n)), np.zeros((lm.BEFORE, lm.CLASSES))
    pairs[3] = [7000, 1000, 1000, 1000, 300, 700]
    of_class[3, 1], of_class[3, 2] = 10000, 1000
    w = lm.pair_weights(share, classes, pairs, of_class)
    got = np.exp(share + w) / lm.normaliser(share, classes, w)[:, classes]
    assert np.abs(got[3] - [0.7, 0.1, 0.1, 0.1, 0.3, 0.7]).max() < 0.01
    assert np.abs(got[0] - np.exp(share)).max() < 1e-9


def test_lm_scores_against_the_model_by_hand(spark, monkeypatch):
    """Words beyond the table are scored by a join; the table's size changes no count, and scores stay those of a model."""
    r = random.Random(12)
    rows = [(i, " ".join(r.choice("abcdefghij") * r.randint(1, 3) for _ in range(30))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    whole = {x.doc_id: x for x in lm.lm_scores(df).collect()}
    monkeypatch.setattr(lm, "TABLE", 9)
    cut = {x.doc_id: x for x in lm.lm_scores(df).collect()}
    assert all(abs(whole[i].base_score - cut[i].base_score) < 1e-6 and whole[i].n_known == cut[i].n_known for i in whole)
    mean = [sum(x.score for x in got.values()) / sum(x.n_tokens for x in got.values()) for got in (whole, cut)]
    assert abs(mean[0] - mean[1]) < 0.25 and mean[0] > -1.7


def test_lm_matrices_are_added_up_in_a_tree(spark):
    def run(frames):
        n = sum(len(f) for f in frames)
        yield lm._chunks("m", np.full((lm.CHUNK + 3, 2), n), float(n))

    parts = spark.range(0, 500, 1, 70).mapInPandas(run, lm._KINDS)
    got, weight = lm._summed(parts, {"m": (lm.CHUNK + 3, 2)})
    assert (got["m"] == 500).all() and weight == 500


def test_lm_beats_base_on_held_out(spark):
    r = random.Random(9)
    tongues = [["".join(r.choice(a) for _ in range(3)) for _ in range(80)] for a in ("abcd", "efgh", "ijkl")]
    rows = [(i, " ".join(r.choice(tongues[i % 3]) for _ in range(60))) for i in range(300)]
    got = lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert sum(g.score for g in got) > sum(g.base_score for g in got)


def test_lm_steps_do_not_depend_on_the_size_of_the_input():
    import inspect

    assert list(inspect.signature(lm.trained).parameters) == ["texts", "table"] and isinstance(lm.BATCH, int)


def test_sharding(docs, rows):
    got = {r.doc_id: r for r in sharding.shard(docs, 6).collect()}
    size = {r[0]: len((r[1] or "").encode()) + 8 for r in rows}
    assert {i: r.size for i, r in got.items()} == size
    assert all(got[r[0]].text_crc32 == zlib.crc32((r[1] or "").encode()) for r in rows)
    of = defaultdict(set)
    for r in rows:
        of[r[1]].add(got[r[0]].shard)
    assert all(len(x) == 1 for x in of.values())
    for s in {r.shard for r in got.values()}:
        slots = sorted(r.slot for r in got.values() if r.shard == s)
        assert slots == list(range(len(slots)))


def test_sharding_is_even(spark):
    r = random.Random(5)
    rows = [(i, "x" * r.randint(1, 200) + str(i), "s" + str(i % 4)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = [r.b for r in sharding.shard(df).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(size) == 24 and max(size) < 1.03 * min(size)


def test_sharding_of_uneven_groups(spark):
    """Groups of up to a tenth of a shard, and sources whose names begin alike: shards still differ by little."""
    r = random.Random(7)
    rows = [(i, "x" * int(min(9000, r.lognormvariate(6.5, 1.2))) + str(i), f"https://example.org/{i % 5}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = [x.b for x in sharding.shard(df).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(size) == 24 and max(size) < 1.05 * min(size) and sum(size) == sum(len(t) + 8 for _, t, _ in rows)
    points = sharding.groups_of(df.select("doc_id", F.col("source").alias("source_key"), F.length("text").alias("n"), F.length("text").cast("long").alias("size"), F.md5("text").alias("key"), F.col("doc_id").alias("row")))
    assert points.select("d_source").distinct().count() == 5


def test_toxicity(spark):
    r = random.Random(6)
    words = ["".join(r.choice("abcdefg") for _ in range(4)) for _ in range(300)]
    rows, labels = [], []
    for i in range(500):
        w = [r.choice(words) for _ in range(r.choice([5, 40, 150]))]
        toxic = i % 4 == 0
        for _ in range(2 * toxic):
            w.insert(r.randrange(len(w)), r.choice(["Idiot,", "moron", "scum."]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "word " * 9000 + "idiot " + "word " * 9000), (1003, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train_model(df, spark.createDataFrame([*labels, (1000, None), (None, 1)], "doc_id long, toxic int"))
    got = {x.doc_id: x for x in toxicity.score(df, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()}
    held = [i for i, _ in labels if got[i].held]
    right = np.mean([(got[i].score >= 0.5) == (i % 4 == 0) for i in held])
    assert right > 0.9
    assert got[1000].score == got[1001].score == got[1003].score and 0 <= got[1000].score <= 1
    assert all(got[i].held == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in rows)


def test_toxicity_reads_words_of_any_length():
    """Every byte of a long word, of words that are joined, and of a script without spaces counts."""
    long = "".join(chr(97 + i * i * 7 % 26) for i in range(60))
    assert len(toxicity.word_features(long)[1]) == 60
    for x in (long, "-".join(["word"] * 50) + "/idiot_" + long, "今天天气很好" * 20, "ab今天", "ภาษาไทย" * 9, "é" * 70):
        parts = toxicity.pieces(x)
        assert all(len(p) <= toxicity.PIECE and toxicity.pieces(p) == [p] for p in parts)
        assert set(x) - set("-/_") == set("".join(parts))
        for i in range(len(long) - 11):
            assert long not in x or any(long[i : i + 12] in p for p in parts)
    assert toxicity.pieces("idiot,") == ["idiot,"] and toxicity.pieces("-" * 99) == ["-"]
    r = random.Random(8)
    hanzi = [chr(0x4E00 + i) for i in range(60)]
    words = ["".join(r.choice("abcdefg") for _ in range(4)) for _ in range(200)]
    texts, labels = [], []
    for i in range(600):
        w = [r.choice(hanzi) if i % 2 else r.choice(words) for _ in range(r.choice([20, 60]))]
        for _ in range(2 * (i % 4 < 2)):
            w.insert(r.randrange(8, len(w) - 8), "笨蛋" if i % 2 else "idiot")
        texts.append(("" if i % 2 else "-").join(w))
        labels.append(int(i % 4 < 2))
    net = toxicity.Network()
    net.train(texts[:450], np.array(labels[:450]))
    got = toxicity.Scorer(net.p).scores(texts[450:])
    assert np.mean((got >= 0.5) == np.array(labels[450:])) > 0.95


def test_toxicity_reads_the_window_at_every_word():
    """Along a stream of texts, short, empty and long, windows have the logits that each has by itself."""
    r = np.random.default_rng(3)
    net = toxicity.Network(2)
    table = r.standard_normal((50, 6 * toxicity.HIDDEN)).astype(np.float32)
    each = [r.integers(1, 50, n).astype(np.int32) for n in (0, 40, 3, toxicity.WINDOW, toxicity.WINDOW + 1, 5000, 1)]
    stream = toxicity.Stream(each)
    assert stream.count.tolist() == [max(1, len(x) - toxicity.WINDOW + 1) for x in each]
    want = []
    for x in each:
        padded = np.pad(x, (0, max(0, toxicity.WINDOW - len(x))))
        alone = np.array([padded[i : i + toxicity.WINDOW] for i in range(len(padded) - toxicity.WINDOW + 1)])
        assert (stream.windows(stream.first[len(want)] + np.arange(len(alone))) == alone).all()
        want.append(net.forward(table, alone))
    assert np.abs(stream.logits(net, table) - np.concatenate(want)).max() < 1e-5


def test_gradients_of_the_network():
    net = toxicity.Network(1)
    r = np.random.default_rng(0)
    table, ids = r.standard_normal((9, 6 * toxicity.HIDDEN)), r.integers(0, 9, (3, toxicity.WINDOW))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    keep: dict = {}
    net.forward(table, ids, keep)
    grad, _ = net.backward(np.ones(3), keep)
    for k in ("uf", "ub", "a", "v", "o"):
        at = (0,) * net.p[k].ndim
        old = net.p[k][at]
        both = []
        for d in (1e-2, -1e-2):
            net.p[k][at] = old + d
            both.append(net.forward(table, ids).sum())
        net.p[k][at] = old
        assert abs((both[0] - both[1]) / 2e-2 - grad[k][at]) < 5e-3


def test_empty_tables(spark, nothing):
    assert exactdedup.exact_dedup(nothing).count() == 0 and exactdedup.deduplicated(nothing).count() == 0
    assert simhash.near_duplicates(nothing).count() == 0
    assert packing.pack(nothing, PATH).count() == 0
    assert mixing.mix(nothing)[2].count() == 0 and mixing.mixed(nothing).count() == 0
    assert fingerprint.fingerprints(nothing).count() == 0
    assert linededup.line_dedup(nothing).count() == 0
    assert substring.without_repeats(nothing).count() == 0
    assert lm.lm_scores(nothing).count() == 0
    assert sharding.shard(nothing).count() == 0
    model = toxicity.train_model(nothing, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(nothing, model).count() == 0


def test_null_ids_do_not_crash(spark):
    df = spark.createDataFrame([(None, "a b c", "s"), (None, None, None), (1, "a b c", "s")], "doc_id long, text string, source string")
    for f in (exactdedup.exact_dedup, simhash.near_duplicates, fingerprint.fingerprints, linededup.line_dedup, substring.without_repeats, lm.lm_scores, sharding.shard):
        assert f(df).count() == 3
    assert packing.pack(df, PATH).count() == 3 and mixing.mix(df)[0].count() == 3


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline as P

    r = random.Random(7)
    clean = [" ".join(r.choice(["apple", "river", "stone", "cloud", "green", "walks"]) + str(r.randint(0, 99)) for _ in range(60)) for _ in range(60)]
    foul = [" ".join(x if r.random() < 0.7 else r.choice(["vile", "scum", "filth", "hateful"]) for x in t.split(" ")) for t in clean[:40]]
    more = [(5000 + i, t, "en", "b", len(t), "k", 5, 6, 7, 8) for i, t in enumerate(clean + foul)]
    docs.unionByName(spark.createDataFrame(more, SCHEMA)).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i * 3, 0) for i in range(50)] + [(5000 + i, int(i >= 60)) for i in range(100)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == now.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
    left = {x.doc_id for x in spark.read.parquet(f"{tmp_path}/toxicity").collect()}
    assert sum(5060 + i in left for i in range(40)) <= 8 and sum(5000 + i in left for i in range(60)) >= 54
    want = {r.doc_id for r in spark.read.parquet(f"{tmp_path}/simhash_near_dedup").collect()}
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/exact_dedup").collect()}
    fp = {i: _fingerprint(t) for i, t in before.items()}
    assert want == set(_components([(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4], sorted(fp)).values())
    # every token of every reading of the mix is in one piece
    tokenizer, tokens = Tokenizer.from_file(PATH), Counter()
    for x in now.collect():
        tokens[x.doc_id] += len(tokenizer.encode(x.text or "", add_special_tokens=False).ids) + 1
    packed, windows = Counter(), defaultdict(list)
    for x in P.run(spark, str(tmp_path)).collect():
        packed[x.doc_id] += x.length
        windows[x.sequence_id].append((x.offset, x.length))
    assert packed == tokens
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_toxicity_tells_the_features_of_new_words_at_once(monkeypatch):
    """Words met together have the features of each by itself, and no call for each word."""
    each = toxicity.word_features
    monkeypatch.setattr(toxicity, "word_features", lambda w: pytest.fail("a call for each word"))
    v = toxicity.Vocabulary()
    assert len(v.features()[0]) == 0 and len(v.numbers("... ΑΣ. ΣΑΣΑ İx <> <a>b 中 Word, word é x\x00y")) == 11
    names = list(v.new)
    words, chars = v.features()
    assert len(names) == 11 and v.new == []
    for i, w in enumerate(names):
        assert (words[i], chars.flat[chars.start[i] : chars.start[i] + chars.count[i]].tolist()) == (each(w)[0], each(w)[1] or [0])

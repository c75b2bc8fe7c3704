"""op11 on pages whose main text is known, op12 against its SQL's arithmetic by hand, op13 against brute force."""

import hashlib
import html
import itertools
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarryline.llm import htmlextract, labelledpages, periodic, resampling
from quarryline.llm.htmltree import Tree

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return htmlextract.train_model(spark.read.parquet(f"{SF}/pages.parquet"))


def sentence(n: int, r=random.Random(5)) -> str:
    return " ".join(r.choice("lorem ipsum dolor sit amet elit sed do magna aliqua enim minim quis".split()) for _ in range(n)).capitalize() + "."


# Pages that are not among the labelled layouts, with their main text.
A, B, C, D = sentence(30), sentence(44), sentence(12), sentence(3)
MENU = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("one", "two", "three", "four"))
KNOWN = [
    (f'<body><nav><ul>{MENU}</ul></nav><article><h1>News</h1><p>{A}</p><div id="google_ads_1" class="adsbygoogle"><p>{B}</p></div><p>{C}</p></article><aside><h3>More</h3><p>{B}</p></aside><footer><p>{A}</p></footer></body>', f"News {A} {C}"),
    (f'<body><div id="onetrust-sdk" role="alertdialog" aria-label="Cookie banner"><p>{B}</p><button>Accept</button></div><header><div>{D}</div></header><main id="main-content"><h1>Head</h1><div class="article__body"><p>{A}</p><p>{D}</p></div></main><footer class="page-footer"><ul>{MENU}</ul></footer></body>', f"Head {A} {D}"),
    (f'<body><div class="header-outer"><h1>Blog</h1></div><div class="tabs-outer"><ul>{MENU}</ul></div><div class="post-outer"><h3 class="post-title">Post</h3><div class="post-body entry-content">{A}<br /><br />{B}<br>{C}</div></div><div class="comments" id="comments"><h4>2 comments</h4><div class="comment-block"><p>{C}</p></div></div></body>', f"Post {A} {B} {C}"),
    (f'<body><noscript>Enable it</noscript><script>document.write("<p>no</p>")</script><!-- <p>{A}</p> --><nav>menu<ul><li><a href=x>a</a><li><a href=y>b</a></ul></nav><article><h1>T &amp; U &lt;ok&gt;</h1><p>caf&eacute; &#8212; na&iuml;ve&nbsp;x <b>bo</b>ld<p>two\n\n  lines<ul><li>first item<li>second item</ul><table><tr><td>cell one<td>cell two</table></article>', "T & U <ok> café — naïve x bold two lines first item second item cell one cell two"),
    (f'<body><header><nav><ul>{MENU}</ul></nav><h2>Paper</h2></header><article><h1>Main</h1><p>{A}</p><p>{B}</p><div class="reader-comments"><article class="comment"><p>{A}</p></article></div></article><aside class="sidebar"><p>{B}</p></aside><div class="notice">{C}</div></body>', f"Main {A} {B}"),
    (f'<body><nav><ul>{MENU}</ul></nav><div class="ad">{A}</div><article><h1>Hi</h1><p>Be.</p></article><footer>&copy; x.com &middot; {C}</footer></body>', "Hi Be."),
    (f'<body><nav><ul>{MENU}</ul></nav><article><h1>Main thing</h1><p>Short text.</p></article><div class="comments"><p>{A}</p><p>{B}</p><p>{B}</p></div><footer><p>{B}</p></footer></body>', "Main thing Short text."),
    (f'<body><nav><ul>{MENU}</ul></nav><div class="ad">{C}</div><footer>&copy; x {D}</footer></body>', ""),
    ("just words", "just words"), ("", ""), (None, ""), ("<", "<"), ("a < b &lt; c", "a < b < c"), (" \n\t&nbsp; ", ""), ("<script>var x = '<p>';", ""), ("<!-- open", ""),
]


def test_html_known_pages(spark, model):
    rows = [(i, p, "x", "y") for i, (p, _) in enumerate(KNOWN * 2)]
    pages = spark.createDataFrame(rows, "page_id long, html string, `a.b` string, parent string").repartition(3)
    got = htmlextract.extract(pages, model)
    assert got.columns == [*pages.columns, "text"]
    for r in got.collect():
        assert r.text == (KNOWN * 2)[r.page_id][1], r.page_id
    assert htmlextract.extract(pages.limit(0), model).count() == 0
    assert set(htmlextract.extract(pages, model, out="html").columns) == set(pages.columns)  # a name that is there is replaced


def test_html_query_against_the_article(spark):
    """Every page of the table has one article element; its text, by a plain rule, is what the marginals find."""
    got = __import__("quarryline.llm.queries", fromlist=["QUERIES"]).QUERIES["op11_html_extraction"](spark, SF)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    got = {r.page_id: r for r in got.collect()}
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        inside = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", " ", inside)).split())
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_html_marginals_are_exact():
    """Messages against the sum over all labellings of small trees."""
    r = np.random.default_rng(2)
    trees = [Tree(p) for p in ("<div><p>a<p>b</div><nav>c</nav>", "<ul><li>a<li>b<ul><li>c</ul></ul>", "x")]
    f = htmlextract.Forest(trees)
    unary, pair = r.normal(size=f.features.shape[1]), r.normal(size=(f.pair.shape[1], 2, 2))
    node, both, log_z = htmlextract.marginals(f, unary, pair)
    theta, psi, total = f.features @ unary, np.tensordot(f.pair, pair, 1), 0.0
    for a, b in zip(f.first[:-1], f.first[1:], strict=True):
        z, sums, joint = 0.0, np.zeros((b - a, 2)), np.zeros((b - a, 2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            w = math.exp(sum(theta[a + i] * y[i] for i in range(b - a)) + sum(psi[a + i, y[f.parent[a + i] - a], y[i]] for i in range(1, b - a)))
            z += w
            for i in range(b - a):
                sums[i, y[i]] += w
                joint[i, y[max(f.parent[a + i] - a, 0)], y[i]] += w
        assert np.allclose(node[a:b], sums / z) and np.allclose(both[a + 1 : b], joint[1:] / z)
        total += math.log(z)
    assert abs(total - log_z) < 1e-8


def test_html_held_out_layouts():
    """Learnt without a layout, its pages' words are mostly told right; pages without names are told by their shape."""
    pages = labelledpages.pages()
    n = labelledpages.FILLINGS
    right = words = 0
    for out in range(0, len(labelledpages.LAYOUTS), 3):
        held = pages[out * n : (out + 1) * n]
        model = htmlextract.train(pages[: out * n] + pages[(out + 1) * n :])
        trees = [Tree(p) for p in held]
        f = htmlextract.Forest(trees)
        marks = np.concatenate([[-1 if m is None else m for m in t.marks] for t in trees])
        y = htmlextract.labels(f, marks, np.ones(len(trees), np.int64))
        told = htmlextract.marginals(f, model["unary"], model["pair"])[0][:, 1] >= 0.5
        right, words = right + f.own[told == y].sum(), words + f.own.sum()
    assert right / words > 0.9, right / words


def test_html_deep_and_long(model):
    deep = "<div>" * 3000 + "<p>" + A + "</p>"
    long = "<article>" + "".join(f"<p>{sentence(50)}</p>" for _ in range(3000)) + "</article>"
    got = htmlextract.main_texts([deep, long, "<b>" * 20000 + "x", "<button>" * 20000 + A, "<p " + "a='" * 5000], model)
    assert A in got[0] and got[1] == " ".join(re.findall(r"<p>(.*?)</p>", long)) and got[2] == "x" and A in got[3]


def words_of(text: str | None) -> list[str]:
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def by_hand(docs, bench, share, least):
    bucket = lambda w: zlib.crc32(w.encode()) % 10000
    s, t = (Counter(bucket(w) for x in xs for w in words_of(x)) for xs in ([d[1] for d in docs], bench))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
    out = []
    for i, text in docs:
        w = words_of(text)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(x)) for x in w)
        out.append((i, len(w), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    pool = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    return out, pool[: share * len(pool) // 100]


def test_resampling(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcÄé7") for _ in range(r.randint(1, 3)))
    docs = [(i * 7 % 500 - 100, r.choice([" ", "-", "\x00", "_"]).join(word().upper() for _ in range(r.choice([0, 5, 20, 60])))) for i in range(300)]
    docs += [(1 << 62, "x y " * 30), (-(1 << 62), "x y " * 30), (7001, None), (7002, ""), (None, "z " * 40), (None, None), (7003, "long " * 30000)]
    bench = [" ".join(word() for _ in range(30)) for _ in range(5)] + [None]
    want, drawn = by_hand(docs, bench, 10, 20)
    df = spark.createDataFrame([(*d, "s", 1, 2) for d in docs], "doc_id long, text string, score string, rank int, row long").repartition(5)
    got = resampling.resample(df, spark.createDataFrame([(b,) for b in bench], "text string")).collect()
    key = lambda x: (x is None, x or 0)
    assert sorted([tuple(x)[:4] for x in got], key=lambda x: (key(x[0]), x)) == sorted(want, key=lambda x: (key(x[0]), x))
    assert [x[:4] for x in sorted((x for x in got if x.rank), key=lambda x: x.rank)] == [tuple(x) for x in drawn]
    assert sorted(x.rank for x in got if x.rank) == list(range(1, len(drawn) + 1))


def test_resampling_ties_and_empty_tables(spark):
    bench = spark.createDataFrame([("a b",)], "text string")
    same = spark.createDataFrame([(3, "a b c " * 10)] * 50 + [(None, "a b c " * 10)] * 50, "doc_id long, text string").repartition(4)
    got = resampling.resample(same, bench, share=30).collect()
    assert sorted(x.rank for x in got if x.rank) == list(range(1, 31)) and len(got) == 100
    best = {x.score for x in got if x.rank}
    assert len(best) == 1 and min(best) == max(x.score for x in got)
    assert resampling.resample(same.limit(0), bench).count() == 0
    assert {x.weight for x in resampling.resample(same, bench.limit(0)).collect()} != {None}
    with pytest.raises(ValueError):
        resampling.resample(same, bench, share=101)


def test_radix_select(spark):
    r = random.Random(4)
    values = [(r.choice([-(1 << 63), (1 << 63) - 1, 0, r.randint(-5, 5), r.randint(-(1 << 40), 1 << 40)]), i) for i in range(400)]
    df = spark.createDataFrame(values, "a long, b long").repartition(3).cache()
    for k in (0, 1, 7, 100, 250, 399, 400, 500):
        assert sorted(map(tuple, df.where(resampling.radix_select(df, ["a", "b"], k)).collect())) == sorted(values)[:k]
    with pytest.raises(ValueError):
        resampling.radix_select(df.select(F.lit(1).cast("long").alias("a")), ["a"], 3)


def test_resampling_runs_of_words():
    f = resampling.Features(3, 1000)
    assert f.of(b"A b, c")[0] == 3
    assert f.of(b"A b, c")[1] == [zlib.crc32(x) % 1000 for x in (b"a", b"b", b"c", b"a b", b"b c", b"a b c")]


def runs(w: list[str]) -> list[tuple[int, int, int]]:
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            x = w[i : j + q]
            if len(x) >= max(6, 4 * q) and not any(x[d:] == x[:-d] for d in range(1, q)):
                out.append((i, len(x), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w: list[str], found) -> str:
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_against_brute_force():
    r = random.Random(1)
    for _ in range(60):
        docs = []
        for _ in range(r.randint(1, 12)):
            n, letters = r.choice([0, 1, 5, 6, 7, 20, 60, 150]), "abc"[: r.choice([1, 2, 2, 3])]
            w = [r.choice(letters) for _ in range(n)]
            if r.random() < 0.5 and n > 10:
                p, a = r.randint(1, n // 4), r.randint(0, n // 3)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            docs.append(w)
        n, found, kept = periodic._found(pa.array([" \t".join(d) + "\n" for d in docs]))
        for d, k, f, c in zip(docs, n.to_pylist(), found.to_pylist(), kept.to_pylist(), strict=True):
            want = runs(d)
            assert (k, [tuple(x.values()) for x in f], c) == (len(d), want, collapsed(d, want))


def test_extensions():
    r = np.random.default_rng(3)
    for n in (2, 5, 40, 300):
        x = r.integers(0, 2, n)
        x[n // 2 :] = x[: n - n // 2]
        i, j = r.integers(0, n, 200), r.integers(0, n, 200)
        i, j = i[i != j], j[i != j]
        want = [next((k for k in range(n) if max(a, b) + k >= n or x[a + k] != x[b + k]), n) for a, b in zip(i, j, strict=True)]
        assert periodic.Extensions(x).of(i, j).tolist() == want


def test_runs_on_rows(spark):
    rows = [(1, "a " * 50, "k", "c"), (1, "a " * 50, "k", "c"), (None, "x y " * 9 + "z", None, None), (2, None, None, None), (3, "", "", ""), (4, " \t\x0b", "", ""), (5, "b " * 200000, "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, `a.b` string").repartition(3)
    got = periodic.with_runs(df)
    assert got.columns == ["doc_id", "text", "a.b", "n_words", "runs", "collapsed"] and got.count() == len(rows)
    by = {(r.doc_id, r.text): r for r in got.collect()}
    assert [tuple(x) for x in by[5, rows[6][1]].runs] == [(0, 200000, 1)] and by[5, rows[6][1]].collapsed == "b"
    assert [tuple(x) for x in by[None, rows[2][1]].runs] == [(0, 18, 2)] and by[None, rows[2][1]].collapsed == "x y z"
    assert (by[2, None].n_words, by[2, None].runs, by[2, None].collapsed) == (0, [], "")
    assert periodic.with_runs(df.limit(0)).count() == 0


def test_runs_query(spark):
    query = __import__("quarryline.llm.queries", fromlist=["QUERIES"]).QUERIES["op13_periodic_runs"]
    got = {r.doc_id: r for r in query(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        n, h = len(w), zlib.crc32(str(d.doc_id).encode())
        if n > 4000:
            continue  # too long for brute force
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found, x = runs(w), got[d.doc_id]
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        assert (x.n_runs, x.start, x.length, x.period) == (len(found), *best)
        assert x.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert x.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert x.collapsed_sha256 == hashlib.sha256(collapsed(w, found).encode()).hexdigest()

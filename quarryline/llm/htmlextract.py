"""Main text of web pages by a graphical model with the shape of the page's tree.

Each block is a variable: main text or not. Its own features give a potential, and each block and the one around it share a
potential that depends on what the block is. Sum-product messages upward and downward give exact marginals; blocks
with a marginal of a half and more are the main text. Weights are those that make labelled pages likeliest, by gradients of
the same messages. All pages of a batch are one forest, so numpy passes the messages of a level at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready
from .htmltree import AGAINST, FOR, GROUPS, HINT_NAMES, Tree
from .labelledpages import pages as labelled_pages
from .labelledpages import plain

#: Pages of the table that label themselves, by one article element: so many at most, none of over MOST_CHARS.
SAMPLE, MOST_CHARS = 128, 1 << 16
STEPS, RATE, DECAY = 250, 0.08, 2e-3
#: Pages, and characters of them, that are one forest.
FOREST, FOREST_CHARS = 200, 1 << 22


class Forest:
    """Trees laid out as arrays, deepest levels first for messages upward."""

    def __init__(self, trees: list[Tree]) -> None:
        sizes = np.array([len(t.parent) for t in trees])
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        join = lambda name, kind=np.int64: np.concatenate([np.asarray(getattr(t, name), kind) for t in trees])
        self.page = np.repeat(np.arange(len(trees)), sizes)
        self.parent = join("parent") + np.where(join("parent") >= 0, self.first[self.page], 0)
        self.depth, self.group, self.hint = join("depth"), join("group"), join("hint")
        own = {k: join(k, np.float64) for k in ("words", "linked", "stops", "inputs", "says")}
        order = np.argsort(self.depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(self.depth[order])) + 1)
        whole = {k: v.copy() for k, v in own.items()}
        prose = np.where(self.group == 0, own["words"], 0.0)
        for level in self.levels[:0:-1]:
            for v in whole.values():
                np.add.at(v, self.parent[level], v[level])
            np.add.at(prose, self.parent[level], prose[level])
        self.own, self.words = own["words"], whole["words"]
        w, n = whole["words"], np.maximum(whole["words"], 1.0)
        total = np.maximum(w[self.first[:-1]], 1.0)[self.page]
        before = np.cumsum(own["words"])
        start = before - own["words"] - (before - own["words"])[self.first[:-1]][self.page]
        bits = (self.hint[:, None] >> np.arange(len(HINT_NAMES)) & 1).astype(np.float32)
        against, towards = (self.hint & AGAINST > 0).astype(np.float32), (self.hint & FOR > 0).astype(np.float32)
        kinds = np.eye(len(GROUPS) + 1, dtype=np.float32)[self.group]
        link = whole["linked"] / n
        numbers = [
            np.ones(len(w)), np.log1p(w) / 5, link, link * (w < 30), np.minimum(whole["stops"] / n, 0.5), w / total, (w / total) ** 2, prose / n, w < 4, w == 0,
            start / total, (start + w) / total > 0.98, start == 0, np.log1p(whole["inputs"]), np.minimum(whole["inputs"] / n, 1.0), whole["says"] > 0, (whole["says"] > 0) * (w < 40),
            (whole["inputs"] > 0) * (w / total > 0.5), against * towards, self.depth == 0, np.log1p(own["words"]) / 5,
        ]
        self.features = np.concatenate([np.stack(numbers, 1).astype(np.float32), kinds, bits], 1)
        # what a pair's potential depends on: the inner block, and what the outer one says of itself
        at = np.maximum(self.parent, 0)
        outer = np.stack([against[at], towards[at], self.group[at] == 2, np.isin(self.group[at], (9, 10, 11, 12, 13)), self.own[at] > 0], 1)
        inner = np.stack([np.ones(len(w)), against, towards, w < 4, link > 0.5, w / np.maximum(w[at], 1) > 0.5], 1)
        self.pair = np.concatenate([inner, kinds, outer], 1).astype(np.float32)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def marginals(f: Forest, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of all nodes [n, 2] and pairs [n, outer, inner] (those of roots mean nothing), and the sum of the log
    partition functions, by messages up the levels and down again."""
    theta = f.features.astype(np.float64) @ unary
    below = np.stack([np.zeros_like(theta), theta], 1)  # with all messages from inner blocks
    psi = np.tensordot(f.pair.astype(np.float64), pair, 1)
    up = np.zeros_like(below)
    for level in f.levels[:0:-1]:
        up[level] = _log_sum(psi[level] + below[level][:, None, :], 2)
        np.add.at(below, f.parent[level], up[level])
    full = below.copy()
    both = np.zeros_like(psi)
    for level in f.levels[1:]:
        outer = full[f.parent[level]] - up[level]
        joint = psi[level] + outer[:, :, None] + below[level][:, None, :]
        full[level] = _log_sum(joint, 1)
        joint -= joint.max((1, 2), keepdims=True)
        both[level] = np.exp(joint)
        both[level] /= both[level].sum((1, 2), keepdims=True)
    z = _log_sum(full, 1)
    return np.exp(full - z[:, None]), both, float(z[f.first[:-1]].sum())


def labels(f: Forest, marks: np.ndarray, default: np.ndarray) -> np.ndarray:
    """Labels of all nodes: a marked node and what is inside is main text or not; a node with words inside is what most of
    them are. default: for pages without a mark at the top."""
    own = np.empty(len(marks), np.int64)
    own[f.levels[0]] = default
    for level in f.levels:
        inside = level if level is not f.levels[0] else level[:0]
        own[inside] = own[f.parent[inside]]
        own[level] = np.where(marks[level] >= 0, marks[level], own[level])
    main = np.where(own == 1, f.own, 0.0)
    for level in f.levels[:0:-1]:
        np.add.at(main, f.parent[level], main[level])
    return np.where(f.words > 0, (main * 2 >= f.words).astype(np.int64), own)


def train(pages: list[str]) -> dict:
    """Weights from pages whose elements are marked by data-main="1" and "0"; a page without marks is all main text."""
    trees = [Tree(p) for p in pages]
    f = Forest(trees)
    marks = np.concatenate([[-1 if m is None else m for m in t.marks] for t in trees])
    y = labels(f, marks, np.ones(len(trees), np.int64))
    unary, pair = np.zeros(f.features.shape[1]), np.zeros((f.pair.shape[1], 2, 2))
    moment = [np.zeros_like(x) for x in (unary, unary, pair, pair)]
    inside = np.flatnonzero(f.parent >= 0)
    seen = np.zeros((len(y), 2, 2))
    seen[inside, y[f.parent[inside]], y[inside]] = 1
    features, edges = f.features.astype(np.float64), f.pair[inside].astype(np.float64)
    for step in range(1, STEPS + 1):
        node, both, _ = marginals(f, unary, pair)
        grads = [features.T @ (y - node[:, 1]) / len(trees), np.tensordot(edges.T, (seen - both)[inside], 1) / len(trees)]
        for k, (p, g) in enumerate(zip((unary, pair), grads, strict=True)):
            g = g - DECAY * p
            moment[2 * k] += 0.1 * (g - moment[2 * k])
            moment[2 * k + 1] += 0.001 * (g * g - moment[2 * k + 1])
            p += RATE * (moment[2 * k] / (1 - 0.9**step)) / (np.sqrt(moment[2 * k + 1] / (1 - 0.999**step)) + 1e-8)
    return {"unary": unary, "pair": pair}


def main_texts(htmls: list[str | None], model: dict) -> list[str]:
    """The main text of each page."""
    out: list[str] = []
    at = 0
    while at < len(htmls):
        last, size = at, 0
        while last < len(htmls) and last - at < FOREST and (last == at or size + len(htmls[last] or "") <= FOREST_CHARS):
            size += len(htmls[last] or "")
            last += 1
        trees = [Tree(h) for h in htmls[at:last]]
        f = Forest(trees)
        keep = marginals(f, model["unary"], model["pair"])[0][:, 1] >= 0.5
        out += [t.text(keep[a:b]) for t, a, b in zip(trees, f.first[:-1], f.first[1:], strict=True)]
        at = last
    return out


def self_labelled(pages: DataFrame, html_col: str = "html") -> list[str]:
    """At most SAMPLE pages, in the order of a hash, that label themselves: with one article element, which is marked as
    main text, and the rest as not. Half of them are given plain elements and no names."""
    html = F.col(f"`{html_col}`").cast("string")
    one = pages.select(html.alias("h")).where((F.length("h") <= MOST_CHARS) & (F.size(F.split(F.lower("h"), "<article[\\s>]")) == 2) & F.lower("h").contains("<body"))
    one = one.withColumn("key", F.xxhash64("h"))
    keys = [r[0] for r in one.select("key").distinct().orderBy("key").limit(SAMPLE).collect()]  # so tasks send no pages to choose from
    rows = sorted(one.where(F.col("key").isin(keys)).groupBy("key").agg(F.min("h").alias("h")).collect())  # SAMPLE pages at most
    out = []
    for k, r in enumerate(rows):
        low = r.h.lower()
        a, b = low.index("<article") + 8, low.index("<body") + 5
        if b > a:
            continue
        marked = r.h[:b] + ' data-main="0"' + r.h[b:a] + ' data-main="1"' + r.h[a:]
        out.append(plain(marked) if k % 2 else marked)
    return out


def train_model(pages: DataFrame | None = None, html_col: str = "html") -> dict:
    """The model, learnt on the driver from the labelled pages of this package and a bounded sample of pages."""
    return train(labelled_pages() + (self_labelled(pages, html_col) if pages is not None else []))


def extract(pages: DataFrame, model: dict, html_col: str = "html", out: str = "text") -> DataFrame:
    """Adds out: the main text of the whole page. Null and empty pages have an empty one, and so have pages without any.

    Character references are decoded; white space of any kind, also no-break, becomes one space, as does the place where a
    block or line ends. Scripts, styles, titles, form controls and drawings are never text; one that is not ended hides the
    rest of its page only if it is a script or style. Equal pages have equal texts. All rows and columns stay.
    """
    ready(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model)  # some hundred weights

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(main_texts([h if isinstance(h, str) else None for h in b], shared.value))

    return pages.withColumn(out, run(F.col(f"`{html_col}`").cast("string")))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: main texts of all pages, by a model learnt from labelled pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    out = extract(pages, train_model(pages))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

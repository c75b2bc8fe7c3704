"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints that differ in at most MAX_DIFF bits agree in at least two of the six blocks that the 64 bits are cut
into. The index's upper nodes are these shared masked bit patterns: a node (mask, pattern) for each of the 15 pairs
of blocks. Under a node its fingerprints are sorted by Gray rank, so that neighbours share long bit patterns; LEAF of
them make a leaf and FAN leaves a node, each with the mask of the bits on which all below agree. A search goes down
with the differences counted so far on shared bits and drops a whole group as soon as they exceed MAX_DIFF, or as soon
as all of it is linked already. Of a node's links only a spanning forest leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, ready, salted_join, written
from .components import components

WORDS, SEED, MAX_DIFF, BLOCKS = 4, 42, 4, 6
LEAF, FAN = 32, 16
#: Fingerprints under one upper node beyond which it is cut further by pairs of blocks of its other bits.
NODE_MAX = 1 << 18
_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def shingle_hashes(text: str, words: int = WORDS) -> list[int]:
    w = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if len(w) < words:
        return [_hash(b" ".join(w))] if w else []
    return list(map(_hash, map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))))


def fingerprints_of(texts: list[str], words: int = WORDS, chunk: int = 1 << 17) -> np.ndarray:
    """A signed 64-bit fingerprint for each text: a bit is 1 if it is set in over half of the shingles' hashes."""
    ones, n = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held: list[np.ndarray] = []
    owner: list[int] = []

    def flush() -> None:
        if held:
            h = np.concatenate(held)
            bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            starts = np.cumsum([0] + [len(x) for x in held[:-1]])
            np.add.at(ones, owner, np.add.reduceat(bits, starts, axis=0, dtype=np.int32))
            held.clear()
            owner.clear()

    size = 0
    for i, t in enumerate(texts):
        h = np.array(shingle_hashes(t, words), np.uint64)
        n[i] = len(h)
        for k in range(0, len(h), chunk):
            held.append(h[k : k + chunk])
            owner.append(i)
            size += len(held[-1])
            if size >= chunk:
                flush()
                size = 0
    flush()
    on = (2 * ones > n[:, None]).astype(np.uint8)
    return np.packbits(on, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed 64 bits)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "fp": fingerprints_of(f["t"].tolist())})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    return rows.mapInPandas(run, "doc_id long, fp long")


def _block_masks(bits: list[int]) -> list[int]:
    """Masks of each pair of BLOCKS nearly equal blocks of these bits."""
    cuts = [bits[len(bits) * i // BLOCKS : len(bits) * (i + 1) // BLOCKS] for i in range(BLOCKS)]
    return [sum(1 << b for b in x + y) for x, y in combinations(cuts, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def upper_nodes(codes: DataFrame, n: int, node_max: int = NODE_MAX) -> DataFrame:
    """mask, pattern, fp: each fingerprint under each of its nodes. A node of over node_max fingerprints gives way to
    the pairs of blocks of its remaining bits; any two of its fingerprints within MAX_DIFF meet there again."""
    masks = _block_masks(list(range(64)))
    nodes = codes.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask")).withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))
    if n <= node_max:
        return nodes
    nodes = written(nodes, "nodes")
    hot = nodes.groupBy("mask", "pattern").count().where(F.col("count") > node_max).drop("count")
    hot = written(hot, "hot")
    if not hot.limit(1).count():
        return nodes
    finer = [(_signed(m), _signed(m | x)) for m in masks for x in _block_masks([b for b in range(64) if not m >> b & 1])]
    table = codes.sparkSession.createDataFrame(finer, "mask long, finer long")  # 225 rows
    below = salted_join(nodes, hot, ["mask", "pattern"], "left_semi", "fp").join(F.broadcast(table), "mask")
    below = below.select("fp", F.col("finer").alias("mask")).withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))
    rest = nodes.join(hot, ["mask", "pattern"], "left_anti")
    return rest.select("fp", "mask", "pattern").union(below.select("fp", "mask", "pattern"))


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _linked(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of the component of each of n nodes, given links a-b."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        root = _roots(root)
    return root


def small_groups(fp: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups of at most LEAF codes each, one leaf a group: all differences at once."""
    left = np.repeat(size, size) - (np.arange(len(fp)) - np.repeat(start, size)) - 1  # codes after it in its group
    a, b = [], []
    for k in range(1, int(size.max(initial=1))):
        i = np.flatnonzero(left >= k)
        i = i[np.bitwise_count(fp[i] ^ fp[i + k]) <= MAX_DIFF]
        a.append(i)
        b.append(i + k)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def _shared(values: np.ndarray, masks: np.ndarray, fan: int) -> tuple[np.ndarray, np.ndarray]:
    """The pattern and mask that each run of `fan` nodes shares."""
    at = np.arange(0, len(values), fan)
    ones, zeros = np.bitwise_and.reduceat(values & masks, at), np.bitwise_and.reduceat(~values & masks, at)
    return ones, ones | zeros


def large_group(fp: np.ndarray) -> np.ndarray:
    """The first member of each code's component, for one group in Gray order."""
    n = len(fp)
    every = np.full(n, ~np.uint64(0))
    leaf, leaf_mask = _shared(fp, every, LEAF)
    top, top_mask = _shared(leaf, leaf_mask, FAN)
    root = np.arange(n)
    for i in range(len(leaf)):
        low, high = i * LEAF, min((i + 1) * LEAF, n)
        near = np.flatnonzero(np.bitwise_count((top ^ leaf[i]) & top_mask & leaf_mask[i]) <= MAX_DIFF)
        near = (near[:, None] * FAN + np.arange(FAN)).ravel()
        near = near[(near >= i) & (near < len(leaf))]
        near = near[np.bitwise_count((leaf[near] ^ leaf[i]) & leaf_mask[near] & leaf_mask[i]) <= MAX_DIFF]
        for part in np.array_split(near, max(1, len(near) // 512)):
            j = (part[:, None] * LEAF + np.arange(LEAF)).ravel()
            j = j[j < n]
            if (root[low:high] == root[low]).all():
                j = j[root[j] != root[low]]
            x, y = np.nonzero(np.bitwise_count(fp[low:high, None] ^ fp[None, j]) <= MAX_DIFF)
            x, y = root[x + low], root[j[y]]
            keep = x != y
            if keep.any():
                pairs = np.unique(np.stack([np.minimum(x, y)[keep], np.maximum(x, y)[keep]], 1), axis=0)
                root = _linked(pairs[:, 0], pairs[:, 1], n)[root]
    return root


def _forest(mask: np.ndarray, pattern: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (code, first of its component) in whole groups, sorted by mask, pattern and Gray rank."""
    start = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])])
    size = np.diff(np.r_[start, len(fp)])
    root = np.arange(len(fp))
    few = (size > 1) & (size <= LEAF)
    if few.any():
        at = np.flatnonzero(np.repeat(few, size))
        a, b = small_groups(fp[at], np.cumsum(size[few]) - size[few], size[few])
        root[at] = at[_linked(a, b, len(at))]
    for s, n in zip(start[size > LEAF], size[size > LEAF], strict=True):
        root[s : s + n] = s + large_group(fp[s : s + n])
    moved = np.flatnonzero(root != np.arange(len(fp)))
    return fp[moved], fp[root[moved]]


def links(nodes: DataFrame) -> DataFrame:
    """a, b: a spanning forest of the links under each node; the ends of an edge are linked, if not directly."""
    gray = F.col("fp")
    for shift in (1, 2, 4, 8, 16, 32):
        gray = gray.bitwiseXOR(F.shiftrightunsigned(gray, shift))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []

        def out(part: tuple[np.ndarray, ...]) -> pd.DataFrame:
            a, b = _forest(part[0], part[1], part[2].view(np.uint64))
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

        for f in frames:
            held.append((f["mask"].to_numpy(np.int64), f["pattern"].to_numpy(np.int64), f["fp"].to_numpy(np.int64)))
            if sum(len(x[0]) for x in held) < 1 << 16 and len(held) < 200:
                continue
            m, p, c = (np.concatenate(x) for x in zip(*held, strict=True))
            whole = len(m) - int(np.argmax(((m != m[-1]) | (p != p[-1]))[::-1])) if m[0] != m[-1] or p[0] != p[-1] else 0  # the last group may go on
            if whole:
                yield out((m[:whole], p[:whole], c[:whole]))
            held = [(m[whole:], p[whole:], c[whole:])]
        if held:
            m, p, c = (np.concatenate(x) for x in zip(*held, strict=True))
            if len(m):
                yield out((m, p, c))

    dealt = nodes.repartition("mask", "pattern").withColumn("gray", gray).sortWithinPartitions("mask", "pattern", "gray").drop("gray")
    return dealt.select("mask", "pattern", "fp").mapInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", node_max: int = NODE_MAX) -> DataFrame:
    """One row for each row of docs: doc_id, fp, component_id (the smallest doc_id reachable over links).

    Null, empty and blank texts have fingerprint zero and are linked like any other; texts of fewer words than a
    shingle have one, the whole. A null id is never a component's id unless a component has no other. Repeated rows
    are rows of the same component. Other columns are ignored; an empty table gives an empty result.
    """
    ready(docs.sparkSession)
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    codes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "codes")
    found = components(links(upper_nodes(codes.select("fp"), codes.count(), node_max)))
    known = codes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("members")).where("members > 1")
    named = salted_join(known.select("fp", "root"), least, ["root"], "inner", "fp").select("fp", "component_id")
    out = salted_join(rows, named, ["fp"], "left", "doc_id")
    return out.select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id names their component: one document of each group stays, with all its columns.

    Null and empty texts are one group. Rows that repeat the id that stays all stay (they are one document); a null id
    stays only in a component without any other. Columns may have any names; an empty table gives an empty result.
    """
    name = free_name("_stay", docs.columns)
    stay = near_duplicates(docs, id_col, text_col).where("doc_id = component_id or component_id is null").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(stay, F.col(id_col).eqNullSafe(F.col(name)), "left_semi")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    """op3: fingerprints of whole texts, linked at 4 or fewer differing bits."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

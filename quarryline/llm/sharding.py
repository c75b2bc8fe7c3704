"""Sharding by a K-d tree: nodes are split at distributed weighted medians along their widest metadata dimension until
each leaf has its share of the bytes. What leaves are over their share then goes, in small groups, to those under it.

The points are groups of equal texts, which stay together: their metadata are a function of the group (text length,
least doc_id, first source), their weight is all bytes of the group. A median is found by counting weights in
histograms that are narrowed round by round, for all nodes of a level at once; the driver gets a row for each bin of
these and one for each node, never a row for a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import block_bits, exclusive_sum, hash_block, ready, salted_join, source_key, with_sources, written

SHARDS, OVERHEAD = 24, 8
#: Bins of a histogram round, as bits; a key has 60 bits: a dimension's 28, and 32 of the text's hash, which break ties.
BIN_BITS, DIM_BITS, TIE_BITS = 12, 28, 32
#: Of equally wide ones the first is split; length comes last, as nodes of long texts are hard to balance.
#: Shards that differ by less than this part of the share are even; rounds in which others are levelled, at most.
EVEN, ROUNDS = 0.02, 6
DIMS = ("d_id", "d_source", "d_length")


def groups_of(rows: DataFrame) -> DataFrame:
    """One row for each distinct text, with its weight and dimensions, scaled to 0 .. 2^28 - 1."""
    g = rows.groupBy("key").agg(F.sum("size").alias("weight"), F.min("n").alias("n"), F.min("doc_id").alias("id"), F.min("source_key").alias("source_key"), F.min("row").alias("row"))
    # A source is its place among all, a row for each, so that sources whose names begin alike are apart.
    places = written(rows.groupBy("source_key").agg(F.lit(1).alias("one")).select("source_key", F.row_number().over(Window.orderBy("source_key")).cast("double").alias("d_source")), "sources")
    raw = with_sources(g, places).select("key", "weight", F.log2(F.col("n") + 2.0).alias("d_length"), F.coalesce(F.col("id").cast("double"), F.lit(0.0)).alias("d_id"), "d_source")
    raw = written(raw, "groups")
    ends = raw.agg(*[f(c).alias(f"{n}_{c}") for c in DIMS for n, f in (("lo", F.min), ("hi", F.max))]).first()
    top = (1 << DIM_BITS) - 1
    scaled = [(F.lit(0).cast("long") if not ends[f"hi_{c}"] or ends[f"hi_{c}"] <= ends[f"lo_{c}"] else F.round((F.col(c) - F.lit(ends[f"lo_{c}"])) / (ends[f"hi_{c}"] - ends[f"lo_{c}"]) * top).cast("long")).alias(c) for c in DIMS]
    tie = F.xxhash64("key").bitwiseAND(F.lit((1 << TIE_BITS) - 1))
    return raw.select("key", "weight", tie.alias("tie"), *scaled)


def split_level(points: DataFrame, nodes: dict[int, tuple[int, int]]) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """Splits every node (id: first shard, number of shards) of two shards and more."""
    open_ = {k: v for k, v in nodes.items() if v[1] > 1}
    spans = {r["node"]: r for r in points.groupBy("node").agg(F.sum("weight").alias("w"), *[F.min(c).alias(f"lo_{c}") for c in DIMS], *[F.max(c).alias(f"hi_{c}") for c in DIMS]).collect()}
    dim = {k: max(DIMS, key=lambda c, r=spans[k]: r[f"hi_{c}"] - r[f"lo_{c}"]) if k in spans else DIMS[0] for k in open_}
    by_node = lambda values, other: F.coalesce(*[F.when(F.col("node") == k, v) for k, v in values.items()], other)
    key = F.shiftleft(by_node({k: F.col(c) for k, c in dim.items()}, F.lit(0).cast("long")), TIE_BITS) + F.col("tie")
    keyed = points.withColumn("k", key)
    goal = {k: spans[k]["w"] * (open_[k][1] // 2) / open_[k][1] if k in spans else 0 for k in open_}
    base, below = dict.fromkeys(open_, 0), dict.fromkeys(open_, 0)  # the cut is in [base, base + 2^left), with `below` to its left
    left = DIM_BITS + TIE_BITS
    while left > 0:
        left -= BIN_BITS
        bin_ = F.shiftrightunsigned(F.col("k") - by_node({k: F.lit(v) for k, v in base.items()}, F.lit(0)), left)
        bins = keyed.where(F.col("node").isin(list(open_))).withColumn("bin", bin_).where(f"bin >= 0 and bin < {1 << BIN_BITS}").groupBy("node", "bin").agg(F.sum("weight").alias("w")).collect()
        each: dict[int, dict[int, int]] = {}
        for r in bins:
            each.setdefault(r["node"], {})[r["bin"]] = r["w"]
        for k in open_:
            at = 0
            for b, w in sorted(each.get(k, {}).items()):
                at = b
                if below[k] + w > goal[k]:
                    break
                below[k] += w
            base[k] += at << left
            if not left and 2 * (goal[k] - below[k]) > each.get(k, {}).get(at, 0):
                base[k] += 1  # the group at the cut is nearer to the goal on the left
    after: dict[int, tuple[int, int]] = {k: v for k, v in nodes.items() if v[1] == 1}
    for k, (first, n) in open_.items():
        after[2 * k], after[2 * k + 1] = (first, n // 2), (first + n // 2, n - n // 2)
    right = F.col("k") >= by_node({k: F.lit(v) for k, v in base.items()}, F.lit(0))
    moved = F.when(F.col("node").isin(list(open_)), F.col("node") * 2 + right.cast("int")).otherwise(F.col("node"))
    return keyed.withColumn("node", moved).drop("k"), after


def levelled(points: DataFrame, shards: int, groups: int, level: float) -> DataFrame:
    """Points (key, weight, tie, shard) with shards levelled: leaves are over or under the share by up to half a group at
    each cut above them, so leaves over `level` times it give small groups, as many as are over, to those under it."""
    have = {r["shard"]: r["w"] for r in points.groupBy("shard").agg(F.sum("weight").alias("w")).collect()}
    share = sum(have.values()) // shards
    goal = int(share * level)
    over = {s: w - goal for s, w in have.items() if w > goal}
    under = [(s, goal - have.get(s, 0)) for s in range(shards) if have.get(s, 0) < goal]
    if not over or not under or max(have.values()) - min(have.get(s, 0) for s in range(shards)) <= EVEN * share:
        return points
    look = lambda values: F.coalesce(*[F.when(F.col("shard") == s, F.lit(v)) for s, v in values.items()])
    least = min(max(v for _, v in under), max(over.values()))
    spare = points.withColumn("over", look(over)).where((F.col("weight") <= F.lit(least)) & (F.col("weight") <= F.col("over")))
    spare = spare.withColumn("block", F.shiftrightunsigned("tie", TIE_BITS - min(TIE_BITS, block_bits(groups))))
    spare = exclusive_sum(spare, ["shard"], "block", ["tie", "key"], "weight", "before").where(F.col("before") + F.col("weight") <= F.col("over"))
    spare = written(spare.select("key", "weight", "block", "tie"), "spare")
    queue = exclusive_sum(spare, [], "block", ["tie", "key"], "weight", "at")
    to, end = F.lit(None).cast("int"), 0
    for s, room in under:
        end += room
        middle = F.col("at") + F.floor(F.col("weight") / 2)
        to = F.coalesce(to, F.when(middle < end, F.lit(s)))
    moved = queue.select("key", to.alias("to")).where("`to` is not null")
    return points.join(moved, "key", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to")


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of docs: shards of nearly equal bytes, equal texts together.

    A group of equal texts with more bytes than a shard's share has a shard of its own that is larger. Null texts are
    one group, apart from empty ones. Rows of equal ids get slots of their own, in no stated order. Other columns are
    ignored; an empty table gives an empty result.
    """
    ready(docs.sparkSession)
    text = F.col(text_col).cast("string")
    n = F.coalesce(F.octet_length(text), F.lit(0))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), source_key(source_col).alias("source_key"), n.alias("n"), (n + OVERHEAD).cast("long").alias("size"), F.crc32(F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))).alias("text_crc32"), F.coalesce(F.unhex(F.md5(text)), F.lit(b"")).alias("key"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    points, nodes = groups_of(rows).withColumn("node", F.lit(1).cast("long")), {1: (0, shards)}
    while any(n > 1 for _, n in nodes.values()):
        points, nodes = split_level(points, nodes)
        points = written(points, "points")
    of = F.coalesce(*[F.when(F.col("node") == k, F.lit(first)) for k, (first, _) in nodes.items()])
    points = written(points.select("key", "weight", "tie", of.alias("shard")), "leaves")
    groups = points.count()
    for turn in range(ROUNDS):
        # At the share, then a little above it, so that those at the share take too, and below it, so that they give too.
        now = levelled(points, shards, groups, 1 + (0, EVEN / 2, -EVEN / 2)[turn % 3])
        if now is points:
            break
        points = written(now, "leaves")
    placed = salted_join(rows, points.select("key", "shard"), ["key"], "inner", "row")
    h = F.xxhash64(F.lit(13), "doc_id", "row")
    blocks = placed.withColumn("h", h).withColumn("one", F.lit(1).cast("long")).withColumn("block", hash_block(F.col("h"), block_bits(rows.count())))
    return exclusive_sum(blocks, ["shard"], "block", ["h", "row"], "one", "slot").select("doc_id", "size", "text_crc32", "shard", "slot")


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    """op9: 24 shards by the law of bytes."""
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""Connected components of an edge table, by rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, salted_join, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """(u, v) with u > v: hooks each node's neighbours to the smallest of them and the node."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    seen = salted_join(both, least, ["u"], "inner", "v")
    hooked = seen.where(F.col("v") > F.col("u")) if large else seen
    out = hooked.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest node that it is linked with, for nodes with a link to another node.

    Edges with a null end or with two equal ends are left out; repeated edges count once. The rounds, a logarithmic
    number, each end in a table in the shared folder; the driver sees only how many edges there are and their sum.
    """
    now = written(edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == mark or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark, old = state, now
        now = written(_star(_star(now, True), False), "edges")
        discard(old)

"""Exact dedup: a tree merge of sorted digest runs, with DataFrame operations only.

Each input partition makes a run of digests, sorted. In each round 2 ** FAN_BITS neighbouring runs are exchanged, part
by part (a part holds the digests of one hash of run and digest, so a run is spread over tasks), and merged in the
order of the digest by a sort aggregation: it reads each merged part once, in order, with one entry in memory.
An entry keeps the identifier that stays (the largest or the smallest), the number of rows behind it, and a second,
independent digest and the length, whose smallest and largest values must agree at every level. A digest of a third
of all rows is one entry a run before the first exchange, so no task sees its copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, quoted, ready, salted_join, written

#: Runs merged into one in each round (2 ** FAN_BITS).
FAN_BITS = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. lower() agrees with it on ASCII texts and is much faster there."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (SHA-256 of the text with A-Z lower-cased; null as empty), check (a second hash), n (bytes), run."""
    norm = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("t"))
    return norm.select(
        "doc_id",
        F.unhex(F.sha2("t", 256)).alias("digest"),
        F.xxhash64("t").alias("check"),
        F.octet_length("t").alias("n"),
        F.spark_partition_id().alias("run"),
    )


def sorted_runs(entries: DataFrame) -> DataFrame:
    return entries.sortWithinPartitions("run", "digest")


def merged(runs: DataFrame, keep: str) -> DataFrame:
    """The entries of sorted runs with one entry for each run and digest; in order within each task."""
    pick = F.max if keep == "max" else F.min
    # Aggregates of structs are kept by sort aggregation only, before the exchange and after it.
    out = runs.groupBy("run", "digest").agg(pick("keep_id").alias("keep_id"), F.sum("size").alias("size"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    unlike = F.raise_error(F.lit("two texts with one SHA-256 digest"))
    return out.withColumn("size", F.when(F.col("lo") == F.col("hi"), F.col("size")).otherwise(unlike.cast("long")))


def merged_runs(rows: DataFrame, n_runs: int, keep: str = "max") -> DataFrame:
    """digest, keep_id, group_size: the one run that is left after the rounds, of (doc_id, digest, check, n, run)."""
    seen = F.struct("check", "n")
    level = rows.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("size"), seen.alias("lo"), seen.alias("hi"), "run")
    left = max(n_runs, 2)
    while left > 1:
        level = merged(sorted_runs(level.withColumn("run", F.shiftright("run", FAN_BITS))), keep)
        left = -(-left // (1 << FAN_BITS))
    return level.select("digest", "keep_id", F.col("size").alias("group_size"))


def _marked(docs: DataFrame, id_col: str, text_col: str, keep: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows of exact_dedup with digest, row and first; and, if any, the (doc_id, digest) that stay but repeat."""
    ready(docs.sparkSession)
    rows = written(digests(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "digests")
    n_runs = rows.agg(F.max("run")).first()[0]
    groups = merged_runs(rows, (n_runs or 0) + 1, keep).where("group_size > 1")
    out = salted_join(rows.select("doc_id", "digest", "row"), groups, ["digest"], "left", "row")
    alone = F.col("group_size").isNull()
    out = out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "digest",
        "row",
    )
    # Rows that repeat the id that stays: all but the first of them go. Only rows with kept meet here.
    again = out.where("kept and group_size > 1").groupBy("digest").agg(F.min("row").alias("first_row"), F.count("*").alias("n")).where("n > 1").select("digest", "first_row")
    if again.isEmpty():
        return out, None
    again = written(again, "again")
    out = salted_join(out, again, ["digest"], "left", "row")
    return out.withColumn("kept", F.col("kept") & (F.col("first_row").isNull() | (F.col("first_row") == F.col("row")))).drop("first_row"), again


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. Rows of one id and equal text are copies as well: of them one is kept, since only one
    row of a group has kept = true. A null id stays only in a group without any other id (its keep_id is null).
    Other columns are ignored. An empty table gives an empty result.
    """
    return _marked(docs, id_col, text_col, keep)[0].drop("digest", "row")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of docs that stay, with all their columns, one of each group of equal texts.

    Of rows that repeat the id that stays, the one stays whose columns (but maps) have the least hash, so reruns agree.
    Null texts count as empty; a null id stays only in a group without any other id. Columns may have any names.
    """
    key, tie = free_name("_key", docs.columns), free_name("_tie", docs.columns)
    out, again = _marked(docs, id_col, text_col, keep)
    sha = F.sha2(ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), 256)
    of = lambda i, h: F.concat(F.coalesce(i.cast("string"), F.lit("null")), F.lit(" "), h)
    rows = docs.withColumn(key, of(F.col(id_col), sha))
    stay = out.where("kept").select(of(F.col("doc_id"), F.col("text_sha256")).alias(key))
    if again is None:
        return rows.join(stay, key, "left_semi").drop(key)
    twice = out.where("kept").join(again.select("digest"), "digest", "left_semi").select(of(F.col("doc_id"), F.col("text_sha256")).alias(key))
    once = rows.join(stay, key, "left_semi").join(twice, key, "left_anti").drop(key)
    plain = quoted(*[f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])  # no hash of maps, inner ones too
    many = rows.join(twice, key, "left_semi").withColumn(tie, F.xxhash64(F.lit(0), *plain))
    # min_by adds up before it shuffles, so no task sees the repeats of one id.
    one = many.groupBy(key).agg(F.min_by(F.struct(*quoted(*docs.columns)), tie).alias(tie)).select(f"{tie}.*")
    return once.union(one)


SQL = """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(d.t) as text_sha256 from d join g using (t)
"""


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """op10: copies of whole texts after lower-casing A-Z; the largest doc_id stays."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))



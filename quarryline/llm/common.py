"""What the operators share: the shared scratch folder, prefix sums in blocks, joins with hot keys."""

from __future__ import annotations

import atexit
import gc
import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Copies of the small side of a join whose large side may have hot keys.
SALTS = 8
#: Blocks that share one second-level block in a prefix sum.
FAN = 4096


def ready(spark: SparkSession) -> None:
    """Lets Python workers import this package and keeps Arrow batches of long texts small."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = root + (os.pathsep + have if have else "")
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. In local mode, as in tests, one of our own where it is
    unset; a cluster's executors and driver share no folder that this machine could make up, so there it must be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        folder = "file://" + tempfile.mkdtemp(prefix="quarryline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    atexit.register(_remove, spark, path)
    return out


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the folder is the cluster's to clean
        pass


def discard(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more, and lets Spark drop its shuffle files."""
    for t in tables:
        _remove(t.sparkSession, t._scratch)
    release(tables[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def source_key(source: str | Column) -> Column:
    """A source as a key without nulls that sorts by code point, null last."""
    c = F.col(source) if isinstance(source, str) else source
    return F.when(c.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), c.cast("string")))


def block_bits(rows: int, per_block: int = 2048) -> int:
    """Bits of a hash that cut `rows` rows into blocks of about per_block."""
    return max(0, min(40, (max(rows, 1) // per_block).bit_length()))


def hash_block(h: Column, bits: int) -> Column:
    """The leading bits of a 64-bit hash, so that blocks are in the (unsigned) order of the hash."""
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")


def spread_hash(df: DataFrame, seed: int, cols: list[str], most: int = 2048) -> DataFrame:
    """Adds h, a hash of cols for shuffled orders and blocks. Rows of one hash that occurs more than `most` times, as
    those without an id may, are told apart by the column row, so that no block of a hash holds them all."""
    df = df.withColumn("h", F.xxhash64(F.lit(seed), *cols))
    hot = df.groupBy("h").agg(F.ceil(F.count("*") / most).alias("_parts")).where("_parts > 1")
    if hot.isEmpty():
        return df
    df = salted_join(df, hot, ["h"], "left", "row")
    part = F.pmod(F.xxhash64("row"), F.col("_parts"))
    return df.withColumn("h", F.when(F.col("_parts").isNull(), F.col("h")).otherwise(F.xxhash64("h", part))).drop("_parts")


#: Equal parts into which ids are cut: cut points of this number go to the tasks, whatever the number of rows.
SEGMENTS, FIRST_CUTS = 4096, 64


def id_blocks(rows: DataFrame, count: int, per_block: int, id_col: str = "doc_id") -> Column:
    """A block of about per_block rows for each id, in the order of ids: ids are cut at quantiles, so that no outlying id
    or gap puts most rows in one block, and evenly between neighbouring cut points. A null id has block -1."""
    n = min(SEGMENTS, max(1, count // per_block))
    ends = rows.agg(F.min(id_col), F.max(id_col), F.percentile_approx(id_col, [i / n for i in range(n)], 16 * n)).first()
    if ends[0] is None:
        return F.lit(-1).cast("long")
    cuts = sorted({ends[0], *ends[2]})
    tops = [*cuts[1:], ends[1] + 1]
    inner = max(1, count // (len(cuts) * per_block))
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    id_, of = F.col(id_col), range(0, len(cuts), FIRST_CUTS)
    upto = lambda xs: F.size(F.filter(xs, lambda c: c <= id_))
    first = upto(longs(cuts[i] for i in of)) - 1
    at = first * FIRST_CUTS + upto(F.get(F.array(*[longs(cuts[i : i + FIRST_CUTS]) for i in of]), first)) - 1
    low, high = F.get(longs(cuts), at), F.get(longs(tops), at)
    within = F.floor((id_ - low.cast("double")) / (high - low.cast("double")) * inner)
    return F.when(id_.isNull(), F.lit(-1).cast("long")).otherwise(at.cast("long") * inner + F.least(within, F.lit(inner - 1)))


def free_name(name: str, taken: list[str]) -> str:
    """A column name that no column of taken has, whatever the case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def quoted(*names: str) -> list[str]:
    """Names as columns, also those with dots."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


def exclusive_sum(df: DataFrame, part: list[str], block: str, order: list, value: str, out: str) -> DataFrame:
    """Adds out: the sum of value over all rows of the same part that come before, by block and then by order.

    Blocks follow the order. Only rows of one block meet in a task; block sums are added up in two levels, so the
    one task that sees every second-level block gets a row for FAN blocks.
    """
    sums = df.groupBy(*part, block).agg(F.sum(value).alias("_sum")).withColumn("_super", F.floor(F.col(block) / FAN))
    inner = Window.partitionBy(*part, "_super").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*part).orderBy("_super").rowsBetween(Window.unboundedPreceding, -1)
    supers = sums.groupBy(*part, "_super").agg(F.sum("_sum").alias("_tot")).withColumn("_base", F.coalesce(F.sum("_tot").over(outer), F.lit(0))).drop("_tot")
    offsets = (
        sums.withColumn("_in", F.coalesce(F.sum("_sum").over(inner), F.lit(0)))
        .join(supers, [*part, "_super"])
        .select(*part, block, (F.col("_in") + F.col("_base")).alias("_off"))
    )
    rows = Window.partitionBy(*part, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_run", F.coalesce(F.sum(value).over(rows), F.lit(0)))
        .join(offsets, [*part, block])
        .withColumn(out, (F.col("_run") + F.col("_off")).cast("long"))
        .drop("_run", "_off")
    )


def salted_join(large: DataFrame, small: DataFrame, keys: list[str], how: str, salt_by: str, salts: int = SALTS) -> DataFrame:
    """large join small on keys, where a key of large may be hot and small has a row for each key: small is copied
    to `salts` salts and large dealt over them by a hash of salt_by. AQE splits what is still large."""
    a = large.withColumn("_salt", F.pmod(F.xxhash64(F.col(salt_by)), F.lit(salts)).cast("int"))
    b = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return a.join(b, [*keys, "_salt"], how).drop("_salt")


def with_sources(rows: DataFrame, per_source: DataFrame, most: int = 10_000) -> DataFrame:
    """rows, with a column row, joined with a table that has a row for each source: sent to all tasks if it has at most
    `most` rows, salted otherwise, as a source may hold a third of all rows."""
    if per_source.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(per_source), "source_key")
    return salted_join(rows, per_source, ["source_key"], "inner", "row")

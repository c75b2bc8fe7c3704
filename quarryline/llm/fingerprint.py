"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

With DataFrame functions only. Each shingle of five words is hashed once; the leading bits choose one of BINS bins and
the least hash of a bin is its value. An empty bin takes the value of the first bin with one in a pseudo-random order
of its own, the same for all documents (a universal hash of the bin and the attempt, then of the bin and the place).
Of each value, hashed with its bin so that bins filled by one value do not agree by one chance,
the BITS low-order bits are kept, as one hex digit of the fingerprint. Two fingerprints' likeness is the
share of equal digits with the part that agrees by chance (2 ** -BITS) taken out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FAN, id_blocks, ready, written

WORDS, BIN_BITS, BITS = 5, 8, 4
BINS = 1 << BIN_BITS
#: Attempts by hash before an empty bin looks at all bins that have a value.
ATTEMPTS = 10
#: Documents in one block of neighbours, about.
BLOCK = 256
_WHITE = "[\\x20\\x09-\\x0D]+"


def _probe(b: int, t: int) -> int:
    """The bin that bin b tries in attempt t: a rule, in place of a table."""
    x = (b * 0x9E3779B1 + (t + 1) * 0x85EBCA77) & 0xFFFFFFFF
    x = ((x ^ x >> 16) * 0x7FEB352D) & 0xFFFFFFFF
    x = ((x ^ x >> 15) * 0x846CA68B) & 0xFFFFFFFF
    return (x ^ x >> 16) % BINS


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds out: BINS hex digits, all zero for a text without words.

    Each step is a column of its own that is used at least twice, so that nothing is computed again within a lambda.
    """
    df = df.withColumn("_w", F.transform(F.array_remove(F.split(F.col(text), _WHITE), ""), lambda w: F.xxhash64(w)))
    # slice() would copy the whole array for each shingle, so places are read one by one.
    places = F.sequence(F.lit(0), F.size("_w") - WORDS)
    shingles = F.transform(places, lambda i: F.xxhash64(*[F.col("_w")[i + k] for k in range(WORDS)]))
    hashes = F.when(F.size("_w") >= WORDS, shingles).when(F.size("_w") > 0, F.array(F.xxhash64("_w"))).otherwise(F.array().cast("array<bigint>"))
    # Each bin also gets the largest hash that it can hold, so that the sorted hashes have a first one in every bin;
    # bins come in the order of signed hashes.
    rest = (1 << (64 - BIN_BITS)) - 1
    ends = F.transform(F.sequence(F.lit(-BINS // 2), F.lit(BINS // 2 - 1)), lambda b: F.shiftleft(b.cast("long"), 64 - BIN_BITS).bitwiseOR(F.lit(rest)))
    df = df.withColumn("_h", F.sort_array(F.concat(hashes, ends)))
    bin_ = lambda h: F.shiftright(h, 64 - BIN_BITS)
    df = df.withColumn("_d", F.filter("_h", lambda h, i: (i == 0) | (bin_(h) != bin_(F.col("_h")[i - 1]))))
    empty = lambda v: v.bitwiseAND(F.lit(rest)) == F.lit(rest)
    df = df.withColumn("_full", F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: ~empty(F.col("_d")[j])))
    probe = lambda b, t: F.col("_d")[F.array(*[F.lit(_probe(x, t)) for x in range(BINS)])[b]]
    tries = [probe for _ in range(ATTEMPTS)]
    last = lambda b: F.col("_d")[F.array_min(F.transform("_full", lambda j: F.struct(F.xxhash64(b, j).alias("r"), j.alias("j"))))["j"]]

    def filled(v: Column, b: Column) -> Column:
        c = F.when(~empty(v), v)
        for t, at in enumerate(tries):
            c = c.when(~empty(at(b, t)), at(b, t))
        return c.otherwise(last(b))

    digit = lambda v, b: F.substring(F.lit("0123456789abcdef"), (F.xxhash64(v, b).bitwiseAND(F.lit((1 << BITS) - 1)) + 1).cast("int"), F.lit(1))
    digits = F.array_join(F.transform("_d", lambda v, b: digit(filled(v, b), b)), "")
    return df.withColumn(out, F.when(F.size("_full") == 0, F.repeat(F.lit("0"), BINS)).otherwise(digits)).drop("_w", "_h", "_d", "_full")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal values, estimated from two fingerprints, in 0 .. 1."""
    same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    chance = 1.0 / (1 << BITS)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (same / float(BINS) - chance) / (1.0 - chance)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of each row of docs. Null texts are empty; texts without words have a fingerprint of zeros,
    equal texts equal ones. Null ids and repeated rows have a row each, as any other. Other columns are ignored; an empty
    table gives an empty result."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    return with_fingerprint(rows, "t", "fingerprint").drop("t")


def with_next(rows: DataFrame, count: int, cols: list[str]) -> DataFrame:
    """Adds next_<col>: of the row after it in the order of (doc_id, n, crc), after the last of the first. Rows without
    an id come first; rows equal in all three are in any order; a row alone is followed by itself.

    Rows meet in blocks of BLOCK neighbouring ids, about; the last of a block gets the next block's first row by a join.
    """
    rows = rows.withColumn("block", id_blocks(rows, count, BLOCK))
    order = ["doc_id", "n", "crc"]
    w = Window.partitionBy("block").orderBy(*order)
    here = rows
    for c in cols:
        here = here.withColumn(f"next_{c}", F.lead(c).over(w))
    here = here.withColumn("_last", F.lead(F.lit(True)).over(w).isNull())
    # Of the blocks' first rows only their numbers are found over all rows; the rest is read for these alone.
    blocks = written(rows.groupBy("block").agg(F.min(F.struct(*order, "row")).alias("first")).withColumn("super", F.floor(F.col("block") / FAN)), "blocks")
    supers = blocks.groupBy("super").agg(F.min("block").alias("b0")).withColumn("after", F.lead("b0").over(Window.orderBy("super")))
    first = blocks.agg(F.min("block")).first()[0]
    follow = blocks.withColumn("follows", F.lead("block").over(Window.partitionBy("super").orderBy("block"))).join(supers, "super")
    follow = follow.select(F.col("block").alias("prev"), F.coalesce("follows", "after", F.lit(first)).alias("block"))
    heads = rows.select("row", *cols).join(blocks.select("block", F.col("first.row").alias("row")), "row")
    ends = heads.join(follow, "block").select(F.col("prev").alias("block"), F.lit(True).alias("_last"), F.struct(*cols).alias("head"))
    out = here.join(ends, ["block", "_last"], "left")
    for c in cols:
        out = out.withColumn(f"next_{c}", F.when(F.col("_last"), F.col(f"head.{c}")).otherwise(F.col(f"next_{c}")))
    return out.drop("_last", "head", "block")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited, fingerprint, edited_fingerprint, next_fingerprint for each row of docs.

    The edited text is the text with its last floor(n_chars / 4) code points replaced by the first as many, or all, of
    the next document's, in the order of doc_id, after the last the first. Null texts are empty; `with_next` says what
    repeated and null ids do. Other columns are ignored; an empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = with_fingerprint(texts, "t", "fp").withColumn("n", F.length("t").cast("long")).withColumn("crc", F.crc32(F.encode("t", "UTF-8")))
    # Written, as hashing the shingles is what costs and two plans read the rows.
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    out = with_next(rows, rows.count(), ["t", "fp"])
    cut = F.floor(F.col("n") / 4).cast("int")
    out = out.withColumn("edited", F.concat(F.substring(F.col("t"), F.lit(1), (F.col("n") - cut).cast("int")), F.substring(F.col("next_t"), F.lit(1), cut)))
    out = with_fingerprint(out.drop("t", "next_t"), "edited", "edited_fp")
    return out.select("doc_id", F.col("n").alias("n_chars"), "edited", F.col("fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"), F.col("next_fp").alias("next_fingerprint"))


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    """op5: whole texts and their edited forms."""
    ready(spark)
    out = edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    near = lambda c: likeness(F.col("fingerprint"), F.col(c))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"))

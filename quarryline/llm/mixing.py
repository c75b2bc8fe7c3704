"""Mixing sources to target weights by a low-discrepancy schedule.

Slots 0, 1, 2 ... get the points of the golden-ratio sequence (or of van der Corput's), and a point falls into the
part of [0, 1) that its source's share of the mix covers; so any run of slots holds every source about in proportion.
Slots are ranked within their source, and the r-th slot of a source takes the r-th block, of a fixed number of words,
of its shuffled documents. So the schedule alone decides how many words a source gives: the slots that it was dealt, a
block for each, which a low-discrepancy sequence keeps within a few blocks of the target at any length. A source whose
slots go beyond its size is read round again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import block_bits, exclusive_sum, free_name, hash_block, quoted, ready, source_key, spread_hash, with_sources, written

#: Words in a block: what a slot takes, at every size of the corpus.
BLOCK_WORDS = 64
#: Parts of [0, 1) by which slots find their source; a hot source covers many of them.
CELLS = 4096
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
GOLDEN = 0x9E3779B97F4A7C15
WORD = "[^\\x20\\x09-\\x0D]+"


def point(slot: Column, sequence: str = "golden") -> Column:
    """The slot's point in [0, 1) as a 32-bit integer."""
    if sequence == "golden":
        low, high = GOLDEN & 0xFFFFFFFF, GOLDEN >> 32
        # the upper half of slot * GOLDEN modulo 2^64, in 64-bit signed arithmetic, for slots below 2^31 and beyond
        a, b = slot.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(slot, 32).bitwiseAND(F.lit(0xFFFFFFFF))
        part = lambda x, y: _low32_product(x, y)
        carry = F.shiftrightunsigned(_product(a, low), 32)
        return (carry + part(a, high) + part(b, low)).bitwiseAND(F.lit(0xFFFFFFFF))
    if sequence == "van_der_corput":
        x = slot.bitwiseAND(F.lit(0xFFFFFFFF))
        for step, mask in ((16, 0x0000FFFF), (8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            x = F.shiftrightunsigned(x, step).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(mask)), step))
        return x
    raise ValueError(f"no such sequence: {sequence}")


def _product(x: Column, y: int) -> Column:
    """x * y modulo 2^64 for 32-bit x and y, as its two halves added with wrap-around kept out of ANSI checks."""
    low, high = x * F.lit(y & 0xFFFF), x * F.lit(y >> 16)  # 48 bits each
    sum_low = low.bitwiseAND(F.lit(0xFFFF)).bitwiseOR(F.shiftleft(F.shiftrightunsigned(low, 16) + high, 16))
    return sum_low


def _low32_product(x: Column, y: int) -> Column:
    return _product(x, y).bitwiseAND(F.lit(0xFFFFFFFF))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds target to (source_key, source_size): `share` times all sizes dealt by weight, where no source gets over
    `most` times its size and the excess is dealt again. Sources are few rows; they meet in one task as rows, sorted."""
    ranked = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(Window.orderBy("source_key")) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    # With sources in the order of cap / weight, those that stop at their cap come first.
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "source_key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    ranked = ranked.withColumn("_level", level).withColumn("_place", F.row_number().over(order))
    # The first that does not stop gives the words per unit of weight of all that do not.
    first = F.min(F.when(F.col("_cap") > F.col("_w") * F.col("_level"), F.struct("_place", "_level"))).over(whole)
    final = F.when(first.isNull() | (F.col("_place") < first["_place"]), F.col("_cap")).otherwise(F.least("_cap", F.col("_w") * first["_level"]))
    return ranked.withColumn("target", final).select("source_key", "source_size", "target")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source_key, size (words), row."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        source_key(source_col).alias("source_key"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.monotonically_increasing_id().alias("row"),
    )


def schedule(shares: DataFrame, slots: int, sequence: str = "golden") -> DataFrame:
    """slot, source_key, slot_rank: the source of each slot and the slot's rank among those of the source."""
    spark = shares.sparkSession
    all_ = Window.partitionBy()
    upto = F.sum("target").over(Window.orderBy("source_key")) / F.sum("target").over(all_)
    one = float(1 << 32)
    ends = shares.where("target > 0").withColumn("high", F.round(upto * one).cast("long"))
    ends = ends.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("source_key")), F.lit(0).cast("long"))).where("low < high")
    width = (1 << 32) // CELLS
    cells = ends.select("source_key", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))).alias("cell"))
    drawn = spark.range(slots).withColumnRenamed("id", "slot").withColumn("u", point(F.col("slot"), sequence)).withColumn("cell", F.floor(F.col("u") / width))
    placed = drawn.join(cells, "cell").where("u >= low and u < high").select("slot", "source_key").withColumn("one", F.lit(1).cast("long")).withColumn("block", F.floor(F.col("slot") / 4096))
    return exclusive_sum(placed, ["source_key"], "block", ["slot"], "one", "slot_rank").select("slot", "source_key", "slot_rank")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, sequence: str = "golden", block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, sources, pieces): the measured documents; source_key, source_size, target; and the mix itself, as
    slot, source_key, round, row, doc_id, start, length, where the piece is words start to start + length of the
    document in the round-th reading of its source.

    A slot takes block_words words, so a source's words are its slots times that, and differ from its target by the
    few blocks of the sequence's discrepancy. A source stops at `most` times its size, within a slot if need be. A
    source with a target on which no point falls gets one slot after the others, of at most its target's words.

    Null and empty texts have no words and are never in the mix. Rows with equal ids are mixed one by one. Sources
    sort by code point with null last. Other columns are ignored. An empty table gives empty results.
    """
    ready(docs.sparkSession)
    rows = written(measured(docs, id_col, text_col, source_col), "measured") if rows is None else rows
    sources = written(targets(rows.groupBy("source_key").agg(F.sum("size").alias("source_size")), weights, share, most), "sources")
    count = rows.count()
    total = sources.agg(F.coalesce(F.sum(F.floor("target")), F.lit(0))).first()[0]
    slots = -(-total // block_words)
    drawn = written(schedule(sources, slots, sequence), "slots")
    per = drawn.groupBy("source_key").agg(F.count("*").alias("n_slots"))
    per = sources.where("target >= 1").join(per, "source_key", "left")
    most_words = F.when(F.col("n_slots").isNull(), F.floor("target")).otherwise(F.floor(F.lit(float(most)) * F.col("source_size")))
    per = per.select("source_key", "source_size", "n_slots", F.least(F.coalesce("n_slots", F.lit(1).cast("long")) * block_words, most_words).alias("take"))
    late = per.where("n_slots is null").select((F.lit(slots) + F.row_number().over(Window.orderBy("source_key")) - 1).cast("long").alias("slot"), "source_key", F.lit(0).cast("long").alias("slot_rank"))
    drawn = drawn.union(late)

    placed = spread_hash(rows.where("size > 0"), 11, ["doc_id", "size"]).withColumn("block", hash_block(F.col("h"), block_bits(count)))
    placed = exclusive_sum(placed, ["source_key"], "block", ["h", "row"], "size", "begin")
    readings = with_sources(placed, per).withColumn("round", F.explode(F.sequence(F.lit(0), F.expr("cast((take - 1) div source_size as int)"))))
    at = readings.withColumn("from", F.col("begin") + F.col("round") * F.col("source_size")).withColumn("to", F.least(F.col("from") + F.col("size"), F.col("take"))).where("from < to")
    cut = at.withColumn("slot_rank", F.explode(F.expr(f"sequence(`from` div {block_words}, (`to` - 1) div {block_words})")))
    cut = cut.withColumn("a", F.greatest(F.col("from"), F.col("slot_rank") * block_words)).withColumn("b", F.least(F.col("to"), (F.col("slot_rank") + 1) * block_words))
    pieces = cut.join(drawn, ["source_key", "slot_rank"]).select("slot", "source_key", "round", "row", "doc_id", (F.col("a") - F.col("from")).alias("start"), (F.col("b") - F.col("a")).alias("length"))
    return rows, sources, pieces


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", n_col: str | None = "n_chars", **options) -> DataFrame:
    """The mix as rows with the columns of docs: a row for each reading of a document, whole if all its words are taken.

    Where the mix ends within a document its text is cut to the words taken, joined by one space (its line ends and
    other white space go), and n_col is counted anew. Null and empty texts and texts of white space take no part.
    Rows of equal ids are mixed one by one; columns of docs may have any names.
    """
    row, start, length, words = (free_name(n, docs.columns) for n in ("_row", "_start", "_length", "_words"))
    held = written(docs.withColumn(row, F.monotonically_increasing_id()), "mixed")
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = held.select(F.col(id_col).cast("long").alias("doc_id"), source_key(source_col).alias("source_key"), size.alias("size"), F.col(row).alias("row"))
    rows, _, pieces = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, rows=written(rows, "measured"), **options)
    taken = pieces.groupBy("row", "round").agg(F.min("start").alias(start), F.sum("length").alias(length))
    taken = taken.join(rows.select("row", F.col("size").alias(words)), "row").select(F.col("row").alias(row), start, length, words)
    out = held.join(taken, row)
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD})"), F.lit(1)), (F.col(start) + 1).cast("int"), F.col(length).cast("int")), " ")
    out = out.withColumn(text_col, F.when(F.col(length) == F.col(words), F.col(text_col)).otherwise(cut))
    if n_col in docs.columns:
        out = out.withColumn(n_col, F.length(text_col).cast(docs.schema[n_col].dataType))
    return out.select(*quoted(*docs.columns))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """op4: weights 5, 2, 1 repeating, 150 % of all sizes, at most twice each source's size."""
    rows, sources, pieces = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = pieces.groupBy("row").agg(F.sum("length").alias("taken"))
    out = with_sources(rows.join(taken, "row", "left"), sources)
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))

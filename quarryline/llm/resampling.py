"""Target-distribution importance resampling: array-scored weights, then distributed radix selection of the k-th key.

Each feature's gain is looked up in an array with an entry for each bucket, and a text's weight is the sum of its gains. Of
the composite key (score downwards, id upwards, row) histograms of one digit after another, each over the rows that
share the digits so far, find the k-th key exactly; only rows up to it are sorted by range and ranked.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, ready, written

BUCKETS, RUN, SHARE, LEAST_WORDS, SEED = 10_000, 1, 10, 20, "2024"
#: Bits of a digit: a histogram sends 2**DIGIT rows to the driver at most. Rows of a range that is sorted in one task.
DIGIT, PER_RANGE = 12, 200_000
#: Distinct words whose buckets a task keeps before it starts anew.
CACHE_MOST = 1 << 18

#: Lower-cases A-Z and makes a space of each ASCII byte that is no digit or letter.
_TO_WORDS = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


class Features:
    """Buckets of the features of texts: all runs of 1 to `longest` consecutive words, repeats included."""

    def __init__(self, longest: int, buckets: int) -> None:
        self.longest, self.buckets, self.known = longest, buckets, {}

    def of(self, text: bytes | None) -> tuple[int, list[int]]:
        """The number of words of a text, and the bucket of each feature."""
        words = [w for w in text.translate(_TO_WORDS).split(b" ") if w] if text else []
        known, out = self.known, []
        if len(known) > CACHE_MOST:
            known.clear()
        for n in range(1, self.longest + 1):
            for run in words if n == 1 else map(b" ".join, zip(*(islice(words, k, None) for k in range(n)), strict=False)):
                if (b := known.get(run)) is None:
                    b = known[run] = zlib.crc32(run) % self.buckets
                out.append(b)
        return len(words), out


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket. Tasks count first and send a row for each bucket they met."""
    ready(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(longest, buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for t in b.column(0):
                if found := features.of(t.as_py())[1]:
                    total += np.bincount(found, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    parts = texts.select(F.col(f"`{text_col}`").cast("string").cast("binary").alias("t")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket at most
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed share in target over that in source) for each bucket."""
    s, t, n = source.astype(np.float64), target.astype(np.float64), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def noise(id_: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, by the first 32 bits of the SHA-256 of `seed:id`; a null id is written as nothing."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weighed(docs: DataFrame, gain: np.ndarray, text_col: str = "text", longest: int = RUN, count: str = "n_features", weight: str = "weight", words: str = "n_words") -> DataFrame:
    """Adds the number of features and of words and the sum of the features' gains; null texts have none of either."""
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # an entry for each bucket

    @F.pandas_udf(f"{count} long, {weight} long, {words} long")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table, features = shared.value, Features(longest, len(shared.value))
        for batch in texts:
            found = [features.of(t) for t in batch]
            yield pd.DataFrame({count: [len(f) for _, f in found], weight: [int(table[f].sum()) if f else 0 for _, f in found], words: [n for n, _ in found]})

    name = free_name("_weighed", docs.columns)
    out = docs.withColumn(name, run(F.col(f"`{text_col}`").cast("string").cast("binary")))
    return out.select(*[f"`{c}`" for c in docs.columns], f"{name}.{count}", f"{name}.{weight}", f"{name}.{words}")


def radix_select(keys: DataFrame, cols: list[str], k: int) -> Column:
    """The condition that the k rows with the smallest keys meet, for key columns of whole numbers without nulls. All rows
    if there are no more than k; keys must differ where the k-th and the next row meet.

    A column is shifted by its least value and cut into digits of DIGIT bits. For each digit from the highest, one pass
    counts the rows that share the digits so far; the digit that holds the k-th row is fixed, and those below it are in.
    The passes end as soon as a digit's rows are in as a whole.
    """
    ends = keys.agg(F.count("*"), *[f(c) for c in cols for f in (F.min, F.max)]).first()
    if k < 1 or ends[0] <= k:
        return F.lit(k >= 1)
    parts = []
    for c, least, most in zip(cols, ends[1::2], ends[2::2], strict=True):
        wide = most - least >= 1 << 62  # a difference would not fit a long: two halves then
        halves = [(F.shiftright(c, 32), least >> 32, most >> 32), (F.col(c).bitwiseAND(0xFFFFFFFF), 0, 0xFFFFFFFF)]
        parts += halves if wide else [(F.col(c), least, most)]
    prefix, below, left = F.lit(True), F.lit(False), k
    for c, least, most in parts:
        value, digits = 0, -(-max(1, (most - least).bit_length()) // DIGIT)
        for shift in range((digits - 1) * DIGIT, -1, -DIGIT):
            base = least + (value << DIGIT + shift)  # where the digits so far begin
            rows = keys.where(prefix & c.between(base, min(most, base + (1 << DIGIT + shift) - 1)))
            counts = Counter({r[0]: r[1] for r in rows.groupBy(F.shiftright(c - F.lit(base), shift).alias("d")).count().collect()})  # 2**DIGIT at most
            for d in sorted(counts):
                if counts[d] >= left:
                    break
                left -= counts[d]
            value = (value << DIGIT) + d
            if counts[d] == left:
                return below | (prefix & (c <= min(most, least + (value + 1 << shift) - 1)))
        below = below | (prefix & (c < least + value))
        prefix = prefix & (c == least + value)
    raise ValueError("the k-th row and the next have the same key")


def ranked(rows: DataFrame, order: list[Column], count: int, out: str = "rank") -> DataFrame:
    """Adds 1, 2, 3... in the order: rows are dealt by range, sorted within, and counted on from the ranges before.
    The written table fixes the ranges; a row for each of them goes to all tasks."""
    ranges = max(1, -(-count // PER_RANGE))
    part, at = free_name("_range", rows.columns), free_name("_at", rows.columns)
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    dealt = written(dealt.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ranges")
    sizes = sorted((r[0], r[1]) for r in dealt.groupBy(part).count().collect())  # a row for each range
    before, table = 0, []
    for p, n in sizes:
        table.append((p, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(table, f"{part} int, _before long")
    return dealt.join(F.broadcast(offsets), part).withColumn(out, F.col("_before") + F.col(at) + 1).drop(part, at, "_before")


def resample(
    docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", longest: int = RUN, buckets: int = BUCKETS
) -> DataFrame:
    """n_features, weight, score and rank of every row of docs: of the N rows with at least least_words words the
    floor(share * N / 100) highest scores are drawn and ranked, ties by smaller id; others have no rank.

    Null texts have no words, a null id comes after all ids. Rows of one id and score are told apart by their place in
    the scored table, so as many as there is room for are drawn. Counts are those of all rows of either table.
    """
    if not 0 <= share <= 100:
        raise ValueError("a share is a number of hundredths")
    gain = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_col, longest, buckets))
    mine = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = weighed(mine, gain, longest=longest).drop("text").withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    keys, cols = ["down", "no_id", "id", "row"], ["doc_id", "n_features", "weight", "score"]
    rows = rows.withColumns({"down": -F.col("score"), "no_id": F.col("doc_id").isNull().cast("long"), "id": F.coalesce("doc_id", F.lit(0))})
    pool = rows.where(F.col("n_words") >= least_words).select(keys)
    k = share * pool.count() // 100
    drawn = (F.col("n_words") >= least_words) & radix_select(pool, keys, k)
    top = ranked(rows.where(drawn).select(*cols, *keys[1:]), [F.col("score").desc(), *map(F.col, keys[1:])], k)
    rest = rows.where(~drawn).select(*cols, F.lit(None).cast("long").alias("rank"))
    return top.select(*cols, "rank").unionByName(rest)


def op12_resampling(spark, sf_dir: str) -> DataFrame:
    """op12: documents drawn towards the distribution of benchmark."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
with tab as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from (select unnest(range(256)) as i)),
texts as (select 'd' as kind, doc_id as id, text from documents union all select 'b', item_id, text from benchmark),
words as (select kind, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from texts),
codes as (select w, hex(encode(w)) as h from (select distinct w from words)),
crcs as (select w, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as bucket from codes, tab),
n as (select bucket, count(*) filter (kind = 'd') as s, count(*) filter (kind = 'b') as t from words join crcs using (w) group by bucket),
tot as (select sum(s)::double as ss, sum(t)::double as tt from n),
gain as (select bucket, floor(1000 * ln((t::double + 1) * (ss + 10000) / ((s::double + 1) * (tt + 10000))))::bigint as g from n, tot),
per as (select id, count(*) as n_features, sum(g)::bigint as weight from words join crcs using (w) join gain using (bucket) where kind = 'd' group by id),
scored as (select doc_id, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
  coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5) / 4294967296)))::bigint as score
  from documents left join per on doc_id = id),
r as (select *, case when n_features >= 20 then row_number() over (partition by n_features >= 20 order by score desc, doc_id) end as k, count(*) filter (n_features >= 20) over () as m from scored)
select doc_id, n_features, weight, score, case when k <= 10 * m // 100 then k end as rank from r
"""

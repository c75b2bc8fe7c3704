"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop lines over a threshold,
reassemble by position."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, salted_join, written

LEAST_CHARS, LEAST_DOCS = 40, 5
_SPACE = b" \t\n\x0b\x0c\r"


def line_keys(text: str, least_chars: int = LEAST_CHARS) -> list[tuple[int, bytes]]:
    """(position, 128-bit hash of the key) of the lines whose keys are long enough."""
    out = []
    for i, line in enumerate(text.encode().split(b"\n")):
        key = line.strip(_SPACE).lower()  # bytes: A-Z only
        if len(key) >= least_chars and (key.isascii() or len(key.decode()) >= least_chars):
            out.append((i, xxhash.xxh3_128_digest(key)))
    return out


def repeated_lines(docs: DataFrame, least_chars: int, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """(lines, repeated) of docs(doc_id, t, of): doc_id, of, pos, hash of long lines; and hash, keeper of those in enough
    documents."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d, x, i, h) for d, t, x in zip(f["doc_id"], f["t"], f["of"], strict=True) for i, h in line_keys(t, least_chars)]
            yield pd.DataFrame(rows, columns=["doc_id", "of", "pos", "hash"])

    lines = written(docs.where("doc_id is not null").mapInPandas(run, "doc_id long, of long, pos int, hash binary"), "lines")
    # A document counts once for a hash; both steps add up before they shuffle.
    per_doc = lines.groupBy("hash", "doc_id").agg(F.lit(1).alias("one"))
    repeated = per_doc.groupBy("hash").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper")).where(F.col("docs") >= least_docs)
    return lines, repeated.select("hash", "keeper")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text for each row of docs.

    Lines whose key (stripped, A-Z lower-cased) has at least least_chars code points and is in at least least_docs
    documents go everywhere but in the document with the largest id that holds it, where all of them stay. Null and
    empty texts are one empty line. Rows of one id count as one document, and each loses the lines of its own text. Rows
    without an id count for no line and keep theirs. Other columns are ignored; an empty table gives an empty result.
    """
    ready(docs.sparkSession)
    # Rows are known by id and text, so rows of one id with different texts have positions of their own.
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).withColumn("of", F.xxhash64("t"))
    lines, repeated = repeated_lines(rows, least_chars, least_docs)
    repeated = written(repeated, "repeated")
    gone = salted_join(lines, repeated, ["hash"], "inner", "doc_id").where("doc_id <> keeper")
    gone = gone.groupBy("doc_id", "of").agg(F.collect_set("pos").alias("gone"))
    out = rows.join(gone, ["doc_id", "of"], "left").withColumn("l", F.split("t", "\n", -1))
    # array_except looks positions up by hash, so a long text costs its lines, not lines times dropped ones.
    stay = F.array_except(F.sequence(F.lit(0), F.size("l") - 1), "gone")
    kept = F.transform(stay, lambda i: F.get("l", i))
    out = out.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), F.col("l")).otherwise(kept).alias("k"), "t", "gone")
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.size("k")).alias("n_dropped"), F.when(F.col("gone").isNull(), F.col("t")).otherwise(F.array_join("k", "\n")).alias("kept_text"))


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """op6: keys of at least 40 code points in at least 5 documents."""
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
k as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
r as (select key, max(doc_id) as keeper from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
m as (select k.*, r.keeper is not null and r.keeper <> k.doc_id as gone from k left join r using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from m group by doc_id
"""

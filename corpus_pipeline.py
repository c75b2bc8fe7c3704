"""A corpus pipeline: toxicity, exact dedup, SimHash near-dedup, mixing sources, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the columns of docs.
Null and empty texts are clean, are copies of one another, and take part in no mix. SQL can't express the pipeline:
tests hold each stage against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import exactdedup, mixing, packing, simhash, toxicity
from quarryline.llm.common import free_name, ready, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 and more go; the model is learnt from the labels of docs. Null texts count as
    empty; rows of one id are judged one by one; columns may have any names."""
    model = toxicity.train_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = free_name("_toxicity", docs.columns)
    return toxicity.score(docs, model, out=name).where(F.col(name) < 0.5).drop(name)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, one of those that repeat it. Null texts count as empty."""
    return exactdedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near fingerprints the one with the smallest doc_id stays. Null and empty texts are one group."""
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, a row for each reading; the last of a source may be cut, and has its
    words joined by one space. Null and empty texts take no part; rows of one id are mixed one by one."""
    return mixing.mixed(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2,048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again as the next one's docs."""
    ready(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

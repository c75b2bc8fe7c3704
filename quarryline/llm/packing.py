"""Mixture-controlled packing: deficit round-robin over source queues, in closed form.

Each source is a queue of the tokens of its documents, in a shuffled order. In every round, one round a window, a source
is credited its share of the window, its quantum, and as many tokens as the credit has whole ones leave its queue; the
fraction left is carried as the source's deficit to the next round. So after r rounds a source has given
floor(r * quantum) tokens, whatever partition they are in: every partition knows the deficits with which the one before
it ended, without running it. A document is cut where rounds end, so a window holds tokens of every source in its
proportion, also of sources whose documents are longer than a window. The tokens of a round differ from a window's by
less than one a source; the rounds in order make one stream that is cut at each window's end, so only the last window
is short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_bits, exclusive_sum, hash_block, ready, source_key, spread_hash, with_sources, written

WINDOW, END_ID = 2048, 1
#: Rounds in one block of the prefix sum over the whole stream: at most as many windows' tokens meet in it.
ROUNDS_PER_BLOCK = 64
_encoders: dict = {}


def encoder(path: str):
    """text -> ids as uint16. The vocabulary's ranks file gives the ids of the tokenizers file faster; a text that
    holds a special token goes to tokenizers itself."""
    if path not in _encoders:
        import base64
        import json

        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        special = [t["content"] for t in json.loads(slow.to_str())["added_tokens"]]
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> np.ndarray:
            if any(s in text for s in special):
                return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint16)
            return np.array(fast.encode_ordinary(text), np.uint16)

        _encoders[path] = encode
    return _encoders[path]


def tokenized(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source_key, n (ids with the end id), ids (little-endian 16-bit), row (unique)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        end = np.array([END_ID], np.uint16).tobytes()
        for f in frames:
            ids = [encode(t or "").tobytes() + end for t in f["t"]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "source_key": f["source_key"], "n": [len(b) // 2 for b in ids], "ids": ids})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), source_key(source_col).alias("source_key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    return rows.mapInPandas(run, "doc_id long, source_key string, n long, ids binary").withColumn("row", F.monotonically_increasing_id())


def quanta(lengths: DataFrame, window: int = WINDOW, weights: dict[str, float] | None = None) -> DataFrame:
    """source_key, quantum: the tokens a round of each source, a row for each; by its share of all tokens, or by weights."""
    totals = lengths.groupBy("source_key").agg(F.sum("n").alias("of_source"))
    if weights is None:
        every = totals.agg(F.sum("of_source").alias("all"))
        return totals.crossJoin(F.broadcast(every)).select("source_key", (F.lit(float(window)) * F.col("of_source") / F.col("all")).alias("quantum"))  # one row
    w = F.coalesce(*[F.when(F.col("source_key") == k, F.lit(float(v))) for k, v in weights.items()], F.lit(0.0))
    return totals.select("source_key", F.greatest(F.lit(float(window)) * w / sum(weights.values()), F.lit(1e-6)).alias("quantum"))


def scheduled(lengths: DataFrame, rows: int, window: int = WINDOW, weights: dict[str, float] | None = None) -> DataFrame:
    """row, start, length, round, pos (where the piece starts in the packed stream), of lengths(row, doc_id, source_key, n).

    Without weights each window holds the mixture of the whole corpus, the one that every queue can keep up until
    all run out together. With weights (by source_key) windows hold these while all queues last; then the others go on.
    """
    queued = spread_hash(lengths, 7, ["doc_id", "n"]).withColumn("block", hash_block(F.col("h"), block_bits(rows)))
    queued = exclusive_sum(queued, ["source_key"], "block", ["h", "row"], "n", "before")
    served = with_sources(queued, quanta(lengths, window, weights)).withColumn("end", F.col("before") + F.col("n"))
    # Token x leaves in the round r with floor(r * quantum) <= x < floor((r + 1) * quantum). Of a quantum under one
    # token a round, the tokens are told one by one, as most rounds have none; else the rounds are.
    whole = F.col("quantum") >= 1
    rounds = F.sequence(F.greatest(F.lit(0).cast("long"), F.floor(F.col("before") / F.col("quantum")) - 1), F.floor(F.col("end") / F.col("quantum")) + 1)
    served = served.withColumn("_at", F.explode(F.when(whole, rounds).otherwise(F.sequence("before", F.col("end") - 1))))
    edge = lambda r: F.floor(r * F.col("quantum"))
    served = (
        served.withColumn("round", F.when(whole, F.col("_at")).otherwise(F.ceil((F.col("_at") + 1) / F.col("quantum")) - 1))
        .withColumn("a", F.when(whole, F.greatest(F.col("before"), edge(F.col("_at")))).otherwise(F.col("_at")))
        .withColumn("b", F.when(whole, F.least(F.col("end"), edge(F.col("_at") + 1))).otherwise(F.col("_at") + 1))
        .where("a < b")
    )
    pieces = served.select("row", "source_key", (F.col("a") - F.col("before")).alias("start"), (F.col("b") - F.col("a")).alias("length"), "a", "round", F.floor(F.col("round") / ROUNDS_PER_BLOCK).alias("block"))
    return exclusive_sum(pieces, [], "block", ["round", "source_key", "a"], "length", "pos").select("row", "start", "length", "round", "pos")


def pack(docs: DataFrame, path: str, window: int = WINDOW, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_to
    (and ids, little-endian 32-bit, with with_ids).

    Null and empty texts are documents of the end id alone. A null source is a source of its own. Documents with equal
    ids are packed one by one. Windows hold every source in its proportion, to less than two tokens a source; those
    with fewer tokens than there are sources hold one of some. Every sequence is full but the last, which is padded unless its length is a power of two.
    Other columns are ignored; an empty table gives no pieces.
    """
    ready(docs.sparkSession)
    tokens = written(tokenized(docs, path, id_col, text_col, source_col), "tokens")
    lengths = tokens.select("row", "doc_id", "source_key", "n")
    count, total = lengths.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    plan = written(scheduled(lengths, count, window, weights).select("row", "start", "pos"), "plan")
    last, rest = divmod(total, window)
    short = rest if rest & (rest - 1) == 0 else window

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_to", "ids")}
            for doc, n, ids, starts, places in zip(f["doc_id"], f["n"], f["ids"], f["starts"], f["places"], strict=True):
                wide = np.frombuffer(ids, np.uint16).astype("<u4").tobytes()
                at, to = starts.tolist(), [*starts[1:].tolist(), n]
                for start, end, pos in zip(at, to, places.tolist(), strict=True):
                    while start < end:
                        seq, off = divmod(pos, window)
                        length = min(window - off, end - start)
                        piece = wide[4 * start : 4 * (start + length)]
                        for k, v in zip(out, (doc, start, length, zlib.crc32(piece), n, seq, off, short if seq == last else window, piece if with_ids else None), strict=True):
                            out[k].append(v)
                        start, pos = start + length, pos + length
            made = pd.DataFrame(out)
            made["doc_id"] = made["doc_id"].astype("Int64")
            yield made if with_ids else made.drop(columns="ids")

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_to int" + ", ids binary" * with_ids
    # The plan has a row for each document, so the join is a merge at every size, never a broadcast.
    per_row = plan.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "pos"))).alias("_p"))
    per_row = per_row.select("row", F.col("_p.start").alias("starts"), F.col("_p.pos").alias("places"))
    return tokens.select("row", "doc_id", "n", "ids").join(per_row.hint("merge"), "row").mapInPandas(cut, kinds)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    """op2: all documents in sequences of at most 2,048 tokens."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))

"""Checks of answers and runs: citations of training rows, corrections of false premises, evidence by stage, backends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BRACKET = "\\[([^\\[\\]\\n]{1,128})\\]"


def citation_faults(answer: Column, allowed: Column) -> Column:
    """The faults of an answer's citations, in order: `malformed` if a bracket holds something else than one alias of
    allowed form, `unknown` if one cites what is not allowed, `adjacent` if two neighbours are the same, with a space
    between them."""
    said = F.coalesce(answer, F.lit(""))
    found = F.regexp_extract_all(said, F.lit(_BRACKET), F.lit(1))
    malformed = F.exists(found, lambda x: ~x.rlike("^[\\p{L}\\p{N}_:.-]{1,128}$") | (x.rlike("^[0-9]{3,4}$") & ~F.array_contains(allowed, x)))
    unknown = F.size(F.array_except(found, F.coalesce(allowed, F.array().cast("array<string>")))) > 0
    adjacent = said.rlike("\\[([^\\[\\]\\n]{1,128})\\] \\[\\1\\]")
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in (("malformed", malformed), ("unknown", unknown), ("adjacent", adjacent))]))


def premise_corrected(answer: Column, kind: Column, success: Column, signs: str) -> Column:
    """1 or 0: whether an answer to a question of a false premise has one of the words of `signs`, a pattern, on its own;
    null for other questions and for answers that failed."""
    word = f"(?i)(?<![\\p{{L}}\\p{{N}}_])(?:{signs})(?![\\p{{L}}\\p{{N}}_])"
    return F.when(success & (kind == "false_premise"), F.coalesce(answer, F.lit("")).rlike(word).cast("int"))


def stage_evidence(results: DataFrame, id_col: str, stages: str, corpus: DataFrame, row_id: str = "row_id") -> DataFrame:
    """id, stage, rank, row_id, score and the corpus's columns: a row for each hit of each stage (a map from a stage to an
    array of (row_id, rank, score)). A hit without a row in the corpus has nulls, so that it can be told and refused."""
    hits = results.select(id_col, F.explode(stages).alias("stage", "_hits")).select(id_col, "stage", F.explode("_hits").alias("_h"))
    hits = hits.select(id_col, "stage", F.col("_h.rank").alias("rank"), F.col("_h.row_id").alias(row_id), F.col("_h.score").alias("score"))
    return hits.join(corpus, row_id, "left")


def backend_summary(runs: DataFrame, backend: str, latency: str, metrics: list[str]) -> DataFrame:
    """A row for each backend: its runs, the means of its metrics over what is observed, and linear p50 and p95 latencies."""
    means = [F.round(F.avg(m), 6).alias(f"mean_{m}") for m in metrics]
    return runs.groupBy(backend).agg(F.count("*").alias("n"), *means, *[F.round(F.percentile(latency, p), 6).alias(f"p{round(100 * p)}") for p in (0.5, 0.95)])

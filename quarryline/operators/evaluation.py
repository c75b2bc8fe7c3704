"""Evaluation operators. Null is 'not observed' and never 0."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked_metrics(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """query_id, hit, recall, precision, mrr, ndcg at k, of ranked (query_id, rank, item) against gold (query_id,
    items: array). Null gold: all null. Empty gold: hit and precision 0, the others null. Precision divides by k."""
    seen = ranked.groupBy("query_id", "item").agg(F.min("rank").alias("rank"))
    seen = seen.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "item"))).where(F.col("rank") <= k)
    j = gold.join(seen, "query_id", "left").withColumn("rel", F.array_contains("items", F.col("item")))
    g = j.groupBy("query_id").agg(
        F.first("items").alias("items"), F.sum(F.col("rel").cast("int")).alias("found"), F.min(F.when(F.col("rel"), F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rel"), 1 / F.log2(F.col("rank") + 1.0))).alias("dcg"),
    )
    n = F.size(F.array_distinct("items"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, F.lit(k)))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    known, some = F.col("items").isNotNull(), F.size("items") > 0
    found = F.coalesce("found", F.lit(0))
    return g.select(
        "query_id",
        F.when(known, (found > 0).cast("double")).alias("hit"),
        F.when(known & some, F.round(found / n, 6)).alias("recall"),
        F.when(known, F.round(found / F.lit(float(k)), 6)).alias("precision"),
        F.when(known & some, F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6)).alias("mrr"),
        F.when(known & some, F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 6)).alias("ndcg"),
    )


def metrics_by_level(ranked: DataFrame, gold: DataFrame, levels: list[str], ks: list[int]) -> DataFrame:
    """query_id, level, k, hit, recall, precision, mrr, ndcg: for each level, a column of ranked (query_id, rank, ...) that
    names what is found and of gold (query_id, ...) an array of what is right, and for each k. Of items that repeat the
    first counts, and those after it move up; a null item is none. Null and empty gold as in ranked_metrics.

    All levels and numbers are told from one ranking: rows meet gold once for each k that they are within."""
    each = lambda df, also: df.select("query_id", *also, F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.col(x).cast("array<string>" if not also else "string").alias("v")) for x in levels])).alias("_l")).select("query_id", *also, "_l.*")
    seen = each(ranked, ["rank"]).where("v is not null").groupBy("query_id", "level", "v").agg(F.min("rank").alias("rank"))
    seen = seen.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "level").orderBy("rank", "v"))).where(F.col("rank") <= max(ks))
    seen = seen.groupBy("query_id", "level").agg(F.array_sort(F.collect_list(F.struct("rank", "v"))).alias("top"))  # max(ks) at most
    j = each(gold, []).join(seen, ["query_id", "level"], "left").withColumn("right", F.array_distinct("v"))
    hits = F.filter(F.transform(F.coalesce("top", F.array().cast("array<struct<rank:int,v:string>>")), lambda x: F.when(F.array_contains("right", x["v"]), x["rank"])), lambda r: r.isNotNull())
    j = j.select("query_id", "level", F.when(F.col("right").isNotNull(), F.size("right")).alias("n"), hits.alias("at"), F.explode(F.array(*map(F.lit, ks))).alias("k"))
    j = j.withColumn("at", F.filter("at", lambda r: r <= F.col("k")))
    gain = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    known, some, found = F.col("n") >= 0, F.col("n") > 0, F.size("at")
    ideal = gain(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("n", "k"))))
    measures = {
        "hit": F.when(known, (found > 0).cast("double")), "recall": F.when(some, F.round(found / F.col("n"), 6)), "precision": F.when(known, F.round(found / F.col("k").cast("double"), 6)),
        "mrr": F.when(some, F.round(F.coalesce(1.0 / F.get("at", F.lit(0)), F.lit(0.0)), 6)), "ndcg": F.when(some, F.round(gain(F.col("at")) / ideal, 6)),
    }
    return j.select("query_id", "level", "k", *[c.alias(m) for m, c in measures.items()])


def token_overlap(df: DataFrame, id_col: str, predicted: Column, gold: Column) -> DataFrame:
    """id, precision, recall, f1 over multisets of tokens; null gold tokens give null, two empty ones 1, one 0."""
    side = lambda c, n: df.select(id_col, F.explode_outer(c).alias("t")).where("t is not null").groupBy(id_col, "t").agg(F.count("*").alias(n))
    both = side(predicted, "a").join(side(gold, "b"), [id_col, "t"]).groupBy(id_col).agg(F.sum(F.least("a", "b")).alias("c"))
    s = df.select(id_col, F.size(predicted).alias("n"), F.size(gold).alias("m"), gold.isNotNull().alias("known")).join(both, id_col, "left").withColumn("c", F.coalesce("c", F.lit(0)))
    share = lambda x: F.when(~F.col("known"), None).when((F.col("n") == 0) & (F.col("m") == 0), 1.0).when((F.col("n") == 0) | (F.col("m") == 0), 0.0).otherwise(x)
    return s.select(id_col, F.round(share(F.col("c") / F.col("n")), 6).alias("precision"), F.round(share(F.col("c") / F.col("m")), 6).alias("recall"), F.round(share(2 * F.col("c") / (F.col("n") + F.col("m"))), 6).alias("f1"))


def rouge_l(predicted: Column, gold: Column) -> Column:
    """F-measure of the longest common subsequence of two token arrays. A token of one updates a whole row of the table of
    common subsequences at once, whose steps are the bits of one number; null tokens are equal to none."""

    @F.pandas_udf("long")
    def lcs(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out: list[int | None] = []
        for x, y in zip(xs, ys, strict=True):
            if x is None or y is None:
                out.append(None)
                continue
            places: dict[str, int] = {}
            for i, t in enumerate(y):
                places[t] = places.get(t, 0) | 1 << i
            places.pop(None, None)
            every = (1 << len(y)) - 1
            row = every
            for t in x:
                same = row & places.get(t, 0)
                row = (row + same | row - same) & every
            out.append(len(y) - row.bit_count())
        return pd.Series(out, dtype="Int64")

    return F.when(F.size(predicted) + F.size(gold) == 0, 1.0).otherwise(2.0 * lcs(predicted, gold) / (F.size(predicted) + F.size(gold)))


def observed(df: DataFrame, id_cols: list[str], metrics: list[str]) -> DataFrame:
    """metric, mean, n: means over the rows that have the metric, and how many have it."""
    long = df.unpivot(id_cols, metrics, "metric", "v")
    ok = F.col("v").isNotNull() & ~F.isnan(F.col("v").cast("double"))
    return long.groupBy("metric").agg(F.round(F.avg(F.when(ok, F.col("v"))), 6).alias("mean"), F.count(F.when(ok, 1)).alias("n"))


def cited_targets(answer: Column) -> Column:
    """Targets of bracketed groups cut at commas and semicolons, in order; four-digit years are no citations."""
    groups = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit("\\[([^\\[\\]]+)\\]"), F.lit(1))
    parts = F.flatten(F.transform(groups, lambda g: F.split(g, "[,;]")))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike("^[0-9]{4}$"))


def citations(df: DataFrame, id_col: str, answer: Column) -> DataFrame:
    """id, pos, target: a row for each citation of the answer."""
    return df.select(id_col, F.posexplode(cited_targets(answer)).alias("pos", "target"))


def citation_scores(df: DataFrame, id_col: str, answer: Column, known: Column, gold: Column) -> DataFrame:
    """id, cited, validity (share of citations that name a known target), precision (share of distinct targets that are
    known and gold), recall (share of gold targets cited); null where there is nothing to divide by."""
    c = df.select(id_col, cited_targets(answer).alias("c"), known.alias("k"), gold.alias("g"))
    share = lambda x, n: F.when(n > 0, F.round(x / n, 6))
    hit = F.size(F.array_intersect(F.array_intersect("c", "k"), "g"))
    valid = F.size(F.filter("c", lambda x: F.array_contains("k", x)))
    return c.select(
        id_col, F.size("c").alias("cited"), share(valid, F.size("c")).alias("validity"),
        share(hit, F.size(F.array_distinct("c"))).alias("precision"), share(hit, F.size(F.array_distinct("g"))).alias("recall"),
    )


# What counts as a year in an answer, and as a refusal.
ANSWER_YEAR = "(?<!\\d)(?:[5-9]\\d{2}|1\\d{3}|20\\d{2})(?!\\d)"
REFUSAL = "(?i)không (?:có )?đủ (?:thông tin|bằng chứng|tư liệu)|không thể (?:xác minh|trả lời)|ngoài phạm vi|insufficient (?:evidence|information)|cannot verify|outside (?:the )?scope"


def grounding(df: DataFrame, id_col: str, answer: Column, evidence: Column, facts: Column, answerable: Column) -> DataFrame:
    """id, fact_recall (share of required facts the answer holds, ignoring case and spacing), unverified_years, its
    rate, refused_rightly, refused_wrongly; null where the label or the evidence is missing."""
    years = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(ANSWER_YEAR), F.lit(0)))
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), "\\s+", " "))
    r = df.select(id_col, F.coalesce(answer, F.lit("")).alias("a"), F.nullif(evidence, F.lit("")).alias("e"), facts.alias("f"), answerable.alias("ok"))
    held = F.size(F.filter("f", lambda x: F.contains(flat(F.col("a")), flat(x))))
    wrong = F.size(F.array_except(years(F.col("a")), years(F.col("e"))))
    refused = F.col("a").rlike(REFUSAL.replace("(?i)", "(?iu)")).cast("double")
    return r.select(
        id_col, F.when(F.size("f") > 0, F.round(held / F.size("f"), 6)).alias("fact_recall"),
        F.when(F.col("e").isNotNull(), wrong).alias("unverified_years"),
        F.when(F.col("e").isNotNull() & (F.size(years(F.col("a"))) > 0), F.round(wrong / F.size(years(F.col("a"))), 6)).alias("unverified_rate"),
        F.when(~F.col("ok"), refused).alias("refused_rightly"), F.when(F.col("ok"), refused).alias("refused_wrongly"),
    )


def behavior_checks(df: DataFrame, id_col: str, captured: Column, calls: Column, required: Column, groups: Column, forbidden: Column, allowed: Column, most: Column, most_repeated: Column) -> DataFrame:
    """id, call_count, repeated_calls, repeated_rate and checks of a run's calls, an array of (name, fingerprint).

    Nothing is known of a run whose calls were not captured; a check without an expectation is null; repeats are known
    only if every call has a fingerprint. Duplicates after the first count, whatever their order."""
    d = df.select(id_col, F.when(F.coalesce(captured, F.lit(False)), calls).alias("c"), required.alias("q"), groups.alias("s"), forbidden.alias("x"), allowed.alias("w"), most.alias("m"), most_repeated.alias("mr"))
    names = F.transform("c", lambda c: c["name"])
    known = F.forall("c", lambda c: c["fingerprint"].isNotNull() & (c["fingerprint"] != ""))
    repeated = F.when(known, F.size("c") - F.size(F.array_distinct("c")))
    d = d.withColumn("n", F.when(F.col("c").isNotNull(), F.size("c"))).withColumn("r", repeated).withColumn("names", names)
    some = lambda c: F.col("n").isNotNull() & F.col(c).isNotNull() & (F.size(c) > 0)
    return d.select(
        id_col, F.col("n").alias("call_count"), F.col("r").alias("repeated_calls"), F.when(F.col("n") > 0, F.round(F.col("r") / F.col("n"), 6)).alias("repeated_rate"),
        F.when(some("q"), F.size(F.array_except("q", "names")) == 0).alias("required_tools"),
        F.when(some("s"), F.forall("s", lambda g: F.arrays_overlap("names", g))).alias("any_tool_groups"),
        F.when(some("x"), ~F.arrays_overlap("names", "x")).alias("forbidden_tools"),
        F.when(F.col("n").isNotNull() & F.col("w").isNotNull(), F.size(F.array_except("names", "w")) == 0).alias("allowed_tools"),
        (F.col("n") <= F.col("m")).alias("max_tool_calls"), (F.col("r") <= F.col("mr")).alias("max_repeated_calls"),
    )


def retrieval_behavior(gold: Column, dense: Column, bm25: Column, final: Column, negative: Column) -> Column:
    """How a question's gold documents were found: by which lane's ten, and whether the final five have one."""
    has = lambda c, n: F.coalesce(F.arrays_overlap(gold, F.slice(c, 1, n)), F.lit(False))
    d, b = has(dense, 10), has(bm25, 10)
    return F.when(F.coalesce(negative, F.lit(False)), "negative_edge").when(~has(final, 5), "final_miss").when(d & ~b, "dense_only_hit").when(b & ~d, "bm25_only_hit").otherwise("shared_hit")

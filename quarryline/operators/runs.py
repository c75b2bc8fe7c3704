"""Runs of agents and evaluations: calls matched with results, summaries, overlaps of splits, flags of answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import match_norm


def matched_calls(calls: DataFrame, results: DataFrame, run: str, name: str, seq: str, call_id: str) -> DataFrame:
    """run, call, result (their seq), name, matched (id, name or null) of the calls and results of each run.

    A result is of the call that has its id; of the other results and calls of one name, the first is of the first, and
    so on. A call without a result has result null, a result without a call has call null. Of calls (or results) that
    share an id, the first goes by it.
    """
    nth = lambda d, *by: d.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(seq)))
    a = calls.select(run, name, call_id, F.col(seq).alias("call"))
    b = results.select(run, name, call_id, F.col(seq).alias("result"))
    once = lambda d, c: d.where(F.col(call_id).isNotNull()).groupBy(run, call_id).agg(F.min(c).alias(c))
    by_id = once(a, "call").join(once(b, "result"), [run, call_id]).select(run, "call", "result")
    rest_a = nth(a.join(by_id.select(run, "call"), [run, "call"], "left_anti").withColumnRenamed("call", seq), run, name)
    rest_b = nth(b.join(by_id.select(run, "result"), [run, "result"], "left_anti").withColumnRenamed("result", seq), run, name)
    by_name = rest_a.select(run, name, "_n", F.col(seq).alias("call")).join(rest_b.select(run, name, "_n", F.col(seq).alias("result")), [run, name, "_n"], "full")
    how = F.when(F.col("call").isNotNull() & F.col("result").isNotNull(), "name")
    named = by_id.join(a.select(run, "call", name), [run, "call"])
    return by_name.select(run, "call", "result", name, how.alias("matched")).unionByName(named.withColumn("matched", F.lit("id")))


def agent_cases(calls: DataFrame, cases: DataFrame, run: str, name: str, key: str, began: str, ended: str, after: dict[str, str]) -> DataFrame:
    """run, calls, duplicate_calls, excess_calls, coverage, dependency_valid, complete: each case's calls against what it
    asks for. calls (run, name, key, began, ended); cases (run, required: keys, most: useful calls, fulfilled: keys
    found). after: names of calls that need an ended call of another name before they begin.
    """
    first = {p: F.min(F.when(F.col(name) == p, F.col(ended))).over(Window.partitionBy(run)) for p in set(after.values())}
    c = calls.withColumns({f"_first_{p}": w for p, w in first.items()})
    broken = reduce(lambda x, y: x | y, [(F.col(name) == n) & ~F.coalesce(F.col(f"_first_{p}") <= F.col(began), F.lit(False)) for n, p in after.items()], F.lit(False))
    made = c.groupBy(run).agg(F.count("*").alias("calls"), F.count_distinct(F.struct(name, key)).alias("distinct"), F.count_if(broken).alias("broken"))
    j = cases.join(made, run, "left").fillna(0, ["calls", "distinct", "broken"])
    need = F.size("required")
    j = j.withColumn("coverage", F.when(need > 0, F.round(F.size(F.array_intersect("required", "fulfilled")) / F.size(F.array_distinct("required")), 6)))
    j = j.withColumn("dependency_valid", F.col("broken") == 0)
    return j.select(
        run, "calls", (F.col("calls") - F.col("distinct")).alias("duplicate_calls"), F.greatest(F.lit(0), F.col("calls") - F.col("most")).alias("excess_calls"),
        "coverage", "dependency_valid", (F.coalesce(F.col("coverage") == 1, F.lit(False)) & F.col("dependency_valid")).alias("complete"),
    )


def agent_summary(cases: DataFrame, variant: str) -> DataFrame:
    """variant, cases, completed, dependency_valid, calls, duplicate_calls, excess_calls, mean_coverage."""
    total = [F.sum(c).alias(c) for c in ("calls", "duplicate_calls", "excess_calls")]
    return cases.groupBy(variant).agg(F.count("*").alias("cases"), F.count_if("complete").alias("completed"), F.count_if("dependency_valid").alias("dependency_valid"), *total, F.round(F.avg("coverage"), 6).alias("mean_coverage"))


def split_overlaps(items: DataFrame, split: str, kind: str, value: str, splits: list[str]) -> DataFrame:
    """kind, a, b, shared: how many values of a kind two splits have in common, for every pair of splits and kind in
    items (a row for each value that a split's row names). Values are brought together with the set of splits that have
    them, so that a value of many rows makes no pairs of rows."""
    named = items.where(F.col(value).isNotNull()).groupBy(kind, value).agg(F.collect_set(split).alias("_in"))
    pairs = [(a, b) for i, a in enumerate(splits) for b in splits[i + 1 :]]
    both = F.array_compact(F.array(*[F.when(F.array_contains("_in", a) & F.array_contains("_in", b), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))) for a, b in pairs]))
    found = named.select(kind, F.explode(both).alias("p")).groupBy(kind, "p.a", "p.b").agg(F.count("*").alias("shared"))
    every = items.select(kind).distinct().select(kind, F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])).alias("p")).select(kind, "p.a", "p.b")
    return every.join(found, [kind, "a", "b"], "left").fillna(0, ["shared"])


def isolated(parts: dict[str, DataFrame], frozen: dict[str, DataFrame], key: str, never: DataFrame) -> dict[str, DataFrame]:
    """parts, if no two share a key, each is within its frozen keys and none has a key of `never`; else an error that
    names the first faults."""
    faults = []
    names = sorted(parts)
    for i, a in enumerate(names):
        faults += [(f"{a} and {b} share", parts[a].select(key).join(parts[b].select(key), key, "left_semi")) for b in names[i + 1 :]]
        faults.append((f"{a} is not all of its split:", parts[a].select(key).join(frozen[a].select(key), key, "left_anti")))
        faults.append((f"{a} holds what is kept out:", parts[a].select(key).join(never.select(key), key, "left_semi")))
    for what, rows in faults:
        some = rows.limit(3).collect()
        if some:
            raise ValueError(f"{what} {[r[0] for r in some]}")
    return parts


def answer_flags(text: Column, whole: dict[str, list[str]], sentence: dict[str, tuple[list[str], str]], invalid: Column, uncited: Column) -> Column:
    """The names of an answer's faults, in order: of `whole`, where any pattern is in the answer; of `sentence`, where one
    sentence has all patterns of a list and not the last pattern; invalid_citations and missing_citations. Patterns see
    lower case."""
    t = F.lower(F.coalesce(text, F.lit("")))
    parts = F.split(t, "[;!?\n]|(?<=\\p{Ll})\\.\\s")
    flag = lambda c, n: F.when(F.coalesce(c, F.lit(False)), F.lit(n))
    out = [flag(reduce(lambda a, b: a | b, [t.rlike(p) for p in ps]), n) for n, ps in whole.items()]
    has = lambda wanted, but: lambda s: reduce(lambda a, b: a & b, [s.rlike(p) for p in wanted]) & ~s.rlike(but)
    out += [flag(F.exists(parts, has(*x)), n) for n, x in sentence.items()]
    return F.array_compact(F.array(*out, flag(invalid, "invalid_citations"), flag(uncited, "missing_citations")))


def contained_items(texts: DataFrame, id_col: str, text: Column, items: DataFrame, item: str, least: int = 4) -> DataFrame:
    """id, item: the items of at least `least` characters that a text names as whole words, both normalised; each pair
    once. Runs of words as long as some item are joined with the items by equality; items of one normal form are all
    named. The lengths of items come to the driver: one number for each, of at most MOST_WORDS."""
    i = items.select(F.col(item).alias("item"), match_norm(F.col(item)).alias("_k")).where(F.length("_k") >= least).distinct()
    i = i.withColumn("_n", F.size(F.split("_k", " ")))
    sizes = sorted(r[0] for r in i.select("_n").distinct().limit(MOST_WORDS + 1).collect())
    if len(sizes) > MOST_WORDS:
        raise ValueError(f"items of more than {MOST_WORDS} lengths")
    w = texts.select(id_col, F.split(match_norm(text), " ").alias("_w"))
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - n + 1, F.lit(1))), lambda s: F.array_join(F.slice("_w", s, n), " "))
    keys = F.array_distinct(F.flatten(F.array(*[runs(n) for n in sizes]))) if sizes else F.array().cast("array<string>")
    return w.select(id_col, F.explode(keys).alias("_k")).join(i, "_k").select(id_col, "item").distinct()


#: Different numbers of words that items may have.
MOST_WORDS = 64


def ordered_by_flags(df: DataFrame, by: str, flags: list[str], scores: list[str], tie: str) -> DataFrame:
    """Adds place: within `by`, rows with flags first, then by scores, downwards; nulls last, ties by the key."""
    order = [F.coalesce(F.col(f), F.lit(False)).desc() for f in flags] + [F.col(s).desc_nulls_last() for s in scores]
    return df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order, tie)))


# Fixed value: what a text in Markdown looks like on its surface.
MARKDOWN = r"(?m)^\s*(?:#{1,6}\s|[-*+]\s|\d+\.\s|```)|\*\*.+?\*\*|\[[^\]]+\]\([^)]+\)"


def looks_markdown(c: Column) -> Column:
    return c.rlike(MARKDOWN)


def is_json(c: Column) -> Column:
    """Whether a text is JSON, of any kind; null stays null."""
    return F.when(c.isNotNull(), F.try_parse_json(c).isNotNull())


def outcome_checks(df: DataFrame, id_col: str, answer: Column, exit_reason: Column, exits: Column, found: Column, wanted: Column, evidence: Column, terms: Column, form: Column, keys: Column) -> DataFrame:
    """id and the checks of how a run ended, each null without an expectation or an observation: expected_exit_reason
    (among exits), evidence_recall and evidence_ids (wanted ids found; null where found is), evidence_terms (all terms in
    the evidence, case and spacing aside), output_format (text, json or markdown), required_json_keys."""
    d = df.select(id_col, answer.alias("a"), F.nullif(F.trim(exit_reason), F.lit("")).alias("x"), exits.alias("xs"), found.alias("f"), F.array_distinct(wanted).alias("w"), evidence.alias("e"), terms.alias("t"), form.alias("o"), keys.alias("k"))
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), "\\s+", " "))
    recall = F.when(some("w") & F.col("f").isNotNull(), F.size(F.array_intersect("w", "f")) / F.size("w"))
    in_form = F.when(F.col("o") == "text", F.trim("a") != "").when(F.col("o") == "json", is_json(F.col("a"))).when(F.col("o") == "markdown", looks_markdown(F.col("a")))
    has = F.json_object_keys(F.when(is_json(F.col("a")), F.col("a")))  # null where the answer is no object
    return d.select(
        id_col, F.when(F.col("x").isNotNull() & some("xs"), F.array_contains("xs", F.col("x"))).alias("expected_exit_reason"),
        F.round(recall, 6).alias("evidence_recall"), (recall == 1).alias("evidence_ids"),
        F.when(some("t") & F.col("e").isNotNull(), F.forall("t", lambda t: F.contains(flat(F.col("e")), flat(t)))).alias("evidence_terms"),
        F.when(F.col("a").isNotNull() & F.col("o").isNotNull(), in_form).alias("output_format"),
        F.when(some("k") & F.col("a").isNotNull(), F.coalesce(F.size(F.array_except("k", has)) == 0, F.lit(False))).alias("required_json_keys"),
    )


def question_faults(rows: DataFrame, chunks: DataFrame, categories: list[str], policy: str) -> DataFrame:
    """id, level (error or warning), fault of reviewed questions: a row for each rule that one breaks.

    rows (id, question, category, review_status, reviewed, answerable, in_domain, reviewed_at, review_version, policy,
    chunk_ids, source_ids); chunks (chunk_id, source_id), each id once. Referential rules explode the ids and join them,
    so that the corpus is joined by key and only once.
    """
    c, empty = F.col, F.array().cast("array<string>")
    r = rows.withColumns({"_c": F.coalesce("chunk_ids", empty), "_s": F.coalesce("source_ids", empty)})
    blank = lambda x: F.coalesce(F.trim(x) == "", F.lit(True))
    true = lambda x: F.coalesce(x, F.lit(False))
    none = lambda x: F.size(x) == 0
    rules = {
        "not_accepted": ~true((c("review_status") == "accepted") & c("reviewed")),
        "empty_question": blank(c("question")),
        "invalid_category": ~true(c("category").isin(categories)),
        "unlabelled": c("answerable").isNull() | c("in_domain").isNull(),
        "answerable_outside_domain": true(c("answerable") & ~c("in_domain")),
        "invalid_reviewed_at": F.try_to_timestamp("reviewed_at").isNull(),
        "invalid_review_version": ~true(c("review_version") >= 1),
        "stale_policy": ~true(c("policy") == policy),
        "relevance_not_explicit": c("chunk_ids").isNull() | c("source_ids").isNull(),
        "answerable_without_gold": true(c("answerable")) & (none("_c") | none("_s")),
        "repeated_relevance": (F.size(F.array_distinct("_c")) < F.size("_c")) | (F.size(F.array_distinct("_s")) < F.size("_s")),
    }
    named = F.array_compact(F.array(*[F.when(x, F.lit(n)) for n, x in rules.items()]))
    own = r.select("id", F.lit("error").alias("level"), F.explode(named).alias("fault"))
    warned = r.where(true(~c("in_domain")) & ~(none("_c") & none("_s"))).select("id", F.lit("warning").alias("level"), F.lit("outside_domain_with_relevance").alias("fault"))
    again = r.groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1").select("id", F.lit("error").alias("level"), F.lit("repeated_id").alias("fault"))
    known = r.select("id", "_s", F.explode(F.array_distinct("_c")).alias("chunk_id")).join(chunks.select("chunk_id", "source_id"), "chunk_id", "left")
    lost = F.when(c("source_id").isNull(), F.concat(F.lit("unknown_chunk:"), c("chunk_id"))).when(~F.array_contains("_s", c("source_id")), F.concat(F.lit("source_absent:"), c("chunk_id")))
    lost = known.select("id", F.lit("error").alias("level"), lost.alias("fault")).where("fault is not null")
    sources = chunks.select(c("source_id").alias("_source")).distinct()
    strange = r.select("id", F.explode(F.array_distinct("_s")).alias("_source")).join(sources, "_source", "left_anti")
    strange = strange.select("id", F.lit("error").alias("level"), F.concat(F.lit("unknown_source:"), c("_source")).alias("fault"))
    out = own
    for more in (warned, again, lost, strange):
        out = out.unionByName(more)
    return out.distinct()

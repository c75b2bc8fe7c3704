"""Training examples from reviewed records: confidence, answers by mode, messages, second variants, and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .records import fold

# The parts of a prompt, and the lead of details added to an answer.
QUESTION_LEAD, SOURCES_LEAD, NO_SOURCES, DETAILS_LEAD = "Câu hỏi: ", "Nguồn được truy xuất:", "Không có nguồn phù hợp.", "Chi tiết liên quan: "
# What each doubt takes from 100 points; the doubts that make confidence low by themselves; the levels.
PENALTIES = {
    "semantic_disagreement": 45, "missing_answer_evidence": 45, "unresolved_contradiction": 45, "uncertain_relevance": 18, "edge_case": 12, "edge_label_conflict": 45,
    "normal_question_unanswerable": 45, "multi_hop_complexity": 8, "source_concentration": 6, "retrieval_miss": 10, "backend_disagreement": 7, "no_bm25_support": 4,
    "no_reranker_support": 4, "domain_conflict": 45,
}
HARD_STOPS = ["semantic_disagreement", "missing_answer_evidence", "unresolved_contradiction", "domain_conflict", "edge_label_conflict", "normal_question_unanswerable"]
LOW_BELOW, HIGH_FROM = 55, 80


def confidence(doubts: dict[str, Column]) -> Column:
    """(points, level, doubts) of a record; doubts: the condition of each, null as false; those named in PENALTIES count."""
    held = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in doubts.items()]))
    taken = sum((F.when(F.coalesce(c, F.lit(False)), F.lit(PENALTIES[n])).otherwise(0) for n, c in doubts.items()), F.lit(0))
    points = F.greatest(F.lit(0), F.lit(100) - taken)
    low = F.arrays_overlap(held, F.array(*[F.lit(n) for n in HARD_STOPS])) | (points < LOW_BELOW)
    return F.struct(points.alias("points"), F.when(low, "low").when(points < HIGH_FROM, "medium").otherwise("high").alias("level"), F.array_sort(held).alias("doubts"))


def mode_answer(answer: Column, facts: Column, answerable: Column, mode: Column, short: int = 7, novel: int = 3, share: float = 0.4, most: int = 2) -> Column:
    """A record's answer in a mode. concise: as it is. standard and detailed: its one fact for an answer of up to `short`
    words. detailed: with several facts, up to `most` of them behind it, each with at least `novel` words, and `share` of
    its words, that neither the answer nor a fact before has."""
    words = lambda c: F.array_distinct(F.filter(F.split(fold(c), " "), lambda w: w != ""))
    a, f = F.trim(answer), F.transform(F.coalesce(facts, F.array().cast("array<string>")), lambda x: F.trim(x))
    brief = F.size(F.filter(F.split(a, "\\s+"), lambda w: w != "")) <= short
    start = F.struct(words(a).alias("seen"), F.array().cast("array<string>").alias("added"))

    def step(s: Column, fact: Column) -> Column:
        mine = words(fact)
        n = F.size(F.array_except(mine, s["seen"]))
        take = (F.size(s["added"]) < most) & (n >= novel) & (n / F.greatest(F.lit(1), F.size(mine)) >= share)
        grown = F.struct(F.array_union(s["seen"], mine).alias("seen"), F.concat(s["added"], F.array(fact)).alias("added"))
        return F.when(take, grown).otherwise(s)

    added = F.aggregate(f, start, step, lambda s: s["added"])
    more = F.when(F.size(added) > 0, F.concat(a, F.lit("\n\n" + DETAILS_LEAD), F.array_join(added, " "))).otherwise(a)
    plain = ~F.coalesce(answerable, F.lit(False)) | (mode == "concise")
    return F.when(plain, a).when((F.size(f) == 1) & brief, F.get(f, F.lit(0))).when((F.size(f) == 1) | (mode == "standard"), a).when(mode == "detailed", more)


def prompt_messages(system: Column, question: Column, contexts: Column, history: Column | None = None, title: int | None = 250, text: int | None = 2000, turns: int = 6, turn: int = 1800) -> Column:
    """The messages to a model, an array of (role, content): system, the last turns of user and assistant, and the question
    with its sources (array of chunk_id, title, text) in their order; title, text and turn are cut to so many characters,
    or whole for None."""
    cut = lambda c, n: F.coalesce(c if n is None else F.substring(c, 1, n), F.lit(""))
    each = F.transform(contexts, lambda c: F.concat(F.lit("["), F.coalesce(c["chunk_id"], F.lit("")), F.lit("] "), cut(c["title"], title), F.lit("\n"), cut(c["text"], text)))
    sources = F.when(F.size(each) > 0, F.array_join(each, "\n\n")).otherwise(NO_SOURCES)
    row = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    ask = row(F.lit("user"), F.concat(F.lit(QUESTION_LEAD), question, F.lit("\n\n" + SOURCES_LEAD + "\n"), sources))
    if history is None:
        return F.array(row(F.lit("system"), system), ask)
    last = F.slice(history, F.greatest(F.lit(1), F.size(history) - turns + 1), F.lit(turns))
    said = F.filter(last, lambda h: h["role"].isin("user", "assistant"))
    said = F.transform(said, lambda h: row(h["role"], cut(h["content"], turn)))
    return F.concat(F.array(row(F.lit("system"), system)), said, F.array(ask))


def second_modes(df: DataFrame, id_col: str, mode: str, modes: list[str], each: int, seed: str) -> DataFrame:
    """id, mode: of each mode's rows the `each` first in the order of a seeded hash, with the mode that follows it; at most
    one second mode a row, and as many of every mode."""
    after = F.create_map(*[F.lit(x) for i, m in enumerate(modes) for x in (m, modes[(i + 1) % len(modes)])])
    h = F.sha2(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")), 256)
    parts = [df.where(F.col(mode) == m).select(id_col, mode).orderBy(h, id_col).limit(each) for m in modes]  # top-k of each
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(id_col, after[F.col(mode)].alias("mode"))


def example_faults(examples: DataFrame, records: DataFrame, key: str, mode: str, messages: str, modes: list[str], most: int) -> DataFrame:
    """key, fault of training examples (id, key, mode, messages) against records (key, split, and rebuilt: the messages of
    every mode as a map): foreign (no record, or one of the test split), invalid_mode, invalid_id, repeated, changed
    (messages are not as rebuilt), too_many (over `most` modes), and uncovered (a record of the examples' splits without one)."""
    n = F.count("*")
    twice = examples.groupBy(key, mode).agg(n.alias("_m")).where("_m > 1").select(key, F.lit("repeated").alias("fault"))
    many = examples.groupBy(key).agg(n.alias("_m")).where(F.col("_m") > most).select(key, F.lit("too_many").alias("fault"))
    j = examples.join(records.select(key, "split", "rebuilt"), key, "left")
    rules = {
        "foreign": F.col("split").isNull() | (F.col("split") == "test"),
        "invalid_mode": ~F.coalesce(F.col(mode).isin(modes), F.lit(False)),
        "invalid_id": ~F.col("id").eqNullSafe(F.concat_ws(":", F.col(key).cast("string"), F.col(mode))),
        "changed": F.col("split").isNotNull() & ~F.to_json(F.col(messages)).eqNullSafe(F.to_json(F.col("rebuilt")[F.col(mode)])),
    }
    broken = j.select(key, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).alias("fault"))
    lacking = records.where("split <> 'test'").join(examples.select(key), key, "left_anti").select(key, F.lit("uncovered").alias("fault"))
    return broken.unionByName(twice).unionByName(many).unionByName(lacking).distinct()

"""Registered queries of runs, reviewed questions, splits and running answers; inputs are derived from the tables so that
every outcome occurs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as G
from ..streaming import pieces as P
from .catalogue import query

_lits = lambda *xs: F.array(*[F.lit(x) for x in xs])


@query("""with e as (select *, case when event_id % 3 = 0 then 'c' || event_id end as cid from events), a as (select user_id, event_type, cid, event_id as call from e where event_id % 5 <> 4),
b as (select user_id, event_type, case when event_id % 2 = 0 then cid end as cid, event_id as result from e where event_id % 7 <> 6),
i as (select a.user_id, call, result, a.event_type from a join b using (user_id, cid)),
ra as (select *, row_number() over (partition by user_id, event_type order by call) as n from a where (user_id, call) not in (select user_id, call from i)),
rb as (select *, row_number() over (partition by user_id, event_type order by result) as n from b where (user_id, result) not in (select user_id, result from i))
select coalesce(ra.user_id, rb.user_id) as user_id, call, result, coalesce(ra.event_type, rb.event_type) as event_type, if(call is null or result is null, null, 'name') as matched from ra full join rb on ra.user_id = rb.user_id and ra.event_type = rb.event_type and ra.n = rb.n
union all select *, 'id' from i""")
def call_matching(t):
    i = F.col("event_id")
    e = t("events").withColumn("cid", F.when(i % 3 == 0, F.concat(F.lit("c"), i.cast("string"))))
    return G.matched_calls(e.where(i % 5 != 4), e.where(i % 7 != 6).withColumn("cid", F.when(i % 2 == 0, F.col("cid"))), "user_id", "event_type", "event_id", "cid")


_CASES = """k as (select user_id, count(*) as calls, count(distinct event_type || event_id % 40) as d, min(event_id + event_id % 30) filter (event_type = 'view') as v from events where event_id % 3 = 0 group by 1),
q as (select e.user_id, count(*) filter (event_type = 'purchase' and not coalesce(v <= event_id, false)) as broken from events e join k using (user_id) where event_id % 3 = 0 group by 1),
u as (select distinct user_id, user_id % 4 as want from events),
c as (select u.user_id, coalesce(calls, 0) as calls, coalesce(calls - d, 0) as duplicate_calls, greatest(0, coalesce(calls, 0) - 30) as excess_calls, case want when 0 then null when 3 then 0.5 else 1.0 end as coverage, coalesce(broken, 0) = 0 as dependency_valid from u left join k using (user_id) left join q using (user_id)),
cs as (select *, coalesce(coverage = 1, false) and dependency_valid as complete from c)"""


def _cases(t):
    e, i = t("events"), F.col("event_id")
    calls = e.where(i % 3 == 0).select("user_id", F.col("event_type").alias("name"), (i % 40).alias("key"), i.alias("began"), (i + i % 30).alias("ended"))
    want = F.when(F.col("user_id") % 4 == 0, F.array().cast("array<string>")).when(F.col("user_id") % 4 == 3, _lits("a", "b")).otherwise(_lits("a", "a"))
    cases = e.select("user_id").distinct().select("user_id", want.alias("required"), F.lit(30).alias("most"), _lits("a", "z").alias("fulfilled"))
    return G.agent_cases(calls, cases, "user_id", "name", "key", "began", "ended", {"purchase": "view"})


@query(f"with {_CASES} select * from cs")
def agent_cases(t):
    return _cases(t)


@query(f"with {_CASES} select user_id % 3 as variant, count(*) as cases, count(*) filter (complete) as completed, count(*) filter (dependency_valid) as dependency_valid, cast(sum(calls) as bigint) as calls, cast(sum(duplicate_calls) as bigint) as duplicate_calls, cast(sum(excess_calls) as bigint) as excess_calls, round(avg(coverage), 6) as mean_coverage from cs group by 1")
def agent_summary(t):
    return G.agent_summary(_cases(t).withColumn("variant", F.col("user_id") % 3), "variant")


@query("""with d as (select doc_id, source, lang, case doc_id % 10 when 8 then 'validation' when 9 then 'test' else 'train' end as split, sha256(coalesce(text, '')) as h from documents),
i as (select split, 'text' as kind, h as value from d union all select split, 'source', source from d union all select split, 'id', cast(doc_id as varchar) from d),
p as (select * from (values ('train', 'validation'), ('train', 'test'), ('validation', 'test')) v(a, b)), k as (select distinct kind from i),
x as (select distinct split, kind, value from i where value is not null), f as (select p.a, p.b, l.kind, count(*) as n from p join x l on l.split = p.a join x r on r.split = p.b and r.kind = l.kind and r.value = l.value group by all)
select k.kind, p.a, p.b, coalesce(n, 0) as shared from k cross join p left join f on f.kind = k.kind and f.a = p.a and f.b = p.b""")
def split_leakage(t):
    """The cross join of the SQL is of three pairs with three kinds."""
    split = F.when(F.col("doc_id") % 10 == 8, "validation").when(F.col("doc_id") % 10 == 9, "test").otherwise("train")
    values = [("text", F.sha2(F.coalesce("text", F.lit("")), 256)), ("source", F.col("source")), ("id", F.col("doc_id").cast("string"))]
    each = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in values])
    items = t("documents").select(split.alias("split"), F.explode(each).alias("i")).select("split", "i.*")
    return G.split_overlaps(items, "split", "kind", "value", ["train", "validation", "test"])


_SAID = "lower(coalesce(text, '') || case doc_id % 5 when 0 then ' By all accounts! The army was 33,000 lost' when 1 then ' 33000 lost is not a loss; certainly won' else '' end)"


@query(f"""with d as (select doc_id, {_SAID} as x from documents)
select doc_id, concat_ws(',', if(regexp_matches(x, 'by all accounts') or regexp_matches(x, 'certainly won'), 'formulaic', null), if(doc_id % 5 = 0, 'strength_as_loss', null), if(doc_id % 3 = 1, 'invalid_citations', null), if(doc_id % 4 = 1, 'missing_citations', null)) as flags from d""")
def answer_flags(t):
    i = F.col("doc_id")
    said = F.when(i % 5 == 0, " By all accounts! The army was 33,000 lost").when(i % 5 == 1, " 33000 lost is not a loss; certainly won").otherwise("")
    text = F.concat(F.coalesce("text", F.lit("")), said)
    rules = {"strength_as_loss": (["33[., ]?000", "\\blost\\b"], "is not")}
    flags = G.answer_flags(text, {"formulaic": ["by all accounts", "certainly won"]}, rules, i % 3 == 1, i % 4 == 1)
    return t("documents").select("doc_id", F.array_join(flags, ",").alias("flags"))


@query("""with n as (select doc_id, ' ' || trim(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^a-z0-9]+', ' ', 'g')) || ' ' as x from documents where doc_id % 20 = 0),
w as (select string_split(trim(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^a-z0-9]+', ' ', 'g')), ' ') as w, item_id from benchmark),
i as (select distinct array_to_string(w[2:1 + 1 + item_id % 3], ' ') as item from w where len(w) > 4), k as (select item from i where length(item) >= 4)
select doc_id, item from n join k on contains(n.x, ' ' || item || ' ')""")
def named_items(t):
    """Queries are the rows whose id is divisible by 20, against all items."""
    words = F.split(G.match_norm(F.col("text")), " ")
    items = t("benchmark").select(words.alias("w"), (F.col("item_id") % 3).cast("int").alias("n")).where(F.size("w") > 4)
    items = items.select(F.array_join(F.slice("w", F.lit(2), F.col("n") + 1), " ").alias("item"))
    return G.contained_items(t("documents").where("doc_id % 20 = 0"), "doc_id", F.col("text"), items, "item")


@query("select doc_id, row_number() over (partition by source order by coalesce(quality = 1, false) desc, toxic desc nulls last, n_chars desc nulls last, doc_id) as place from documents left join labels using (doc_id) where doc_id % 11 <> 3")
def direct_first(t):
    d = t("documents").where("doc_id % 11 <> 3").join(t("labels"), "doc_id", "left").withColumn("direct", F.col("quality") == 1)
    return G.ordered_by_flags(d, "source", ["direct"], ["toxic", "n_chars"], "doc_id").select("doc_id", "place")


_ANSWER = "case doc_id % 6 when 0 then '{\"k\": 1, \"v\": [2]}' when 1 then '[1, 2]' when 2 then '# Title' when 3 then 'plain **bold** text' when 4 then ' ' end"
_FORM = "case doc_id % 4 when 0 then 'json' when 1 then 'markdown' when 2 then 'text' end"


@query(f"""with d as (select doc_id, {_ANSWER} as a, {_FORM} as o, case doc_id % 3 when 0 then 'done' when 1 then ' ' else 'budget' end as x, doc_id % 7 as f, lower(coalesce(text, '')) as e from documents)
select doc_id, case when doc_id % 3 = 1 or doc_id % 5 = 0 then null else doc_id % 3 = 0 end as expected_exit_reason, case when f = 6 then null else round(least(f, 3) / 3.0, 6) end as evidence_recall, case when f = 6 then null else f >= 3 end as evidence_ids,
case when doc_id % 2 = 0 then contains(trim(regexp_replace(e, '\\s+', ' ', 'g')), 'in') end as evidence_terms,
case when a is null then null when o = 'json' then doc_id % 6 in (0, 1) when o = 'markdown' then doc_id % 6 in (2, 3) when o = 'text' then doc_id % 6 <> 4 end as output_format, case when a is not null then doc_id % 6 = 0 end as required_json_keys from d""")
def outcome_checks(t):
    i = F.col("doc_id")
    exits = F.when(i % 5 != 0, _lits("done", "answered"))
    found = F.when(i % 7 != 6, F.slice(_lits("a", "b", "c", "d", "e", "g"), F.lit(1), (i % 7).cast("int")))
    terms = F.when(i % 2 == 0, _lits(" IN "))
    reason = F.when(i % 3 == 0, "done").when(i % 3 == 1, " ").otherwise("budget")
    evidence = F.coalesce("text", F.lit(""))
    return G.outcome_checks(t("documents"), "doc_id", F.expr(_ANSWER), reason, exits, found, _lits("a", "b", "c", "c"), evidence, terms, F.expr(_FORM), _lits("k", "v"))


@query("""with d as (select *, doc_id % 13 as m from documents), f as (
select doc_id, 'error' as level, unnest(list_filter([if(m = 0, 'not_accepted', null), if(m = 1, 'empty_question', null), if(lang not in ('en', 'fr') or lang is null, 'invalid_category', null), if(m = 2, 'unlabelled', null), if(m = 3, 'answerable_outside_domain', null), if(m = 4, 'invalid_reviewed_at', null), if(m = 5, 'invalid_review_version', null), if(m = 6, 'stale_policy', null), if(m = 7, 'relevance_not_explicit', null), if(m = 7, 'answerable_without_gold', null), if(m = 8, 'repeated_relevance', null)], lambda x: x is not null)) as fault from d
union all select doc_id, 'warning', 'outside_domain_with_relevance' from d where m = 3 union all select doc_id, 'error', 'unknown_chunk:x' || doc_id from d where m = 9
union all select doc_id, 'error', 'source_absent:c' || doc_id from d where m = 10 union all select doc_id, 'error', 'unknown_source:s-1' from d where m in (10, 11) union all select doc_id, 'error', 'repeated_id' from d where m = 12)
select doc_id as id, level, fault from f""")
def question_rules(t):
    i, m = F.col("doc_id"), F.col("doc_id") % 13
    at = lambda n, x, other: F.when(m == n, x).otherwise(other)
    own, src = F.concat(F.lit("c"), i.cast("string")), F.concat(F.lit("s"), (i % 50).cast("string"))
    chunk_ids = F.when(m != 7, F.when(m == 8, F.array(own, own)).when(m == 9, F.array(own, F.concat(F.lit("x"), i.cast("string")))).otherwise(F.array(own)))
    source_ids = F.when(m != 7, F.when(m == 10, _lits("s-1")).when(m == 11, F.array(src, F.lit("s-1"))).otherwise(F.array(src)))
    rows = t("documents").select(
        i.alias("id"), at(1, F.lit(" "), F.lit("Why?")).alias("question"), F.col("lang").alias("category"), at(0, F.lit("open"), F.lit("accepted")).alias("review_status"), F.lit(True).alias("reviewed"),
        F.when(m != 2, F.lit(True)).alias("answerable"), (m != 3).alias("in_domain"), at(4, F.lit("soon"), F.lit("2024-05-01T10:00:00")).alias("reviewed_at"), at(5, F.lit(0), F.lit(2)).alias("review_version"),
        at(6, F.lit("p1"), F.lit("p2")).alias("policy"), chunk_ids.alias("chunk_ids"), source_ids.alias("source_ids"),
    )
    rows = rows.unionByName(rows.where("id % 13 = 12"))
    chunks = t("documents").select(own.alias("chunk_id"), src.alias("source_id"))
    return G.question_faults(rows, chunks, ["en", "fr"], "p2")


@query("""with c as (select conv_id, turn, replace(replace(replace(text, '[', '('), ']', ')'), '<', '(') as x from conversations where role = 'assistant')
select conv_id * 1000 + turn as id, 'so ' || x || '[c1] and ' || ' then [c' as shown from c""")
def answer_pieces(t):
    """Answers in pieces of seven characters, so that tags and brackets are cut anywhere, and what their readers see."""
    c = t("conversations").where("role = 'assistant'")
    x = F.translate("text", "[]<", "()(")
    whole = F.concat(F.lit("so <think>no [c1] </thin </THINK>"), x, F.lit("[zz][c1] and <tool_call>{}</tool_call> then [[c"))
    d = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), whole.alias("w")).withColumn("n", F.ceil(F.length("w") / 7).cast("int"))
    cut = d.select("id", "n", "w", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("seq"))
    pieces = cut.select("id", "seq", F.substr("w", F.col("seq") * 7 + 1, F.lit(7)).alias("piece"), (F.col("seq") == F.col("n") - 1).alias("last"), _lits("c1", "c2").alias("ids"))
    out = P.filtered_pieces(pieces, "id", "seq", "piece", "last", "ids")
    return out.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "shown"))), lambda p: p["shown"]), "").alias("shown"))

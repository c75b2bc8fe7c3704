"""Registered queries of training examples and of comparisons over several metrics; inputs are derived from the tables so
that every outcome occurs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import analytics as A
from ..operators import training as V
from ..sources import files
from .catalogue import query

_lits = lambda *xs: F.array(*[F.lit(x) for x in xs])
_MODES = ["concise", "standard", "detailed"]

#: A doubt and when a document has it, in SQL that both engines know.
_DOUBTS = {
    "semantic_disagreement": "doc_id % 17 = 3", "uncertain_relevance": "doc_id % 3 = 0", "edge_case": "lang = 'fr'", "multi_hop_complexity": "n_chars > 2000",
    "source_concentration": "doc_id % 5 = 1", "retrieval_miss": "doc_id % 4 = 2", "backend_disagreement": "lang = 'de'", "no_bm25_support": "doc_id % 2 = 0",
    "no_reranker_support": "doc_id % 7 = 0", "domain_conflict": "doc_id % 19 = 5",
}
_POINTS = "100 - (" + " + ".join(f"if(coalesce({c}, false), {V.PENALTIES[n]}, 0)" for n, c in _DOUBTS.items()) + ")"
_HELD = "array_to_string(list_sort(list_filter([" + ", ".join(f"if(coalesce({c}, false), '{n}', null)" for n, c in _DOUBTS.items()) + "], lambda x: x is not null)), ',')"


@query(f"select doc_id, greatest(0, p) as points, case when doc_id % 17 = 3 or doc_id % 19 = 5 or p < 55 then 'low' when p < 80 then 'medium' else 'high' end as level, doubts from (select doc_id, {_POINTS} as p, {_HELD} as doubts from documents)")
def confidence_points(t):
    c = V.confidence({n: F.expr(c) for n, c in _DOUBTS.items()})
    return t("documents").select("doc_id", c.alias("c")).select("doc_id", "c.points", "c.level", F.array_join("c.doubts", ",").alias("doubts"))


_SAID = "'zero' || doc_id || ' one two' || if(doc_id % 2 = 0, ' three four five six', '')"


def _records(t):
    """Answers of three or seven words, with no fact, one, or four, of which the first and the third say something new."""
    i = F.col("doc_id")
    answer = F.concat(F.lit("zero"), i.cast("string"), F.lit(" one two"), F.when(i % 2 == 0, " three four five six").otherwise(""))
    facts = F.when(i % 3 == 1, _lits(" alpha fact ")).when(i % 3 == 2, _lits("Red green blue", "red, green blue!", "north south east one", "up down left"))
    return t("documents").select("doc_id", answer.alias("answer"), facts.alias("facts"), (i % 5 != 0).alias("ok"), F.get(_lits(*_MODES), (i % 4 % 3).cast("int")).alias("mode"))


@query(f"""with r as (select doc_id, {_SAID} as a, doc_id % 3 as f, doc_id % 5 <> 0 as ok, doc_id % 4 % 3 as m from documents)
select doc_id, case when not ok or m = 0 or f = 0 then a when f = 1 then 'alpha fact' when m = 1 then a else a || chr(10) || chr(10) || '{V.DETAILS_LEAD}Red green blue north south east one' end as answer from r""")
def mode_answers(t):
    r = _records(t)
    return r.select("doc_id", V.mode_answer(F.col("answer"), F.col("facts"), F.col("ok"), F.col("mode")).alias("answer"))


@query(f"""with h as (select conv_id, list({{'r': role, 'x': role || ': ' || text[:15]}} order by turn) as h from conversations group by 1), l as (select conv_id, list_transform(list_filter(h[-3:], lambda x: x.r in ('user', 'assistant')), lambda x: x.x) as h from h)
select conv_id, 'system: Be brief.' || chr(30) || if(len(h) > 0, array_to_string(h, chr(30)) || chr(30), '') || 'user: {V.QUESTION_LEAD}what?' || chr(10) || chr(10) || '{V.SOURCES_LEAD}' || chr(10) || if(conv_id % 2 = 0, '[c' || conv_id || '] titl' || chr(10) || 'body' || chr(10) || chr(10) || '[] ' || chr(10), '{V.NO_SOURCES}') as prompt from l""")
def prompts(t):
    """The last three turns, titles and texts cut to four characters, turns to 15."""
    h = t("conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("h"))
    source = lambda i, a, b: F.struct(i.alias("chunk_id"), F.lit(a).cast("string").alias("title"), F.lit(b).cast("string").alias("text"))
    some = F.array(source(F.concat(F.lit("c"), F.col("conv_id").cast("string")), "title", "body of it"), source(F.lit(None).cast("string"), None, None))
    contexts = F.when(F.col("conv_id") % 2 == 0, some).otherwise(F.slice(some, F.lit(1), F.lit(0)))
    m = V.prompt_messages(F.lit("Be brief."), F.lit("what?"), contexts, F.col("h"), title=4, text=4, turns=3, turn=15)
    return h.select("conv_id", F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\x1e").alias("prompt"))


@query("""with m as (select doc_id, (['concise', 'standard', 'detailed'])[doc_id % 3 + 1] as mode from documents), r as (select *, row_number() over (partition by mode order by sha256('s2:' || doc_id), doc_id) as n from m)
select doc_id, case mode when 'concise' then 'standard' when 'standard' then 'detailed' else 'concise' end as mode from r where n <= 40""")
def second_modes(t):
    m = t("documents").select("doc_id", F.get(_lits(*_MODES), (F.col("doc_id") % 3).cast("int")).alias("mode"))
    return V.second_modes(m, "doc_id", "mode", _MODES, 40, "s2")


@query("""with d as (select doc_id as k, doc_id % 23 as m from documents), f as (
select k, 'foreign' as fault from d where m = 1 union all select k, 'invalid_mode' from d where m = 2 union all select k, 'changed' from d where m in (2, 3) union all select k, 'invalid_id' from d where m = 4
union all select k, 'repeated' from d where m = 5 union all select k, 'too_many' from d where m = 6 union all select k, 'uncovered' from d where m = 7 union all select k + 1000000000, 'foreign' from d where m = 8)
select k, fault from f""")
def example_checks(t):
    i, m = F.col("doc_id"), F.col("doc_id") % 23
    message = lambda x: F.array(F.struct(F.lit("user").alias("role"), x.alias("content")))
    said = lambda mode: F.concat(mode, F.lit(" of "), i.cast("string"))
    rebuilt = F.create_map(*[x for n in _MODES for x in (F.lit(n), message(said(F.lit(n))))])
    records = t("documents").select(i.alias("k"), F.when(m == 1, "test").otherwise("train").alias("split"), rebuilt.alias("rebuilt"))
    times = F.when(m == 6, F.lit(3)).when(m == 5, F.lit(2)).when(m == 7, F.lit(0)).otherwise(F.lit(1))
    e = t("documents").select(i, m.alias("m"), F.explode(F.filter(F.array(*[F.lit(x) for x in range(3)]), lambda x: x < times)).alias("n"))
    mode = F.when(F.col("m") == 2, "other").when(F.col("m") == 5, "concise").otherwise(F.get(_lits(*_MODES), F.col("n")))
    key = F.when(F.col("m") == 8, i + 1000000000).otherwise(i)
    e = e.select(i, "m", key.alias("k"), mode.alias("mode"))
    records = records.unionByName(records.where("k % 23 = 8").withColumn("split", F.lit("test"))).where("not (k % 23 = 8 and split = 'train')")
    e = e.select(F.concat_ws(":", (F.col("k") + F.when(F.col("m") == 4, 1).otherwise(0)).cast("string"), "mode").alias("id"), "k", "mode", message(F.concat(said(F.col("mode")), F.when(F.col("m") == 3, "!").otherwise(""))).alias("messages"))
    return V.example_faults(e, records, "k", "mode", "messages", _MODES, 2)


@query("""with c as (select c_nationkey as k, c_mktsegment as who, avg(c_acctbal) as score, cast(count(*) as double) as latency from customer group by all), l as (select k, who, 'score' as metric, score as v, 1 as s from c union all select k, who, 'latency', latency, -1 from c where k % 5 <> 2)
select l.metric, l.who as a, r.who as b, count(*) filter ((r.v - l.v) * l.s > 0) as wins, count(*) filter (r.v = l.v) as ties, count(*) filter ((r.v - l.v) * l.s < 0) as losses, count(*) as n, round(avg(r.v - l.v), 6) as mean_delta from l join l r on l.k = r.k and l.metric = r.metric and l.who < r.who group by all""")
def paired_metrics(t):
    """Scores, where more is better, and latencies, where less is; some keys have no latency."""
    c = t("customer").groupBy(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("who")).agg(F.avg("c_acctbal").alias("score"), F.count("*").cast("double").alias("latency"))
    c = c.withColumn("latency", F.when(F.col("k") % 5 != 2, F.col("latency")))
    return A.paired_metrics(c, "k", "who", {"score": True, "latency": False})


@query("""with p as (select * from (values ('1-URGENT', 10.0), ('2-HIGH', null), ('3-MEDIUM', 4.0), ('warmup', 2.0)) v(phase, s)), o as (select o_orderpriority as phase, o_orderstatus <> 'P' as ok, case when o_orderpriority <> '3-MEDIUM' or o_orderkey % 3 <> 0 then o_custkey end as t from orders),
g as (select phase, count(*) as n, count(*) filter (ok) as good, sum(t) filter (ok) as t, count(t) filter (ok) as known from o group by 1)
select p.phase, coalesce(n, 0) as n, coalesce(good, 0) as succeeded, round(good / n, 6) as success_rate, round((n - good) / n, 6) as error_rate, round(coalesce(good, 0) / s, 6) as requests_per_second, case when coalesce(known, 0) = coalesce(good, 0) then round(coalesce(t, 0) / s, 6) end as tokens_per_second from p left join g using (phase)""")
def phase_rates(t):
    o = t("orders").withColumn("tokens", F.when((F.col("o_orderpriority") != "3-MEDIUM") | (F.col("o_orderkey") % 3 != 0), F.col("o_custkey"))).withColumnRenamed("o_orderpriority", "phase")
    return A.phase_rates(o, "phase", F.col("o_orderstatus") != "P", "tokens", {"1-URGENT": 10.0, "2-HIGH": None, "3-MEDIUM": 4.0, "warmup": 2.0})


@query("with b as (select event_type, cast(least(4, greatest(0, floor(value / 20))) as integer) as bucket from events where value is not null), k as (select distinct event_type from b), r as (select unnest(range(5)) as bucket) select k.event_type, cast(r.bucket as integer) as bucket, count(b.bucket) as n from k cross join r left join b on b.event_type = k.event_type and b.bucket = r.bucket group by all")
def score_histogram(t):
    return A.histogram(t("events"), "event_type", "value", 20, 5)




@query("""select doc_id, '987|1945|2150|thế kỷ' as history, '1945' as metadata, '987|0123|1945|2150' as question, '987|1945' as explicit, '987|1945' as answer from documents where doc_id % 10 = 0 union all
select doc_id, '', '', '', '', '' from documents where doc_id % 10 <> 0""")
def year_kinds(t):
    """One text by every kind of pattern: each takes other numbers for years."""
    said = F.when(F.col("doc_id") % 10 == 0, "In 987 and 0123, x1945 1945, 2150 and 12345 of thế kỷ").otherwise("")
    return t("documents").select("doc_id", *[F.array_join(X.year_signs(said, k), "|").alias(k) for k in X.YEAR_PATTERNS if k != "citation"])


@query("select doc_id, lang, text from documents qualify row_number() over (partition by lang order by doc_id) <= 5")
def split_limit(t):
    return files.inspected(t("documents").select("doc_id", "lang", "text"), "lang", "doc_id", 5, 0)


@query("select doc_id, case when length(text) > 60 then text[:59] || '…' else text end as clip from documents")
def clipped_texts(t):
    return t("documents").select("doc_id", X.clipped(F.col("text"), 60).alias("clip"))

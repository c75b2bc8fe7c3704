"""Registered queries: question planning, merging of rankings, scores of answers, comparisons of runs, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import unicode as N
from ..operators import analytics as A
from ..operators import curation as U
from ..operators import evaluation as E
from ..operators import questions as Q
from ..operators import retrieval as R
from ..sources import files as S
from ..streaming import telemetry as T
from .catalogue import _DENSE, _GOLD, _RUNS, _TERMS, NORM, _bm25, _dense, _fused, _gold, _paired, query

# Question planning -------------------------------------------------------------------------------------------------

#: What stands before a user's turn to make it a question.
LEADS = ["So sánh ", "Vì sao ", "Bối cảnh và ý nghĩa của ", "", "Ai thắng trong "]
_BASE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(question, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
_FOUND = "list_filter([" + ", ".join(f"if(regexp_matches(norm, '{p}'), '{n}', null)" for n, (p, _) in Q.FACETS.items()) + "], lambda x: x is not null)"
_SUFFIX = "case f " + " ".join(f"when '{n}' then '{w}'" for n, (_, w) in Q.FACETS.items()) + " end"
_ASK = f"""q0 as (select conv_id * 1000 + turn as id, ({LEADS!r})[cast(turn % {len(LEADS)} as int) + 1] || coalesce(text, '') as question from conversations where role = 'user'),
 q1 as (select *, {_BASE} as base, {NORM.replace('text', 'question')} as norm from q0), q2 as (select *, {_FOUND} as found from q1),
 q as (select *, case when len(found) = 0 then ['general'] when list_contains(found, 'winner') and not list_contains(found, 'outcome') then list_append(found, 'outcome') else found end as facets from q2)"""


def _ask(t):
    lead = F.get(F.array(*[F.lit(x) for x in LEADS]), (F.col("turn") % len(LEADS)).cast("int"))
    return t("conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(lead, F.coalesce("text", F.lit(""))).alias("question"))


@query(f"with {_ASK} select id, array_to_string(facets, ',') as facets, facets[1] as facet, len(list_filter(facets, lambda f: f <> 'time')) >= 2 as multi_part from q")
def question_facets(t):
    f = Q.facets(F.col("question"))
    return _ask(t).withColumn("f", f).select("id", F.array_join("f", ",").alias("facets"), F.get("f", F.lit(0)).alias("facet"), (F.size(F.filter("f", lambda x: x != "time")) >= 2).alias("multi_part"))


@query(f"with {_ASK}, v as (select id, list_slice(list_concat([base], list_transform(list_filter(facets, lambda f: {_SUFFIX} is not null), lambda f: base || ' ' || {_SUFFIX})), 1, 3) as vs from q) select id, unnest(generate_series(0, len(vs) - 1)) as variant, unnest(vs) as query, unnest(list_transform(generate_series(1, len(vs)), lambda i: if(i = 1, 1.0, 0.82)::double)) as weight from v")
def query_variants(t):
    v = _ask(t).select("id", F.posexplode(Q.variants(F.col("question"), Q.facets(F.col("question")))).alias("variant", "query"))
    return v.select("id", F.col("variant").cast("long").alias("variant"), "query", F.when(F.col("variant") == 0, 1.0).otherwise(0.82).alias("weight"))


_TARGETS = f"b as (select *, regexp_replace(regexp_replace(regexp_replace(base, '{Q.COMPARE_LEAD}', ''), '{Q.COMPARE_TAIL}', ''), '{Q.EDGES}', '', 'g') as body from q), p as (select *, list_filter(list_transform(regexp_split_to_array(body, '{Q.CONJUNCTION}'), lambda x: regexp_replace(x, '{Q.EDGES}', '', 'g')), lambda x: x <> '') as parts from b where regexp_matches(norm, '{Q.FACETS['compare'][0]}'))"


@query()
def comparison_plan(t):
    """SQL has no split with a limit; tests hold the plan against hand-made questions."""
    return Q.comparison_plan(_ask(t), "id", F.col("question"))


@query(f"with {_ASK}, {_TARGETS} select id, len(parts) >= 2 as two_targets, if(len(parts) >= 2, parts[1], null) as first from p")
def comparison_targets(t):
    c = _ask(t).where(X.match_norm(F.col("question")).rlike(Q.FACETS["compare"][0])).withColumn("t", Q.comparison_targets(F.col("question")))
    return c.select("id", (F.size("t") == 2).alias("two_targets"), F.get("t", F.lit(0)).alias("first"))


@query("with a as (select label, arg_min(list_transform(embedding, lambda x: x::double), vec_id) as v from embeddings group by 1), h as (select list(v) filter (label % 2 = 0) as inside, list(v) filter (label % 2 = 1) as outside from a), m as (select vec_id, label, round(list_max(list_transform(inside, lambda w: list_dot_product(w, list_transform(embedding, lambda x: x::double)))) - list_max(list_transform(outside, lambda w: list_dot_product(w, list_transform(embedding, lambda x: x::double)))), 6) as margin from embeddings, h) select vec_id, margin, case when label = 0 then 'domain_signal' when margin < -0.06 then 'anchor_guard' when abs(margin) < 0.02 then 'low_domain_margin' else 'domain_anchor' end as reason from m")
def domain_gate(t):
    """The first vector of each label is an anchor; even labels stand for the domain. Anchors are one row, a vector a label."""
    e = t("embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    a = e.groupBy("label").agg(F.min_by("v", "vec_id").alias("v"))
    side = lambda r: F.collect_list(F.when(F.col("label") % 2 == r, F.col("v")))
    h = a.agg(side(0).alias("inside"), side(1).alias("outside"))
    near = lambda c: F.array_max(F.transform(c, lambda w: X.dot(w, F.col("v"))))
    m = e.crossJoin(F.broadcast(h)).select("vec_id", "label", F.round(near("inside") - near("outside"), 6).alias("margin"))
    no = F.lit(False)
    return m.select("vec_id", "margin", Q.domain_gate(no, F.col("label") == 0, no, F.col("margin"))["reason"].alias("reason"))


# Merging of rankings -----------------------------------------------------------------------------------------------


@query(f"with {_TERMS}, r as (select query_id, 'global' as role, 0.7 as weight, rank, row_id from b union all select query_id, if(row_id % 2 = 0, 'target_a', 'target_b'), 1.0, rank, row_id from b), e as (select query_id, role, row_id, round(sum(weight / (60 + rank)), 9) as s from r group by query_id, role, row_id qualify row_number() over (partition by query_id, role order by s desc, row_id) <= 15) select query_id, row_id, max(s) as rrf_score, array_to_string(list_sort(list(distinct role)), ',') as roles from e group by all")
def target_merge(t):
    b = _bm25(t)
    runs = b.select("query_id", F.lit("global").alias("role"), F.lit(0.7).alias("weight"), "rank", "row_id").union(b.select("query_id", F.when(F.col("row_id") % 2 == 0, "target_a").otherwise("target_b"), F.lit(1.0), "rank", "row_id"))
    return R.merged_roles(runs, 5)


@query(f"with {_TERMS}, u as (select query_id, row_id, score / 100 as rerank, 0.5 as previous, false as att from b union all select query_id, row_id, score / 50, 0.25, true from b where rank > 10), o as (select query_id, row_id, arg_min(rerank, att) as rr, arg_min(previous, att) as pp, bool_and(att) as attached from u group by all), w as (select query_id, row_id, attached, round(0.85 * rr + 0.15 * pp + if(attached and query_id % 2 = 0, 0.08, 0), 6) as score from o) select *, row_number() over (partition by query_id order by score desc, row_id) as rank from w qualify rank <= 6")
def attached_merge(t):
    b = _bm25(t)
    row = lambda d, scale, p: d.select("query_id", "row_id", (F.col("score") / scale).alias("rerank"), F.lit(p).alias("previous"))
    return R.attached_merge(row(b, 100, 0.5), row(b.where("rank > 10"), 50, 0.25), 6, F.col("query_id") % 2 == 0)


@query(f"with {_DENSE}, m as (select *, row_number() over (partition by query_id order by score desc, row_id) as r from (select query_id, row_id, round(score, 2) as score from n0) qualify r <= 20), j as (select coalesce(n.query_id, m.query_id) as query_id, n.rank as ra, m.r as rb, n.score as sa, m.score as sb from n full join m on n.query_id = m.query_id and n.row_id = m.row_id) select query_id, " + ", ".join(f"round(count(*) filter (ra <= {k} and rb <= {k}) / {k}.0, 6) as overlap_{k}, round(count(*) filter (ra <= {k} and rb <= {k}) / count(*) filter (ra <= {k} or rb <= {k}), 6) as jaccard_{k}" for k in (10, 20)) + ", round(max(abs(sa - sb)), 6) as max_delta from j group by 1")
def backend_overlap(t):
    """Exact rankings against those by the same scores, of six decimals, rounded to two."""
    e = t("embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    coarse = R.dense_top(q, e.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("v")), 20, places=(6, 2))
    return R.overlap_at(_dense(t), coarse, (10, 20))


@query()
def comparison_balance(t):
    """Balanced selection depends on its own choices; tests hold it against hand-made cases."""
    c = _bm25(t).select("query_id", "row_id", "score").join(t("documents").select(F.col("doc_id").alias("row_id"), "lang"), "row_id")
    side = lambda lang: F.when(F.col("lang") == lang, 0.5).otherwise(0.0)
    return R.balanced(c.select("query_id", "row_id", "score", side("fr").alias("relevance_a"), side("de").alias("relevance_b")), 6)


# Answers -----------------------------------------------------------------------------------------------------------

_CITED = "c as (select doc_id, [cast(n_chars % 7 as varchar), cast(length(text) % 5 as varchar)] as c, ['0', '1', '2'] as k, [cast(doc_id % 3 as varchar), '1'] as g from documents where text is not null)"


@query(f"with {_CITED} select doc_id, cast(len(c) as integer) as cited, round(len(list_filter(c, lambda x: list_contains(k, x))) / len(c), 6) as validity, round(len(list_intersect(list_intersect(c, k), g)) / len(list_distinct(c)), 6) as precision, round(len(list_intersect(list_intersect(c, k), g)) / len(list_distinct(g)), 6) as recall from c")
def citation_scores(t):
    d = t("documents").where("text is not null")
    answer = F.concat(F.lit("a ["), (F.col("n_chars") % 7).cast("string"), F.lit("; "), (F.length("text") % 5).cast("string"), F.lit("] [1999]"))
    return E.citation_scores(d, "doc_id", answer, F.array(F.lit("0"), F.lit("1"), F.lit("2")), F.array((F.col("doc_id") % 3).cast("string"), F.lit("1")))


_YEARS = "list_distinct(list_filter(regexp_extract_all({}, '[0-9]+'), lambda y: regexp_full_match(y, '[5-9][0-9]{{2}}|1[0-9]{{3}}|20[0-9]{{2}}')))"
_FLAT = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"


@query(f"with u as (select conv_id, turn, text as e from conversations where role = 'user'), a as (select conv_id, turn - 1 as turn, text as a from conversations where role = 'assistant'), j as (select conv_id * 1000 + turn as id, a, e, [e[1:12], a[3:15]] as f, turn % 3 <> 0 as ok from a join u using (conv_id, turn)), y as (select *, {_YEARS.format('a')} as ya, {_YEARS.format('e')} as ye, cast(regexp_matches(a, '{E.REFUSAL}') as double) as r from j), z as (select *, len(list_filter(ya, lambda y: not list_contains(ye, y))) as wrong from y) select id, round(len(list_filter(f, lambda x: contains({_FLAT.format('a')}, {_FLAT.format('x')}))) / 2, 6) as fact_recall, cast(if(e <> '', wrong, null) as integer) as unverified_years, if(e <> '' and len(ya) > 0, round(wrong / len(ya), 6), null) as unverified_rate, if(ok, null, r) as refused_rightly, if(ok, r, null) as refused_wrongly from z")
def grounding_scores(t):
    c = t("conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("e"))
    j = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a")).join(u, ["conv_id", "turn"])
    j = j.withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    facts = F.array(F.substring("e", 1, 12), F.substring("a", 3, 13))
    return E.grounding(j, "id", F.col("a"), F.col("e"), facts, F.col("turn") % 3 != 0)


@query("select doc_id, text[1:10] || if(instr(text, text[1:10]) > 0, ' [c1]', '') || text[11:] as with_citation, true as round_trip from documents where length(text) >= 10")
def citation_insertion(t):
    d = t("documents").where("length(text) >= 10")
    facts = F.array(F.struct(F.substring("text", 1, 10).alias("fact"), F.lit("c1").alias("id")))
    c = X.cited(F.col("text"), facts)
    return d.select("doc_id", c.alias("with_citation"), (X.uncited(c, F.array(F.lit("c1"))) == X.uncited(F.col("text"), F.array(F.lit("c1")))).alias("round_trip"))


# Runs, labels, imports ---------------------------------------------------------------------------------------------

_DIST = "count(*) as n, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99"


@query(f"with d as (select event_type, {_DIST} from events group by 1) select x.event_type, coalesce(n, 0) as n, mean, std, p50, p95, p99 from (values ('click'), ('view'), ('warmup')) x(event_type) left join d using (event_type)")
def phase_summary(t):
    return A.phase_summary(t("events"), "event_type", "value", ["click", "view", "warmup"])


@query("with d as (select user_id, event_type, quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.95) as p95 from events where event_type in ('click', 'view') group by all), l as (unpivot d on p50, p95 into name metric value v) select a.user_id, a.metric, if(a.user_id % 2 = 0, round(a.v - b.v, 6), null) as delta, if(a.user_id % 2 = 0 and b.v > 0, round(100.0 * (a.v - b.v) / b.v, 6), null) as percent, a.metric = 'p50' and coalesce(round(abs(100.0 * (a.v - b.v) / b.v), 6) > 20, false) as review from l a join l b on a.user_id = b.user_id and a.metric = b.metric and a.event_type = 'click' and b.event_type = 'view'")
def run_deltas(t):
    run = lambda k: t("events").where(F.col("event_type") == k).groupBy("user_id").agg(F.percentile("value", 0.5).alias("p50"), F.percentile("value", 0.95).alias("p95"))
    return A.run_deltas(run("click"), run("view"), "user_id", ["p50", "p95"], F.col("user_id") % 2 == 0, "p50")


@query("select vec_id, case when label = 0 then 'unexpected' when label = 1 then 'missing' when label = 2 then 'different' else 'same' end as state from embeddings")
def point_comparison(t):
    """A collection against a copy that lacks some points, has others more and some changed."""
    e = t("embeddings")
    moved = F.transform("embedding", lambda x: x + F.when(F.col("label") == 2, 0.5).otherwise(1e-7).cast("float"))
    return A.compared_points(e.where("label <> 0"), e.where("label <> 1").withColumn("embedding", moved), "vec_id", "embedding")


@query("select 'quality' as field, cast(quality as varchar) as value, count(*) as n from labels group by all union all select 'toxic', cast(toxic as varchar), count(*) from labels group by all")
def label_distribution(t):
    return A.value_counts(t("labels"), ["quality", "toxic"])


@query("select toxic as level, round(avg(cast(quality = toxic as double)), 6) as agreement, count(*) as n from labels group by grouping sets ((), (toxic))")
def agreement_rates(t):
    return t("labels").groupingSets([[], ["toxic"]], "toxic").agg(F.round(F.avg((F.col("quality") == F.col("toxic")).cast("double")), 6).alias("agreement"), F.count("*").alias("n")).withColumnRenamed("toxic", "level")


@query("select user_id, max(value) filter (event_type = 'click') as click, max(value) filter (event_type = 'view') as view from events group by 1")
def snapshot_pivot(t):
    cells = t("events").groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    return A.snapshot(cells, "user_id", "event_type", "v", ["click", "view"])


@query("select doc_id, (['base', 'cited', 'short'])[cast((row_number() over (partition by source order by sha256('42:' || doc_id), doc_id) - 1) % 3 as int) + 1] as mode from documents")
def mode_assignment(t):
    return U.dealt(t("documents").select("doc_id", "source"), "source", "doc_id", "42", ["base", "cited", "short"]).select("doc_id", "mode")


@query("with l as (select user_id, max(event_id) filter (event_type = 'click') as a, max(event_id) filter (event_type = 'view') as b, ('0x' || substr(sha256('blind:' || user_id), 1, 1))::int % 2 = 1 as swapped from events group by 1) select user_id, if(swapped, b, a) as \"left\", if(swapped, a, b) as \"right\", swapped from l where a is not null and b is not null")
def blind_pairs(t):
    return U.blind_pairs(t("events"), "user_id", "event_type", "event_id", "click", "view", "blind")


@query("select doc_id, case when lang <> 'en' then 'insert' when source = 'src0' then 'overwrite' else 'unchanged' end as action from documents")
def import_plan(t):
    d = t("documents").withColumn("h", F.md5("text"))
    new = d.withColumn("h", F.when(F.col("source") == "src0", F.concat("h", F.lit("x"))).otherwise(F.col("h")))
    return U.import_plan(d.where("lang = 'en'"), new, "doc_id", "h", "overwrite")


# Streams -----------------------------------------------------------------------------------------------------------


@query("select conv_id, cast(row_number() over (partition by conv_id order by turn) as integer) as frame, role as event, replace(text, chr(13), '') as data from conversations")
def sse_frames(t):
    """Each conversation as an event stream of its turns, with comments between, read back as frames."""
    body = F.transform(F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n"), lambda x: F.concat(F.lit("data: "), x))
    frame = F.concat(F.array(F.lit(": turn"), F.concat(F.lit("event: "), F.col("role"))), body, F.array(F.lit("")))
    lines = t("conversations").select("conv_id", "turn", F.posexplode(frame).alias("i", "line"))
    return T.sse_frames(lines.withColumn("seq", F.struct("turn", "i")), "conv_id", "seq", "line")


@query("with e as (select *, epoch_us(ts) as us from events), g as (select *, if(event_type = 'view', us - lag(us) over (partition by user_id, event_type order by us), null) as gap from e) select user_id, round((min(us) filter (event_type = 'view') - min(us)) / 1000.0, 3) as first_ms, round((max(us) filter (event_type = 'purchase') - min(us)) / 1000.0, 3) as total_ms, round(quantile_cont(gap, 0.5) / 1000.0, 3) as p50_gap_ms from g group by 1")
def stream_records(t):
    return T.stream_records(t("events"), "user_id", "ts", "event_type", "view", "purchase")


@query("select user_id, round((epoch_us(timestamp '2024-02-01') - max(epoch_us(ts))) / 1000000.0, 3) as age_s, epoch_us(timestamp '2024-02-01') - max(epoch_us(ts)) > 86400000000 as stale from events group by 1")
def staleness(t):
    return T.staleness(t("events"), "user_id", "ts", F.lit("2024-02-01 00:00:00"), 86400)


@query("with e as (select event_id, user_id, case event_type when 'click' then 'a' when 'view' then 'a' else 'b' end as stage, case when event_type in ('click', 'signup') then 'started' when event_type = 'error' then 'failed' else 'completed' end as kind, epoch_us(ts) as us from events), n as (select *, lead(us) over (partition by user_id, stage order by us) as nx from e) select user_id, stage, arg_max(kind, us) as state, round(coalesce(sum(nx - us) filter (kind = 'started'), 0) / 1000.0, 3) as active_ms from n group by all")
def stage_progress(t):
    e = t("events").withColumn("stage", F.when(F.col("event_type").isin("click", "view"), "a").otherwise("b"))
    e = e.withColumn("kind", F.when(F.col("event_type").isin("click", "signup"), "started").when(F.col("event_type") == "error", "failed").otherwise("completed"))
    return T.staged_progress(e, "user_id", "stage", "kind", "ts")


# Pages and listings ------------------------------------------------------------------------------------------------


@query("select page_id, regexp_matches(url, '^https?://[^/?#@\\s]+([/?#]|$)') as public, length(url) as chars from pages")
def url_filter(t):
    return t("pages").select("page_id", X.public_url(F.col("url")).alias("public"), F.length(X.without_secret_parameters(F.col("url"))).alias("chars"))


@query("select lang, want, coalesce(n, 0) as n, greatest(0, want - coalesce(n, 0)) as short_by from (values ('en', 500), ('de', 100), ('xx', 5)) q(lang, want) left join (select lang, count(*) as n from documents group by 1) using (lang)")
def quota_report(t):
    n = t("documents").groupBy("lang").agg(F.count("*").alias("n"))
    want = F.array(*[F.struct(F.lit(k).alias("lang"), F.lit(w).alias("want")) for k, w in (("en", 500), ("de", 100), ("xx", 5))])
    quotas = n.agg(F.count("*")).select(F.explode(want).alias("q")).select("q.*")
    return quotas.join(n, "lang", "left").select("lang", "want", F.coalesce("n", F.lit(0)).alias("n"), F.greatest(F.lit(0), F.col("want") - F.coalesce("n", F.lit(0))).alias("short_by"))


@query("select user_id, round(sum(value) filter (event_type = 'click'), 6) as planning, round(sum(value) filter (event_type = 'view'), 6) as tools, round(greatest(0, sum(value) - coalesce(sum(value) filter (event_type = 'click'), 0) - coalesce(sum(value) filter (event_type = 'view'), 0)), 6) as orchestration from events group by 1")
def wall_time_buckets(t):
    of = lambda k: F.sum(F.when(F.col("event_type") == k, F.col("value")))
    rest = F.sum("value") - F.coalesce(of("click"), F.lit(0.0)) - F.coalesce(of("view"), F.lit(0.0))
    return t("events").groupBy("user_id").agg(F.round(of("click"), 6).alias("planning"), F.round(of("view"), 6).alias("tools"), F.round(F.greatest(F.lit(0.0), rest), 6).alias("orchestration"))


@query("with s as (select doc_id, '[\"' || coalesce(lang, 'null') || '\",\"' || coalesce(source, 'null') || '\"]' as s from documents), n as (select s, count(*) as n, sha256('7:' || s) as r from s group by 1), k as (select *, sum(n) over () as al, cast(count(*) over () <= 100 as int) as own from n), j as (select *, unnest(generate_series(0, least(n, 100))) as j from (select s, n, r, al, own from k)), g as (select s, count(*) as more from (select s, row_number() over (order by round(100.0 * n / al - own - j, 9) desc, r desc, s) as p from j where j < n - own) where p <= (select 100 - sum(own) from k) group by 1), i as (select doc_id, s, row_number() over (partition by s order by sha256('7:' || doc_id), doc_id) as i from s) select doc_id from i join k using (s) left join g using (s) where i <= own + coalesce(more, 0)")
def stratified_sample(t):
    return U.stratified_sample(t("documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 100, "7").select("doc_id")


@query()
def balanced_subset(t):
    """A choice depends on those before; tests hold it against the loop over all rows."""
    return U.balanced_subset(t("documents"), ["lang", "source"], "doc_id", 60)


_POOL = "g as (select source, ascii(lang) as grp, row_number() over (partition by source, lang order by doc_id) as pos, doc_id, case doc_id % 3 when 0 then 'history' when 1 then 'web' else 'upload' end as kind from documents)"


@query(f"with {_POOL}, f as (select *, row_number() over (partition by source, kind order by pos, -grp, doc_id) = 1 as lead from g), o as (select *, case when lead and kind = 'upload' then 0 when lead and kind = 'web' then 1 else 2 end as o from f) select source, doc_id, row_number() over (partition by source order by o, pos, -grp, doc_id) as rank from o qualify rank <= 8")
def evidence_selection(t):
    pos = F.row_number().over(Window.partitionBy("source", "lang").orderBy("doc_id"))
    kind = F.get(F.array(F.lit("history"), F.lit("web"), F.lit("upload")), (F.col("doc_id") % 3).cast("int"))
    g = t("documents").select("source", F.ascii("lang").alias("grp"), pos.alias("pos"), "doc_id", kind.alias("kind"))
    return U.selected_evidence(g, "source", "grp", "pos", "doc_id", "kind", ["upload", "web"], 8)


@query("with g as (select user_id, user_id % 4 <> 0 as cap, count(*) as n, count(*) - count(distinct event_type || props) as r, list(distinct event_type) as seen from events group by all) select user_id, cast(if(cap, n, null) as integer) as call_count, cast(if(cap, r, null) as integer) as repeated_calls, if(cap, round(r / n, 6), null) as repeated_rate, if(cap, list_has_all(seen, ['click', 'view']), null) as required_tools, if(cap, list_has_any(seen, ['signup', 'purchase']), null) as any_tool_groups, if(cap, not list_has_any(seen, ['error']), null) as forbidden_tools, if(cap and user_id % 3 = 0, list_has_all(['click', 'view', 'error', 'purchase'], seen), null) as allowed_tools, if(cap, n <= 60, null) as max_tool_calls, if(cap, r <= 0, null) as max_repeated_calls from g")
def behavior_checks(t):
    g = t("events").groupBy("user_id").agg(F.collect_list(F.struct(F.col("event_type").alias("name"), F.concat("event_type", "props").alias("fingerprint"))).alias("c"))
    names = lambda *n: F.array(*[F.lit(x) for x in n])
    allowed = F.when(F.col("user_id") % 3 == 0, names("click", "view", "error", "purchase"))
    return E.behavior_checks(g, "user_id", F.col("user_id") % 4 != 0, F.col("c"), names("click", "view"), F.array(names("signup", "purchase")), names("error"), allowed, F.lit(60), F.lit(0))


_WAYS = f"with {_RUNS}, {_GOLD.replace('g as (', 'gg as (')}, w as (select gg.query_id, items, (select list(row_id order by rank) from b where b.query_id = gg.query_id and rank <= 10) as bm, (select list(row_id order by rank) from r where lane = 'dense' and r.query_id = gg.query_id and rank <= 10) as de, (select list(row_id order by rank) from ff where ff.query_id = gg.query_id and rank <= 5) as fi from gg)"


@query(f"{_WAYS} select query_id, case when items is null then 'negative_edge' when not coalesce(list_has_any(items, fi), false) then 'final_miss' when coalesce(list_has_any(items, de), false) and not coalesce(list_has_any(items, bm), false) then 'dense_only_hit' when coalesce(list_has_any(items, bm), false) and not coalesce(list_has_any(items, de), false) then 'bm25_only_hit' else 'shared_hit' end as behavior from w")
def retrieval_behavior(t):
    """A benchmark item that no document holds has no answer."""
    f = _fused(t)
    ids = lambda d, n: d.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "row_id"))), lambda x: x["row_id"]).alias(n))
    dense = _paired(t).select("query_id", "rank", "row_id")
    j = _gold(t).join(ids(dense, "de"), "query_id", "left").join(ids(_bm25(t), "bm"), "query_id", "left").join(ids(f, "fi"), "query_id", "left")
    return j.select("query_id", E.retrieval_behavior(F.col("items"), F.col("de"), F.col("bm"), F.col("fi"), F.col("items").isNull()).alias("behavior"))


@query(f"with {_RUNS} select query_id, row_id, cast(list_min(list_transform(list_filter(string_split(hits, ','), lambda h: starts_with(h, 'dense:')), lambda h: cast(split_part(h, '@', 2) as int))) as integer) as dense_rank, cast(list_min(list_transform(list_filter(string_split(hits, ','), lambda h: starts_with(h, 'bm25:')), lambda h: cast(split_part(h, '@', 2) as int))) as integer) as bm25_rank from ff")
def hit_ranks(t):
    return _fused(t).select("query_id", "row_id", X.first_rank(F.col("hits"), "dense").alias("dense_rank"), X.first_rank(F.col("hits"), "bm25").alias("bm25_rank"))


@query("select conv_id, turn, text || ' [c1]' as shown from conversations where role = 'assistant' and not regexp_matches(text, '\\[')")
def known_citations(t):
    c = t("conversations").where("role = 'assistant' and not contains(text, '[')")
    whole = F.concat(F.lit("[zz]"), "text", F.lit(" [c1][c9]"))
    return c.select("conv_id", "turn", X.only_known_citations(whole, F.array(F.lit("c1"), F.lit("c2"))).alias("shown"))


@query("select doc_id, coalesce(regexp_matches(text, '(?i)\\b(sk|pk|api|key|token)[-_][a-z0-9_-]{8,}') or regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'), false) as secret from documents")
def secret_flags(t):
    return t("documents").select("doc_id", X.has_secret(F.col("text")).alias("secret"))


@query("with c as (select lang, source, len(regexp_extract_all(text, '[0-9]{4}')) as n from documents) select lang, source, count(*) as rows, count(*) filter (n > 0) as cited, cast(coalesce(sum(n), 0) as bigint) as citations, round(median(n) filter (n > 0), 6) as median_of_cited from c group by grouping sets ((), (lang), (source))")
def citation_statistics(t):
    c = t("documents").select("lang", "source", F.size(F.regexp_extract_all("text", F.lit("[0-9]{4}"), F.lit(0))).alias("n"))
    c = c.withColumn("n", F.when(F.col("n") >= 0, F.col("n")))
    return c.groupingSets([[], ["lang"], ["source"]], "lang", "source").agg(F.count("*").alias("rows"), F.count_if(F.col("n") > 0).alias("cited"), F.coalesce(F.sum("n"), F.lit(0)).alias("citations"), F.round(F.median(F.when(F.col("n") > 0, F.col("n"))), 6).alias("median_of_cited")).select("lang", "source", "rows", "cited", "citations", "median_of_cited")


@query("select source, doc_id, text[1:240] as text from (select *, row_number() over (partition by source order by doc_id) as n from documents) where n <= 3")
def source_inspection(t):
    return S.inspected(t("documents").select("source", "doc_id", "text"), "source", "doc_id", 3)


@query("select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(coalesce(text, '')), '\\r\\n?', chr(10), 'g'), '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x9F]', '', 'g'), '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+\\z', '', 'g') as normalized from documents")
def doc_normalized(t):
    return t("documents").select("doc_id", N.normalized_text(F.col("text")).alias("normalized"))

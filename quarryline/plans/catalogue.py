"""The registered queries of the library and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import analytics as A
from ..operators import corpus as C
from ..operators import evaluation as E
from ..operators import lexical as L
from ..operators import retrieval as R
from ..sources import scratch as S
from ..streaming import telemetry as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__doc__ = f.__doc__
        if f.__name__ in QUERIES:
            raise ValueError(f"there are two queries named {f.__name__}")
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


NORM = "trim(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^a-z0-9]+', ' ', 'g'))"


# Text and identity -------------------------------------------------------------------------------------------------


@query(f"select doc_id, {NORM} as norm, regexp_replace(regexp_replace(trim(coalesce(text, ''), ' ' || chr(10)), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') as clean from documents")
def text_match_norm(t):
    return t("documents").select("doc_id", X.match_norm(F.col("text")).alias("norm"), X.clean_text(F.col("text")).alias("clean"))


@query("""select doc_id, sha256(text) as content_hash, 'doc_' || substr(sha256('["' || doc_id || '","' || source || '"]'), 1, 24) as stable_id from documents""")
def doc_content_hash(t):
    return t("documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"), X.stable_id("doc", F.col("doc_id"), F.col("source")).alias("stable_id"))


@query("select doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as tokens, length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) >= 80 as enough from documents")
def doc_token_counts(t):
    return t("documents").select("doc_id", F.size(F.filter(F.split("text", "\\s+"), lambda x: x != "")).alias("tokens"), X.enough_text(F.col("text")).alias("enough"))


@query("select doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '\\b(1[0-9]{3}|20[0-9]{2})\\b', 1), lambda x: cast(x as integer)))) as years from documents where regexp_matches(text, '\\b(1[0-9]{3}|20[0-9]{2})\\b')")
def doc_years(t):
    return t("documents").select("doc_id", X.years(F.col("text")).alias("years")).where(F.size("years") > 0)


@query("""select page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) as title,
 trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<head[^>]*>.*?</head>', ' ', 'g'), '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) as body from pages""")
def page_text(t):
    return t("pages").select("page_id", X.html_title(F.col("html")).alias("title"), X.html_text(F.col("html")).alias("body"))


@query("select page_id, regexp_extract(url, '^([a-z]+)://', 1) as scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) as path, starts_with(url, 'http') and url not like '%@%' as public from pages")
def page_url_parts(t):
    return t("pages").select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path"), (F.col("url").startswith("http") & ~F.col("url").contains("@")).alias("public"))


@query("select doc_id, regexp_replace(regexp_replace(text, '(?i)\\b(sk|pk|api|key|token)[-_][a-z0-9_-]{8,}', '[REDACTED]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[REDACTED]', 'g') as masked from documents where regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')")
def doc_redaction(t):
    return t("documents").where(F.col("text").rlike("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}")).select("doc_id", X.secrets_masked(F.col("text")).alias("masked"))


# Corpus ------------------------------------------------------------------------------------------------------------


@query("select doc_id, source, lang from (select *, row_number() over (partition by sha256(text) order by lang, doc_id) as n from documents) where n = 1")
def doc_exact_dedup(t):
    return C.first_of_each(t("documents").withColumn("sha", F.sha2("text", 256)).select("doc_id", "source", "lang", "sha"), ["sha"], ["lang", "doc_id"]).select("doc_id", "source", "lang")


@query("select count(*) as n, count(distinct doc_id) as ids, count(*) - count(distinct doc_id) as duplicate_ids, count(*) - count(distinct text) as duplicate_texts, count(*) filter (text is null or text = '') as no_text, count(*) filter (source is null or source = '') as no_source, count(*) filter (length(trim(text)) < 40) as near_empty from documents")
def doc_audit_counts(t):
    d = t("documents")
    # Distinct texts are counted by digest groups; countDistinct over texts would carry them through the shuffle.
    texts = d.groupBy(F.unhex(F.md5("text")).alias("h")).agg(F.count("*").alias("c")).agg(F.sum(F.col("c") - 1).alias("duplicate_texts"))
    ids = d.groupBy("doc_id").count().agg(F.count("*").alias("ids"), F.sum("count").alias("n"))
    rest = d.agg(F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("no_text"), F.count_if(F.col("source").isNull() | (F.col("source") == "")).alias("no_source"), F.count_if(F.length(F.trim("text")) < 40).alias("near_empty"))
    return ids.crossJoin(texts).crossJoin(rest).select("n", "ids", (F.col("n") - F.col("ids")).alias("duplicate_ids"), "duplicate_texts", "no_text", "no_source", "near_empty")


@query("""with r as (select lang, n_chars, row_number() over (partition by lang order by n_chars) as i, count(*) over (partition by lang) as n from documents)
select lang, max(n) as n, min(n_chars) as least, round(avg(n_chars), 2) as mean, max(n_chars) filter (i = 1 + floor((n - 1) * 0.5)) as p50, max(n_chars) filter (i = 1 + floor((n - 1) * 0.9)) as p90, max(n_chars) filter (i = 1 + floor((n - 1) * 0.95)) as p95, max(n_chars) as most from r group by lang""")
def doc_length_profile_lower(t):
    return C.lower_rank_profile(t("documents"), ["lang"], "n_chars", {"p50": 0.5, "p90": 0.9, "p95": 0.95})


@query("select lang, round(median(n_chars), 6) as median, quantile_disc(n_chars, 0.95) as p95 from documents group by lang")
def doc_length_profile_nearest(t):
    return t("documents").groupBy("lang").agg(F.round(F.median("n_chars"), 6).alias("median"), F.expr("percentile_disc(0.95) within group (order by n_chars)").cast("long").alias("p95"))


@query("select lang, count(*) as n, round(avg(n_chars), 6) as mean, round(stddev_pop(n_chars), 6) as std, round(quantile_cont(n_chars, 0.5), 6) as p50, round(quantile_cont(n_chars, 0.95), 6) as p95, round(quantile_cont(n_chars, 0.99), 6) as p99 from documents group by lang")
def doc_length_profile_linear(t):
    return t("documents").withColumn("v", F.col("n_chars").cast("double")).groupBy("lang").agg(*A.distribution("v"))


#: name, pattern, points; None drops.
RULES = [("near_empty", None, None), ("licence", "(?i)(license|copyright)", -3), ("shouting", "!!", -4), ("markup", "[|*&%$]{3}", -3), ("sentences", "[a-z][.] [A-Z]", 4), ("articles", "(?i)(^|[^\\p{L}])(the|der|die|le|la|el|los)([^\\p{L}]|$)", 4)]


def _rules():
    out = []
    for name, pattern, points in RULES:
        out.append((name, F.length(F.trim("text")) < 40 if pattern is None else F.col("text").rlike(pattern), points))
    return out


_FLAGS = ", ".join(f"coalesce({'length(trim(text)) < 40' if p is None else f'regexp_matches(text, {chr(39)}{p}{chr(39)})'}, false) as {n}" for n, p, _ in RULES)
_SCORE = " + ".join(f"if({n}, {w}, 0)" for n, _, w in RULES if w is not None)
_REASONS = "list_filter([" + ", ".join(f"if({n}, '{n}', null)" for n, _, _ in RULES) + "], lambda x: x is not null)"
CLASSIFIED = f"c as (select doc_id, lang, source, greatest(0, least(10, {_SCORE})) as score, {_REASONS} as reasons, near_empty from (select *, {_FLAGS} from documents)), k as (select *, case when near_empty then 'DROP' when score >= 6 then 'KEEP' when score >= 3 then 'REVIEW' else 'DROP' end as decision from c)"


def _classified(t):
    return C.classified(t("documents"), _rules(), 6, 3)


@query(f"with {CLASSIFIED} select doc_id, score, array_to_string(reasons, ',') as reasons, decision from k")
def doc_classify_rules(t):
    return _classified(t).select("doc_id", "score", F.array_join("reasons", ",").alias("reasons"), "decision")


@query(f"with {CLASSIFIED} select if(len(reasons) = 0, '<none>', array_to_string(list_sort(reasons), ' + ')) as combo, count(*) as n from k group by 1")
def doc_reason_combos(t):
    combo = F.when(F.size("reasons") == 0, "<none>").otherwise(F.array_join(F.array_sort("reasons"), " + "))
    return _classified(t).groupBy(combo.alias("combo")).agg(F.count("*").alias("n"))


@query(f"with {CLASSIFIED} select lang, count(*) filter (decision = 'KEEP') as keep, count(*) filter (decision = 'REVIEW') as review, count(*) filter (decision = 'DROP') as dropped from k group by lang")
def doc_category_decision_pivot(t):
    p = _classified(t).groupBy("lang").pivot("decision", ["KEEP", "REVIEW", "DROP"]).count()
    return p.select("lang", *[F.coalesce(a, F.lit(0)).alias(b) for a, b in (("KEEP", "keep"), ("REVIEW", "review"), ("DROP", "dropped"))])


@query("select doc_id, n_chars from documents order by n_chars desc, doc_id desc limit 10")
def doc_top10_longest(t):
    return t("documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), F.desc("doc_id")).limit(10)


@query("select source, doc_id, n_chars, n as rank from (select *, row_number() over (partition by source order by n_chars desc, doc_id) as n from documents) where n <= 3")
def doc_top_by_source(t):
    return R.top(t("documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), "doc_id"], 3)


@query("select lang, doc_id, h as hash_rank, n as rank from (select *, row_number() over (partition by lang order by h, doc_id desc) as n from (select *, substr(sha256('42:' || lang || ':' || doc_id), 1, 16) as h from documents)) where n <= 12")
def doc_hash_sample(t):
    return C.hash_ranked(t("documents").select("lang", "doc_id"), "42", "lang", "doc_id", 12)


_CHUNKS = "w as (select doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as w from documents), i as (select doc_id, w, unnest(generate_series(0, greatest(0, cast(ceil((len(w) - 220) / 180.0) as bigint)))) as chunk_index from w where len(w) > 0), c as (select doc_id, cast(chunk_index as integer) as chunk_index, array_to_string(list_slice(w, chunk_index * 180 + 1, chunk_index * 180 + 220), ' ') as chunk_text from i)"


@query(f"with {_CHUNKS} select * from c")
def chunk_fixed_words(t):
    return C.word_chunks(t("documents"), "doc_id", F.col("text"))


@query(f"with {_CHUNKS} select a.doc_id, a.chunk_index as anchor, b.chunk_index, length(b.chunk_text) as chars from c a join c b on a.doc_id = b.doc_id and b.chunk_index between a.chunk_index - 1 and a.chunk_index + 1 and a.chunk_index <> b.chunk_index")
def chunk_neighbors(t):
    n = C.neighbours(C.word_chunks(t("documents"), "doc_id", F.col("text")), "doc_id", 1)
    return n.select("doc_id", "anchor", "chunk_index", F.length("chunk_text").alias("chars"))


@query()
def chunk_token_budget(t):
    """Sentence packing by a budget of words is sequential; tests hold it against its invariants."""
    return C.budget_chunks(t("documents"), "doc_id", "text")


# Retrieval ---------------------------------------------------------------------------------------------------------

_TERMS = f"d as (select doc_id, list_filter(string_split({NORM}, ' '), lambda x: length(x) >= 2) as ts from documents), p as (select term, doc_id as row_id, count(*) as tf from (select doc_id, unnest(ts) as term from d) group by all), l as (select row_id, sum(tf) as dl from p group by 1), s as (select (select count(*) from documents) as n_docs, (select avg(dl) from l) as avgdl), f as (select term, count(*) as df from p group by 1), q as (select item_id as query_id, term, count(*) as qtf from (select item_id, unnest(list_filter(string_split({NORM}, ' '), lambda x: length(x) >= 2)) as term from benchmark) group by all), b0 as (select query_id, p.row_id, round(sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score from q join p using (term) join f using (term) join l on l.row_id = p.row_id cross join s group by all), b as (select *, row_number() over (partition by query_id order by score desc, row_id) as rank from b0 qualify rank <= 20)"


def _asked(t, terms=X.terms):
    q = t("benchmark").select(F.col("item_id").alias("query_id"), F.explode(terms(F.col("text"))).alias("term"))
    return q.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def _bm25(t, k=20):
    """By an index of the documents that the session writes once for all queries that search it."""
    d = t("documents")
    return L.search(d.sparkSession, S.once(d, "bm25", lambda path: L.build(d, "doc_id", F.col("text"), path)), _asked(t), k)


@query(f"with {_TERMS} select * from b")
def bm25_topk(t):
    return _bm25(t)


_DENSE = "e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v, label from embeddings), n0 as (select a.vec_id as query_id, b.vec_id as row_id, a.label as q_label, b.label, round(list_dot_product(a.v, b.v), 6) as score from e a, e b where a.vec_id % 20 = 0), n as (select *, row_number() over (partition by query_id order by score desc, row_id) as rank from n0 qualify rank <= 20)"


def _dense(t, k=20, asked=None):
    """asked: the ids (query_id) that are searched for, if not all."""
    e = t("embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    q = q if asked is None else q.join(F.broadcast(asked), "query_id", "left_semi")
    return R.dense_top(q, e.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("v")), k)


@query(f"with {_DENSE} select query_id, row_id, score, rank from n")
def dense_topk(t):
    return _dense(t)


@query(f"with {_DENSE} select query_id, round(avg(cast(q_label = label as double)), 6) as label_precision from n where query_id <> row_id group by 1")
def dense_label_gold(t):
    e = t("embeddings")
    n = _dense(t).join(e.select(F.col("vec_id").alias("row_id"), "label"), "row_id").join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label")), "query_id").where("query_id <> row_id")
    return n.groupBy("query_id").agg(F.round(F.avg((F.col("q_label") == F.col("label")).cast("double")), 6).alias("label_precision"))


@query(f"with {_DENSE}, m as (select *, row_number() over (partition by query_id order by score desc, row_id) as r from n0 where q_label = label qualify r <= 10) select n.query_id, count(m.row_id) as common, round(count(m.row_id) / 10.0, 6) as recall from n left join m on n.query_id = m.query_id and n.row_id = m.row_id where n.rank <= 10 group by 1")
def ann_overlap(t):
    """Exact top 10 against a probe of the query's own partition."""
    e = t("embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")
    near = R.dense_top(q, e.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("v"), "label"), 10, within="label").select("query_id", "row_id", F.lit(1).alias("found"))
    both = _dense(t, 10).join(near, ["query_id", "row_id"], "left")
    return both.groupBy("query_id").agg(F.count("found").alias("common"), F.round(F.count("found") / 10.0, 6).alias("recall"))


_RUNS = f"{_TERMS}, {_DENSE.replace(' n as', ' dn as').replace('from n0', 'from n0')}, r as (select query_id, 0 as variant, 'bm25' as lane, 1 as lane_order, 1.0 as weight, rank, row_id, score from b union all select m.item_id, 0, 'dense', 0, 0.82, dn.rank, dn.row_id, dn.score from dn join (select item_id, row_number() over (order by item_id) - 1 as i from benchmark) m on dn.query_id = m.i * 20), fu as (select query_id, row_id, round(sum(weight / (60 + rank)), 9) as rrf_score, min(variant * 1000000 + lane_order * 1000 + rank) as f, max(score) filter (lane = 'dense') as best_dense, max(score) filter (lane = 'bm25') as best_bm25, array_to_string(list_sort(list(lane || ':q' || variant || '@' || rank)), ',') as hits from r group by all), ff as (select * exclude (f), row_number() over (partition by query_id order by rrf_score desc, f, row_id) as rank from fu qualify rank <= 20)"


def _paired(t):
    """The dense rankings that stand for those of the benchmark's items; no other vectors are searched for."""
    pair = t("benchmark").select("item_id", ((F.row_number().over(Window.orderBy("item_id")) - 1) * 20).cast("long").alias("query_id"))  # the queries, few
    return _dense(t, asked=pair.select("query_id")).join(pair, "query_id").drop("query_id").withColumnRenamed("item_id", "query_id")


def _fused(t):
    cols = ["query_id", F.lit(0).alias("variant"), "lane", "lane_order", "weight", "rank", "row_id", "score"]
    lex = _bm25(t).withColumns({"lane": F.lit("bm25"), "lane_order": F.lit(1), "weight": F.lit(1.0)}).select(*cols)
    den = _paired(t)
    den = den.withColumns({"lane": F.lit("dense"), "lane_order": F.lit(0), "weight": F.lit(0.82)}).select(*cols)
    return R.fused(lex.unionByName(den), 20)


@query(f"with {_RUNS} select query_id, row_id, rrf_score, best_dense, best_bm25, hits, rank from ff")
def rrf_fuse(t):
    return _fused(t)


_MM = "if(max({0}) over w - min({0}) over w < 1e-9, 0.5, ({0} - min({0}) over w) / (max({0}) over w - min({0}) over w))"


@query(f"with {_RUNS}, x as (select ff.query_id, ff.row_id, ff.rrf_score, coalesce(best_bm25, 0) as rr, least(0.18, 0.07 * cast(lang = 'en' as integer) + 0.035 * least(4, len(regexp_extract_all(coalesce(text, ''), '[0-9]{{4}}')))) as bonus from ff left join documents d on ff.row_id = d.doc_id) select query_id, row_id, round(0.72 * {_MM.format('rr')} + 0.28 * {_MM.format('rrf_score')} + coalesce(bonus, 0), 6) as final_score from x window w as (partition by query_id)")
def blend_scores(t):
    d = t("documents").select(F.col("doc_id").alias("row_id"), "lang", F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[0-9]{4}"), F.lit(0))).alias("digits"))
    j = _fused(t).join(d, "row_id", "left").withColumn("rr", F.coalesce("best_bm25", F.lit(0.0)))
    bonus = F.coalesce(R.capped_bonus([((F.col("lang") == "en").cast("int"), 0.07), (F.least(F.lit(4), F.col("digits")), 0.035)]), F.lit(0.0))
    return R.blended(j, "rr", "rrf_score", bonus, ["query_id"]).select("query_id", "row_id", "final_score")


@query(f"with {_RUNS}, y as (select ff.query_id, ff.row_id, source, row_number() over (partition by query_id, source order by ff.rank) as n from ff join documents d on ff.row_id = d.doc_id) select query_id, row_id, source from y where n <= 2")
def title_cap(t):
    j = _fused(t).join(t("documents").select(F.col("doc_id").alias("row_id"), "source"), "row_id")
    return R.top(j, ["query_id", "source"], ["rank"], 2, "n").select("query_id", "row_id", "source")


@query()
def diverse_selection(t):
    """Three-pass selection depends on its own choices; tests hold it against hand-made cases."""
    d = t("documents").select(F.col("doc_id").alias("row_id"), F.col("source").alias("title_key"), F.array("lang").alias("facets"))
    c = _fused(t).join(d, "row_id").select("query_id", "row_id", "title_key", "facets", F.array(F.lit("en"), F.lit("fr")).alias("wanted"), F.col("rrf_score").alias("score"))
    return R.diverse(c, 6)


@query(f"with {_RUNS} select query_id, case when count(best_dense) = 0 and count(best_bm25) = 0 then 'none' when count(best_dense) = 0 then 'bm25_only' when count(best_bm25) = 0 then 'dense_only' when count(*) filter (best_dense is not null and best_bm25 is not null) > 0 then 'shared' else 'both_apart' end as behavior from ff group by 1")
def behavior_class(t):
    a, b = F.count("best_dense"), F.count("best_bm25")
    both = F.count_if(F.col("best_dense").isNotNull() & F.col("best_bm25").isNotNull())
    return _fused(t).groupBy("query_id").agg(F.when((a == 0) & (b == 0), "none").when(a == 0, "bm25_only").when(b == 0, "dense_only").when(both > 0, "shared").otherwise("both_apart").alias("behavior"))


# Evaluation --------------------------------------------------------------------------------------------------------

_GOLD = "g as (select item_id as query_id, list(doc_id) filter (doc_id is not null) as items from benchmark left join documents d on contains(d.text, benchmark.text) group by 1)"


def _gold(t, short_most: int = 1000):
    """Documents that hold a benchmark item. An item's inner words are whole in any document that holds it, so a document
    is only compared with the items whose words 2 to 5, as one string, it has. Items of fewer words than six have no such
    key: they are a stated set, each looked for in every document, `short_most` at a time."""
    b = t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("item")).withColumn("w", F.split("item", "\\s+"))
    long = b.where("size(w) >= 6").select("query_id", "item", F.array_join(F.slice("w", 2, 4), " ").alias("key"))
    d = t("documents").select("doc_id", "text")
    w = d.select("doc_id", F.split("text", "\\s+").alias("w"))
    shingles = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - 4)), lambda i: F.array_join(F.array(*[F.get("w", i + k) for k in range(4)]), " "))
    keys = w.select("doc_id", F.explode(F.array_distinct(shingles)).alias("key"))
    hit = keys.join(long, "key").select("doc_id", "query_id", "item").distinct()  # items, which are few, are sent to all tasks
    hit = hit.join(d, "doc_id").where(F.contains("text", "item")).select("query_id", "doc_id").distinct()
    short = [tuple(r) for r in b.where("size(w) < 6 and item <> ''").select("query_id", "item").toLocalIterator()]
    for i in range(0, len(short), short_most):
        items = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(x).alias("x")) for q, x in short[i : i + short_most]])
        found = d.select("doc_id", F.explode(F.filter(items, lambda s: F.contains("text", s["x"]))).alias("s"))
        hit = hit.unionByName(found.select(F.col("s.q").alias("query_id"), "doc_id"))
    return b.select("query_id").join(hit.groupBy("query_id").agg(F.collect_list("doc_id").alias("items")), "query_id", "left")


_METRICS = f"with {_TERMS}, {_GOLD}, j as (select g.query_id, items, rank, list_contains(items, b.row_id) as rel from g left join b on g.query_id = b.query_id and rank <= 10), m as (select query_id, any_value(items) as items, count(*) filter (rel) as found, min(rank) filter (rel) as first, sum(1 / log2(rank + 1)) filter (rel) as dcg from j group by 1), ms as (select query_id, if(items is null, null, cast(found > 0 as double)) as hit, round(found / len(items), 6) as recall, if(items is null, null, round(found / 10.0, 6)) as precision, if(items is null, null, round(coalesce(1.0 / first, 0), 6)) as mrr, if(items is null, null, round(coalesce(dcg, 0) / list_sum(list_transform(generate_series(1, least(len(items), 10)), lambda i: 1 / log2(i + 1))), 6)) as ndcg from m)"


def _metrics(t):
    return E.ranked_metrics(_bm25(t).select("query_id", "rank", F.col("row_id").alias("item")), _gold(t), 10)


@query(f"{_METRICS} select * from ms")
def retrieval_metrics_at_k(t):
    return _metrics(t)


@query(f"{_METRICS}, u as (unpivot ms on hit, recall, precision, mrr, ndcg into name metric value v) select metric, round(avg(v), 6) as mean, count(v) as n from (select m as metric, u.v from (values ('hit'), ('recall'), ('precision'), ('mrr'), ('ndcg')) x(m) left join u on u.metric = x.m) group by 1")
def retrieval_metrics_observed(t):
    return E.observed(_metrics(t), ["query_id"], ["hit", "recall", "precision", "mrr", "ndcg"])


@query("select quality, toxic, count(*) as n, round(avg(n_chars), 6) as mean_chars from labels join documents using (doc_id) group by grouping sets ((), (quality), (toxic), (quality, toxic))")
def label_breakdown(t):
    j = t("labels").join(t("documents").select("doc_id", "n_chars"), "doc_id")
    return j.groupingSets([[], ["quality"], ["toxic"], ["quality", "toxic"]], "quality", "toxic").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars")).select("quality", "toxic", "n", "mean_chars")


_TURNS = "u as (select conv_id, turn, lower(text) as x from conversations where role = 'user'), v as (select conv_id, turn - 1 as turn, lower(text) as y from conversations where role = 'assistant'), a as (select u.conv_id * 1000 + u.turn as id, x, y from u join v on u.conv_id = v.conv_id and u.turn = v.turn)"


def _turns(t):
    """A question and the answer of the turn after it, as tokens of whole texts."""
    c = t("conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", X.answer_tokens(F.col("text")).alias("x"))
    v = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), X.answer_tokens(F.col("text")).alias("y"))
    return u.join(v, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "x", "y")


_TOK = "regexp_extract_all({}, '[\\p{{L}}\\p{{N}}]+')"
_ONE = "case when n = 0 and m = 0 then 1.0 when n = 0 or m = 0 then 0.0 else round({}, 6) end"


@query(f"with {_TURNS}, ta as (select id, t, count(*) as n from (select id, unnest({_TOK.format('x')}) as t from a) group by all), tb as (select id, t, count(*) as n from (select id, unnest({_TOK.format('y')}) as t from a) group by all), c as (select id, sum(least(ta.n, tb.n)) as c from ta join tb using (id, t) group by 1), z as (select id, len({_TOK.format('x')}) as n, len({_TOK.format('y')}) as m, coalesce(c, 0) as c from a left join c using (id)) select id, {_ONE.format('c / n')} as precision, {_ONE.format('c / m')} as recall, {_ONE.format('2 * c / (n + m)')} as f1 from z")
def answer_token_f1(t):
    return E.token_overlap(_turns(t), "id", F.col("x"), F.col("y"))


@query()
def answer_rouge_l(t):
    """Longest common subsequences of questions and answers; tests hold it against dynamic programming."""
    return _turns(t).select("id", F.round(E.rouge_l(F.col("x"), F.col("y")), 6).alias("rouge_l"))


# Curation ----------------------------------------------------------------------------------------------------------


@query("with h as (select sha256(text) as h, min(doc_id) as first, count(*) as n from documents group by 1 having count(*) > 1) select d.doc_id, first, n from documents d join h on sha256(d.text) = h.h")
def exact_dup_groups(t):
    d = t("documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return d.join(d.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "h").select("doc_id", "first", "n")


@query("select lang, n, quota from (select *, cast(f + if(row_number() over (order by round(e - f, 9) desc, lang) <= 100 - sum(f) over (), 1, 0) as bigint) as quota from (select *, floor(e) as f from (select lang, count(*) as n, count(*) * 100 / sum(count(*)) over () as e from documents group by lang)))")
def quota_largest_remainder(t):
    return A.largest_remainder(t("documents").groupBy("lang").agg(F.count("*").alias("n")), "lang", "n", 100).select("lang", "n", "quota")


@query("select lang, doc_id, n as rank from (select *, row_number() over (partition by lang order by sha256('latency-v1:42:' || doc_id), doc_id) as n from documents) where n <= 5")
def stratified_freeze_rank(t):
    h = F.sha2(F.concat(F.lit("latency-v1:42:"), F.col("doc_id").cast("string")), 256)
    return R.top(t("documents").select("lang", "doc_id", h.alias("h")), ["lang"], ["h", "doc_id"], 5).select("lang", "doc_id", "rank")


_SPLIT = "s as (select doc_id, source, sha256(text) as h, case when ('0x' || substr(sha256('42:' || source), 1, 4))::int % 10 < 8 then 'train' when ('0x' || substr(sha256('42:' || source), 1, 4))::int % 10 = 8 then 'validation' else 'test' end as split from documents)"


def _split(t):
    """Splits by a hash of the group, so that a group is in one split and no row needs another."""
    n = F.conv(F.substring(F.sha2(F.concat(F.lit("42:"), F.col("source")), 256), 1, 4), 16, 10).cast("int") % 10
    return t("documents").select("doc_id", "source", F.sha2("text", 256).alias("h"), F.when(n < 8, "train").when(n == 8, "validation").otherwise("test").alias("split"))


@query(f"with {_SPLIT} select split, count(*) as n, count(distinct source) as sources from s group by 1")
def group_hash_split(t):
    return _split(t).groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


@query(f"with {_SPLIT}, p as (select h, list_sort(list(distinct split)) as ss from s group by 1 having count(distinct split) > 1) select array_to_string(ss, '+') as splits, count(*) as texts from p group by 1")
def hash_split_leakage(t):
    p = _split(t).groupBy("h").agg(F.array_join(F.array_sort(F.collect_set("split")), "+").alias("splits"), F.size(F.collect_set("split")).alias("k")).where("k > 1")
    return p.groupBy("splits").agg(F.count("*").alias("texts"))


_PENALTIES = [("n_chars < 200", 45), ("regexp_like(text, '!!')", 18), ("regexp_like(text, '(?i)copyright')", 12), ("lang <> 'en'", 10), ("n_chars > 8000", 8)]
_CONF = "100" + "".join(f" - if(coalesce({p.replace('regexp_like', 'regexp_matches')}, false), {w}, 0)" for p, w in _PENALTIES)


@query(f"select doc_id, {_CONF} as confidence_score, case when n_chars < 40 or {_CONF} < 55 then 'low' when {_CONF} < 80 then 'medium' else 'high' end as confidence from documents")
def confidence_levels(t):
    s = F.lit(100) - sum((F.when(F.expr(p.replace("regexp_like", "rlike")), w).otherwise(0) for p, w in _PENALTIES), F.lit(0))
    return t("documents").withColumn("confidence_score", s).select("doc_id", "confidence_score", F.when((F.col("n_chars") < 40) | (F.col("confidence_score") < 55), "low").when(F.col("confidence_score") < 80, "medium").otherwise("high").alias("confidence"))


# Analytics ---------------------------------------------------------------------------------------------------------


@query("select user_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value from events group by 1")
def latest_per_key(t):
    return C.latest_of_each(t("events"), "user_id", "event_id", ["event_type", "value"])


@query("with a as (select user_id, arg_max(value, event_id) as x from events where event_type = 'click' group by 1), b as (select user_id, arg_max(value, event_id) as y from events where event_type = 'view' group by 1) select count(*) as n, round(avg(abs(x - y)), 6) as mae from a join b using (user_id)")
def judge_mae(t):
    last = lambda k, n: C.latest_of_each(t("events").where(F.col("event_type") == k), "user_id", "event_id", ["value"]).withColumnRenamed("value", n)
    return last("click", "x").join(last("view", "y"), "user_id").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("x") - F.col("y"))), 6).alias("mae"))


@query("with c as (select user_id, event_type as who, round(avg(value), 6) as v from events group by all) select a.who as a, b.who as b, count(*) filter (b.v > a.v) as wins, count(*) filter (b.v = a.v) as ties, count(*) filter (b.v < a.v) as losses, round(avg(b.v - a.v), 6) as mean_delta from c a join c b on a.user_id = b.user_id and a.who < b.who group by all")
def paired_win_tie_loss(t):
    cells = t("events").groupBy("user_id", F.col("event_type").alias("who")).agg(F.round(F.avg("value"), 6).alias("v"))
    return A.win_tie_loss(cells, "user_id", "who", "v")


@query("select l_orderkey, l_linenumber, round(0.3 * l_quantity + 0.2 * l_discount * 100 + 0.5 * l_tax * 100, 2) as weighted, cast(least(4, floor(l_quantity / 10.5)) as bigint) as bucket from lineitem")
def rubric_weighted(t):
    w = F.round(0.3 * F.col("l_quantity") + 0.2 * F.col("l_discount") * 100 + 0.5 * F.col("l_tax") * 100, 2)
    return t("lineitem").select("l_orderkey", "l_linenumber", w.alias("weighted"), F.least(F.lit(4), F.floor(F.col("l_quantity") / 10.5)).alias("bucket"))


@query("select c_nationkey, if(count(x) = count(*), round(sum(x), 2), null) as total from (select c_nationkey, if(c_acctbal > -900, c_acctbal, null) as x from customer) group by 1")
def all_or_null_total(t):
    x = F.when(F.col("c_acctbal") > -900, F.col("c_acctbal"))
    return t("customer").select("c_nationkey", x.alias("x")).groupBy("c_nationkey").agg(F.round(A.all_or_null(F.col("x")), 2).alias("total"))


@query("select o_orderpriority, count(*) as n, round(avg(o_totalprice), 6) as mean, round(stddev_pop(o_totalprice), 6) as std, round(quantile_cont(o_totalprice, 0.5), 6) as p50, round(quantile_cont(o_totalprice, 0.95), 6) as p95, round(quantile_cont(o_totalprice, 0.99), 6) as p99 from orders group by 1")
def latency_by_phase(t):
    return t("orders").groupBy("o_orderpriority").agg(*A.distribution("o_totalprice"))


@query("with m as (select o_orderpriority as k, o_orderstatus as s, quantile_cont(o_totalprice, 0.5) as p from orders group by all) select a.k, round(a.p - b.p, 6) as delta, case when b.p > 0 then round(100.0 * (a.p - b.p) / b.p, 6) end as percent from m a join m b on a.k = b.k and a.s = 'F' and b.s = 'O'")
def latency_deltas(t):
    m = t("orders").groupBy(F.col("o_orderpriority").alias("k"), F.col("o_orderstatus").alias("s")).agg(F.percentile("o_totalprice", 0.5).alias("p"))
    p = m.where("s = 'F'").select("k", F.col("p").alias("a")).join(m.where("s = 'O'").select("k", F.col("p").alias("b")), "k")
    return p.select("k", F.round(F.col("a") - F.col("b"), 6).alias("delta"), A.percent_difference(F.col("a"), F.col("b")).alias("percent"))


@query("select c_nationkey, count(distinct c_mktsegment) as segments, count(distinct c_mktsegment) > 1 as differs from customer group by 1")
def config_differences(t):
    n = F.count_distinct("c_mktsegment")
    return t("customer").groupBy("c_nationkey").agg(n.alias("segments"), (n > 1).alias("differs"))


# Conversations and events ------------------------------------------------------------------------------------------


@query("select conv_id, turn, role, n as back from (select *, row_number() over (partition by conv_id order by turn desc) as n from conversations) where n <= 3")
def conv_last_n(t):
    return R.top(t("conversations").select("conv_id", "turn", "role"), ["conv_id"], [F.desc("turn")], 3, "back")


@query("select conv_id, count(*) as messages, count(*) filter (role = 'user') as of_user, cast(sum(length(text)) as bigint) as chars from conversations group by 1")
def conv_counts(t):
    return t("conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("of_user"), F.sum(F.length("text")).alias("chars"))


@query("select conv_id, string_agg(role || ': ' || text[:1800], chr(10) order by turn) as prompt from (select *, row_number() over (partition by conv_id order by turn desc) as n from conversations) where n <= 6 group by 1")
def conv_prompt(t):
    last = R.top(t("conversations"), ["conv_id"], [F.desc("turn")], 6, "n")
    line = F.struct("turn", F.concat("role", F.lit(": "), F.substring("text", 1, 1800)).alias("l"))
    return last.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l"]), "\n").alias("prompt"))


@query("with b as (select cast(floor(epoch_us(ts) / 1000000) as bigint) as second, count(*) as n from events group by 1) select second, n, cast(sum(n) over (order by second range between 299 preceding and current row) as bigint) as rolling from b")
def event_rolling_5m(t):
    return T.rolling_counts(t("events"), "ts").select("second", "n", "rolling")


@query("select event_id, round((epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id))) / 1000.0, 3) as gap_ms from events")
def event_gaps(t):
    return T.gaps(t("events"), "user_id", "ts", "event_id").select("event_id", "gap_ms")


@query("select event_type, count(value) as n, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95 from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as i from events) where i <= 500 group by 1")
def event_last_n_pctl(t):
    return T.last_n_percentiles(t("events"), "event_type", "ts", "event_id", "value")


@query("with e as (select *, epoch_us(ts) as us from events), c as (select event_id, count(*) over (partition by user_id order by us range between 3599999999 preceding and current row) as in_hour, count(*) over (partition by user_id order by us range between 86399999999 preceding and current row) as in_day from e) select *, in_hour <= 2 and in_day <= 10 as allowed from c")
def event_quota(t):
    return T.quotas(t("events"), "user_id", "ts", "event_id", 2, 10).select("event_id", "in_hour", "in_day", "allowed")


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def event_json_props(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("with c as (select user_id, event_type, count(*) as n from events group by all) select user_id, cast(sum(n) as bigint) as calls, cast(sum(n - 1) as bigint) as repeated, round(sum(n - 1) / sum(n), 6) as rate from c group by 1")
def tool_repeat_counts(t):
    c = t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return c.groupBy("user_id").agg(F.sum("n").alias("calls"), F.sum(F.col("n") - 1).alias("repeated"), F.round(F.sum(F.col("n") - 1) / F.sum("n"), 6).alias("rate"))


# Plain relations ---------------------------------------------------------------------------------------------------


@query("select r_name, n_name, count(*) as orders, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all")
def q_join_agg(t):
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all")
def q_pricing_summary(t):
    return t("lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("select c_custkey, exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F') as has_f from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def q_semi_anti(t):
    o = t("orders")
    c = t("customer").join(o.where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    f = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("f")).distinct()
    return c.join(f, "c_custkey", "left").select("c_custkey", F.coalesce("f", F.lit(False)).alias("has_f"))


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)")
def q_cube(t):
    return t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("(select c_nationkey as k from customer intersect select s_nationkey from supplier) except select n_nationkey from nation where n_regionkey = 0")
def q_setops(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).intersect(t("supplier").select("s_nationkey")).subtract(t("nation").where("n_regionkey = 0").select("n_nationkey"))


@query("select p_partkey from part p where p_retailprice > (select avg(p_retailprice) from part x where x.p_brand = p.p_brand)")
def q_corr_subquery(t):
    p = t("part")
    return p.join(p.groupBy("p_brand").agg(F.avg("p_retailprice").alias("m")), "p_brand").where("p_retailprice > m").select("p_partkey")

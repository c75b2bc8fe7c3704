"""Queries that search written indexes: BM25 lists in impact order, and inverted files of vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evaluation as E
from ..operators import lexical as L
from ..operators import vectors as V
from ..sources import scratch as S
from .catalogue import _DENSE, _GOLD, _TERMS, NORM, QUERIES, _asked, _bm25, _dense, _gold, query  # noqa: F401

_RARE = 10  # letters of a query's words here, so that some queries find less than k
_TITLED = NORM.replace("coalesce(text, '')", "concat_ws(' ', source, source, text)")


@query(f"""with d as (select doc_id, list_filter(string_split({_TITLED}, ' '), lambda x: length(x) >= 2) as ts from documents),
p as (select term, doc_id as row_id, count(*) as tf from (select doc_id, unnest(ts) as term from d) group by all), l as (select row_id, sum(tf) as dl from p group by 1),
s as (select (select count(*) from documents) as n_docs, (select avg(dl) from l) as avgdl), f as (select term, count(*) as df from p group by 1),
q as (select item_id as query_id, term, count(*) as qtf from (select item_id, unnest(list_filter(string_split({NORM}, ' '), lambda x: length(x) >= {_RARE})) as term from benchmark) group by all),
b as (select query_id, p.row_id, round(sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score from q join p using (term) join f using (term) join l on l.row_id = p.row_id cross join s group by all),
z as (select q.query_id, d.doc_id as row_id, coalesce(b.score, 0) as score from (select distinct query_id from q) q cross join documents d left join b on b.query_id = q.query_id and b.row_id = d.doc_id)
select query_id, row_id, score, row_number() over (partition by query_id order by score desc, row_id) as rank from z qualify rank <= 40""")
def bm25_titled_filled(t):
    """Titles count twice; queries of rare words that few documents hold are filled with documents of score 0."""
    d = t("documents")
    path = S.once(d, "bm25-titled", lambda path: L.build(d, "doc_id", L.titled(F.col("source"), F.col("text")), path))
    rare = lambda c: F.filter(X.terms(c), lambda w: F.length(w) >= _RARE)
    return L.search(d.sparkSession, path, _asked(t, rare), 40, fill=True)


def _file(e, lists: int) -> str:
    rows = e.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("v"))
    return S.once(e, f"vectors-{lists}", lambda path: V.build(rows, path, lists))


def _queries(e):
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query(f"with {_DENSE} select query_id, row_id, score, rank from n")
def ann_exact_topk(t):
    """Few lists are probed; those whose bound may reach the k-th score are searched as well, so nothing is missed."""
    e = t("embeddings")
    return V.search(e.sparkSession, _file(e, 16), _queries(e), 20, 2, exact=True)


@query()
def ann_recall(t):
    """Recall at 10 of probing five eighths of the lists, a row for each number of lists; tests hold it to 0.9 and more. The
    vectors at hand are close to random ones, which is why it takes so many."""
    e, truth = t("embeddings"), _dense(t, 10)
    out = []
    for lists in (32, 64):
        found = V.search(e.sparkSession, _file(e, lists), _queries(e), 10, lists * 5 // 8)
        r = V.recall(found, truth)
        out.append(r.groupBy().agg(F.lit(lists).alias("lists"), F.count("*").alias("queries"), F.round(F.avg("recall"), 6).alias("recall"), F.min("recall").alias("least")))
    return out[0].unionByName(out[1])


@query(f"""with {_TERMS}, {_GOLD}, lv as (select query_id, 'chunk' as level, cast(row_id as varchar) as item, rank from b union all select query_id, 'source', source, rank from b join documents on doc_id = row_id where source is not null),
s0 as (select query_id, level, item, min(rank) as r0 from lv group by all), sx as (select *, row_number() over (partition by query_id, level order by r0, item) as rk from s0),
gs as (select query_id, list(distinct source) as sources from (select query_id, unnest(items) as doc_id from g) join documents using (doc_id) group by 1),
gl as (select query_id, 'chunk' as level, list_transform(items, lambda x: cast(x as varchar)) as items from g union all select g.query_id, 'source', sources from g left join gs using (query_id)),
j as (select gl.query_id, gl.level, k, items, rk, list_contains(items, sx.item) as rel from gl cross join (values (1), (3), (5), (10)) v(k) left join sx on sx.query_id = gl.query_id and sx.level = gl.level and rk <= k),
m as (select query_id, level, k, any_value(items) as items, count(*) filter (rel) as found, min(rk) filter (rel) as first, sum(1 / log2(rk + 1)) filter (rel) as dcg from j group by all)
select query_id, level, k, if(items is null, null, cast(found > 0 as double)) as hit, round(found / len(items), 6) as recall, if(items is null, null, round(found / cast(k as double), 6)) as precision,
if(items is null, null, round(coalesce(1.0 / first, 0), 6)) as mrr, if(items is null, null, round(coalesce(dcg, 0) / list_sum(list_transform(generate_series(1, least(len(items), k)), lambda i: 1 / log2(i + 1))), 6)) as ndcg from m""")
def retrieval_metrics_levels(t):
    """At 1, 3, 5 and 10, of documents and of their sources."""
    d = t("documents").select(F.col("doc_id").alias("row_id"), "source")
    ranked = _bm25(t).join(d, "row_id", "left").select("query_id", "rank", F.col("row_id").alias("chunk"), "source")
    gold = _gold(t)
    sources = gold.select("query_id", F.explode("items").alias("row_id")).join(d, "row_id").groupBy("query_id").agg(F.collect_set("source").alias("source"))
    return E.metrics_by_level(ranked, gold.select("query_id", F.col("items").alias("chunk")).join(sources, "query_id", "left"), ["chunk", "source"], [1, 3, 5, 10])

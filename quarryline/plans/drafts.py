"""Queries of choices made in rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curation as U
from ..operators import drafting as D
from ..sources import scratch as S
from .catalogue import query

_WORDS = "list_slice(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''), 1, 8)"


@query(f"""with recursive c as materialized (select doc_id, lang, source, list_distinct({_WORDS}) as w, row_number() over (order by sha256('7:' || doc_id), doc_id) as pos from documents where text is not null),
e as materialized (select b.pos, list(a.pos) as en from c a join c b on a.pos < b.pos and len(a.w) > 0 and len(list_intersect(a.w, b.w)) / greatest(len(list_distinct(list_concat(a.w, b.w))), 1) >= 0.5 group by b.pos),
x as materialized (select c.*, coalesce(e.en, []) as en from c left join e using (pos)),
r as (select 0::bigint as pos, []::bigint[] as acc, []::varchar[] as srcs, []::varchar[] as langs
  union all select x.pos, if(ok, list_append(r.acc, x.pos), r.acc), if(ok, list_append(r.srcs, x.source), r.srcs), if(ok, list_append(r.langs, x.lang), r.langs)
  from (select r.*, x.*, not list_has_any(x.en, r.acc) and (x.source is null or len(list_filter(r.srcs, lambda s: s = x.source)) < 6) and (x.lang is null or len(list_filter(r.langs, lambda s: s = x.lang)) < 25) as ok from r join x on x.pos = r.pos + 1) q(pos0, acc, srcs, langs, doc_id, lang, source, w, pos, en, ok), lateral (select q.pos as pos, q.source as source, q.lang as lang) x, lateral (select q.acc as acc, q.srcs as srcs, q.langs as langs) r)
select doc_id, lang, source from c where pos in (select unnest(acc) from r where pos = (select max(pos) from r))""")
def drafted(t):
    """Drafts in the order of a hash, six of a source, 25 of a language, none whose first words are close to an earlier one's."""
    d = t("documents").where("text is not null").select("doc_id", "lang", "source", F.array_distinct(F.slice(F.filter(F.split(F.lower("text"), "\\s+"), lambda x: x != ""), 1, 8)).alias("w"))
    caps = {"source": 6, "lang": 25}
    d = S.written(d.withColumn("h", F.sha2(F.concat(F.lit("7:"), F.col("doc_id").cast("string")), 256)), "drafts")
    n = d.count()
    if n <= _FIRST:
        return _taken(d, caps).select("doc_id", "lang", "source")
    # a row's fate depends on those before it alone, and what comes later in a full group is out
    early = F.col("h") < f"{_FIRST * (1 << 32) // n:08x}"
    taken = S.written(_taken(d.where(early), caps), "drafts-taken")
    left = d.where(~early)
    for c, most in caps.items():
        full = taken.where(F.col(c).isNotNull()).groupBy(c).count().where(F.col("count") >= most)
        left = left.join(F.broadcast(full.select(c)), c, "left_anti")  # a row for each group that the first rows fill
    left = S.written(left.select(*d.columns), "drafts-left")
    out = taken if left.isEmpty() else _taken(taken.unionByName(left), caps)
    return out.select("doc_id", "lang", "source")


#: Rows that drafts are looked for in first, about.
_FIRST = 4096


def _taken(d, caps):
    """The rows of d that greedy choice takes; classes of equal words have a cap of one, and close ones are in conflict."""
    pairs = U.similar_pairs(d, "doc_id", F.col("w"), 0.5)
    classes = d.select("doc_id", U.set_key(F.col("w")).alias("key"), "lang", "source", "h")
    rep = classes.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("a"))
    # a class is close to another as its members are
    near = pairs.join(rep.withColumnsRenamed({"key": "ka"}), "a").join(rep.withColumnsRenamed({"key": "kb", "a": "b"}), "b")
    first = classes.join(near.select("ka", "kb"), classes["key"] == F.col("ka")).select(F.col("doc_id").alias("a"), "kb")
    links = first.join(classes.select(F.col("doc_id").alias("b"), F.col("key").alias("kb")), "kb").select("a", "b")
    out = D.greedy(classes, "doc_id", [F.col("h")], {**caps, "key": 1}, links)
    return d.join(out.where("accepted").select("doc_id"), "doc_id", "left_semi").select(*d.columns)


_RATIOS = {"train": 0.8, "validation": 0.1, "test": 0.1}
_COST = "3.0 * ((s.sizes[k] + g.n - tot * rat[k]) ** 2 - (s.sizes[k] - tot * rat[k]) ** 2) / greatest(1.0, tot * rat[k]) + list_sum(list_transform(range(1, nl + 1), lambda i: if(g.lc[i] = 0, 0.0, 1.5 * ((s.cnt[(k - 1) * nl + i] + g.lc[i] - lt[i] * rat[k]) ** 2 - (s.cnt[(k - 1) * nl + i] - lt[i] * rat[k]) ** 2) / greatest(1.0, lt[i] * rat[k]))))"
_SPLITS = f"""recursive d as (select source as grp, coalesce(lang, chr(0)) as label from documents), l as (select label, count(*) as n, row_number() over (order by label) as i from d group by 1),
k as (select count(*) as nl, list(n order by i) as lt, sum(n) as tot, [0.8, 0.1, 0.1] as rat from l),
g0 as (select grp, label, count(*) as n from d group by all),
g1 as (select s.grp, sum(coalesce(g0.n, 0)) as n, list(coalesce(g0.n, 0) order by l.i) as lc from (select distinct grp from d) s cross join l left join g0 on g0.grp is not distinct from s.grp and g0.label = l.label group by s.grp),
g as (select *, row_number() over (order by n desc, sha256('42:' || coalesce(grp, ''))) as pos from g1),
r as (select 0::bigint as pos, [0.0, 0.0, 0.0]::double[] as sizes, list_transform(range(3 * nl), lambda i: 0.0)::double[] as cnt, 0::bigint as pick from k
  union all select g.pos, list_transform(s.sizes, lambda v, j: if(j = p.pick, v + g.n, v)), list_transform(s.cnt, lambda v, j: if((j - 1) // nl + 1 = p.pick, v + g.lc[(j - 1) % nl + 1], v)), p.pick
  from r s join g on g.pos = s.pos + 1 cross join k, lateral (select list_position(c, list_min(c)) as pick from (select list_transform([1, 2, 3], lambda k: round({_COST}, 9)) as c)) p),
a as (select g.grp, ['train', 'validation', 'test'][r.pick] as split from r join g on g.pos = r.pos)"""


@query(f"""with {_SPLITS}, c as (select a.split, d.label, count(*) as n from d join a on a.grp is not distinct from d.grp group by all)
select split, nullif(label, chr(0)) as label, n, round(n / sum(n) over (partition by label), 6) as share, round(n / sum(n) over (partition by label) - map {{'train': 0.8, 'validation': 0.1, 'test': 0.1}}[split], 6) as gap from c""")
def balanced_group_split(t):
    """The SQL deals groups one after another; the operator does so while there are few of them."""
    d = t("documents").select("source", "lang")
    a = D.group_split(d, "source", {"lang": 1.5}, _RATIOS)
    return D.split_report(d.join(a.withColumnRenamed("source", "g"), F.col("source").eqNullSafe(F.col("g"))).drop("g"), "lang", _RATIOS)

"""Record operators: projections, checks of records and runs, guards, listings, merges."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_edges, bound, folded, match_norm, stable_id, strip_accents, years

# What an injected instruction looks like in folded text, and what an id of evidence may look like.
INJECTION = (
    r"(?:ignore|disregard|override|forget)\s+(?:all\s+)?(?:previous|prior|system|developer)\s+(?:instructions?|prompts?|messages?)|"
    r"(?:reveal|print|leak|exfiltrate|send)\s+(?:the\s+)?(?:system\s+prompt|api\s+key|secret|password)|"
    r"(?:bo qua|quen|ghi de)\s+(?:tat ca\s+)?(?:chi dan|huong dan|lenh)\s+(?:truoc|he thong)|"
    r"(?:tiet lo|in ra|gui)\s+(?:mat khau|api key|system prompt|bi mat)|"
    r"<\|(?:im_start|im_end|system|assistant|developer)\|>|"
    r"</?(?:system|developer|tool_call|function_call|plan_status|think)>|"
    r"\[(?:system|developer|assistant)\]\s*:"
)
# One of these is in all that the pattern matches, which is told faster than the pattern is; folded text has no capitals.
SIGNS = ["instruction", "prompt", "message", "secret", "password", "api", "chi dan", "huong dan", "lenh", "mat khau", "bi mat", "<|"]
SIGNS += ["system>", "developer>", "_call>", "plan_status>", "think>", "system]", "developer]", "assistant]"]
EVIDENCE_ID = r"^[\p{L}\p{N}_:./-]{1,200}$"
# Signs of either domain in a folded question.
HOME = r"\b(viet nam|vietnam|vietnamese|dai viet|su viet|van lang|au lac|bach dang|ngo quyen|tran hung dao|nha tran|nha ly|nha le|hai ba trung|quang trung|dien bien phu)\b"
ABROAD = (
    r"\b(the gioi|world history|global history|chien tranh lanh|cold war|chau au|chau my|chau phi|europe|roman empire|la ma|hy lap|"
    r"ai cap co dai|co dai ai cap|napoleon|napoleon bonaparte|chien tranh the gioi|world war|the chien|cach mang phap|french revolution|"
    r"lich su (?:trung quoc|nhat ban|han quoc|anh|phap|my|nga|an do))\b"
)
# Weight of a matching item of each metadata field; of a year and the most for years; of a facet; the most.
FIELD_WEIGHTS = {"people": 0.055, "events": 0.045, "documents": 0.055, "dynasties": 0.055, "locations": 0.03, "periods": 0.03, "topics": 0.012}
YEAR_WEIGHT, YEARS_MOST, FACET_WEIGHT, BONUS_MOST = 0.035, 0.07, 0.025, 0.18
BRACKETED = r"\[([^\[\]\n]{1,128})\]"


def present(c: Column) -> Column:
    """Whether a string is more than white space; null is not."""
    return F.coalesce(c.rlike("\\S"), F.lit(False))


def fold(c: Column) -> Column:
    """Lower case without accents; runs of what is neither letter, digit nor underscore are one space."""
    return F.trim(F.regexp_replace(strip_accents(F.coalesce(c, F.lit(""))), "[^\\p{L}\\p{N}_]+", " "))


def suspicious(c: Column) -> Column:
    """Whether the text tries to change instructions or to obtain secrets."""
    return bound(folded(F.coalesce(c, F.lit(""))), lambda x: reduce(or_, [F.contains(x, F.lit(s)) for s in SIGNS]) & x.rlike("(?i)" + INJECTION))


def safe_evidence(id_: Column, text: Column, title: Column) -> Column:
    """Whether a row may be shown as evidence: an id of known form, a text, and no injected instruction."""
    return F.coalesce(id_.rlike(EVIDENCE_ID), F.lit(False)) & present(text) & ~suspicious(text) & ~suspicious(title)


def question_domain(c: Column) -> Column:
    """vietnamese, external, mixed or unspecified, by explicit signs alone."""
    plain = strip_accents(F.coalesce(c, F.lit("")))
    home, abroad = plain.rlike(ascii_edges(HOME)), plain.rlike(ascii_edges(ABROAD))
    return F.when(home & abroad, "mixed").when(home, "vietnamese").when(abroad, "external").otherwise("unspecified")


def tags(c: Column, rules: dict[str, str], dated: str | None = None) -> Column:
    """The names of all rules whose pattern the folded text has, in their order; dated: the tag of texts with a year."""
    folded = fold(c)
    found = [F.when(folded.rlike(ascii_edges(p)), F.lit(n)) for n, p in rules.items()]
    if dated:
        found.append(F.when(F.size(years(F.coalesce(c, F.lit("")))) > 0, F.lit(dated)))
    return F.array_compact(F.array(*found))


def selected_splits(df: DataFrame, split: str, wanted: str, known: list[str], row: str | None = None, offset: int = 0) -> DataFrame:
    """The rows of the wanted splits, 'all' or names separated by commas, from row number `offset` on."""
    names = known if wanted == "all" else [x.strip() for x in wanted.split(",")]
    if len(set(names)) != len(names) or set(names) - set(known):
        raise ValueError(f"splits must be among {known}, each once: {wanted}")
    out = df.where(F.col(split).isin(names))
    return out.where(F.col(row) >= offset) if row else out


def document_records(df: DataFrame, id_col: str, text_col: str, dataset: str, revision: str, split: str) -> DataFrame:
    """document_id, source_id, article_id, raw_sha256, char_count, has_year, excerpt: the record of each raw row, with ids
    that follow from dataset, revision, split and the row's own id."""
    article = F.col(id_col).cast("string")
    source = stable_id("src", F.lit(dataset), F.lit(revision), F.lit(split), article)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(
        stable_id("doc", source).alias("document_id"), source.alias("source_id"), article.alias("article_id"), F.sha2(text, 256).alias("raw_sha256"),
        F.length(text).alias("char_count"), (F.size(years(text)) > 0).alias("has_year"), F.substring(text, 1, 300).alias("excerpt"),
    )


def chunk_records(chunks: DataFrame, id_col: str) -> DataFrame:
    """chunk_id, id, chunk_index, token_count, char_count, years of chunks (id, chunk_index, chunk_text): of equal texts,
    over all documents, only the first chunk."""
    c = chunks.withColumn("digest", F.sha2("chunk_text", 256))
    at = F.struct(id_col, "chunk_index")
    first = c.groupBy("digest").agg(F.min(at).alias("at"), F.min_by("chunk_text", at).alias("chunk_text")).select("digest", "chunk_text", "at.*")
    return first.select(
        stable_id("chk", F.col(id_col), F.col("chunk_index"), F.col("digest")).alias("chunk_id"), id_col, "chunk_index",
        F.size(F.split("chunk_text", " ")).alias("token_count"), F.length("chunk_text").alias("char_count"), years(F.col("chunk_text")).alias("years"),
    )


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """key, n of keys that more than one row has."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def with_unique(df: DataFrame, key: str) -> DataFrame:
    """df, if no two rows have one key."""
    again = repeated_keys(df, key).limit(3).collect()
    if again:
        raise ValueError(f"{key} repeats: {[r[0] for r in again]}")
    return df


def sections(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """id, part, section, body: the lines below each heading (== x ==, or one to four # and x), those before the first
    below ''. A heading without lines has no row."""
    heading = "^\\s*(?:={2,}\\s*(.*?)\\s*={2,}|#{1,4}\\s+(.*))\\s*$"
    lines = df.select(id_col, F.posexplode(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\n$", ""), "\n")).alias("pos", "line"))
    is_head = F.col("line").rlike(heading)
    w = Window.partitionBy(id_col).orderBy("pos")
    named = F.when(is_head, F.trim(F.concat(F.regexp_extract("line", heading, 1), F.regexp_extract("line", heading, 2))))
    lines = lines.withColumn("part", F.sum(is_head.cast("int")).over(w)).withColumn("name", F.last(named, ignorenulls=True).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    body = F.regexp_replace(body, "^\\s+|\\s+$", "")
    return lines.where(~is_head).groupBy(id_col, "part").agg(F.coalesce(F.min("name"), F.lit("")).alias("section"), body.alias("body"))


def running_offset(df: DataFrame, order: str, length: Column, per_block: int = 4096) -> DataFrame:
    """Adds start: the sum of lengths of all rows before, by a whole-number order; blocks of it are added up first, so no
    task sees more rows than a block has, or blocks."""
    rows = df.withColumn("_n", length).withColumn("_b", F.floor(F.col(order) / per_block))
    sums = rows.groupBy("_b").agg(F.sum("_n").alias("_s"))
    sums = sums.select("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_i", inside).join(sums, "_b").withColumn("start", F.col("_o") + F.col("_i")).drop("_n", "_b", "_i", "_o")


def risk_queue(df: DataFrame, id_col: str, risk: Column, fit: Column, size: int, risky: int, seed: str) -> DataFrame:
    """id, risk, place, kind: the `risky` rows of the greatest risk, then others that are fit in the order of a seeded
    hash, up to `size`."""
    d = df.select(F.col(id_col), risk.alias("risk"), fit.alias("_fit"))
    first = d.orderBy(F.desc("risk"), id_col).limit(risky).select(id_col, "risk")
    first = first.withColumn("place", F.row_number().over(Window.orderBy(F.desc("risk"), id_col))).withColumn("kind", F.lit("risky"))
    h = F.sha2(F.concat(F.lit(seed + ":"), F.col(id_col).cast("string")), 256)
    rest = d.where("_fit").join(F.broadcast(first.select(id_col)), id_col, "left_anti")  # at most `risky` rows
    rest = rest.withColumn("_h", h).orderBy("_h").limit(max(0, size - risky))
    rest = rest.select(id_col, "risk", (F.row_number().over(Window.orderBy("_h")) + risky).alias("place"), F.lit("fill").alias("kind"))
    return first.unionByName(rest)


def partition_report(parts: dict[str, DataFrame], every: DataFrame, key: str) -> DataFrame:
    """key, parts (names, sorted), state: once, repeated (in several parts), missing (in none) or foreign (not in all)."""
    named = None
    for n, d in parts.items():
        one = d.select(key, F.lit(n).alias("part"))
        named = one if named is None else named.unionByName(one)
    held = named.groupBy(key).agg(F.array_sort(F.collect_set("part")).alias("parts"))
    j = held.join(every.select(key, F.lit(True).alias("known")).distinct(), key, "full")
    state = F.when(F.col("known").isNull(), "foreign").when(F.col("parts").isNull(), "missing").when(F.size("parts") > 1, "repeated").otherwise("once")
    return j.select(key, F.coalesce(F.array_join("parts", "+"), F.lit("")).alias("parts"), state.alias("state"))


def deficits(counts: DataFrame, name: str, n: str, targets: dict[str, int]) -> DataFrame:
    """name, filled (share of the target), short, next: whether it is the one to fill next, the smallest share of those
    short, ties by name. A row for each target."""
    goal = counts.sparkSession.createDataFrame(list(targets.items()), f"{name} string, target long")
    j = goal.join(counts.groupBy(name).agg(F.sum(n).alias("n")), name, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    j = j.withColumn("filled", F.round(F.col("n") / F.greatest(F.lit(1), F.col("target")), 6)).withColumn("short", F.col("n") < F.col("target"))
    first = F.row_number().over(Window.orderBy(F.desc("short"), "filled", name))
    return j.select(name, "filled", "short", (F.col("short") & (first == 1)).alias("next"))


def metadata_bonus(question: Column, asked: Column, fields: dict[str, Column], years_of: Column, facets_of: Column) -> Column:
    """What a passage gains for metadata that the question names: years, items of at least four characters that stand
    alone in it, and asked facets; bounded."""
    norm = F.concat(F.lit(" "), match_norm(question), F.lit(" "))
    named = F.array_distinct(F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit("(?<![0-9])([0-9]{3,4})(?![0-9])"), F.lit(1)))
    hits = F.size(F.array_intersect(F.transform(named, lambda y: y.cast("int")), years_of))
    out = F.least(F.lit(YEARS_MOST), hits * YEAR_WEIGHT)
    for f, items in fields.items():
        found = F.filter(F.transform(items, match_norm), lambda x: (F.length(x) >= 4) & F.contains(norm, F.concat(F.lit(" "), x, F.lit(" "))))
        out = out + F.least(F.lit(2), F.greatest(F.lit(0), F.size(found))) * FIELD_WEIGHTS[f]
    out = out + F.greatest(F.lit(0), F.size(F.array_intersect(asked, facets_of))) * FACET_WEIGHT
    return F.round(F.least(F.lit(BONUS_MOST), out), 6)


def ood_guard(runs: DataFrame, margins: DataFrame, least_dense: float = 0.28, least_margin: float = -0.06) -> DataFrame:
    """query_id, best_dense, rejected: whether the margin is below the least and the best dense score of the run too."""
    best = runs.groupBy("query_id").agg(F.max("dense").alias("best_dense"))
    j = margins.join(best, "query_id", "left")
    return j.select("query_id", "best_dense", ((F.col("margin") < least_margin) & (F.coalesce("best_dense", F.lit(0.0)) < least_dense)).alias("rejected"))


def title_diversity(hits: DataFrame, query: str, title: Column) -> DataFrame:
    """query, diversity: distinct normalised titles among its hits."""
    return hits.select(query, match_norm(title).alias("_t")).groupBy(query).agg(F.round(F.count_distinct("_t") / F.count("*"), 6).alias("diversity"))


def stage_rows(runs: DataFrame, k: int = 10) -> DataFrame:
    """The first k of every lane and variant of a query, with their rank in it, of runs (query_id, lane, variant, row_id,
    score)."""
    w = Window.partitionBy("query_id", "lane", "variant").orderBy(F.desc("score"), "row_id")
    return runs.withColumn("query_rank", F.row_number().over(w)).where(F.col("query_rank") <= k)


def temporary_top(candidates: DataFrame, k: int) -> DataFrame:
    """query_id, row_id, score, rank of candidates (query_id, row_id, dense, rerank) of an attached corpus: the
    max(3 k, 12) best by dense score, by 0.82 rerank + 0.18 dense, or by dense where the query has no rerank scores."""
    w = Window.partitionBy("query_id").orderBy(F.desc("dense"), "row_id")
    near = candidates.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max(3 * k, 12))
    scored = F.count("rerank").over(Window.partitionBy("query_id")) > 0
    near = near.withColumn("score", F.round(F.when(scored, 0.82 * F.coalesce("rerank", F.lit(0.0)) + 0.18 * F.col("dense")).otherwise(F.col("dense")), 6))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id")
    return near.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "row_id", "score", "rank")


def identity(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, differing (fields, in order), comparable: whether all fields are known on both sides and equal."""
    x = a.select(key, F.struct(*fields).alias("x"))
    j = x.join(b.select(key, F.struct(*fields).alias("y")), key)
    differs = [F.when(F.coalesce(F.col(f"x.{f}") != F.col(f"y.{f}"), F.lit(True)), F.lit(f)) for f in fields]
    return j.select(key, F.array_compact(F.array(*differs)).alias("d")).select(key, F.array_join("d", ",").alias("differing"), (F.size("d") == 0).alias("comparable"))


def scored_runs(df: DataFrame, ok: Column, applicable: dict[str, Column]) -> DataFrame:
    """df with every metric null where the run failed or the metric does not apply to it; ok says whether it succeeded."""
    return df.withColumns({"ok": ok} | {m: F.when(ok & a, F.col(m)) for m, a in applicable.items()})


def evaluation_summary(df: DataFrame, metrics: list[str], by: list[str]) -> DataFrame:
    """by, n, success_rate (of all rows), and mean and count of each observed metric, over all rows and by each of `by`;
    columns not grouped by are null."""
    out = [F.count("*").alias("n"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("success_rate")]
    out += [x for m in metrics for x in (F.round(F.avg(m), 6).alias(f"mean_{m}"), F.count(m).alias(f"n_{m}"))]
    return df.groupingSets([[], *[[b] for b in by]], *by).agg(*out).select(*by, "n", "success_rate", *[c for m in metrics for c in (f"mean_{m}", f"n_{m}")])


def aliases(sources: Column, cited_by: str | None = None) -> Column:
    """(alias, source) of sources, an array of (source_id, chunk_id, display_index): the ids, S and the index, and the
    index; a source without an index, or with 0, has its place, from 1. cited_by: a field with one more alias. Of equal
    aliases the first counts; an empty id is none."""

    def each(s: Column, i: Column) -> Column:
        shown = F.coalesce(F.nullif(s["display_index"].cast("long"), F.lit(0)), i + 1).cast("string")
        source = F.coalesce(F.nullif(s["source_id"], F.lit("")), F.nullif(s["chunk_id"], F.lit("")))
        names = [s["source_id"], s["chunk_id"], *([s[cited_by]] if cited_by else []), F.concat(F.lit("S"), shown), shown]
        return F.array(*[F.struct(a.cast("string").alias("alias"), source.alias("source")) for a in names])

    return F.filter(F.flatten(F.transform(sources, each)), lambda x: x["alias"].isNotNull() & x["source"].isNotNull())


def parsed_citations(answer: Column, known: Column) -> Column:
    """What the brackets of an answer cite, in order: known aliases, and what looks like an id; three- and four-digit
    numbers are years unless known."""
    groups = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(BRACKETED), F.lit(1))
    parts = F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, "[,;]"))), lambda x: F.trim(x))
    return F.filter(parts, lambda x: F.array_contains(known, x) | (x.rlike("^[\\p{L}\\p{N}_:.-]{1,128}$") & ~x.rlike("^[0-9]{3,4}$")))


def resolved_citations(df: DataFrame, id_col: str, answer: Column, sources: Column, gold: Column, corpus: Column) -> DataFrame:
    """id, cited, sources (sorted), invalid, validity (share of citations that are aliases), precision (gold sources among
    distinct targets), recall, existence (share of citations whose source, or spelling, is in the corpus)."""
    d = df.select(id_col, aliases(sources).alias("a"), answer.alias("t"), gold.alias("g"), corpus.alias("k"))
    d = d.withColumn("c", parsed_citations(F.col("t"), F.transform("a", lambda x: x["alias"])))
    d = d.withColumn("r", F.transform("c", lambda c: F.get(F.filter("a", lambda x: x["alias"] == c), F.lit(0))["source"]))
    n, got = F.size("c"), F.array_sort(F.array_distinct(F.array_compact("r")))
    target = F.zip_with("c", "r", lambda c, r: F.coalesce(r, c))
    share = lambda x, y: F.when(y > 0, F.round(x / y, 6))
    hit = F.size(F.array_intersect(got, "g"))
    return d.select(
        id_col, F.array_join("c", "|").alias("cited"), F.array_join(got, "|").alias("sources"),
        F.array_join(F.filter(F.zip_with("c", "r", lambda c, r: F.when(r.isNull(), c)), lambda x: x.isNotNull()), "|").alias("invalid"),
        share(F.size(F.array_compact("r")), n).alias("validity"), share(hit, F.size(F.array_distinct(target))).alias("precision"),
        share(hit, F.size("g")).alias("recall"), share(F.size(F.filter(target, lambda x: F.array_contains("k", x))), n).alias("existence"),
    )


def table_checksum(df: DataFrame, cols: list[str]) -> DataFrame:
    """rows, checksum: SHA-256 over the sorted digests of rows as text, by way of 4,096 buckets, so that it does not
    depend on the order and no task sorts all rows; null is told from empty."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in cols])
    h = df.select(F.sha2(text, 256).alias("h")).withColumn("b", F.substring("h", 1, 3))
    each = h.groupBy("b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("s"), F.count("*").alias("n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "s"))), lambda x: x["s"]), "")
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(joined, 256).alias("checksum"))


def upserted(current: DataFrame, incoming: DataFrame, key: str, revision: str, expected: str, cols: list[str]) -> DataFrame:
    """key, revision, cols, state: rows after incoming ones were written where their expected revision is the current one
    (updated, one revision more) or no row was there (inserted, revision 1); others stay (kept, or conflict)."""
    x = current.select(key, revision, F.struct(*cols).alias("x"), F.lit(True).alias("old"))
    j = x.join(incoming.select(key, expected, F.struct(*cols).alias("y"), F.lit(True).alias("new")), key, "full")
    state = F.when(F.col("new").isNull(), "kept").when(F.col("old").isNull(), "inserted").when(F.col(revision).eqNullSafe(F.col(expected)), "updated").otherwise("conflict")
    j = j.withColumn("state", state)
    take = F.col("state").isin("inserted", "updated")
    rev = F.when(F.col("state") == "inserted", F.lit(1)).when(F.col("state") == "updated", F.col(revision) + 1).otherwise(F.col(revision))
    return j.select(key, rev.alias(revision), *[F.when(take, F.col(f"y.{c}")).otherwise(F.col(f"x.{c}")).alias(c) for c in cols], "state")


def batch_failures(df: DataFrame, batch: str, id_col: str, kind: str, size: int, quotas: dict[str, int]) -> DataFrame:
    """batch, failures: what each batch lacks: size, sequence (ids without gap from the batch's first place), repeated,
    and quota:<kind>."""
    n = F.count("*")
    first = F.col(batch) * size
    checks = {"size": n != size, "sequence": (F.min(id_col) != F.min(first)) | (F.max(id_col) - F.min(id_col) != size - 1), "repeated": F.count_distinct(id_col) != n}
    checks |= {f"quota:{k}": F.count_if(F.col(kind) == k) != q for k, q in quotas.items()}
    return df.groupBy(batch).agg(F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()])), ",").alias("failures"))


def memoised(calls: DataFrame, key: list[str], order: str, payload: str) -> DataFrame:
    """Adds state: call (the first of its key), hit (same payload as the first) or changed."""
    first = calls.groupBy(*key).agg(F.min_by(F.struct(F.sha2(payload, 256).alias("h"), F.col(order).alias("o")), order).alias("f"))
    j = calls.join(first, key)
    return j.withColumn("state", F.when(F.col("f.o") == F.col(order), "call").when(F.sha2(payload, 256) == F.col("f.h"), "hit").otherwise("changed")).drop("f")


def merged_latest(df: DataFrame, key: list[str], seq: str, cols: list[str]) -> DataFrame:
    """Each key's last value of every column, nulls passed over."""
    return df.groupBy(*key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in cols])


def joined_or_unknown(rows: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows joined with what is known of their key, rows whose key is unknown)."""
    return rows.join(known, key), rows.join(known.select(key), key, "left_anti")


def strict_zip(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a and b of one position; fails where either has a position that the other lacks."""
    j = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), keys, "full")
    gap = F.raise_error(F.lit("one side has no row for a position"))
    return j.withColumn("_a", F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.lit(True)).otherwise(gap.cast("boolean"))).where("_a").drop("_a", "_b")


def chat_messages(system: str, question: Column, contexts: Column, answer: Column) -> Column:
    """The three messages of a training example; contexts are quoted verbatim below the question, numbered from 1."""
    quoted = F.array_join(F.transform(contexts, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c)), "\n")
    ask = F.when(F.size(contexts) > 0, F.concat(question, F.lit("\n\n"), quoted)).otherwise(question)
    row = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(row("system", F.lit(system)), row("user", ask), row("assistant", answer))


def max_difference(a: Column, b: Column) -> Column:
    """The largest absolute difference of two vectors; null where their sizes differ."""
    return F.when(F.size(a) == F.size(b), F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))))

"""Question planning: facets, query variants, comparison targets, the domain gate. Column builders, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, match_norm

# Facets in their order, the pattern that shows each in a normalised question, and the words that a query
# for it gets.
FACETS = {
    "winner": ("phe nao.*thang|ben nao.*thang|ai thang|chien thang cua phe|thang hay thua|thang loi cua ai", "kết quả quân sự chiến thuật chiến lược chính trị bên thắng bên thua tổn thất mục tiêu"),
    "compare": ("\\bso sanh\\b|khac nhau|giong nhau|doi chieu", "so sánh vai trò điểm giống khác đóng góp xây dựng bảo vệ"),
    "context": ("boi canh|hoan canh", "bối cảnh hoàn cảnh trước khi nguyên nhân dẫn tới"),
    "cause": ("nguyen nhan|vi sao|tai sao|do dau", "nguyên nhân lý do điều kiện dẫn đến"),
    "outcome": ("ket qua|hau qua|ket thuc|ra sao", "kết quả kết thúc thắng lợi thất bại hậu quả hệ quả"),
    "significance": ("y nghia|vai tro|tac dong", "ý nghĩa tác động vai trò đánh dấu mở ra góp phần"),
    "process": ("dien ra nhu the nao|dien bien|qua trinh", "diễn biến quá trình các giai đoạn mốc chính"),
    "content": ("noi dung|dieu khoan|quy dinh", "nội dung điều khoản quy định chính"),
    "features": ("dac diem|noi bat", "đặc điểm nổi bật tính chất lực lượng hình thức"),
    "time": ("khi nao|thoi gian nao|vao nam nao|nam nao", "thời gian niên đại mốc năm"),
}
COMPARED_BY_DEFAULT = "bối cảnh mục tiêu tính chất lực lượng hình thức đấu tranh kết quả hệ quả ý nghĩa lịch sử"
COMPARE_LEAD = "(?i)^\\s*(hãy\\s+|hay\\s+)?(so\\s+sánh|so sanh|đối\\s+chiếu|doi chieu)\\s+"
COMPARE_TAIL = "(?i)(\\s+(khác nhau|giong nhau|giống nhau)\\s+(như thế nào|ra sao)?|\\s+(như thế nào|ra sao))\\??\\s*\\z"
CONJUNCTION = "(?i)\\s+(?:và|va|với|voi)\\s+|[,;/]+"
EDGES = "^[ .?!:;]+|[ .?!:;]+\\z"
OOD_MARGIN, UNSURE_MARGIN = -0.06, 0.02


def _java(pattern: str) -> str:
    return pattern.replace("(?i)", "(?iu)")


def facets(question: Column) -> Column:
    """Facets a question asks for, in the fixed order; a winner asks for the outcome too; none: general."""
    norm = match_norm(question)
    found = F.array_compact(F.array(*[F.when(norm.rlike(p), F.lit(n)) for n, (p, _) in FACETS.items()]))
    also = F.array_contains(found, "winner") & ~F.array_contains(found, "outcome")
    return F.when(F.size(found) == 0, F.array(F.lit("general"))).when(also, F.array_append(found, F.lit("outcome"))).otherwise(found)


def _suffix(facet: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (_, words) in FACETS.items():
        out = F.when(facet == name, F.lit(words)).otherwise(out)
    return out


def variants(question: Column, wanted: Column, most: int = 3) -> Column:
    """The cleaned question, then one variant for each wanted facet that has words; at most `most`."""
    base = clean_text(question)
    more = F.transform(F.filter(wanted, lambda f: _suffix(f).isNotNull()), lambda f: F.concat(base, F.lit(" "), _suffix(f)))
    return F.slice(F.array_distinct(F.concat(F.array(base), more)), 1, most)


def comparison_targets(question: Column) -> Column:
    """The two things that a comparing question names; empty for other questions and where there is but one."""
    base = clean_text(question)
    bare = lambda c: F.regexp_replace(c, EDGES, "")
    body = bare(F.regexp_replace(F.regexp_replace(base, _java(COMPARE_LEAD), ""), _java(COMPARE_TAIL), ""))
    parts = F.filter(F.transform(F.split(body, _java(CONJUNCTION), 3), bare), lambda p: p != "")
    none = F.array().cast("array<string>")
    return F.when(match_norm(question).rlike(FACETS["compare"][0]) & (F.size(parts) >= 2), F.slice(parts, 1, 2)).otherwise(none)


def comparison_plan(df: DataFrame, id_col: str, question: Column) -> DataFrame:
    """id, role, weight, query for questions that compare: the whole question (0.7) and a query for each target (1.0)
    with the words of at most two facets it asks for."""
    q = df.select(id_col, clean_text(question).alias("_base"), comparison_targets(question).alias("_t"), facets(question).alias("_f")).where(F.size("_t") == 2)
    asked = F.slice(F.filter("_f", lambda f: ~f.isin("general", "compare", "time")), 1, 2)
    words = F.array_join(F.transform(asked, _suffix), " ")
    words = F.when(words == "", F.lit(COMPARED_BY_DEFAULT)).otherwise(words)
    row = lambda role, weight, text: F.struct(F.lit(role).alias("role"), F.lit(weight).alias("weight"), text.alias("query"))
    target = lambda i: clean_text(F.concat_ws(" ", F.get("_t", F.lit(i)), words))
    plan = F.array(row("global", 0.7, F.col("_base")), row("target_a", 1.0, target(0)), row("target_b", 1.0, target(1)))
    return q.select(id_col, F.explode(plan).alias("_p")).select(id_col, "_p.*")


def domain_gate(meta: Column, signal: Column, explicit_ood: Column, margin: Column) -> Column:
    """Struct of result and reason; the first of these decides: a question about the system, a sign of the domain, a
    sign of another, the margin between the anchors of both."""
    as_ = lambda result, reason: F.struct(F.lit(result).alias("result"), F.lit(reason).alias("reason"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(meta), as_("meta", "meta_request")).when(yes(signal), as_("in_domain", "domain_signal"))
        .when(yes(explicit_ood), as_("out_of_domain", "explicit_ood")).when(margin < OOD_MARGIN, as_("out_of_domain", "anchor_guard"))
        .when(F.abs(margin) < UNSURE_MARGIN, as_("ambiguous", "low_domain_margin")).otherwise(as_("in_domain", "domain_anchor"))
    )


def covers(text: Column, terms: list[str]) -> Column:
    """Whether the normalised text holds any of the terms."""
    norm = match_norm(text)
    return F.coalesce(F.array_max(F.array(*[F.contains(norm, F.lit(t)) for t in terms])), F.lit(False)) if terms else F.lit(False)


def target_score(title: Column, text: Column, target: Column) -> Column:
    """How directly a passage is about a target: 1 for the title holding it, 0.82 for two thirds of its words in the
    title, 0.42 for the text holding it, 0.32 for two thirds of its words there, else 0."""
    name, head, body = match_norm(target), match_norm(title), match_norm(text)
    words = F.filter(F.split(name, " "), lambda w: F.length(w) > 2)
    share = lambda c: F.size(F.array_intersect(words, F.split(c, " "))) / F.greatest(F.lit(1), F.size(F.array_distinct(words)))
    score = F.when(F.contains(head, name), 1.0).when(share(head) >= 0.67, 0.82).when(F.contains(body, name), 0.42).when(share(body) >= 0.67, 0.32).otherwise(0.0)
    return F.when(name == "", 0.0).otherwise(score)

"""Text functions as Column builders; all run in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folding() -> tuple[str, str]:
    """Letters whose decomposition is one letter and marks, and that letter, then the marks, which have no letter and so
    are deleted; from the Unicode database."""
    src, dst, marks = [], [], []
    for i in range(0x80, 0xFFFF):
        c = chr(i)
        if unicodedata.category(c) == "Mn":
            marks.append(c)
            continue
        if not unicodedata.decomposition(c) or c.lower() != c:
            continue
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if base != c and len(base) == 1:
            src.append(c)
            dst.append(base)
    return "".join(src) + "đ" + "".join(marks), "".join(dst) + "d"


_SRC, _DST = _folding()


def _compatible() -> tuple[str, str, dict[str, str]]:
    """Letters and signs whose compatibility form, case folded and without marks, is one other sign, and that; and of those
    with several, all that are folded to a-z alone."""
    src, dst, longer = [], [], {}
    for i in (*range(0x80, 0x2E80), *range(0xF900, 0xFFFF), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F1AD)):
        c = chr(i)
        if unicodedata.category(c) in ("Cs", "Cn", "Co", "Mn"):
            continue
        form = "".join(x for x in unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", c).casefold()) if unicodedata.category(x) != "Mn")
        if len(form) == 1 and form != c:
            src.append(c)
            dst.append(form)
        elif len(form) > 1 and form.isascii() and form.isalpha():
            longer[c] = form
    return "".join(src), "".join(dst), longer


_COMPATIBLE, _PLAIN, _LONGER = _compatible()
#: Signs that show nothing and may stand between letters.
_UNSEEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"


def _once_folded() -> tuple[str, str]:
    """What folded() maps letters to, accents and then forms, as one map; those that go come last."""
    accents: dict[str, str] = {}
    for i, c in enumerate(_SRC + _UNSEEN):
        accents.setdefault(c, _DST[i : i + 1])
    forms: dict[str, str] = {}
    for c, plain in zip(_COMPATIBLE, _PLAIN, strict=True):
        forms.setdefault(c, plain)
    both = forms | {c: forms.get(x, x) for c, x in accents.items()}
    order = sorted(both, key=lambda c: both[c] == "")
    return "".join(order), "".join(both[c] for c in order)


_FOLDED, _INTO = _once_folded()
_BEYOND_ASCII = "[^\\x00-\\x7F]"


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, where c is told once however often f names it."""
    return F.transform(F.array(c), f)[0]


def folded(c: Column) -> Column:
    """Case folded, in compatibility form and without accents: full-width, mathematical and other letters that look like
    a-z become them, ligatures their letters, and signs that show nothing go. Letters without such a form stay."""
    plain = lambda x: bound(F.translate(F.lower(x), _FOLDED, _INTO), _spread)
    return bound(c, lambda x: F.when(x.rlike(_BEYOND_ASCII), plain(x)).otherwise(F.lower(x)))


def _spread(c: Column) -> Column:
    """Ligatures as their letters; only those that a text has are looked for."""
    letters = F.create_map(*[F.lit(x) for pair in _LONGER.items() for x in pair])
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?={_BEYOND_ASCII})[{''.join(_LONGER)}]"), F.lit(0)))
    return F.when(c.rlike(_BEYOND_ASCII), F.aggregate(found, c, lambda s, sign: F.replace(s, sign, letters[sign]))).otherwise(c)


def clean_text(c: Column) -> Column:
    """Null as '', line ends as LF, runs of blanks as one, at most one empty line, trimmed."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n")
    c = F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), "\n{3,}", "\n\n")
    return F.regexp_replace(c, "^\\s+|\\s+$", "")


def strip_accents(c: Column) -> Column:
    """Lower case without combining marks."""
    return F.translate(F.lower(c), _SRC, _DST)


def match_norm(c: Column) -> Column:
    """Lower case, no accents, and only a-z, 0-9 and single spaces."""
    return F.trim(F.regexp_replace(strip_accents(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def terms(c: Column) -> Column:
    """Terms of match_norm of at least two characters."""
    return F.filter(F.split(match_norm(c), " "), lambda t: F.length(t) >= 2)


def answer_tokens(c: Column) -> Column:
    """Runs of letters and digits of the lower-case text."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


#: A word's edge as SQL's patterns have it, where words are of ASCII letters, digits and _; Java's \\b knows letters of any script.
_EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def ascii_edges(pattern: str) -> str:
    """The pattern with every \\b between ASCII word characters and others."""
    return pattern.replace("\\b", _EDGE)


def years(c: Column) -> Column:
    """Sorted distinct four-digit years 1000 to 2099 that stand alone."""
    found = F.regexp_extract_all(c, F.lit(ascii_edges("\\b(1[0-9]{3}|20[0-9]{2})\\b")), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda y: y.cast("int"))))


def html_title(c: Column) -> Column:
    return F.trim(F.regexp_extract(c, "(?is)<title[^>]*>(.*?)</title>", 1))


def html_text(c: Column) -> Column:
    """Visible text: scripts, styles and tags out, five entities decoded, white space collapsed."""
    c = F.regexp_replace(c, "(?is)<(script|style|head)[^>]*>.*?</\\1>", " ")
    c = F.regexp_replace(F.regexp_replace(c, "(?s)<!--.*?-->", " "), "<[^>]+>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def without_hidden_markup(c: Column) -> Column:
    """Text without the spans of tags that a reader must not see."""
    return F.regexp_replace(c, "(?is)<(think|tool_call|function_call|plan_status)>.*?</\\1>", "")


def safe_filename(c: Column) -> Column:
    base = F.regexp_extract(c, "([^/\\\\]*)$", 1)
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(base, "[\\x00-\\x1f]", ""), "\\s+", " ")), 1, 180)


def enough_text(c: Column, least: int = 80) -> Column:
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), "[^\\p{L}\\p{N}]", "")) >= least


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and 24 hex digits of the SHA-256 of the parts as a compact JSON list."""
    texts = F.array(*[F.concat(F.lit('"'), F.replace(F.replace(p.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")), 256), 1, 24))


def secrets_masked(c: Column) -> Column:
    """Keys, tokens and e-mail addresses replaced."""
    c = F.regexp_replace(c, ascii_edges("(?i)\\b(sk|pk|api|key|token)[-_][a-z0-9_-]{8,}"), "[REDACTED]")
    return F.regexp_replace(c, "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", "[REDACTED]")


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cited(text: Column, facts: Column) -> Column:
    """Text with ' [id]' after each fact it holds, at the fact's first place; facts: array of (fact, id)."""
    at = F.filter(F.transform(facts, lambda f: F.struct((F.instr(text, f["fact"]) + F.length(f["fact"])).alias("end"), f["id"].alias("id"), (F.instr(text, f["fact"]) > 0).alias("found"))), lambda f: f["found"])
    last_first = F.reverse(F.array_sort(at))
    return F.aggregate(last_first, text, lambda s, f: F.concat(F.substr(s, F.lit(1), f["end"] - 1), F.lit(" ["), f["id"], F.lit("]"), F.substr(s, f["end"])))


def uncited(text: Column, ids: Column) -> Column:
    """Text without ' [id]' for the given ids."""
    return F.aggregate(ids, text, lambda s, i: F.replace(s, F.concat(F.lit(" ["), i, F.lit("]")), F.lit("")))


def without_names(c: Column, names: list[str], mask: str = "[hidden]") -> Column:
    """Text with the names replaced, whatever their case, the longest first."""
    for n in sorted(names, key=lambda n: (-len(n), n)):
        c = F.regexp_replace(c, f"(?iu)\\Q{n}\\E", mask)
    return c


def article_url(url: Column, source_id: Column, title: Column, base: str) -> Column:
    """The record's own URL, else one from its id, else one from its title, percent-encoded."""
    given = F.nullif(F.trim(url), F.lit(""))
    by_id = F.concat(F.lit(base + "?curid="), F.nullif(F.trim(source_id.cast("string")), F.lit("")))
    by_title = F.concat(F.lit(base + "/"), F.replace(F.url_encode(F.replace(F.nullif(F.trim(title), F.lit("")), F.lit(" "), F.lit("_"))), F.lit("+"), F.lit("%20")))
    return F.coalesce(given, by_id, by_title)


def public_url(c: Column) -> Column:
    """Whether an http(s) URL with a host and no user information."""
    return F.coalesce(c.rlike("^https?://[^/?#@\\s]+([/?#]|$)"), F.lit(False))


def without_secret_parameters(c: Column, names: str = "token|key|secret|password|signature|sig") -> Column:
    """The URL without query parameters of these names."""
    c = F.regexp_replace(c, f"(?i)([?&])(?:{names})=[^&#]*", "$1")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&{2,}", "&"), "[?]&", "?"), "[?&](#|$)", "$1")


def first_rank(hits: Column, lane: str) -> Column:
    """The least rank of a lane in a list of hits as lane:qN@rank, separated by commas."""
    found = F.regexp_extract_all(hits, F.lit(f"(?:^|,){lane}:q[0-9]+@([0-9]+)"), F.lit(1))
    return F.array_min(F.transform(found, lambda r: r.cast("int")))


def only_known_citations(text: Column, known: Column) -> Column:
    """Text without the bracketed ids that are not known; an id has letters, digits and _ : . - only."""
    ids = F.array_distinct(F.regexp_extract_all(text, F.lit("\\[([\\w:.-]+)\\]"), F.lit(1)))
    return F.aggregate(F.array_except(ids, known), text, lambda s, i: F.replace(s, F.concat(F.lit("["), i, F.lit("]")), F.lit("")))


def has_secret(c: Column) -> Column:
    """Whether secrets_masked would mask anything."""
    return F.coalesce(c.rlike(ascii_edges("(?i)\\b(sk|pk|api|key|token)[-_][a-z0-9_-]{8,}")) | c.rlike("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"), F.lit(False))


# The patterns by which years are read in different places; they are not the same on purpose.
YEAR_PATTERNS = {
    "history": r"(?iu)(?<!\d)[1-9]\d{2,3}(?!\d)|\b(?:thế kỷ|thế kỉ|TCN|SCN)\b",
    "metadata": r"\b(1[0-9]{3}|20[0-9]{2})\b",
    "question": r"(?<!\d)(\d{3,4})(?!\d)",
    "explicit": r"(?<!\d)(9[0-9]{2}|1[0-9]{3}|20[0-9]{2})(?!\d)",
    "answer": r"(?<!\d)(?:[5-9]\d{2}|1\d{3}|20\d{2})(?!\d)",
    "citation": r"^\d{3,4}$",
}


def year_signs(c: Column, kind: str) -> Column:
    """What a text has that one kind of pattern takes for a year, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(YEAR_PATTERNS[kind]), F.lit(0)))


def clipped(c: Column, most: int) -> Column:
    """A text of at most `most` characters; what is cut ends in an ellipsis."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)

"""Classification by lists of terms and an ordered list of decisions, both of them data.

Terms of all families are matched in one pass over a text's words by a table of first words that each task compiles once, so
hundreds of thousands of terms cost no more passes than one. Decisions are tried in order, and the first that fits is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms that are sent to the tasks; more are refused.
MOST_TERMS = 500_000
_APART = " ?[^\\p{L}\\p{N}_ ][^\\p{L}\\p{N}_]*| {2,}[^\\p{L}\\p{N}_]*"


def word_line(c: Column) -> Column:
    """A text's lower-case words, one space between those that one space is between, ` | ` for any other gap. A term occurs
    with word ends on both sides where its own line occurs between spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), _APART, " | "))


@dataclass(frozen=True)
class Rule:
    """A decision with its reason, taken where every feature of `needs` is at least its number, some of `some` is (if any are
    given), and none of `bars` is. A feature is `field.family`, the number of distinct terms of a family in a field,
    or one of the caller's own."""

    decision: str
    reason: str
    needs: dict[str, int] = field(default_factory=dict)
    some: dict[str, int] = field(default_factory=dict)
    bars: dict[str, int] = field(default_factory=dict)


class Matcher:
    """Terms by their line, and the lengths of those that begin with a word, so that a word costs a look-up a length."""

    def __init__(self, terms: list[tuple[str, str]]) -> None:
        self.of: dict[str, list[str]] = {}
        lengths: dict[str, set[int]] = {}
        for family, line in sorted(set(terms)):
            self.of.setdefault(line, []).append(family)
            lengths.setdefault(line.split(" ", 1)[0], set()).add(line.count(" ") + 1)
        self.lengths = {w: sorted(n) for w, n in lengths.items()}

    def families(self, line: str) -> dict[str, int]:
        """The number of distinct terms of each family that occur in a line of words."""
        words = line.split(" ")
        found = set()
        for i, w in enumerate(words):
            for n in self.lengths.get(w, ()):
                term = w if n == 1 else " ".join(words[i : i + n])
                if term in self.of:
                    found.add(term)
        out: dict[str, int] = {}
        for term in found:
            for family in self.of[term]:
                out[family] = out.get(family, 0) + 1
        return out


def with_term_hits(docs: DataFrame, fields: dict[str, Column], terms: DataFrame, out: str = "features") -> DataFrame:
    """Adds a map from `field.family` to the number of distinct terms (family, term) of the family that occur in the field.

    Null texts and terms, and terms without a word, match nothing; case and the width of gaps don't count."""
    lines = terms.select("family", word_line(F.col("term")).alias("line")).where("family is not null and line not in ('', '|')").distinct()
    known = [tuple(r) for r in lines.limit(MOST_TERMS + 1).collect()]
    if len(known) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    shared = docs.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf("map<string,int>")
    def families(lines: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(shared.value)
        for batch in lines:
            yield pd.Series([matcher.families(x) for x in batch], dtype=object)

    def of(name: str, c: Column) -> Column:
        return F.transform_keys(families(word_line(c)), lambda k, _: F.concat(F.lit(f"{name}."), k))

    return docs.withColumn(out, F.map_concat(*[of(name, c) for name, c in fields.items()]))


def decided(df: DataFrame, rules: list[Rule], otherwise: tuple[str, str], points: list[tuple[str, int, int]], reasons: list[tuple[str, str, int]], extra: dict[str, Column] | None = None, features: str = "features") -> DataFrame:
    """Adds score, decision and reasons. score: the points (feature, least, points) of all features that are at least their
    least, 0 to 10. reasons: those (name, feature, least) that hold, in order, then that of the first rule that fits, or of
    otherwise (decision, reason). extra: features of the caller's own, as whole numbers; null is 0."""
    own = {k: F.coalesce(c.cast("int"), F.lit(0)) for k, c in (extra or {}).items()}
    value = lambda k: own[k] if k in own else F.coalesce(F.element_at(F.col(features), k), F.lit(0))
    at_least = lambda pairs: [value(k) >= n for k, n in pairs.items()]

    def fits(r: Rule) -> Column:
        c = F.lit(True)
        for x in at_least(r.needs):
            c = c & x
        for x in at_least(r.bars):
            c = c & ~x
        some = at_least(r.some)
        if some:
            any_ = some[0]
            for x in some[1:]:
                any_ = any_ | x
            c = c & any_
        return c

    taken = F.coalesce(*[F.when(fits(r), F.struct(F.lit(r.decision).alias("decision"), F.lit(r.reason).alias("reason"))) for r in rules], F.struct(F.lit(otherwise[0]).alias("decision"), F.lit(otherwise[1]).alias("reason")))
    score = F.greatest(F.lit(0), F.least(F.lit(10), sum((F.when(value(k) >= n, F.lit(p)).otherwise(0) for k, n, p in points), F.lit(0))))
    named = F.array(*[F.when(value(k) >= n, F.lit(name)) for name, k, n in reasons]).cast("array<string>")
    out = df.withColumn("_taken", taken)
    return out.withColumn("score", score).withColumn("decision", F.col("_taken.decision")).withColumn("reasons", F.array_compact(F.concat(named, F.array(F.nullif(F.col("_taken.reason"), F.lit("")))))).drop("_taken")

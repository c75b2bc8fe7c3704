"""Chunks of sections by a tokenizer's budget: paragraphs, and where they are too long sentences, words or characters.

Each level is tried only where the one above gives a piece over the budget. Pieces of a section are then put together in
order; a chunk begins with the last pieces of the one before that fit the overlap, whatever level they are of.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Count = Callable[[str], int]
#: Headings: == x == or one to four # and x. Where paragraphs and sentences end.
HEADING = re.compile(r"\s*(?:={2,}\s*(?P<a>.*?)\s*={2,}|#{1,4}\s+(?P<b>.*))\s*")
PARAGRAPH, SENTENCE, WORD = re.compile(r"\n\s*\n"), re.compile(r"(?<=[.!?])\s+(?=\S)"), re.compile(r"\S+")
#: A chunk is only counted as a whole where the sum of its pieces comes so near the budget.
MARGIN = 8


def by_words() -> Count:
    """A budget of words."""
    return lambda text: len(text.split())


def by_tokenizer(path: str, ranks: str | None = None, pattern: str = "") -> Callable[[], Count]:
    """A budget of the tokens of a tokenizer file, which each task opens once. ranks: the file of the same vocabulary's ranks,
    with the pattern of its words, that gives the same tokens faster; a text that holds a special token goes to the former."""

    def load() -> Count:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        count = lambda text: len(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0])  # noqa: E731  without places
        if not ranks:
            return count
        import base64
        import json

        import tiktoken

        special = [t["content"] for t in json.loads(tokenizer.to_str())["added_tokens"]]
        with open(ranks, "rb") as f:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens={})
        return lambda text: count(text) if any(s in text for s in special) else len(fast.encode_ordinary(text))

    return load


def sections(text: str) -> list[tuple[str, str]]:
    """(heading, body) of each stretch of lines without a heading; '' before the first."""
    out: list[tuple[str, list[str]]] = [("", [])]
    for line in text.splitlines():
        if m := HEADING.fullmatch(line):
            out.append(((m["a"] or m["b"] or "").strip(), []))
        else:
            out[-1][1].append(line)
    return [(name, "\n".join(lines).strip()) for name, lines in out if lines]


def fitting(ends: Iterator[int], size: Callable[[int], int], budget: int) -> tuple[int, int]:
    """The last of the ends (from the first on, as they are asked for) whose size fits, or 0, and that size. As many as the
    budget are looked at first, then twice as many: no text is counted far beyond what fits."""
    seen: list[int] = []
    sizes: dict[int, int] = {}

    def of(e: int) -> int:
        if e not in sizes:
            sizes[e] = size(e)
        return sizes[e]

    low = 0
    while more := list(islice(ends, max(len(seen), budget))):
        low, seen = len(seen), seen + more
        if of(seen[-1]) > budget:
            break
    fit = bisect_right(seen, budget, lo=low, key=of)
    return (seen[fit - 1], of(seen[fit - 1])) if fit else (0, 0)


def prefixes(text: str, count: Count, budget: int) -> Iterator[str]:
    """A text in the longest runs of words that fit, and words that don't in the longest runs of characters."""
    return (part for part, _ in sized_prefixes(text, count, budget))


def sized_prefixes(text: str, count: Count, budget: int) -> Iterator[tuple[str, int]]:
    """prefixes() with their sizes."""
    at, text = 0, text.strip()
    while at < len(text):
        size = lambda e, at=at: count(text[at:e])
        cut, n = fitting((m.end() for m in WORD.finditer(text, at)), size, budget)
        if not cut:
            letters = range(at + 1, WORD.search(text, at).end() + 1)  # their sizes may fall again, as in a run of one letter
            if not (fit := bisect_right(letters, budget, key=size)):
                raise ValueError("a single character is over the budget")
            cut, n = letters[fit - 1], size(letters[fit - 1])
        yield text[at:cut], n
        at = cut
        while at < len(text) and text[at].isspace():
            at += 1


def pieces(body: str, count: Count, budget: int) -> Iterator[tuple[str, int]]:
    """Paragraphs with their sizes, each at the first level where it fits."""
    for paragraph in filter(None, map(str.strip, PARAGRAPH.split(body))):
        size = count(paragraph)
        if size <= budget:
            yield paragraph, size
            continue
        for sentence in filter(None, map(str.strip, SENTENCE.split(paragraph))):
            size = count(sentence)
            if size <= budget:
                yield sentence, size
            else:
                yield from sized_prefixes(sentence, count, budget)


def packed(body: str, count: Count, budget: int, overlap: int) -> Iterator[str]:
    """The chunks of a section."""
    held: list[tuple[str, int]] = []
    line = lambda more: " ".join([x for x, _ in held] + more)
    for piece, size in pieces(body, count, budget):
        if held and sum(n for _, n in held) + size + len(held) > budget - MARGIN and count(line([piece])) > budget:
            yield line([])
            room = overlap
            keep = len(held)
            while keep and held[keep - 1][1] <= room:
                keep -= 1
                room -= held[keep][1]
            del held[:keep]
            while held and count(line([piece])) > budget:
                del held[0]
        held.append((piece, size))
    if held:
        yield line([])


def nested_chunks(docs: DataFrame, id_col: str, text_col: str, counter: Callable[[], Count] = by_words, budget: int = 384, overlap: int = 48) -> DataFrame:
    """id, chunk_index (from 0 in a document), section, chunk_text, token_count of at most `budget`. Null and blank texts
    have no chunks; the order of chunks is that of the text. A text is cut by one task, as each chunk depends on the one
    before; counter makes the function that counts tokens, once for each task."""
    if not 0 <= overlap < budget:
        raise ValueError("an overlap is from 0 to less than the budget")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter()
        for f in frames:
            rows = []
            for i, text in zip(f["_id"], f["_t"], strict=True):
                index = 0
                for section, body in sections(text or ""):
                    for chunk in packed(body, count, budget, overlap):
                        size = count(chunk)
                        for part, n in [(chunk, size)] if size <= budget else sized_prefixes(chunk, count, budget):
                            rows.append((i, index, section, part, n))
                            index += 1
            yield pd.DataFrame(rows, columns=[id_col, "chunk_index", "section", "chunk_text", "token_count"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t")).mapInPandas(run, f"`{id_col}` {kind}, chunk_index int, section string, chunk_text string, token_count int")

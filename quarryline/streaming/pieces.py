"""Filters over the pieces of running answers, and the last samples of a key as a stream.

A piece is shown as soon as it can be; what a later piece may still complete (a bracket, a tag) is held back as a short
string, which is all the state there is. Functions that workers run are nested, so that workers need not import this.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

# Tags whose content a reader must not see; how long an open bracket is waited for.
HIDDEN_TAGS = ("think", "tool_call", "function_call", "plan_status")
BRACKET_MOST = 512


def _steps():
    """(known, hidden): each takes what is held, a piece and whether it is the last; and gives what to show and to hold."""
    import re

    tags, most = HIDDEN_TAGS, BRACKET_MOST
    span = re.compile(f"<({'|'.join(tags)})>(.*?)(</\\1>|\\Z)", re.IGNORECASE | re.DOTALL)
    bracket = re.compile(r"\[([^\]]*)\]")

    def known(held: str, piece: str, last: bool, ids: set) -> tuple[str, str]:
        text = held + piece
        cut = text.find("[", text.rfind("]") + 1)  # every bracket before is closed
        done, rest = (text, "") if cut < 0 else (text[:cut], text[cut:])
        shown = bracket.sub(lambda m: m[0] if m[1] in ids else "", done)
        return (shown + rest[1:], "") if rest and (last or len(rest) > most) else (shown, rest)

    def hidden(held: str, piece: str, last: bool) -> tuple[str, str]:
        text, out, at, rest = held + piece, [], 0, ""
        for m in span.finditer(text):
            out.append(text[at : m.start()])
            at = m.end()
            if not m[3]:  # still open: of what it hides only the end may matter
                rest = f"<{m[1]}>" + m[2][-len(m[1]) - 2 :]
        tail = text[at:]
        begun = tail.rfind("<")
        if begun >= 0 and not last and any(f"<{t}>".startswith(tail[begun:].lower()) for t in tags):
            tail, rest = tail[:begun], tail[begun:]
        return "".join(out) + tail, "" if last else rest

    return known, hidden


def _filter():
    """A filter of one answer after another: (held, piece, last, ids) to (shown, held); held is a pair."""
    known, hidden = _steps()

    def feed(held: tuple[str, str], piece: str | None, last: bool, ids) -> tuple[str, tuple[str, str]]:
        seen, tag = hidden(held[1], piece or "", bool(last))
        shown, open_ = known(held[0], seen, bool(last), set(ids) if ids is not None else set())
        return shown, (open_, tag)

    return feed


def _rows(pieces: DataFrame, key: str, seq: str, text: str, last: str, known: str) -> DataFrame:
    return pieces.select(key, seq, F.col(text).alias("_text"), F.coalesce(F.col(last), F.lit(False)).alias("_last"), F.col(known).alias("_known"))


def filtered_pieces(pieces: DataFrame, key: str, seq: str, text: str, last: str, known: str) -> DataFrame:
    """key, seq, shown: what each piece lets a reader see, without hidden markup and without brackets that name none of
    the known ids. Pieces of one key follow seq; `last` ends an answer, and what an open tag hides is never shown.

    Null texts are empty, a null list knows no id, pieces of a null key are one answer. A task reads its answers as they
    come and keeps one held string, however many pieces an answer has.
    """
    rows = _rows(pieces, key, seq, text, last, known).repartition(key).sortWithinPartitions(key, seq)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    feed = _filter()

    def run(batches):
        of, held = None, ("", "")
        for b in batches:
            shown = []
            for k, t, end, ids in zip(b[key], b["_text"], b["_last"], b["_known"], strict=True):
                k = None if k != k else k
                if k != of:
                    of, held = k, ("", "")
                out, held = feed(held, t, end, ids)
                held = ("", "") if end else held
                shown.append(out)
            yield b[[key, seq]].assign(shown=shown)

    return rows.mapInPandas(run, f"{key} {kinds[key]}, {seq} {kinds[seq]}, shown string")


def filtered_stream(stream: DataFrame, key: str, seq: str, text: str, last: str, known: str) -> DataFrame:
    """filtered_pieces of a stream: pieces of a micro-batch follow seq, batches must come in order; the state of an
    answer goes with its last piece."""
    rows = _rows(stream, key, seq, text, last, known)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    feed = _filter()

    def run(_, batches, state):
        import pandas as pd

        held = tuple(state.get) if state.exists else ("", "")
        b = pd.concat(list(batches)).sort_values(seq)
        shown = []
        for t, end, ids in zip(b["_text"], b["_last"], b["_known"], strict=True):
            out, held = feed(held, t, end, ids)
            held = ("", "") if end else held
            shown.append(out)
        if held == ("", ""):
            state.remove() if state.exists else None
        else:
            state.update(held)
        yield b[[key, seq]].assign(shown=shown)

    out = f"{key} {kinds[key]}, {seq} {kinds[seq]}, shown string"
    return rows.groupBy(key).applyInPandasWithState(run, out, "open string, tag string", "append", GroupStateTimeout.NoTimeout)


def last_n_stream(stream: DataFrame, key: str, seq: str, value: str, n: int = 500) -> DataFrame:
    """key, n, p50, p95 (linear) of the last n values of each key that a micro-batch touches; nulls are no samples. The
    state of a key is n numbers."""
    rows = stream.select(key, seq, F.col(value).cast("double").alias("_v")).where("_v is not null")
    kind = rows.schema[key].dataType.simpleString()

    def run(k, batches, state):
        import numpy as np
        import pandas as pd

        b = pd.concat(list(batches)).sort_values(seq)
        recent = ([*state.get[0]] if state.exists else []) + b["_v"].tolist()
        recent = recent[-n:]
        state.update((recent,))
        p50, p95 = np.percentile(recent, [50, 95])
        yield pd.DataFrame({key: [k[0]], "n": [len(recent)], "p50": [round(float(p50), 6)], "p95": [round(float(p95), 6)]})

    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, n long, p50 double, p95 double", "recent array<double>", "update", GroupStateTimeout.NoTimeout)

"""Stateful filters on streams of text chunks: hidden reasoning and a model's own list of references."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.functions.text import REFERENCES_HEADING

_OPEN, _CLOSE = "<think>", "</think>"
_HEADING = re.compile(REFERENCES_HEADING, re.I)
#: What such a heading may begin with, at the end of a text that is still arriving.
_BEGUN = re.compile(r"\n+(?:-+[ \t]*\n*)?(?:\*{0,2}|#{1,6}\s*)(?:" + "|".join("References"[:n] for n in range(10, -1, -1)) + ")$", re.I)


def _partial(text: str, tag: str) -> int:
    """How many characters at the end of `text` may be the beginning of `tag`."""
    return next((n for n in range(min(len(tag) - 1, len(text)), 0, -1) if text.endswith(tag[:n])), 0)


def think_step(hidden: bool, held: str, chunk: str) -> tuple[bool, str, str]:
    """(hidden, held, shown) after a chunk. A tag may be split over chunks; its beginning is held until it is decided."""
    text, shown = held + chunk, []
    while True:
        tag = _CLOSE if hidden else _OPEN
        at = text.find(tag)
        if at < 0:
            n = _partial(text, tag)
            if not hidden:
                shown.append(text[: len(text) - n])
            return hidden, text[len(text) - n :], "".join(shown)
        if not hidden:
            shown.append(text[:at])
        text, hidden = text[at + len(tag) :], not hidden


def references_step(done: bool, held: str, chunk: str) -> tuple[bool, str, str]:
    """(done, held, shown) after a chunk: nothing is shown from the heading of a list of references on."""
    if done:
        return True, "", ""
    text = held + chunk
    if m := _HEADING.search(text):
        return True, "", text[: m.start()]
    m = _BEGUN.search(text)
    return (False, text[m.start() :], text[: m.start()]) if m else (False, "", text)


def run_steps(step: Callable[[bool, str, str], tuple[bool, str, str]], chunks: Iterable[str], keep_end: Callable[[bool], bool] = lambda flag: not flag) -> str:
    """What a filter shows of all chunks: the batch form of the streams below."""
    flag, held, out = False, "", []
    for c in chunks:
        flag, held, shown = step(flag, held, c)
        out.append(shown)
    return "".join(out) + (held if keep_end(flag) else "")


def _stateful(chunks: DataFrame, step, stream: str, seq: str, text: str, last: str) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in chunks.schema.fields}

    def handle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flag, held = state.get if state.exists else (False, "")
        rows = pd.concat(list(batches), ignore_index=True).sort_values("_s", kind="stable")
        shown, ended = [], False
        for chunk, is_last in zip(rows["_t"], rows["_e"]):
            flag, held, out = step(bool(flag), held, chunk if isinstance(chunk, str) else "")
            if is_last:
                out, held, ended = out + ("" if flag else held), "", True
            shown.append(out)
        if ended:
            state.remove()
        else:
            state.update((bool(flag), held))
        yield pd.DataFrame({stream: [key[0]] * len(rows), seq: rows["_s"].to_numpy(), "shown": shown})

    rows = chunks.select(F.col(stream).alias("_k"), F.col(seq).alias("_s"), F.col(text).alias("_t"), F.coalesce(F.col(last), F.lit(False)).alias("_e"))
    return rows.groupBy("_k").applyInPandasWithState(
        handle, f"`{stream}` {kinds[stream]}, `{seq}` {kinds[seq]}, shown string", "flag boolean, held string", "append", GroupStateTimeout.NoTimeout
    )


def hide_reasoning(chunks: DataFrame, stream: str = "stream_id", seq: str = "seq", text: str = "chunk", last: str = "is_last") -> DataFrame:
    """(stream, seq, shown): what may be shown of every chunk. State is kept per stream until its last chunk."""
    return _stateful(chunks, think_step, stream, seq, text, last)


def hide_references(chunks: DataFrame, stream: str = "stream_id", seq: str = "seq", text: str = "chunk", last: str = "is_last") -> DataFrame:
    """(stream, seq, shown): chunks up to the heading of a list of references."""
    return _stateful(chunks, references_step, stream, seq, text, last)

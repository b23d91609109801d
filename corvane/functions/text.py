"""Text as column expressions: sentence chunks, snippets, counts, removal of hidden blocks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 500 tokens of 4 characters, and 50 of overlap.
MAX_CHARS = 2000
OVERLAP_CHARS = 200


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sentence_chunks(text: Column | str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> Column:
    """Chunks of whole sentences as an array.

    A text within the limit, or one that holds a table row (" | "), is one chunk. Otherwise sentences are gathered until the
    next would exceed the limit; the next chunk then starts with the last sentences that fit the overlap. A sentence over the
    limit that meets an empty buffer is a chunk of its own. The overlap and the sentence after it are not held against the limit.
    """
    text = _col(text)
    sentences = F.split(text, r"(?<=[.!?])\s+")
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("out"), empty.alias("buf"), F.lit(0).alias("len"))

    def tail(buf: Column) -> Column:
        # The longest suffix whose sentences, a blank each, fit the overlap.
        kept = F.aggregate(
            F.reverse(buf),
            F.struct(empty.alias("s"), F.lit(0).alias("n"), F.lit(True).alias("go")),
            lambda a, x: F.when(
                a["go"] & (a["n"] + F.length(x) <= overlap),
                F.struct(F.concat(F.array(x), a["s"]).alias("s"), (a["n"] + F.length(x) + 1).alias("n"), F.lit(True).alias("go")),
            ).otherwise(F.struct(a["s"].alias("s"), a["n"].alias("n"), F.lit(False).alias("go"))),
        )
        return F.struct(kept["s"].alias("s"), kept["n"].alias("n"))

    def step(a: Column, x: Column) -> Column:
        alone = (F.length(x) > max_chars) & (F.size(a["buf"]) == 0)
        over = (a["len"] + F.length(x) > max_chars) & (F.size(a["buf"]) > 0)
        kept = tail(a["buf"])
        return (
            F.when(alone, F.struct(F.concat(a["out"], F.array(x)).alias("out"), a["buf"].alias("buf"), a["len"].alias("len")))
            .when(
                over,
                F.struct(
                    F.concat(a["out"], F.array(F.array_join(a["buf"], " "))).alias("out"),
                    F.concat(kept["s"], F.array(x)).alias("buf"),
                    (kept["n"] + F.length(x) + 1).alias("len"),
                ),
            )
            .otherwise(F.struct(a["out"].alias("out"), F.concat(a["buf"], F.array(x)).alias("buf"), (a["len"] + F.length(x) + 1).alias("len")))
        )

    def finish(a: Column) -> Column:
        return F.when(F.size(a["buf"]) > 0, F.concat(a["out"], F.array(F.array_join(a["buf"], " ")))).otherwise(a["out"])

    whole = (F.length(text) <= max_chars) | text.contains(" | ")
    return F.when(whole, F.array(text)).otherwise(F.aggregate(sentences, start, step, finish))


def chunk_sentences(text: str | None, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> list[str]:
    """What `sentence_chunks` gives, for use outside of column expressions; null has no chunks."""
    if text is None:
        return []
    if len(text) <= max_chars or " | " in text:
        return [text]
    out: list[str] = []
    buffer: list[str] = []
    size = 0
    for sentence in re.split(r"(?<=[.!?])\s+", text, flags=re.ASCII):
        if buffer and size + len(sentence) > max_chars:
            out.append(" ".join(buffer))
            keep, kept = len(buffer), 0
            while keep and kept + len(buffer[keep - 1]) <= overlap:
                keep -= 1
                kept += len(buffer[keep]) + 1
            buffer, size = buffer[keep:], kept
        elif not buffer and len(sentence) > max_chars:
            out.append(sentence)
            continue
        buffer.append(sentence)
        size += len(sentence) + 1
    return out + ([" ".join(buffer)] if buffer else [])


def token_estimate(text: Column | str) -> Column:
    """Four characters count as a token."""
    return F.floor(F.length(_col(text)) / 4).cast("int")


def snippet(text: Column | str, limit: int = 320) -> Column:
    """One paragraph: white space as single blanks, cut at the last blank within the limit; null gives ''."""
    t = F.trim(F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"\s+", " "))
    cut = F.regexp_replace(F.substring(t, 1, limit), r" [^ ]*$", "")
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(cut, F.lit("…")))


def strip_think(text: Column | str) -> Column:
    """Without the blocks of hidden reasoning and the white space after them."""
    return F.regexp_replace(_col(text), r"(?s)<think>.*?</think>\s*", "")


def plural(n: Column | str, noun: str) -> Column:
    many = noun[:-1] + "ies" if noun.endswith("y") else noun + "s"
    n = _col(n)
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(f" {noun}")).otherwise(F.lit(f" {many}")))


def references_suffix(text: Column | str, marker: str = "\n\n---\n**References:**") -> Column:
    """The text from the last marker on; '' without one."""
    t = _col(text)
    at = F.length(t) - F.instr(F.reverse(t), marker[::-1]) - len(marker) + 2
    return F.when(t.contains(marker), F.substring(t, at, F.length(t))).otherwise("")


# Fixed value: the heading of a list of references that an answer brings along: a rule, a mark-up mark, the word.
REFERENCES_HEADING = r"\n+(?:-{3,}\s*\n+)?(?:\*{0,2}|#{1,6}\s*)References\b"


def cut_at_references(text: Column | str) -> Column:
    """The text up to the first heading of a list of references."""
    return F.regexp_replace(_col(text), rf"(?is){REFERENCES_HEADING}.*$", "")

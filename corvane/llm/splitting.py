"""Splitting oversized items at natural boundaries: structure-tree packing.

A text is parsed into a tree: sections under their headings, nested by level, in them paragraphs, lists and tables, in these lines,
items (nested by indent) and rows, then sentences, words, characters. A node that fits the limit is a piece. Only an oversized
node is opened, and its children, siblings of one parent, are merged from the bottom up as long as they fit; a piece never runs from one
parent's part into another's. A cut thus falls on the highest structure that allows it. Each piece but the first repeats the end
of the one before.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import spread

_BREAK = r"\r\n|[\n\r\v\f\x1c-\x1e\x85\u2028\u2029]"
_LINE_END = re.compile(_BREAK)
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
_SPACE = re.compile(r"\s+")
_NATURAL = re.compile(rf"(?:{_BREAK})|(?<=[.!?])\s+")
_HEADING = re.compile(r"(#{1,6})\s")
_ITEM = re.compile(r"(?:[-*•–+]|\d{1,3}[.)]|[a-zA-Z][.)])\s+\S")
#: A title line without mark-up is a heading below all that are marked.
_TITLE_LEVEL, _TITLE_LENGTH = 7, 80
#: Items nested deeper than this are siblings.
_DEEPEST_ITEM = 20
#: What a stretch of plain text is opened into, one after the other.
LINE, SENTENCE, WORD, CHARACTER = range(4)


class Node:
    """A part of the text: text[start:end] without white space at its ends, and its children, or what it is opened into."""

    __slots__ = ("start", "end", "kids", "level", "kind")

    def __init__(self, start: int, end: int, kind: str, kids: list[Node] | None = None, level: int = LINE):
        self.start, self.end, self.kind, self.kids, self.level = start, end, kind, kids, level

    def opened(self, text: str, size: int) -> list[Node]:
        if self.kids is not None:
            return self.kids
        if self.level == CHARACTER:
            return [Node(s, e, "characters", level=CHARACTER) for s, e in _characters(text, self.start, self.end, size)]
        at, spans = self.start, []
        for m in (_LINE_END, _SENTENCE_END, _SPACE)[self.level].finditer(text, self.start, self.end):
            spans.append((at, m.start()))
            at = m.end()
        spans.append((at, self.end))
        return [Node(s, e, "text", level=self.level + 1) for s, e in (_trim(text, *x) for x in spans) if s < e]


def _trim(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    return start, end


def _characters(text: str, start: int, end: int, size: int) -> Iterator[tuple[int, int]]:
    """As many characters as fit, but a combining mark stays with its letter."""
    while start < end:
        to = back = min(start + size, end)
        while back > start + 1 and back < end and unicodedata.combining(text[back]):
            back -= 1
        to = back if back > start + 1 or to == end else to
        yield start, to
        start = to


def _lines(text: str) -> list[tuple[int, int, int]]:
    """(start, end, indent) of every line without white space at its ends; a blank line has start == end."""
    out, at = [], 0
    for m in [*_LINE_END.finditer(text), None]:
        end = m.start() if m else len(text)
        s, e = _trim(text, at, end)
        out.append((s, e, s - at))
        at = m.end() if m else end
    return out


def _list_node(items: list[tuple[int, Node]]) -> Node:
    """A list from its items with their indents, in order: an item's children are its own lines and the items indented below it."""
    root = Node(items[0][1].start, items[-1][1].end, "list", kids=[])
    path: list[tuple[int, Node]] = []
    for indent, own in items:
        while path and path[-1][0] >= indent:
            path.pop()
        item = Node(own.start, own.end, "item", kids=[own])
        (path[-1][1] if path else root).kids.append(item)
        for _, above in path:
            above.end = own.end
        if len(path) < _DEEPEST_ITEM:
            path.append((indent, item))
    return root


def structure(text: str) -> Node:
    """The tree of a text."""
    lines = _lines(text)
    filled = [s < e for s, e, _ in lines]

    def is_item(i: int) -> bool:
        return _ITEM.match(text, lines[i][0], lines[i][1]) is not None

    def is_row(i: int) -> bool:
        return "|" in text[lines[i][0] : lines[i][1]]

    def heading(i: int) -> int:
        """The level of the heading that a line is; 0 for none."""
        s, e, _ = lines[i]
        if m := _HEADING.match(text, s, e):
            return len(m.group(1))
        # A short line after a blank one that no sentence mark ends, right above text that starts anew.
        alone = (i == 0 or not filled[i - 1]) and i + 1 < len(lines) and filled[i + 1]
        if alone and e - s <= _TITLE_LENGTH and text[e - 1] not in ".!?:;,|" and not is_item(i) and not is_row(i):
            return 0 if text[lines[i + 1][0]].islower() else _TITLE_LEVEL
        return 0

    root = Node(*_trim(text, 0, len(text)), "section", kids=[])
    path: list[tuple[int, Node]] = [(0, root)]

    def add(node: Node, level: int | None = None) -> None:
        if level is not None:
            while path[-1][0] >= level:
                path.pop()
        path[-1][1].kids.append(node)
        for _, above in path:
            above.end = max(above.end, node.end)
        if level is not None:
            path.append((level, node))

    i = 0
    while i < len(lines):
        s, e, indent = lines[i]
        if not filled[i]:
            i += 1
        elif level := heading(i):
            add(Node(s, e, "section", kids=[Node(s, e, "heading")]), level)
            i += 1
        elif is_item(i):
            items: list[tuple[int, Node]] = []
            while i < len(lines):
                s, e, indent = lines[i]
                if filled[i] and is_item(i) and not (heading(i) and not items):
                    items.append((indent, Node(s, e, "text")))
                elif filled[i] and indent > items[-1][0] and not heading(i):
                    items[-1][1].end = e  # goes on with the item above
                elif filled[i] or i + 1 == len(lines) or not filled[i + 1] or not is_item(i + 1):
                    break
                i += 1
            add(_list_node(items))
        elif is_row(i):
            rows = []
            while i < len(lines) and filled[i] and is_row(i) and not is_item(i):
                rows.append(Node(lines[i][0], lines[i][1], "row", level=SENTENCE))
                i += 1
            add(Node(rows[0].start, rows[-1].end, "table", kids=rows))
        else:
            start = s
            while i < len(lines) and filled[i] and not is_item(i) and not is_row(i) and not (lines[i][0] > start and heading(i)):
                e = lines[i][1]
                i += 1
            add(Node(start, e, "text"))
    _keep_headings(root, text)
    return root


def _keep_headings(node: Node, text: str) -> None:
    """A heading is the first child of the block it stands above, so that it is not left behind by itself."""
    for kid in node.kids:
        if kid.kind == "section":
            _keep_headings(kid, text)
    if len(node.kids) > 1 and node.kids[0].kind == "heading" and node.kids[1].kind != "section":
        title, block = node.kids[0], node.kids[1]
        node.kids[:2] = [Node(title.start, block.end, block.kind, kids=[title, *block.opened(text, 1)])]


def _pack(text: str, node: Node, limit: int, room: int) -> tuple[list[tuple[int, int]], bool]:
    """Spans of `node` that fit, and whether a stretch between natural boundaries had to be cut.

    A span leaves `room` for the overlap; one that cannot be cut at a natural boundary may take all of the limit.
    """
    size, fits = node.end - node.start, limit - room
    whole = node.kids is None and node.level >= WORD
    if size <= fits or whole and size <= limit:
        return [(node.start, node.end)], False
    forced = whole
    out: list[tuple[int, int]] = []
    open_ = False  # whether the last span consists of whole children, so that the next sibling may join it
    for kid in node.opened(text, fits):
        spans, cut = _pack(text, kid, limit, room)
        forced |= cut
        if open_ and len(spans) == 1 and spans[0][1] - out[-1][0] <= fits:
            out[-1] = (out[-1][0], spans[0][1])
        else:
            out += spans
        open_ = len(spans) == 1
    return out, forced


def split_text(text: str | None, limit: int = 2_000, overlap: int = 200) -> tuple[list[tuple[int, int, int]], str | None]:
    """Pieces (start, core, end) of `text` and the kind of cut; offsets count code points.

    A piece is text[start:end], at most `limit` long and without white space at its ends; from start to core it repeats the
    end of the piece before. That is `overlap` characters where the piece before has them, less what brings the start to a natural
    boundary if one lies in the first half of them, else to a word; only beside a stretch that is longer than `limit` less
    `overlap` and has no natural boundary is it less. Cores follow one another and leave out white space only. The kind is
    'forced' if a stretch between natural boundaries exceeds the limit, else 'boundary'. A null text has no pieces and no kind;
    one that is empty or white space has one empty piece.
    """
    if text is None:
        return [], None
    start, end = _trim(text, 0, len(text))
    if end - start <= limit:
        return [(start, start, end)], "boundary"
    spans, forced = _pack(text, structure(text), limit, min(overlap, limit - 1))
    natural = [m.end() for m in _NATURAL.finditer(text)]
    out = [(spans[0][0], *spans[0])]
    for (_, before), (s, e) in zip(spans, spans[1:]):
        # The most that may be repeated: the allowance, and what the piece still has room for; never all of the piece before.
        least = max(s - overlap, e - limit, out[-1][0] + 1)
        out.append((_overlap_start(text, natural, least, before, s), s, e))
    return out, "forced" if forced else "boundary"


def _overlap_start(text: str, natural: list[int], least: int, before: int, core: int) -> int:
    if least >= before:
        return core
    at = bisect.bisect_left(natural, least)
    half = least + (before - least) // 2
    if at < len(natural) and natural[at] <= half:
        begin = natural[at]
    elif text[least - 1].isspace() or text[least].isspace():
        begin = least
    else:
        m = _SPACE.search(text, least, before)
        begin = m.end() if m and m.end() < before else least
    while begin < before and unicodedata.combining(text[begin]):
        begin += 1
    while begin < core and text[begin].isspace():
        begin += 1
    return min(begin, core)


def split_items(df: DataFrame, id_col: str, text_col: str, keep: list[str] = (), limit: int = 2_000, overlap: int = 200, with_text: bool = True) -> DataFrame:
    """(id, *keep, n_chars, cut_kind, piece_no, start, core, end[, piece]) for every piece of every row of `df`.

    n_chars is counted in the text itself, whatever other columns say. Rows whose text is null have no pieces; an empty one
    has one empty piece. Rows that repeat an id are cut each by itself. The text of the pieces is left out without `with_text`.
    """
    if limit < 2 or not 0 <= overlap < limit:
        raise ValueError("the limit must be 2 or more and the overlap less than the limit")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, at = [], []
            for i, text in enumerate(b["_text"]):
                if isinstance(text, str):
                    parts, kind = split_text(text, limit, overlap)
                    for no, (s, c, e) in enumerate(parts):
                        at.append(i)
                        rows.append((len(text), kind, no, s, c, e, *([text[s:e]] if with_text else [])))
            names = ["n_chars", "cut_kind", "piece_no", "start", "core", "end", *(["piece"] if with_text else [])]
            left = b.drop(columns="_text").iloc[at].reset_index(drop=True)
            yield pd.concat([left, pd.DataFrame(rows, columns=names)], axis=1)

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (id_col, *keep))
    schema += ", n_chars int, cut_kind string, piece_no int, start int, core int, end int" + (", piece string" if with_text else "")
    return spread(df.select(id_col, *keep, F.col(text_col).alias("_text"))).mapInPandas(cut, schema)

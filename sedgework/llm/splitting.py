"""Splitting oversized items at natural boundaries.

A text is read as a tree: sections by the level of their headings, blocks (paragraphs,
fenced code, tables, lists), list items by their indentation, lines, sentences, words,
characters. A heading belongs to what it heads: between them no cut is made. Only a
node that does not fit is descended into; below it, sibling subtrees that fit are
merged bottom-up, the two smallest neighbours first, as long as they fit, so that of
two neighbouring pieces neither could take in the other. What a node was cut into is
not merged with the node's siblings. Pieces are spans of the stored text, so nothing
is lost or changed.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEADING = re.compile(r"^(#{1,6})[ \t]+\S[^\n]*\s*", re.M)
_FENCE = re.compile(r"^[ \t]*(```+|~~~+)", re.M)
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+|(?<=[。！？])[」』”’）]*\s*")
_BLANK_LINE = re.compile(r"\n[ \t\r]*\n\s*")
_ITEM = re.compile(r"^([ \t]*)(?:[-+*•・]|\d{1,9}[.)])[ \t]+\S", re.M)
_LINE = re.compile(r"\n")
_WORD = re.compile(r"\s+|(?<=[、，；,;:])")

Span = tuple[int, int]


def _fenced(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Spans of fenced code inside ``text[a:b]``; an open fence runs to the end."""
    spans, mark, start = [], "", 0
    for m in _FENCE.finditer(text, a, b):
        if not mark:
            mark, start = m[1], m.start()
        elif m[1][0] == mark[0] and len(m[1]) >= len(mark):
            spans.append((start, m.end()))
            mark = ""
    return spans + [(start, b)] * bool(mark)


class Tree:
    """The tree of one text, made as far as it is descended into."""

    def __init__(self, text: str):
        self.text = text
        self.code = _fenced(text, 0, len(text))
        self._opens = [a for a, _ in self.code]
        headings = [m for m in _HEADING.finditer(text) if not self._in_code(m.start())]
        self.headings = [(m.start(), len(m[1])) for m in headings]
        self._starts, self._ends = [m.start() for m in headings], [m.end() for m in headings]
        self.items = [(m.start(), len(m[1].expandtabs(4))) for m in _ITEM.finditer(text) if not self._in_code(m.start())]

    def _in_code(self, i: int) -> bool:
        k = bisect_right(self._opens, i) - 1
        return k >= 0 and i < self.code[k][1]

    def _headed(self, i: int) -> bool:
        """Whether a cut at ``i`` would part a heading's line, or the line from what it heads."""
        k = bisect_left(self._starts, i) - 1
        return k >= 0 and i <= self._ends[k]

    def _cut(self, a: int, b: int, cuts: Iterable[int]) -> list[Span]:
        marks = [a, *sorted({c for c in cuts if a < c < b and not self._headed(c)}), b]
        return list(zip(marks, marks[1:]))

    def _outermost(self, a: int, b: int, starts: list[tuple[int, int]]) -> list[Span]:
        """Cut where the nodes of the lowest depth inside begin."""
        inside = starts[bisect_left(starts, (a + 1,)) : bisect_left(starts, (b,))]
        inside = [(i, k) for i, k in inside if not self._headed(i)]
        top = min((k for _, k in inside), default=0)
        return self._cut(a, b, (i for i, k in inside if k == top))

    def sections(self, a: int, b: int) -> list[Span]:
        return self._outermost(a, b, self.headings)

    def blocks(self, a: int, b: int) -> list[Span]:
        cuts = [m.end() for m in _BLANK_LINE.finditer(self.text, a, b)]
        fences = self._opens[bisect_left(self._opens, a) : bisect_left(self._opens, b)]
        return self._cut(a, b, [*(c for c in cuts if not self._in_code(c)), *fences])

    def listed(self, a: int, b: int) -> list[Span]:
        return self._outermost(a, b, self.items)

    def at(self, pattern: re.Pattern, a: int, b: int) -> list[Span]:
        return self._cut(a, b, (m.end() for m in pattern.finditer(self.text, a, b)))

    def levels(self) -> list[Callable[[int, int], list[Span]]]:
        flat = [lambda a, b, p=p: self.at(p, a, b) for p in (_LINE, _SENTENCE, _WORD)]
        return [self.sections, self.blocks, self.listed, *flat]


NESTED = (0, 2)  # sections and list items have their like inside


def merged(spans: list[Span], limit: int) -> list[Span]:
    """Neighbours merged while two together fit, the smallest pair first; ties from the left."""
    ends, alive = [list(s) for s in spans], [True] * len(spans)
    after = list(range(1, len(spans) + 1))
    before = list(range(-1, len(spans) - 1))
    heap = [(spans[i + 1][1] - spans[i][0], i, i + 1, spans[i][1]) for i in range(len(spans) - 1)]
    heapq.heapify(heap)
    while heap:
        size, i, j, seam = heapq.heappop(heap)
        if size > limit:
            break
        if not (alive[i] and j < len(spans) and alive[j] and after[i] == j and ends[j][1] - ends[i][0] == size and ends[i][1] == seam):
            continue
        ends[i][1], alive[j], after[i] = ends[j][1], False, after[j]
        if after[j] < len(spans):
            before[after[j]] = i
            heapq.heappush(heap, (ends[after[j]][1] - ends[i][0], i, after[j], ends[i][1]))
        if before[i] >= 0:
            heapq.heappush(heap, (ends[i][1] - ends[before[i]][0], before[i], i, ends[before[i]][1]))
    return [(a, b) for (a, b), there in zip(ends, alive) if there]


def packed(tree: Tree, limit: int) -> list[Span]:
    """Spans of at most ``limit`` characters that make up the text."""
    levels = tree.levels()

    def pack(a: int, b: int, level: int) -> list[Span]:
        while b - a > limit:
            if level == len(levels):
                return [(i, min(i + limit, b)) for i in range(a, b, limit)]
            children = levels[level](a, b)
            if len(children) > 1:
                break
            level += 1
        else:
            return [(a, b)]
        out: list[Span] = []
        fitting: list[Span] = []
        for i, j in children:
            if j - i <= limit:
                fitting.append((i, j))
            else:
                out += merged(fitting, limit) + pack(i, j, level if level in NESTED else level + 1)
                fitting = []
        return out + merged(fitting, limit)

    return pack(0, len(tree.text), 0)


def _lead(text: str, start: int, overlap: int) -> int:
    """Where a piece that follows on ``start`` begins: at most ``overlap`` before, at a sentence, line or word."""
    lo = max(0, start - overlap)
    for pattern in (_SENTENCE, _LINE, _WORD):
        if (m := pattern.search(text, lo, start)) and m.end() < start:
            return m.end()
    return lo


def split_text(text: str, limit: int, overlap: int = 200) -> list[tuple[int, int, int]]:
    """``(start, end, core)`` of each piece: ``text[core:]`` is where it is new; before that it repeats.

    Every piece has at most ``limit`` characters, the cores make up the text
    without gap, and a piece shares up to ``overlap`` characters with the one
    before. A text within the limit is one piece. ``overlap`` must be less than
    ``limit``.
    """
    if len(text) <= limit:
        return [(0, len(text), 0)]
    cores = packed(Tree(text), limit - overlap)
    return [(_lead(text, a, overlap) if a else 0, b, a) for a, b in cores]


def split_oversized(df: DataFrame, key: str, text: str, limit: int, overlap: int = 200) -> DataFrame:
    """``key, piece (from 1), pieces, starts_at, new_from, content`` of the rows over the limit.

    Lengths and offsets are code points. Null, empty and shorter texts give no rows.
    Of repeated rows with one key and text one counts. Lengths are tested before
    any text leaves the JVM; a text is cut by the task that reads it.
    """
    rows = df.where(F.char_length(text) > limit).select(F.col(key).alias("key"), F.col(text).alias("text")).distinct()
    kind = dict(rows.dtypes)["key"]
    names = ["key", "piece", "pieces", "starts_at", "new_from", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = split_text(t, limit, overlap)
                for i, (a, b, core) in enumerate(spans):
                    for column, value in zip(out, (k, i + 1, len(spans), a, core, t[a:b])):
                        column.append(value)
            types = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    schema = f"key {kind}, piece int, pieces int, starts_at int, new_from int, content string"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)

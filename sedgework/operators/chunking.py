"""Chunking of files: flat windows, semantic blocks, and parent sections with child blocks.

Rows of ``path, text`` become nested ``parents`` and ``children`` in one pass over
Arrow batches; both tables and their ids are then plain projections of that.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgework.functions.text import sha12, token_estimate

# Fixed values of the format.
HEADING = re.compile(r"#{1,6}\s+[^\n\r\u2028\u2029]+\Z")
FENCE = re.compile(r"\s*(?:```|~~~)")
WINDOW_LINES, SEARCH_LINES, LEAST_WINDOW = 50, 15, 10
LEAST_FLAT, LEAST_CHILD, PARENT_LINES = 20, 10, 200
_TRIM = " \t\n\r\x0b\x0c\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


@dataclass(frozen=True)
class Block:
    """Lines ``first`` to ``last``, counted from 1, ends included."""

    first: int
    last: int


def _blank(line: str) -> bool:
    return not line.strip(_TRIM)


def _text(lines: list[str], b: Block) -> str:
    return "\n".join(lines[b.first - 1 : b.last])


def flat_windows(text: str, most: int = WINDOW_LINES) -> list[Block]:
    """Windows of at most ``most`` lines that end at a blank line among their last ones, if there is one.

    Windows of 20 characters or fewer, trimmed, are dropped.
    """
    lines = text.split("\n")
    out, start = [], 0
    while start < len(lines):
        end = min(start + most, len(lines))
        earliest = max(start + LEAST_WINDOW, end - SEARCH_LINES)
        end = next((j + 1 for j in reversed(range(earliest + 1, end)) if _blank(lines[j])), end)
        if len("\n".join(lines[start:end]).strip(_TRIM)) > LEAST_FLAT:
            out.append(Block(start + 1, end))
        start = end
    return out


def semantic_blocks(lines: list[str], offset: int = 0) -> list[Block]:
    """Paragraph-like runs of non-blank lines, at most 50 each; a run that begins with a fence goes on to the next fence.

    Each line gets a label: blank, or the run it belongs to. Fenced runs are never
    cut; an open fence runs to the end.
    """
    labels: list[tuple[int, bool] | None] = []
    run, inside, fenced = 0, False, False
    for line in lines:
        if fenced:
            labels.append((run, True))
            if FENCE.match(line):
                fenced = inside = False
        elif _blank(line):
            labels.append(None)
            inside = False
        else:
            if not inside:
                run, inside, fenced = run + 1, True, bool(FENCE.match(line))
            labels.append((run, fenced))
    out = []
    for label, members in groupby(range(len(lines)), key=labels.__getitem__):
        if label is None:
            continue
        at = list(members)
        size = len(at) if label[1] else WINDOW_LINES
        out += [Block(offset + part[0] + 1, offset + part[-1] + 1) for part in (at[i : i + size] for i in range(0, len(at), size))]
    return out


def sections(lines: list[str]) -> list[tuple[int, int, str | None]]:
    """``(start, end, heading)`` from 0, end excluded; lines before the first heading have none. Fences do not hide headings."""
    starts = [i for i, line in enumerate(lines) if HEADING.match(line)]
    if not starts:
        return [(0, len(lines), None)]
    bounds = [(0, starts[0], None)] if starts[0] else []
    return bounds + [
        (a, b, re.sub(r"\A#{1,6}\s+", "", lines[a]).strip(_TRIM)) for a, b in zip(starts, [*starts[1:], len(lines)])
    ]


def markdown_tree(text: str) -> tuple[list[tuple[Block, str | None]], list[tuple[Block, int]]]:
    """``parents`` with their heading, and ``children`` with the number of their parent.

    A section is one parent, or several if its blocks span 200 lines or more; the
    first begins at the heading, the last ends with the section. Blocks that are
    nothing but a heading and children under 10 characters are left out, but a
    parent with blocks keeps its first one. A section without blocks is a parent
    without children.
    """
    lines = text.split("\n")
    parents: list[tuple[Block, str | None]] = []
    children: list[tuple[Block, int]] = []
    for start, end, heading in sections(lines):
        blocks = [b for b in semantic_blocks(lines[start:end], start) if not HEADING.match(_text(lines, b).strip(_TRIM))]
        packs: list[list[Block]] = []
        for b in blocks:
            if packs and b.last - packs[-1][0].first < PARENT_LINES:
                packs[-1].append(b)
            else:
                packs.append([b])
        late = []
        for k, pack in enumerate(packs or [[]]):
            first = start + 1 if k == 0 else pack[0].first
            last = end if k >= len(packs) - 1 else pack[-1].last
            own = [b for b in pack if len(_text(lines, b).strip(_TRIM)) >= LEAST_CHILD]
            children += [(b, len(parents)) for b in own]
            late += [(b, len(parents)) for b in pack[:1] if not own]
            parents.append((Block(first, last), heading))
        children += late
    return parents, children


def is_markdown(path: Column) -> Column:
    return path.rlike(r"(?i)\.(md|mdx|markdown)$")


def _chunked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        parents, children = [], []
        for text, markdown in zip(pdf["text"], pdf["markdown"]):
            lines = text.split("\n")
            if markdown:
                ps, cs = markdown_tree(text)
            else:
                ps, cs = [], [(b, None) for b in flat_windows(text)]
            parents.append([{"content": _text(lines, b), "line_start": b.first, "line_end": b.last, "heading": h} for b, h in ps])
            children.append([{"content": _text(lines, b), "line_start": b.first, "line_end": b.last, "parent": p} for b, p in cs])
        yield pd.DataFrame({"path": pdf["path"], "parents": parents, "children": children})


_PARENT = "struct<content:string,line_start:int,line_end:int,heading:string>"
_CHILD = "struct<content:string,line_start:int,line_end:int,parent:int>"


def chunk_files(files: DataFrame) -> DataFrame:
    """``path, parents, children`` of ``files(path, text)``; null texts are left out, an empty Markdown file is one empty parent."""
    rows = files.where("path is not null and text is not null").select("path", "text", is_markdown(F.col("path")).alias("markdown"))
    return rows.mapInPandas(_chunked, f"path string, parents array<{_PARENT}>, children array<{_CHILD}>")


def parent_rows(chunked: DataFrame, indexed_at: str) -> DataFrame:
    rows = chunked.select("path", F.explode("parents").alias("p")).select("path", "p.*")
    return rows.select(
        F.concat(sha12(F.col("path")), F.lit("-p-"), "line_start").alias("id"),
        F.col("path").alias("file_path"),
        "content",
        "line_start",
        "line_end",
        "heading",
        sha12(F.col("content")).alias("hash"),
        F.lit(indexed_at).alias("indexed_at"),
        token_estimate(F.col("content")).alias("tokens"),
    )


def child_rows(chunked: DataFrame, indexed_at: str) -> DataFrame:
    rows = chunked.select("path", "parents", F.explode("children").alias("c")).select("path", "parents", "c.*")
    parent = F.concat(sha12(F.col("path")), F.lit("-p-"), F.get("parents", F.col("parent"))["line_start"])
    return rows.select(
        F.concat(sha12(F.col("path")), F.lit("-"), "line_start").alias("id"),
        F.col("path").alias("file_path"),
        F.col("content").alias("chunk_content"),
        "line_start",
        "line_end",
        sha12(F.col("content")).alias("chunk_hash"),
        F.lit(indexed_at).alias("indexed_at"),
        token_estimate(F.col("content")).alias("tokens"),
        F.when(F.col("parent").isNotNull(), parent).alias("parent_id"),
    )

"""Text of files by format: plain, HTML to Markdown, DOCX, PDF through a hook."""

from __future__ import annotations

import hashlib
import io
import os
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgework.functions.text import trimmed

SPARSE_CHARS = 50
_BLOCKS = frozenset("p div section article main header ul ol table blockquote figure tr".split())


class _Markdown(HTMLParser):
    """Writes Markdown while the page is read; scripts, styles, navigation and footers are left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.lists: list[list] = []
        self.links: list[str] = []
        self.hidden = self.pre = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style", "nav", "footer", "head"):
            self.hidden += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("_")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n" if len(self.lists) > 1 else "\n\n")
        elif tag == "li":
            top = self.lists[-1] if self.lists else ["ul", 0]
            top[1] += 1
            mark = f"{top[1]}." if top[0] == "ol" else "-"
            self.out.append("\n" + "    " * (len(self.lists) - 1) + mark + " ")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[")
        elif tag == "img":
            a = dict(attrs)
            self.out.append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "hr":
            self.out.append("\n\n* * *\n\n")
        elif tag in ("td", "th"):
            self.out.append(" | ")
        elif tag in _BLOCKS:
            self.out.append("\n\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "nav", "footer", "head"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.out.append("\n```\n\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("_")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.out.append("\n\n" if not self.lists else "")
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")
        elif tag in _BLOCKS or re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(data.strip("\n") if self.pre else re.sub(r"\s+", " ", data))


def html_to_markdown(page: str) -> str:
    parser = _Markdown()
    parser.feed(page)
    parser.close()
    parts = re.split(r"(```\n.*?\n```)", "".join(parser.out), flags=re.S)
    prose = [p if p.startswith("```") else re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]{0,3}(?=\S|\n)", "\n", p)) for p in parts]
    return "".join(prose).strip()


def docx_text(data: bytes) -> str:
    """Paragraphs of a DOCX, one blank line between them."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in body.iter(f"{w}p"):
        out.append("".join({f"{w}t": x.text or "", f"{w}tab": "\t", f"{w}br": "\n"}.get(x.tag, "") for x in p.iter()))
    return "\n\n".join(out)


def is_sparse(text: Column, pages: Column) -> Column:
    """Fewer than 50 characters a page: the pages are probably images."""
    return F.char_length(trimmed(text)) < SPARSE_CHARS * F.greatest(F.lit(1), pages)


def pdf_text(data: bytes, read: Callable[[bytes], tuple[str, int]], ocr: Callable[[bytes], str] | None = None) -> str:
    """``read`` gives text and pages; if that is sparse, OCR text is kept where it is longer."""
    text, pages = read(data)
    if ocr and len(text.strip()) < SPARSE_CHARS * max(1, pages):
        other = ocr(data)
        if len(other.strip()) > len(text.strip()):
            return other
    return text


def extract(
    path: str, data: bytes, read_pdf: Callable[[bytes], tuple[str, int]] | None = None, ocr: Callable[[bytes], str] | None = None
) -> tuple[str, str, int]:
    """``text, hash, size``: the hash is of what was stored, not of what was made of it.

    Of binary formats every byte is taken as one character before hashing; sizes
    are bytes there and characters for text.
    """
    ext = os.path.splitext(path)[1].lower()
    if ext in (".pdf", ".docx"):
        if ext == ".pdf" and read_pdf is None:
            raise ValueError("reading PDF needs a reader")
        text = docx_text(data) if ext == ".docx" else pdf_text(data, read_pdf, ocr)
        raw, size = data.decode("latin-1"), len(data)
    else:
        raw = data.decode("utf-8", "replace")
        text, size = (html_to_markdown(raw) if ext in (".html", ".htm") else raw), len(raw)
    return text, hashlib.sha256(raw.encode()).hexdigest()[:12], size


def read_files(
    files: DataFrame, read_pdf: Callable[[bytes], tuple[str, int]] | None = None, ocr: Callable[[bytes], str] | None = None
) -> DataFrame:
    """``path, real, text, hash, size, sha256`` of ``files(path, real)``; a file that cannot be read has null text and hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, real in zip(pdf["path"], pdf["real"]):
                row: tuple = (path, real, None, None, None, None)
                try:
                    with open(path, "rb") as f:
                        data = f.read()
                    text, digest, size = extract(path, data, read_pdf, ocr)
                    row = (path, real, text, digest, size, hashlib.sha256(data).hexdigest())
                except (OSError, ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError):
                    pass
                yield pd.DataFrame([row], columns=["path", "real", "text", "hash", "size", "sha256"])

    return files.select("path", "real").mapInPandas(run, "path string, real string, text string, hash string, size long, sha256 string")

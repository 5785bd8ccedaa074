"""Markup residue to clean text that keeps headings, lists, code blocks and formulas.

A text is read once into stretches: fenced code is content as it stands, everything
else goes through the four kinds of markup in turn. Each converter reports whether
it found any of its kind, so that the kinds of a field come from cleaning it.

HTML goes through a DOM. For every node the composite text density is the number of
characters per tag, lowered by the share of characters in links. The threshold is the
least density on the path from the body to the node with the greatest sum of its
children's densities. Of a page, the subtree kept is the one with the greatest sum
whose own density reaches the threshold. Fragments, whose root counts as the body,
lose only what stands under the threshold and mostly in links: menus and the like.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("html", "markdown", "wiki", "latex")

# The tag names of HTML that count as markup.
TAGS = (
    "a abbr address area article aside b base bdi bdo blockquote body br button caption center cite code col colgroup "
    "dd del details dfn dialog div dl dt em embed fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head "
    "header hr html i iframe img input ins kbd label legend li link main map mark meta nav noscript object ol optgroup "
    "option p param picture pre q s samp script section select small source span strike strong style sub summary sup "
    "svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr"
).split()
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("script style template noscript head".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)

_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<!doctype[^>]*>|<(/?)({'|'.join(TAGS)})((?:\s[^<>]*)?)/?>", re.I | re.S)
_ENTITY = re.compile(r"&(?:[a-zA-Z][a-zA-Z0-9]{1,30}|#\d{1,7}|#[xX][0-9a-fA-F]{1,6});")
_FENCE = re.compile(r"^[ \t]*(`{3,}|~{3,})[^\n]*$", re.M)
_SUSPECT = re.compile(r"[<&`*\[\\{$_~>|#=]|''|^[ \t]*(?:[-+] |\d{1,3}[.)] |[-=]{3,})", re.M)


@dataclass
class Node:
    tag: str
    parent: Node | None = None
    children: list = field(default_factory=list)
    chars: int = 0
    tags: int = 0
    link_chars: int = 0
    link_tags: int = 0
    density: float = 0.0
    density_sum: float = 0.0


def parse_html(text: str) -> Node:
    """A forgiving tree: unknown ends are ignored, open tags end with their parent."""
    root = node = Node("#root")
    open_: Counter[str] = Counter()  # so that an end of nothing is no search up the tree
    at = 0
    for m in _TAG.finditer(text):
        if m.start() > at:
            node.children.append(text[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            while open_[tag]:
                open_[node.tag] -= 1
                node, ended = node.parent, node.tag
                if ended == tag:
                    break
        else:
            if tag in ("li", "tr", "td", "th", "p", "dt", "dd", "option") and node.tag == tag:
                open_[tag] -= 1
                node = node.parent
            child = Node(tag, node)
            node.children.append(child)
            if tag not in _VOID and not m[0].endswith("/>"):
                node = child
                open_[tag] += 1
    if at < len(text):
        node.children.append(text[at:])
    _measure(root)
    return root


def _measure(root: Node) -> None:
    """Densities bottom-up, without recursion."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node)]
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(c.strip()) if node.tag not in _DROPPED else 0
            elif c.tag not in _DROPPED:
                node.chars += c.chars
                node.tags += 1 + c.tags
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
    body_links, body_chars = root.link_chars, max(1, root.chars)
    for node in reversed(order):
        c, lc, t = node.chars, node.link_chars, max(1, node.tags)
        if c:
            base = math.log(c / max(1, c - lc) * lc + body_links / body_chars * c + math.e)
            adjusted = math.log(max(1.0, c / max(1, lc) * t / max(1, node.link_tags)))
            node.density = c / t * adjusted / max(0.1, math.log(base))
        node.density_sum = sum(ch.density if isinstance(ch, Node) else float(len(ch.strip())) for ch in node.children)


def _nodes(top: Node) -> list[Node]:
    """The node and all below it that may hold content."""
    out, stack = [], [top]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [c for c in node.children if isinstance(c, Node) and c.tag not in _DROPPED]
    return out


def threshold(body: Node, nodes: list[Node]) -> float:
    """The least density from the node of greatest sum up to the body."""
    node = max((n for n in nodes if n.chars), key=lambda n: n.density_sum, default=body)
    least = node.density
    while node is not body:
        node = node.parent
        least = min(least, node.density)
    return least


def content_of(root: Node) -> tuple[Node, frozenset[int]]:
    """The subtree to keep, and the identities of nodes below it to leave out."""
    nodes = _nodes(root)
    body = next((n for n in nodes if n.tag == "body"), None)
    if body is not None:
        inside = [n for n in _nodes(body) if n.chars]
        least = threshold(body, inside)
        blocks = [n for n in inside if n.density >= least and any(isinstance(c, Node) and c.tag in _BLOCK for c in n.children)]
        return max(blocks, key=lambda n: n.density_sum, default=body), frozenset()
    least = threshold(root, nodes)
    return root, frozenset(id(n) for n in nodes if n.tag in _BLOCK and n.density < least and 2 * n.link_chars > n.chars and n.link_tags > 1)


_CELL, _END = object(), object()


def _items(node: Node, left_out: frozenset[int]) -> list:
    """What a node's content is written as: strings, nodes in their place, and the ends of table cells."""
    out: list = []
    number = 0
    for c in node.children:
        if isinstance(c, str):
            out.append(c)
            continue
        tag = c.tag
        if tag in _DROPPED or id(c) in left_out:
            continue
        if tag == "br":
            out.append("\n")
        elif tag == "hr":
            out.append("\n\n")
        elif tag == "pre":
            out.append("\n\n```\n" + html.unescape("".join(_texts(c))).strip("\n") + "\n```\n\n")
        elif tag[0] == "h" and tag[1:].isdigit():
            out += ["\n\n" + "#" * int(tag[1:]) + " ", c, "\n\n"]
        elif tag == "li":
            number += 1
            out += [f"\n{number}. " if node.tag == "ol" else "\n- ", c]
        elif tag == "tr":
            cells = [x for x in c.children if isinstance(x, Node)]
            out += ["\n", *(y for i, x in enumerate(cells) for y in ([" | "] if i else []) + [_CELL, x, _END])]
        elif tag in _BLOCK:
            gap = "\n\n" if tag not in ("tbody", "thead", "tfoot") else "\n"
            out += [gap, c, gap]
        else:
            out.append(c)
    return out


def _render(root: Node, left_out: frozenset[int] = frozenset()) -> str:
    """Text of a tree: headings as #, items as -, rows with |, pre as fenced code; nesting may be of any depth."""
    out: list[str] = []
    cells: list[int] = []
    stack: list = [root]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x is _CELL:
            cells.append(len(out))
        elif x is _END:
            at = cells.pop()
            out[at:] = [" ".join("".join(out[at:]).split())]
        else:
            stack += reversed(_items(x, left_out))
    return "".join(out)


def _texts(node: Node) -> Iterator[str]:
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            yield x
        else:
            stack += reversed(x.children)


def from_html(text: str) -> tuple[str, bool]:
    found = False
    if "<" in text and _TAG.search(text):
        found = True
        text = _render(*content_of(parse_html(text)))
    if "&" in text and _ENTITY.search(text):
        plain = _ENTITY.sub(lambda m: html.unescape(m[0]), text)
        found, text = found or plain != text, plain.replace("\xa0", " ")
    return text, found


_LATEX_ENV = re.compile(r"\\(?:begin|end)\{[a-zA-Z]+\*?\}(?:\[[^\]\n]*\])?[ \t]*\n?")
_LATEX_ITEM = re.compile(r"^([ \t]*)\\item\b(?:\[([^\]\n]*)\])?[ \t]*", re.M)
_LATEX_HEAD = re.compile(r"\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}\n]*)\}")
_LATEX_MATH = re.compile(r"\\\[(?=[^\n]*\\\])|\\\((?=[^\n]*\\\))|\$\$(?=[^$]+\$\$)")
_LATEX_INLINE = re.compile(r"(?<![\\$])\$(?!\s)([^$\n]*[\\^_{][^$\n]*?)(?<!\s)\$(?!\d)")
_LATEX_DROP = re.compile(r"[~ ]?\\(?:label|index|vspace|hspace|cite[pt]?|ref|eqref|pageref|footnotemark)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}")
_LATEX_BRACE = re.compile(r"\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{|[{}\n]")
_LATEX_SPACE = re.compile(r"(?<=\w)\\[,;:!](?=[^\s\\])|(?<=\w)~(?=\\?\w)")
_LATEX_ANY = re.compile(
    r"(?<![\w:\\/])\\(?:(?:begin|end|[a-zA-Z]{2,}\*?(?:\[[^\]\n]*\])?)\{|item\b|\[(?=[^\n]*\\\])|\((?=[^\n]*\\\)))"
    r"|[~\w]\\(?:ref|cite|label|pageref|eqref|footnote)\*?\{|(?<=\d)\\,(?=\w)|\$\$[^$]+\$\$"
)


_KEPT = re.compile(r"\x00(\d{1,9})\x00")


def from_latex(text: str) -> tuple[str, bool]:
    """Sections and items keep their structure, formulas stay as ``$...$``, other commands give their argument."""
    if "\\" not in text and "$" not in text:
        return text, False
    if not (_LATEX_ANY.search(text) or _LATEX_INLINE.search(text)):
        return text, False
    formulas: list[str] = []
    text = text.replace("\x00", "")

    def keep(m: re.Match) -> str:
        formulas.append(m[0])
        return f"\x00{len(formulas) - 1}\x00"

    text = re.sub(r"\\\[.+?\\\]|\\\(.+?\\\)|\$\$[^$]+\$\$", keep, text)
    text = _LATEX_INLINE.sub(keep, text)
    text = _LATEX_HEAD.sub(lambda m: "#" * (1 + ("sub" in m[1]) + (m[1] == "subsubsection")) + " " + m[2], text)
    text = _LATEX_ENV.sub("", text)
    text = _LATEX_ITEM.sub(lambda m: f"{m[1]}- {m[2] + ' ' if m[2] else ''}", text)
    text = _LATEX_DROP.sub("", text)
    text = _LATEX_SPACE.sub(" ", _arguments(text))
    whole: list[str] = []  # a formula may hold earlier ones

    def restored(m: re.Match) -> str:
        return whole[int(m[1])] if int(m[1]) < len(whole) else ""

    for formula in formulas:
        whole.append(_KEPT.sub(restored, formula))
    return _KEPT.sub(restored, text), True


def _arguments(text: str) -> str:
    """Commands with an argument on one line give the argument, however deeply nested."""
    out: list[str] = []
    open_: list[int] = []  # places of commands in the output, -1 for a brace of the text's own
    at = 0
    for m in _LATEX_BRACE.finditer(text):
        out.append(text[at : m.start()])
        at = m.end()
        if m[0] == "\n":
            open_.clear()
        elif m[0] == "}":
            if open_ and (k := open_.pop()) >= 0:
                out[k] = ""
                continue
        else:
            open_.append(len(out) if m[0] != "{" else -1)
        out.append(m[0])
    return "".join([*out, text[at:]])


_WIKI_ANY = re.compile(
    r"\[\[[^\[\]\n]+\]\]|\{\{[^{}\n]+\}\}|'''?[^'\n]+?'''?|^(={2,6})[^=\n]+\1[ \t]*$|^\{\||^\|\}[ \t]*$|^\|-[ \t]*$|\[https?://[^\]\s]+ [^\]\n]+\]|<ref[ >]", re.M
)
_WIKI_TABLE = re.compile(r"^\{\|.*?(?:^\|\}[ \t]*$|\Z)", re.M | re.S)


def _wiki_table(m: re.Match) -> str:
    rows, row = [], []
    for line in m[0].splitlines()[1:]:
        if line.startswith("|}"):
            break
        if line.startswith("|-"):
            if row:
                rows.append(row)
            row = []
        elif line[:1] in "|!" and line:
            cells = re.split(r"\|\||!!", line[1:])
            row += [c.rsplit("|", 1)[-1].strip() if line[0] == "|" else c.strip() for c in cells]
    return "\n".join(" | ".join(r) for r in [*rows, row] if r)


def _without_templates(text: str) -> str:
    """Templates on one line go, with those inside them and a blank before them."""
    out: list[str] = []
    open_: list[int] = []
    at = 0
    for m in re.finditer(r"[ \t]?\{\{|\}\}|\n", text):
        out.append(text[at : m.start()])
        at = m.end()
        if m[0] == "}}" and open_:
            del out[open_.pop() :]
            continue
        if m[0] == "\n":
            open_.clear()
        elif m[0] != "}}":
            open_.append(len(out))
        out.append(m[0])
    return "".join([*out, text[at:]])


def from_wiki(text: str) -> tuple[str, bool]:
    if not any(x in text for x in ("[[", "{{", "''", "==", "{|", "|-", "[http", "<ref")) or not _WIKI_ANY.search(text):
        return text, False
    text = _WIKI_TABLE.sub(_wiki_table, text)
    text = re.sub(r"\[\[(?:[Cc]ategory|[Ff]ile|[Ii]mage):[^\[\]\n]*\]\]", "", text)
    text = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]\n]*)\]\]", r"\1", text)
    text = re.sub(r"\[https?://\S+ ([^\]\n]+)\]", r"\1", text)
    text = _without_templates(text)
    text = re.sub(r"'{2,5}([^'\n]+?)'{2,5}", r"\1", text)
    text = re.sub(r"^(={2,6})[ \t]*([^=\n]+?)[ \t]*\1[ \t]*$", lambda m: "#" * len(m[1]) + " " + m[2], text, flags=re.M)
    text = re.sub(r"<ref[^>]*/>|<ref[^>]*>.*?</ref>", "", text, flags=re.S)
    return text, True


_MD_LINK = re.compile(r"!?\[([^\[\]\n]*)\]\([^()\s]*(?:\s+\"[^\"\n]*\")?\)")
_MD_CODE = re.compile(r"(?<!`)(`{1,2})(?!`)([^`\n]+)(?<!`)\1(?!`)")
_MD_BOLD = re.compile(r"(?<![*\w])\*\*(?!\s)([^*\n]+?)(?<!\s)\*\*(?![*\w])|(?<![\w_])__(?!\s)([^_\n]+?)(?<!\s)__(?![\w_])")
_MD_ITALIC = re.compile(r"(?<![*\w\\])\*(?![\s*])([^*\n]+?)(?<![\s*])\*(?![*\w])|(?<![\w_\\])_(?![\s_])([^_\n]+?)(?<![\s_])_(?![\w_])")
_MD_STRIKE = re.compile(r"~~(?!\s)([^~\n]+?)(?<!\s)~~")
_MD_QUOTE = re.compile(r"^[ \t]*(?:>[ \t]?)+(?=\S)", re.M)
_MD_RULE = re.compile(r"^\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)*\|?[ \t\r]*(?:\n|\Z)", re.M)
_MD_ROW = re.compile(r"^[ \t]*\|([^\n]*[^\s|])[ \t]*\|[ \t\r]*$", re.M)
_MD_HEAD = re.compile(r"^#{1,6}[ \t]+(?=\S)", re.M)
_MD_ITEM = re.compile(r"^[ \t]*[-+*][ \t]+(?=\S)", re.M)
_MD_ORDERED = re.compile(r"^[ \t]*(\d{1,3})[.)][ \t]+\S", re.M)
_MD_REF = re.compile(r"^\[[^\]\n]+\]:[ \t]+\S+.*$", re.M)
_MD_ESCAPE = re.compile(r"(?<![\w:\\/])\\([*_#`>~|])")


def _ordered(text: str) -> bool:
    """Two items on following lines or blocks, the second numbered one more than the first."""
    last = None
    for m in _MD_ORDERED.finditer(text):
        n = int(m[1])
        if last is not None and n == last[0] + 1 and text.count("\n", last[1], m.start()) <= 3:
            return True
        last = (n, m.start())
    return False


def from_markdown(text: str) -> tuple[str, bool]:
    """Marks go, structure stays: headings as #, items as -, rows with |, code spans as their code."""
    found = bool(_MD_HEAD.search(text) or _MD_ITEM.search(text) or _ordered(text))
    for pattern, new in (
        (_MD_CODE, r"\2"),
        (_MD_LINK, r"\1"),
        (_MD_REF, ""),
        (_MD_BOLD, lambda m: m[1] or m[2]),
        (_MD_ITALIC, lambda m: m[1] or m[2]),
        (_MD_STRIKE, r"\1"),
        (_MD_QUOTE, ""),
        (_MD_ESCAPE, r"\1"),
    ):
        text, n = pattern.subn(new, text)
        found = found or n > 0
    if _MD_RULE.search(text) and "|" in text:
        found = True
        text = _MD_ROW.sub(lambda m: " | ".join(c.strip() for c in m[1].split("|")), _MD_RULE.sub("", text))
    return _MD_ITEM.sub("- ", text), found


def _stretches(text: str) -> Iterator[tuple[bool, str]]:
    """(is fenced code, text); an open fence runs to the end of the text."""
    at, mark, start = 0, "", 0
    for m in _FENCE.finditer(text):
        if not mark:
            yield False, text[at : m.start()]
            mark, start = m[1], m.start()
        elif m[1][0] == mark[0] and len(m[1]) >= len(mark) and m[0].strip() == m[1]:
            yield True, text[start : m.end()]
            at, mark = m.end(), ""
    yield (True, text[start:]) if mark else (False, text[at:])


def clean(text: str | None) -> tuple[str | None, list[str]]:
    """Clean text and the kinds of markup found, in the order of :data:`KINDS`. Null stays null."""
    if not text or not _SUSPECT.search(text):
        return text, []
    found, out = set(), []
    for code, part in _stretches(text.replace("\r\n", "\n")):
        if code:
            found.add("markdown")
            out.append(part)
            continue
        if _own_markdown(part):  # what the other converters make is structure of the result, not markup of the text
            found.add("markdown")
        for kind, convert in (("html", from_html), ("latex", from_latex), ("wiki", from_wiki)):
            part, has = convert(part)
            if has:
                found.add(kind)
        part = from_markdown(part)[0]
        out.append(part)
    joined = re.sub(r"[ \t]+\n", "\n", "".join(out))
    return re.sub(r"\n{3,}", "\n\n", joined).strip("\n"), [k for k in KINDS if k in found]


def _own_markdown(part: str) -> bool:
    """Whether a stretch holds Markdown besides its HTML, wiki and LaTeX."""
    if "{|" in part:
        part = _WIKI_TABLE.sub("", part)
    if "\\" in part or "$" in part:
        for pattern in (_LATEX_INLINE, _LATEX_HEAD, _LATEX_ENV, _LATEX_ITEM):
            part = pattern.sub("", part)
    return from_markdown(_TAG.sub("", part) if "<" in part else part)[1]


def body_of(content: str | None, heading: str | None) -> str | None:
    """Content without the heading's line, which is its first line when there is a heading."""
    if content is None or heading is None:
        return content
    return content.partition("\n")[2]


def clean_fields(df: DataFrame, key: str = "id", content: str = "content", heading: str = "heading") -> DataFrame:
    """``key, field, markup (array<string>), cleaned`` for the fields ``content`` and ``heading`` of each row.

    Rows of one key come as often as they stand. Null fields give no row; empty
    ones are clean. The heading's line does not count for content. A fenced code
    block is content, the fence is Markdown. One pass, no shuffle.
    """
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("key"), F.col(content).alias("content"), F.col(heading).alias("heading"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for k, c, h in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for name, value in (("content", body_of(c, h)), ("heading", h)):
                    if value is not None:
                        text, kinds = clean(value)
                        for column, x in zip(out, (k, name, kinds, text)):
                            column.append(x)
            types = [batch.schema.field(0).type, pa.string(), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types)], ["key", "field", "markup", "cleaned"]
            )

    schema = f"key {kind}, field string, markup array<string>, cleaned string"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)

"""Noise in text from scanned pages: broken words, misread letters, page furniture.

Lines are judged first: page numbers by their form; running headers are lines at the
edge of a page, by its number or where they break a sentence, that their file repeats
(digits masked). A line that stands once is one only if it interrupts a filled
paragraph in the form of a title. Without those lines, words carried over a line end are joined; whether the
hyphen stays is decided by which form the corpus holds more often.

Misread letters are found in the corpus' own vocabulary. A word's anagram hash is the
sum of its characters' hashes, so exchanging a confusable pair moves it by a constant
that does not depend on the word. Rare words are joined in SQL to frequent ones at
that difference; what the join finds is checked letter by letter, and of several
corrections the most frequent word wins. CJK text has no word ends; its pairs of
neighbouring characters are the words here.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgework.llm.neardup import bit_filter
from sedgework.session import checkpointed

# What is read -> what stands on the page.
CONFUSABLE = (
    "c>e 5>s 1>i !>i †>t @>a ö>o 0>o 1>l ii>u li>h rn>m cl>d vv>w 9>g 6>b 8>b $>s "
    "末>未 峙>時 噐>器 郡>部 訂>記 険>検 童>量 液>夜 宂>完 カ>力 占>点 檟>標 囗>口 扳>板 菅>管 冉>再 簿>薄 囘>回 雷>電 閲>閥 己>已 曰>日"
)
PAIRS = tuple(tuple(p.split(">")) for p in CONFUSABLE.split())
CJK_PAIRS = tuple(p for p in PAIRS if ord(p[0][0]) > 0x2FFF)
LATIN_PAIRS = tuple(p for p in PAIRS if p not in CJK_PAIRS)
HYPHENS = "-\u2010\u2011\u00ac\u00ad"
#: A correction is at least this many times as frequent as the word it replaces.
RATIO, LEAST_FREQUENT = 4, 4

_FENCE = re.compile(r"^[ \t]*(`{3,}|~{3,})")
_PAGENO = re.compile(
    r"(?:[-–—·•~*=]{1,3}\s*\d{1,4}\s*[-–—·•~*=]{1,3}|[\[(<]\s*\d{1,4}\s*[\])>]|\d{1,4}\s*/\s*\d{1,4}|\d{1,4}"
    r"|(?:pages?|pag\.?|p\.|pp\.|seite|s\.|blatt|bl\.|feuille|folio|sheet|página)\s*\d{1,4}(?:\s*(?:of|von|de|sur|/)\s*\d{1,4})?"
    r"|\d{1,4}\s*(?:of|von|de|sur)\s*\d{1,4}|第\s*\d{1,4}\s*[頁页ページ]+(?:\s*[/／共]\s*\d{1,4}.{0,2})?|\d{1,4}\s*(?:頁|页|ページ))",
    re.I,
)
_MARKUP = re.compile(r"[ \t]*(?:[#|<>{}\\`$=!]|[-+*•][ \t]|\d{1,3}[.)][ \t]|'''|~~~|\[\[|\]\]|&\w+;)")
_ID = (
    r"Rev\.?\s*\d+(?:\.\d+)*|No\.?\s*\d+(?:\s*/\s*\d+)?|Nr\.?\s*\d+(?:/\d+)?|[A-Z]{1,4}-\d{2,6}|\d{4}-\d{2}-\d{2}"
    r"|\d{1,2}\.? [^\W\d_]{3,10} \d{4}|Sheet\s*\d+|Blatt\s*\d+|Seite\s*\d+|Page\s*\d+|Draft\b[^,–|]*|Entwurf|\d{1,4}|[^\W\d_]+-[^\W\d_]+"
)
_IDS = re.compile(rf"(?:{_ID})\)?\Z")
_PARTS = re.compile(r"\s{2,}|\s[–—|·•-]\s|,\s|\s?\((?=[^()]*\)\Z)")
_STOP = re.compile(r"[.!?。！？:;,，、；：]\W*\Z")
_BROKEN = re.compile(rf"(?<=[^\W\d_])[{HYPHENS}][ \t]*\r?\n[ \t]*(?=[^\W\d_])")
_WORD = re.compile(r"[@†$]?[A-Za-zÀ-ɏ0-9]+(?:[@!†$]+[A-Za-zÀ-ɏ0-9]+)*[@†$]?")
_COMPOUND = re.compile(r"[^\W\d_]+-[^\W\d_]+")
_SEAM = re.compile(rf"([^\W\d_]+)[{HYPHENS}][ \t]*\r?\n[ \t]*([^\W\d_]+)")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]+")
_HELD = re.compile("|".join(re.escape(x) for x, _ in PAIRS))
_PAIRED = re.compile(f"[{''.join(x + y for x, y in CJK_PAIRS)}]")
_JOINED = re.compile(r"[/\\_=#:.~]")
_NUMBERED = re.compile(r"-\d")


def masked(line: str) -> str:
    return re.sub(r"\d+", "9", " ".join(line.split()))


@dataclass
class Line:
    kind: str  # text, pageno, header, perhaps (a header if its file repeats it)
    text: str


def _shape(s: str) -> str:
    """``strong`` for a title with an identifying part, ``weak`` for a mere title, ``other`` for what may be one if repeated, else empty."""
    if len(s) < 3 or _STOP.search(s) or re.search(r"[.!?。]\s+\S*[^\W\d_]{2}", re.sub(r"\b(?:Rev|No|Nr)\.", "", s)):
        return ""
    parts = [p.strip() for p in _PARTS.split(s) if p.strip()]
    if len(parts) > 1 and any(_IDS.match(p) for p in parts):
        title = max((p for p in parts if not _IDS.match(p)), key=len, default="")
        if title[:1].isupper() or ord(title[:1] or "a") > 0x2FFF or parts[0].startswith("Draft"):
            return "strong"
    if len(parts) == 2 and re.search(r"\s{3,}|\s[–—|·]\s", s) and re.fullmatch(r"[^\W\d_]+", min(parts, key=len)):
        return "strong"
    first = s[0]
    if len(s) <= 64 and not re.search(r"\d", s) and (first.isupper() or ord(first) > 0x2FFF) and len(s.split()) <= 9 and not re.search(r"[。，、；：;]", s):
        return "weak"
    return "other"


def judge(text: str, heading: bool = False) -> list[Line]:
    """What each line of a text is. The first line is left alone when it is a heading's."""
    if "\n" not in text:
        return [Line("pageno" if _PAGENO.fullmatch(text.strip()) else "text", text)]
    lines = text.replace("\r\n", "\n").split("\n")
    stripped = [x.strip() for x in lines]
    out, mark = [Line("text", x) for x in lines], ""
    code = [False] * len(lines)
    for i, x in enumerate(lines):
        m = _FENCE.match(x)
        code[i] = bool(mark or m)
        if m and not mark:
            mark = m[1]
        elif m and m[1][0] == mark[0]:
            mark = ""
    for i, s in enumerate(stripped):
        if s and not code[i] and _PAGENO.fullmatch(s):
            out[i].kind = "pageno"
    flow = [i for i, s in enumerate(stripped) if out[i].kind != "pageno"]
    place = {i: k for k, i in enumerate(flow)}
    for i in flow:
        s = stripped[i]
        if not s or code[i] or (i == 0 and heading) or _MARKUP.match(s):
            continue
        shape = _shape(s)
        if not shape:
            continue
        k = place[i]
        before = stripped[flow[k - 1]] if k else ""
        after = stripped[flow[k + 1]] if k + 1 < len(flow) else ""
        if i and _MARKUP.match(before) or _MARKUP.match(after):
            before = "" if _MARKUP.match(before) else before
            after = "" if _MARKUP.match(after) else after
        beside = (i > 0 and out[i - 1].kind == "pageno") or (i + 1 < len(lines) and out[i + 1].kind == "pageno")
        inside = bool(before and after)
        # a filled paragraph breaks a line only where the next word has no room
        word = re.match(r"\S+", after)[0] if after else ""
        room = len(s) + 1 + (len(word) if ord(word[0]) < 0x2FFF else 1) <= 0.9 * max(len(before), len(after)) if inside else False
        broken = inside and not re.search(r"[.!?。！？][\"”’)」]*\Z", before)
        lower = bool(after) and (after[0].islower() or after[0].isdigit() or ord(after[0]) > 0x2FFF)
        capitals = s.upper() == s and s.lower() != s and not (before.upper() == before or after.upper() == after)
        if shape == "strong" and (broken or beside or (inside and room)):
            out[i].kind = "header"
        elif shape == "weak" and broken and room and (lower or capitals):
            out[i].kind = "header"
        elif inside or beside or before or after:
            edge = beside or (inside and (broken or shape != "other"))  # of a page: by its number or where it breaks a sentence
            out[i].kind = "perhaps" if shape == "strong" or edge else "text"
    return out


def flowing(lines: list[Line], also: frozenset[str] = frozenset()) -> str:
    """The text without page numbers and headers; ``also`` names masked lines that the file repeats."""
    return "\n".join(x.text for x in lines if x.kind == "text" or (x.kind == "perhaps" and masked(x.text) not in also))


def joined(text: str) -> str:
    return _BROKEN.sub("", text) if "\n" in text else text


def words_of(token: str) -> Iterator[str]:
    """Words of a lower-case token without blanks, unless they are part of a path, identifier or address.

    Of CJK text the pairs of neighbours that hold a character of a confusable pair;
    others can neither be misread nor be what was meant.
    """
    for m in _WORD.finditer(token):
        a, b = m.span()
        if b - a > 2 and not _NUMBERED.match(token, b) and not (a and _JOINED.match(token[a - 1])) and not (
            b + 1 < len(token) and _JOINED.match(token[b]) and token[b + 1].isalnum()
        ):
            yield m[0]
    if not token.isascii() and _PAIRED.search(token):
        for run in _CJK.finditer(token):
            chars = run[0]
            for i in {j for m in _PAIRED.finditer(chars) for j in (m.start() - 1, m.start())}:
                if 0 <= i < len(chars) - 1:
                    yield chars[i : i + 2]


def _anagram(c: str) -> F.Column:
    """Sum of the characters' hashes; each is under 2^50, so that a sum cannot overflow."""
    return F.expr(f"aggregate(split({c}, ''), 0L, (a, x) -> a + pmod(xxhash64(x), {1 << 50}))")


def _differences() -> dict[tuple[str, str], int]:
    def h(s: str) -> int:
        total = 0
        for c in s:
            v = xxhash.xxh64_intdigest(c.encode(), 42)
            total += (v - (1 << 64) if v >= 1 << 63 else v) % (1 << 50)
        return total

    return {(x, y): h(y) - h(x) for x, y in PAIRS}


def reaches(bad: str, good: str) -> bool:
    """Whether one or two exchanges of confusable pairs, at different places, turn ``bad`` into ``good``."""

    def step(w: str) -> Iterator[tuple[int, str]]:
        for x, y in PAIRS:
            i = w.find(x)
            while i >= 0:
                yield i, w[:i] + y + w[i + len(x) :]
                i = w.find(x, i + 1)

    for _, once in step(bad):
        if once == good or any(twice == good for _, twice in step(once)):
            return True
    return False


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf[[reaches(b, g) for b, g in zip(pdf["bad"], pdf["good"])]]


def corrections(words: DataFrame) -> DataFrame:
    """``bad, good``: rare words and the frequent ones they are misread from.

    The join is on the anagram hash: a rare word, moved by the difference of each
    confusable pair that it holds, or of two such pairs, meets the words of exactly
    that hash.
    """
    deltas = _differences()
    listed = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(d).alias("d")) for (x, _), d in deltas.items()))
    hashed = words.withColumn("h", _anagram("word"))
    held = F.filter(listed, lambda p: F.contains(F.col("word"), p["x"]))
    rare = hashed.select(F.col("word").alias("bad"), F.col("n").alias("few"), "h", held.alias("ps")).where("size(ps) > 0")
    rare = rare.where(~F.col("bad").rlike(r"^[0-9a-f]*[0-9][0-9a-f]*$|^[^0-9]?[0-9]+$"))
    once = F.transform("ps", lambda p: p["d"])
    repeated = "char_length(bad) - char_length(replace(bad, p.x, '')) >= 2 * char_length(p.x)"  # the same part at two places
    twice = F.expr(f"flatten(transform(ps, p -> transform(filter(ps, q -> q.x <> p.x or {repeated}), q -> p.d + q.d)))")
    moved = F.array_distinct(F.concat(once, twice))
    rare = rare.select("bad", "few", "h", F.explode(moved).alias("d")).select("bad", "few", (F.col("h") + F.col("d")).alias("h"))
    frequent = hashed.where((F.col("n") >= LEAST_FREQUENT) & F.col("word").rlike(r"^\p{L}+$")).select(F.col("word").alias("good"), F.col("n").alias("many"), "h")
    met = rare.join(frequent, "h").where((F.col("many") >= RATIO * F.col("few")) & (F.col("bad") != F.col("good")))
    met = met.select("bad", "good", "many").mapInPandas(_verified, "bad string, good string, many long")

    return met.groupBy("bad").agg(F.max(F.struct("many", "good")).alias("m")).select("bad", "m.good")


_TYPES = {"kind": pa.string(), "id": pa.string(), "what": pa.string(), "word": pa.string(), "file": pa.string(), "n": pa.int64(), "words": pa.list_(pa.string())}
_SCHEMA = "kind string, id string, what string, word string, file string, n long, words array<string>"


def _observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All that is seen of the records in one pass.

    Rows of a record: sure defects, joined words (``seam``), lines that are or may be
    headers with their line in the file (``line``), and its words that hold a part
    which may be misread (``words``). Rows of a task: counts of its words (``count``),
    combined before the shuffle and passed on whenever many tokens have gathered.
    """
    tokens: Counter[str] = Counter()
    known: dict[str, tuple[str, ...]] = {}
    out: dict[str, list] = {}

    def put(**row: object) -> None:
        for name in _TYPES:
            out[name].append(row.get(name))

    def batch_of() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(out[name], t) for name, t in _TYPES.items()], list(_TYPES))
        out.update({name: [] for name in _TYPES})
        return rows

    def count() -> None:
        counts: Counter[str] = Counter()
        for token, n in tokens.items():
            for w in words_of(token):
                counts[w] += n
            if "-" in token:
                for m in _COMPOUND.finditer(token):
                    counts[m[0]] += n
        tokens.clear()
        for w, n in counts.items():
            put(what="count", word=w, n=n)

    def may_be_misread(token: str) -> tuple[str, ...]:
        k = known.get(token)
        if k is None:
            if len(known) > 500_000:
                known.clear()
            k = known[token] = tuple(w for w in words_of(token) if _HELD.search(w))
        return k

    out.update({name: [] for name in _TYPES})
    for batch in batches:
        for kind, id_, file, start, text, heading in zip(*(batch.column(i).to_pylist() for i in range(6))):
            lines = judge(text, heading)
            kinds = {x.kind for x in lines}
            for what in kinds & {"pageno", "header"}:
                put(kind=kind, id=id_, what=what)
            if kinds & {"perhaps", "header"}:
                for i, x in enumerate(lines):
                    if x.kind in ("perhaps", "header"):
                        put(kind=kind, id=id_, what="line", word=masked(x.text), file=file, n=(start or 0) + i)
            flow = flowing(lines)
            if _BROKEN.search(flow):
                put(kind=kind, id=id_, what="hyphen")
                for m in _SEAM.finditer(flow):
                    put(kind=kind, id=id_, what="seam", word=f"{m[1]}-{m[2]}".lower())
                flow = joined(flow)
            own = flow.lower().split()
            tokens.update(own)
            if words := {w for token in set(own) for w in may_be_misread(token)}:
                put(kind=kind, id=id_, what="words", words=list(words))
            if len(tokens) > 200_000:
                count()
        yield batch_of()
    count()
    yield batch_of()


def observed(records: DataFrame) -> DataFrame:
    """What :func:`_observed` sees of all records with text and id, written once."""
    rows = records.where("text is not null and id is not null").select("kind", "id", "file", "line", "text", "heading")
    return checkpointed(rows.mapInArrow(_observed, _SCHEMA))


def vocabulary(seen: DataFrame) -> DataFrame:
    """``word, n`` over all records."""
    return seen.where("what = 'count'").groupBy("word").agg(F.sum("n").alias("n"))


def misread(seen: DataFrame, bad: DataFrame) -> DataFrame:
    """``kind, id, bad, good``: the words of each record that have a correction.

    Most words are sorted out by a bitmap over the bad ones before they are shuffled;
    if those are too many for one, all are joined.
    """
    rows = seen.where("what = 'words'").select("kind", "id", "words")
    marked = bit_filter(bad, "bad")
    if marked is not None:
        shared = rows.sparkSession.sparkContext.broadcast(marked)  # 2 MB at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            there = shared.value
            for batch in batches:
                words = batch.column(2)
                coded = pc.dictionary_encode(words.flatten())
                may = np.fromiter((w in there for w in coded.dictionary.to_pylist()), bool, len(coded.dictionary))
                keep = may[coded.indices.to_numpy(zero_copy_only=False)]
                owner = pc.list_parent_indices(words).to_numpy()[keep]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner)), words.flatten().filter(pa.array(keep))],
                    ["kind", "id", "bad"],
                )

        met = rows.mapInArrow(run, "kind string, id string, bad string")
    else:
        met = rows.select("kind", "id", F.explode("words").alias("bad"))
    return met.join(bad, "bad")


def repeated_lines(observed: DataFrame) -> DataFrame:
    """``file, word``: masked lines that stand at two places of their file or more.

    Places are line numbers of the file, so a section and its blocks count once.
    """
    lines = observed.where("what = 'line'").groupBy("file", "word").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    return lines.where("hi > lo").select("file", "word")


def _repeated_headers(seen: DataFrame) -> DataFrame:
    again = repeated_lines(seen)
    lines = seen.where("what = 'line'")
    return lines.join(again, lines.file.eqNullSafe(again.file) & (lines.word == again.word), "left_semi")


def defects(records: DataFrame) -> DataFrame:
    """``kind, id, defect`` of ``records(kind, id, file, line, text, heading)``, each once.

    ``hyphen``, ``chars``, ``header`` and ``pageno`` as above. ``heading`` (boolean)
    says that the first line is a heading's, ``line`` is the line number of the
    first line in the file. Null texts and ids have no defects, empty texts none,
    repeated rows count once; without a file's name lines repeat within the null file.
    """
    seen = observed(records)
    bad = checkpointed(corrections(checkpointed(vocabulary(seen))))
    sure = seen.where("what in ('pageno', 'header', 'hyphen')").select("kind", "id", F.col("what").alias("defect"))
    headers = _repeated_headers(seen).select("kind", "id", F.lit("header"))
    return sure.union(headers).union(misread(seen, bad).select("kind", "id", F.lit("chars"))).distinct()


def repaired(records: DataFrame) -> DataFrame:
    """``kind, id, repaired``: continuous paragraphs of the records that have a defect.

    Each record comes with what concerns it alone: the corrections of its own words
    and the repeated lines among its own. Paragraphs whose lines were broken by the
    page are joined; headings, lists, tables and code keep their lines. Records
    without a defect are not repeated here; of repeated rows one counts.
    """
    seen = observed(records)
    words = checkpointed(vocabulary(seen))
    bad = checkpointed(corrections(words))
    headers = _repeated_headers(seen)
    fixes = misread(seen, bad)
    seams = seen.where("what = 'seam'").select("kind", "id", "word").distinct()
    solid = words.select(F.col("word").alias("_solid"), F.col("n").alias("solid"))
    kept = (
        seams.join(words.withColumnRenamed("n", "parted"), "word")
        .join(solid, F.expr("replace(word, '-', '')") == F.col("_solid"), "left")
        .where("parted > coalesce(solid, 0)")
    )
    notes = (
        seen.where("what in ('pageno', 'header', 'hyphen')").select("kind", "id", F.lit("").alias("a"), F.lit("").alias("b"))
        .union(headers.select("kind", "id", F.lit("line"), "word"))
        .union(kept.select("kind", "id", F.lit("seam"), "word"))
        .union(fixes.select("kind", "id", F.concat(F.lit("word:"), "bad"), "good"))
        .groupBy("kind", "id")
        .agg(F.collect_set(F.struct("a", "b")).alias("notes"))
    )
    split = records.where("text is not null").join(notes, ["kind", "id"]).groupBy("kind", "id").agg(
        F.min(F.struct("text", "heading", "notes")).alias("r")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, heading, ns in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                also, kept = (frozenset(n["b"] for n in ns if n["a"] == a) for a in ("line", "seam"))
                fixes = {n["a"][5:]: n["b"] for n in ns if n["a"].startswith("word:")}
                out.append(repair(text, heading, also, kept, fixes))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["kind", "id", "repaired"])

    return split.select("kind", "id", "r.text", "r.heading", "r.notes").mapInArrow(run, "kind string, id string, repaired string")


def repair(text: str, heading: bool, also: frozenset[str], kept: frozenset[str], fixes: dict[str, str]) -> str:
    """One record's text: ``also`` are its repeated lines, ``kept`` the words that keep their hyphen, ``fixes`` its misread words."""
    flow = flowing(judge(text, heading), also)
    flow = _SEAM.sub(lambda m: m[1] + "-" * (f"{m[1]}-{m[2]}".lower() in kept) + m[2], flow)

    def fix(m: re.Match) -> str:
        good = fixes.get(m[0].lower())
        if good is None:
            return m[0]
        return good.upper() if m[0].isupper() else good.capitalize() if m[0][:1].isupper() else good

    flow = _WORD.sub(fix, flow)
    for b, g in fixes.items():
        if ord(b[0]) > 0x2FFF or ord(b[-1]) > 0x2FFF:
            flow = flow.replace(b, g)
    return reflow(flow)


def reflow(text: str) -> str:
    """Lines of a paragraph joined; headings, list items, table rows and code stay as they are."""
    out: list[str] = []
    mark, open_ = "", False
    for line in text.split("\n"):
        m = _FENCE.match(line)
        if mark or m:
            out.append(line)
            mark = "" if mark and m and m[1][0] == mark[0] else mark or (m[1] if m else "")
            open_ = False
        elif not line.strip() or _MARKUP.match(line):
            out.append(line.rstrip())
            open_ = bool(line.strip()) and bool(re.match(r"[ \t]*(?:[-+*•][ \t]|\d{1,3}[.)][ \t])", line))
        elif open_:
            last = out[-1]
            gap = "" if ord(last[-1]) > 0x2FFF and ord(line.strip()[0]) > 0x2FFF else " "
            out[-1] = last + gap + " ".join(line.split())
        else:
            out.append(" ".join(line.split()))
            open_ = True
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip("\n")

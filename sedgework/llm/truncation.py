"""Texts cut off by field limits or in transfer.

Two kinds of evidence. Near copies: documents that share five-word shingles are found
by min-hash banding, verified by how much of the shorter one stands in the longer, and
aligned; a copy that ends where the other goes on in the same sentence was cut there.
Terminality: other texts are scored by how they close. Open fenced code, table rows,
brackets, quotations and links, and marks that stand for lost text, are cuts. Any
other ending is a unit of what kind of line it is in and which mark or word it closes
with. How often such units end a paragraph, and how often they only stand inside one,
is counted over the whole corpus; a text that closes with a unit that hardly ever
ends anything was cut. A label or signature without a mark is scored by its closing
words, which end something if different documents close with them.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgework.llm import fingerprints as fp
from sedgework.llm.neardup import meeting, where_may_contain
from sedgework.session import checkpointed

SHINGLE_WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 16, 3
#: A unit ends something if this part of its places, counted with a prior of so many, are ends.
LEAST_TERMINALITY, PRIOR = 0.02, 50
SALTS = 16

# Marks that close a sentence, the pairs that enclose, the marks for lost text.
STOPS = ".!?。！？．｡؟।"
PAIRS = ("()", "[]", "{}", "（）", "［］", "【】", "「」", "『』", "“”", "«»", "《》", "〈〉")
CLOSERS = "\"'”’»)]}）］】」』》〉*_`"
LOST = "…�"

_FENCE = re.compile(r"^[ \t]*(`{3,}|~{3,})[^\n]*$", re.M)
_ITEM = re.compile(r"[ \t]*(?:[-+*•・]|\d{1,3}[.)])[ \t]+\S")
_HEAD = re.compile(r"[ \t]*#{1,6}[ \t]+\S")
_PATH = re.compile(r"(?:\w+:/)?/?[\w.~-]+(?:/[\w.~-]+)+\.[A-Za-z]{1,9}$")
_LABEL = re.compile(r"[^\W\d_][\w ]{0,23}[:：][ \t]*\S")
_IGNORED = re.compile(r"[\s\u200b-\u200f\u2028-\u202e\u2060-\u2064\ufeff\u00ad]+$")
_SENTENCES = re.compile(r"[^\W\d_]{2}[.!?]\s|[。！？]")
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")


def _open_fence(text: str) -> bool:
    mark = ""
    for m in _FENCE.finditer(text):
        if not mark:
            mark = m[1]
        elif m[1][0] == mark[0] and len(m[1]) >= len(mark) and m[0].strip() == m[1]:
            mark = ""
    return bool(mark)


def _unclosed(paragraph: str) -> bool:
    for a, b in PAIRS:
        if paragraph.count(a) > paragraph.count(b):
            return True
    bare = re.sub(r"(?<=\d)\"", "", paragraph)  # inches
    return bare.count('"') % 2 == 1 or paragraph.count("`") % 2 == 1


def line_kind(line: str) -> str:
    """What kind a line is; one that holds a whole sentence before its last words is plain, as these are a sentence, too."""
    start = line.lstrip()[:1]
    if _HEAD.match(line):
        return "heading"
    last = line.rsplit(None, 1)[-1] if line.strip() else ""
    if "/" in last and _PATH.search(last):
        return "path"
    if _SENTENCES.search(line):
        return "plain"
    if _ITEM.match(line):
        return "item"
    if len(line.strip()) > 2 and start == line.rstrip()[-1:] and start in "—–-=*_~":
        return "framed"
    if _LABEL.match(line) or (start and start in "—–"):
        return "label"
    return "plain"


def mark_of(token: str) -> str:
    """What a token closes with: a stop, also one before closing marks, another mark or symbol, or ``w`` for anything else."""
    end = token[-1]
    if end in CLOSERS and (bare := token.rstrip(CLOSERS)) and bare[-1] in STOPS:
        end = bare[-1]
    return end if unicodedata.category(end)[0] in "PS" else "w"


def ending(text: str | None) -> tuple[str, str | None]:
    """``(state, what)``: ``blank``, ``whole`` or ``cut`` by structure; ``unit`` with the unit, ``words`` with the closing words.

    Digits of closing words are masked.
    """
    text = _IGNORED.sub("", text or "")
    if not text.strip():
        return "blank", None
    if _open_fence(text):
        return "cut", None
    last = text[text.rfind("\n") + 1 :]
    if last.lstrip().startswith(("```", "~~~")):
        return "whole", None
    paragraph = _PARAGRAPH.split(text)[-1]
    if last.lstrip().startswith("|"):
        rows = [r for r in paragraph.split("\n") if r.lstrip().startswith("|")]
        whole = last.rstrip().endswith("|") and len(last.strip()) > 1 and last.count("|") >= rows[0].count("|")
        return ("whole" if whole else "cut"), None
    if text[-1] in LOST or text.endswith(("...", "．．．", "。。。")) or _unclosed(paragraph):
        return "cut", None
    kind, mark = line_kind(last), mark_of(last.split()[-1])
    if kind == "label" and mark not in STOPS:
        if "\n" in text:
            words = re.sub(r"\d+", "9", last.strip()).split()
            return "words", " ".join(words[-2:])
        kind = "plain"
    return "unit", f"{kind} {mark}"


def prior(unit: Column) -> Column:
    """What holds of a unit as long as nothing is known of it: 1 for stops, items, headings, paths and framed lines, else 0."""
    parts = F.split(unit, " ")
    return (parts[1].isin(*STOPS) | parts[0].isin("item", "heading", "path", "framed")).cast("double")


def units(text: str) -> Iterator[tuple[str, int, int]]:
    """``unit, ends, inside`` of the paragraphs before the last, whose ends are their own."""
    paragraphs = _PARAGRAPH.split(text)
    for paragraph in paragraphs[:-1]:
        lines = [x for x in paragraph.split("\n") if x.strip()]
        for i, line in enumerate(lines):
            kind, tokens = line_kind(line), line.split()
            counts = Counter(map(mark_of, tokens))
            if i + 1 == len(lines):
                last = mark_of(tokens[-1])
                counts[last] -= 1
                yield f"{kind} {last}", 1, 0
            for mark, n in counts.items():
                if n:
                    yield f"{kind} {mark}", 0, n


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per text; ``bands`` only with the first text of a class in the task. Counts of units come in rows of their own."""
    seen: set[int] = set()
    ends: Counter[str] = Counter()
    inside: Counter[str] = Counter()
    key_type = None
    for batch in batches:
        ids, sources, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
        key_type = ids.type
        states = [ending(t) for t in texts]
        classes = [None if s == "blank" else class_of(t) for t, (s, _) in zip(texts, states)]
        fresh = []
        for i, c in enumerate(classes):
            if c is not None and c not in seen:
                seen.add(c)
                fresh.append(i)
                for unit, e, n in units(texts[i]):
                    ends[unit] += e
                    inside[unit] += n
        bands: list[list[int] | None] = [None] * len(texts)
        weights = fp.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))
        for a, b in fp.blocks([len(texts[i]) for i in fresh]):
            part = fresh[a:b]
            hashes, owner = fp.word_shingles([texts[i] for i in part], SHINGLE_WORDS)
            minima = fp.bin_minima(hashes, owner, len(part), 16, BANDS * ROWS // 16).astype(np.uint64)
            keys = fp.mix((fp.mix(minima + np.uint64(1)) * weights).reshape(-1, BANDS, ROWS).sum(axis=2)).view(np.int64)
            for i, row in zip(part, keys.tolist()):
                bands[i] = row
        yield _rows(
            ids,
            sources,
            pa.array(np.array([c or 0 for c in classes], np.uint64).view(np.int64), mask=np.array([c is None for c in classes], bool)),
            [s for s, _ in states],
            [w for _, w in states],
            [len(t) if t else 0 for t in texts],
            bands,
        )
    if key_type is not None:
        names = list(ends | inside)
        n = len(names)
        counts = [[ends[u], inside[u]] for u in names]
        yield _rows(pa.nulls(n, key_type), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), ["count"] * n, names, [0] * n, counts)


def _rows(ids: pa.Array, sources: pa.Array, classes: pa.Array, states: list, what: list, chars: list, bands: list) -> pa.RecordBatch:
    columns = [ids, sources, classes, pa.array(states, pa.string()), pa.array(what, pa.string()), pa.array(chars, pa.int32()), pa.array(bands, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, ["key", "source", "class", "state", "what", "chars", "bands"])


def class_of(text: str) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(text.split()))


def _signatures(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text"))
    return rows.mapInArrow(
        _signed,
        f"key {kind}, source string, class long, state string, what string, chars int, bands array<long>",
    )


def _alignment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each pair that is verified, the class whose alignment ends early, if one does."""
    for batch in batches:
        out: list[int] = []
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for ca, cb, x, y in zip(a, b, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            early = ends_early(x, y)
            if early:
                out.append(ca if early < 0 else cb)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["class"])


def ends_early(x: str, y: str) -> int:
    """-1 if ``x`` ends inside a sentence of ``y``, 1 if ``y`` does inside one of ``x``, else 0; only for verified near copies.

    Verified: at least ``SIMILARITY`` of the distinct five-word shingles of the shorter
    one stand in the longer, so a copy may be cut to any part of the other. Aligned:
    the last words of the shorter, the final one perhaps cut short, stand in the
    longer at about the same place. It ends early if its final word is cut short
    there, or if the longer one goes on before the sentence is closed, or closes it
    with a mark that the shorter lacks.
    """
    wx, wy = fp.words(x), fp.words(y)
    sign = -1 if len(wx) < len(wy) or (len(wx) == len(wy) and len(x) < len(y)) else 1
    short, long_ = (wx, wy) if sign < 0 else (wy, wx)
    if not short:
        return 0
    s, t = ({tuple(w[i : i + SHINGLE_WORDS]) for i in range(max(1, len(w) - SHINGLE_WORDS + 1))} for w in (short, long_))
    final_cut = tuple(short[-SHINGLE_WORDS:]) not in t
    if len(s & t) + final_cut < SIMILARITY * len(s):
        return 0
    tail, final = short[-SHINGLE_WORDS:-1], short[-1]
    wanted, k = len(short) - 1, len(tail)
    at = [i + k for i in range(len(long_) - k) if long_[i : i + k] == tail and long_[i + k].startswith(final)]
    place = min((i for i in at if i >= 0.8 * wanted), key=lambda i: abs(i - wanted), default=None)
    if place is None:
        return 0
    own, other = (y, x) if sign > 0 else (x, y)
    stopped = any(c in STOPS for c in own[fp.spans(own)[-1][1] :])
    if long_[place] != final:
        return 0 if stopped else sign
    if place + 1 == len(long_):
        return 0
    there = fp.spans(other)
    after = other[there[place][1] : there[place + 1][0]]
    stops = any(c in STOPS for c in after)
    return 0 if (stops and stopped) or (not stops and _PARAGRAPH.search(after)) else sign


def _own_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = np.array([class_of(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        yield batch.filter(pa.array(own == batch.column(0).to_numpy()))


def _cut_copies(df: DataFrame, signs: DataFrame, key: str, text: str) -> DataFrame:
    """Classes whose alignment with a near copy ends early.

    Bands are joined on their key between classes, of which copies are one: a group
    of copies is a single row a task. Of texts only those of candidates, and a few
    more that a bitmap lets pass, are shuffled; each is one of its class.
    """
    rows = signs.where("class is not null and bands is not null").select(F.explode("bands").alias("key"), "class")
    pairs = checkpointed(meeting(rows))
    ends = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    wanted = signs.where("class is not null").select("class", "key").join(ends, "class", "left_semi").groupBy("class").agg(F.min("key").alias("key"))
    wanted = checkpointed(wanted.select("class", F.col("key").cast("string").alias("key")))
    texts = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where("key is not null and text is not null")
    texts = where_may_contain(texts, "key", wanted.select("key")).join(wanted, "key").select("class", "text")
    texts = texts.mapInArrow(_own_class, "class long, text string").groupBy("class").agg(F.max("text").alias("text"))
    sides = pairs.join(texts.select(F.col("class").alias("a"), F.col("text").alias("x")), "a")
    sides = sides.join(texts.select(F.col("class").alias("b"), F.col("text").alias("y")), "b")
    return sides.select("a", "b", "x", "y").mapInArrow(_alignment, "class long").distinct()


def terminality(signs: DataFrame) -> DataFrame:
    """``unit, terminality``: the part of a unit's places that are ends. A row for each kind of line and mark of the Unicode standard at most."""
    counted = signs.where("state = 'count'").groupBy(F.col("what").alias("unit")).agg(
        F.sum(F.col("bands")[0]).alias("ends"), F.sum(F.col("bands")[1]).alias("inside")
    )
    share = (F.col("ends") + PRIOR * prior(F.col("unit"))) / (F.col("ends") + F.col("inside") + PRIOR)
    return counted.select("unit", share.alias("terminality"))


def _looked_up(rows: DataFrame, few: DataFrame, on: str) -> DataFrame:
    """A left join with rows that are few and one for each key; rows of a hot key are dealt over ``SALTS`` tasks."""
    dealt = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    copied = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copied, [on, "_salt"], "left").drop("_salt")


def judged(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``key, source, chars, truncated``: one row per row of ``df``.

    A text is truncated if its alignment with a near copy ends early, else if a
    structure is open, else if the terminality of its ending is too low. One that
    stops between sentences is not truncated, even if a copy goes on. Null, empty
    and blank texts are not. Copies are judged alike. Other columns are not read; a
    null source stays null.
    """
    signs = checkpointed(_signatures(df, key, source, text))
    usual = signs.where("state = 'words'").select("what", "class").distinct().groupBy("what").agg(F.count("*").alias("n")).where("n > 1")
    usual = usual.select("what", F.lit(True).alias("usual"))
    copies = _cut_copies(df, signs, key, text).select("class", F.lit(True).alias("early"))
    rows = signs.where("state <> 'count'").drop("bands")
    scores = terminality(signs)
    rows = rows.join(F.broadcast(scores), (rows.state == "unit") & (rows.what == scores.unit), "left")  # kinds of lines x marks
    # most rows have no closing words and some no class: their keys are made their own, so that they do not meet in one task
    own = F.concat(F.lit("\0"), F.col("key").cast("string"), F.lit(" "), F.monotonically_increasing_id().cast("string"))
    words = F.when(F.col("state") == "words", F.col("what")).otherwise(own)
    rows = rows.withColumns({"words": words, "class": F.coalesce("class", F.xxhash64(own))})
    rows = _looked_up(_looked_up(rows, usual.withColumnRenamed("what", "words"), "words"), copies, "class")
    low = F.coalesce("terminality", prior(F.col("what"))) < LEAST_TERMINALITY
    unusual = (F.col("state") == "words") & F.col("usual").isNull()
    cut = F.col("early").isNotNull() | (F.col("state") == "cut") | unusual | ((F.col("state") == "unit") & low)
    return rows.select(F.col("key").alias(key), F.col("source").alias(source), "chars", cut.alias("truncated"))


def rates(judgements: DataFrame, source: str = "source") -> DataFrame:
    """``source, documents, truncated, rate, usual_length``: how often each source truncates.

    ``usual_length`` is the length at which most of its truncated texts end, if at
    least two do at the same: the source's field limit. Of lengths alike in number
    the least counts.
    """
    own = judgements.groupBy(source).agg(F.count("*").alias("documents"), F.count_if("truncated").alias("truncated"))
    lengths = judgements.where("truncated").groupBy(source, "chars").agg(F.count("*").alias("n")).where("n > 1")
    usual = lengths.groupBy(F.col(source).alias("_s")).agg(F.max(F.struct("n", (-F.col("chars")).alias("c"))).alias("m"))
    joined = own.join(usual, own[source].eqNullSafe(F.col("_s")), "left")
    return joined.select(
        source, "documents", "truncated", (F.col("truncated") / F.col("documents")).alias("rate"), (-F.col("m.c")).alias("usual_length")
    )

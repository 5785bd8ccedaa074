"""Several values packed in one field: one row per value, with its position.

A field is a lattice. Its pieces stand between marks that may part values; quoted
spans are atomic. Each mark may part or belong to a value, so that an edge of the
lattice is one piece or a stretch of pieces. What an edge costs is learned from the
whole column by expectation maximisation:

* a value that the column knows costs its frequency; at first these are the pieces,
  quoted ones with the marks inside them;
* a stretch that the column does not know is spelled, at a cost per character;
* each kind of mark has a rate at which it parts, one half at first.

Each round shares every field among its segmentations in proportion to their
likelihood and counts values and partings anew. The Viterbi path of the last round
gives the values. Blanks, and slashes without blanks, are no marks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgework.session import checkpointed

# The marks that part values, and the pairs of marks that enclose one.
DELIMITERS = ",;|\t\n\r、，；"
QUOTES = {'"': '"', "'": "'", "“": "”", "„": "“", "‘": "’", "「": "」", "『": "』", "«": "»"}

_BLANK = " \t\n\r\u00a0\u2002\u2003\u2009\u202f\u3000\ufeff"
#: Spelling: each character of a stretch that the column does not know is one of 64.
SPELLING = -math.log(64)
#: Values with more than this part of all values are joined by broadcast; there are fewer than 1,000.
HOT_PART = 1000
_NEVER = -math.inf


def _closing(text: str, start: int) -> int:
    """Index after the span quoted from ``start``, or -1 if no closing mark ends a value."""
    close, i = QUOTES[text[start]], start + 1
    while (i := text.find(close, i)) >= 0:
        if text[i + 1 : i + 2] == close:
            i += 2
            continue
        rest = text[i + 1 :].lstrip(" \u00a0\u3000")
        if not rest or rest[0] in DELIMITERS or (rest[0] == "/" and (len(rest) < 2 or rest[1] in _BLANK)):
            return i + 1
        i += 1
    return -1


def pieces(text: str) -> tuple[list[str], str]:
    """The smallest pieces of a field, and the marks between them, one character each."""
    out, marks, begin, i, n = [], [], 0, 0, len(text)
    fresh = True  # nothing but blanks since the last mark
    while i < n:
        c = text[i]
        if fresh and c in QUOTES and (end := _closing(text, i)) > 0:
            i, fresh = end, False
            continue
        slash = c == "/" and (i == 0 or text[i - 1] in _BLANK) and (i + 1 == n or text[i + 1] in _BLANK)
        if c in DELIMITERS or slash:
            out.append(text[begin:i])
            marks.append(c)
            begin, fresh = i + 1, True
        elif c not in _BLANK:
            fresh = False
        i += 1
    out.append(text[begin:])
    return out, "".join(marks)


def bare(value: str) -> str:
    """A value trimmed and freed of enclosing quotes; doubled quotes inside become single."""
    value = value.strip(_BLANK)
    if len(value) > 1 and QUOTES.get(value[0]) == value[-1]:
        close = value[-1]
        value = value[1:-1].replace(close * 2, close).strip(_BLANK)
    return value


def stretch(parts: list[str], marks: str, a: int, b: int) -> str:
    """The pieces from ``a`` to before ``b`` with the marks between them, as they stand."""
    return parts[a] + "".join(marks[i - 1] + parts[i] for i in range(a + 1, b))


def _log_sum(*xs: float) -> float:
    top = max(xs)
    return top if top == _NEVER else top + math.log(sum(math.exp(x - top) for x in xs))


class Lattice:
    """One field: its edges, the likelihood of its segmentations, and the best one.

    Positions are the ends of pieces. Values that the column knows are edges of their
    own; unknown stretches of two pieces or more are spelled piece by piece, so their
    number does not matter and a field costs its pieces times ``reach``.
    """

    def __init__(self, parts: list[str], marks: str, known: dict[str, float], total: float, rates: dict[str, float], reach: int):
        self.parts, self.marks, self.n = parts, marks, len(parts)
        self.parted = [0.0, *(math.log(rates.get(m, 0.5)) for m in marks), 0.0]
        self.inside = [0.0, *(math.log(1 - rates.get(m, 0.5)) for m in marks), 0.0]
        self.new = -math.log(total + 1)
        self.spelled = [SPELLING * len(p.strip(_BLANK)) for p in parts]
        self.edges: list[list[tuple[int, float, str]]] = [[] for _ in range(self.n + 1)]  # by end
        for b in range(1, self.n + 1):
            kept = 0.0
            for a in range(b - 1, max(-1, b - reach - 2), -1):
                value = bare(stretch(parts, marks, a, b))
                n = known.get(value, 0.0)
                if b - a == 1:  # an empty piece is no value and costs nothing
                    cost = 0.0 if not value else math.log(n) + self.new if n > 0 else self.new + self.spelled[a]
                    self.edges[b].append((a, cost, value))
                elif n > 0:
                    self.edges[b].append((a, math.log(n) + self.new + kept, value))
                kept += self.inside[a]

    def _more(self, b: int) -> float:
        """A spelled stretch takes in piece ``b``."""
        return self.inside[b] + SPELLING + self.spelled[b]

    def expected(self) -> tuple[dict[str, float], list[float]]:
        """Expected count of each known value, and of a parting at each mark."""
        n = self.n
        ahead, one, more = [0.0] + [_NEVER] * n, [_NEVER] * (n + 1), [_NEVER] * (n + 1)
        for b in range(1, n + 1):
            one[b] = ahead[b - 1] + self.new + self.spelled[b - 1]
            more[b] = _log_sum(one[b - 1], more[b - 1]) + self._more(b - 1) if b > 1 else _NEVER
            ahead[b] = _log_sum(more[b], *(ahead[a] + cost for a, cost, _ in self.edges[b])) + self.parted[b]
        behind, last, run = [_NEVER] * n + [0.0], [_NEVER] * (n + 2), [_NEVER] * (n + 2)
        out: dict[str, float] = {}
        for b in range(n, 0, -1):  # behind[b] is complete: all its edges end later
            closed = self.parted[b] + behind[b]
            grown = self._more(b) + run[b + 1] if b < n else _NEVER
            run[b], last[b] = _log_sum(closed, grown), grown
            for a, cost, value in self.edges[b]:
                behind[a] = _log_sum(behind[a], cost + closed)
                if value and (share := ahead[a] + cost + closed - ahead[n]) > -60:
                    out[value] = out.get(value, 0.0) + math.exp(share)
            behind[b - 1] = _log_sum(behind[b - 1], self.new + self.spelled[b - 1] + last[b])
        return out, [math.exp(min(0.0, ahead[b] + behind[b] - ahead[n])) for b in range(1, n)]

    def best(self) -> list[str]:
        """Values of the Viterbi path, without empty ones; ties keep the parting."""
        n = self.n
        score, back = [0.0] + [_NEVER] * n, [0] * (n + 1)
        one = more = (_NEVER, 0)
        for b in range(1, n + 1):
            longer = max(one, more)
            more = (longer[0] + self._more(b - 1), longer[1]) if b > 1 else (_NEVER, 0)
            one = (score[b - 1] + self.new + self.spelled[b - 1], b - 1)
            for a, cost, _ in self.edges[b]:
                if score[a] + cost > score[b]:
                    score[b], back[b] = score[a] + cost, a
            if more[0] > score[b]:
                score[b], back[b] = more
            score[b] += self.parted[b]
        out, b = [], n
        while b:
            out.append(bare(stretch(self.parts, self.marks, back[b], b)))
            b = back[b]
        return [v for v in reversed(out) if v]


def _lexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces and marks of each field, the bare pieces, and the most marks inside one of them."""
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for text in batch.column(1).to_pylist():
            parts, marks = pieces(text)
            values = [v for p in parts if (v := bare(p))]
            most = max((len(pieces(v)[1]) for v in values), default=0)
            for column, x in zip(out, (parts, marks, values, most)):
                column.append(x)
        strings = pa.list_(pa.string())
        types = [strings, pa.string(), strings, pa.int32()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, t) for c, t in zip(out, types))], ["key", "parts", "marks", "values", "most"]
        )


def split_values(df: DataFrame, key: str, packed: str, rounds: int = 2) -> DataFrame:
    """``key, pos, value`` with ``pos`` (int) from 1 in order.

    Null, blank and delimiter-only fields give no rows, empty values take no
    position, repeated values stay. ``key`` has to be unique and not null in ``df``;
    rows with a null key are left out. A quote that is not closed before a mark or
    the end is an ordinary character, as is an apostrophe inside a value. Every
    field with a mark goes through the lattice; values are joined, never collected,
    and the rates of the marks, a row for each of at most ten, are fixed when the
    operator is called.
    """
    source = df.where(F.col(packed).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(packed).alias("packed"))
    source = source.where(F.length(F.trim("packed")) > 0)
    kind = dict(source.dtypes)["key"]
    schema = f"key {kind}, parts array<string>, marks string, values array<string>, most int"
    fields = checkpointed(source.mapInArrow(_lexed, schema))
    open_ = fields.where("marks <> ''")
    decided = _decided(fields, open_, rounds, kind)
    values = fields.where("marks = ''").select("key", "values").unionByName(decided)
    return values.select(F.col("key").alias(key), F.posexplode("values").alias("p", "value")).select(
        key, (F.col("p") + 1).cast("int").alias("pos"), "value"
    )


def _decided(fields: DataFrame, open_: DataFrame, rounds: int, kind: str) -> DataFrame:
    """``key, values`` of the fields with marks, by the Viterbi path after ``rounds`` rounds."""
    reach = fields.agg(F.max("most")).first()[0] or 0  # no known value spans more marks

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            values = [
                list({bare(stretch(p, m, a, b)) for a in range(len(p)) for b in range(a + 1, min(len(p), a + reach + 1) + 1)} - {""})
                for p, m in rows
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.string()))], ["key", "values"])

    listed = open_.select("key", "parts", "marks").mapInArrow(spans, f"key {kind}, values array<string>")
    edges = checkpointed(listed.select("key", F.explode("values").alias("value")))
    sure = fields.where("marks = ''").select(F.explode("values").alias("value")).groupBy("value").agg(F.count("*").cast("double").alias("n"))
    counts = fields.select(F.explode("values").alias("value")).groupBy("value").agg(F.count("*").cast("double").alias("n"))
    rates: dict[str, float] = {}

    def weighed(counts: DataFrame) -> tuple[DataFrame, float]:
        """Each open field with the frequencies of its edges, and the total of all."""
        counts = checkpointed(counts)
        total = counts.agg(F.sum("n")).first()[0] or 0.0
        hot = counts.where(F.col("n") > total / HOT_PART)  # fewer than HOT_PART rows
        met = edges.join(F.broadcast(hot), "value").unionByName(
            edges.join(F.broadcast(hot.select("value")), "value", "left_anti").join(counts, "value")
        )
        known = met.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("value", "n"))).alias("known"))
        return open_.select("key", "parts", "marks").join(known, "key", "left"), total

    def lattices(batch: pa.RecordBatch, total: float, rates: dict[str, float]) -> Iterator[Lattice]:
        for parts, marks, known in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            yield Lattice(parts, marks, dict(known or ()), total, rates, reach)

    def expect(total: float, rates: dict[str, float]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values: dict[str, float] = {}
                parted: dict[str, list[float]] = {}
                for lattice in lattices(batch, total, rates):
                    own, partings = lattice.expected()
                    for v, n in own.items():
                        values[v] = values.get(v, 0.0) + n
                    for m, p in zip(lattice.marks, partings):
                        sums = parted.setdefault(m, [0.0, 0.0])
                        sums[0] += p
                        sums[1] += 1
                rows = [("value", v, n, 0.0) for v, n in values.items()] + [("mark", m, p, n) for m, (p, n) in parted.items()]
                columns = list(zip(*rows)) or [(), (), (), ()]
                types = [pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["what", "value", "n", "of"])

        return run

    def decide(total: float, rates: dict[str, float]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = [x.best() for x in lattices(batch, total, rates)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.string()))], ["key", "values"])

        return run

    for _ in range(rounds):
        rows, total = weighed(counts)
        seen = checkpointed(rows.mapInArrow(expect(total, dict(rates)), "what string, value string, n double, of double"))
        marks = seen.where("what = 'mark'").groupBy("value").agg(F.sum("n").alias("n"), F.sum("of").alias("of"))
        rates = {r["value"]: (r["n"] + 0.5) / (r["of"] + 1) for r in marks.collect()}  # a row for each kind of mark
        counts = sure.unionByName(seen.where("what = 'value'").select("value", "n")).groupBy("value").agg(F.sum("n").alias("n"))
    rows, total = weighed(counts)
    return rows.mapInArrow(decide(total, rates), f"key {kind}, values array<string>")

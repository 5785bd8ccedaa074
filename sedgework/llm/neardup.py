"""Near-duplicate records with small edits, by multi-index hashing.

Two records are near copies if they share at least ``THRESHOLD`` of their distinct
5-character substrings. A record's fingerprint is a row of 192 symbols, each the least
hash of its substrings in one bin; the distance of two fingerprints is the number of
symbols that differ in their lowest bit. The indexed part of the fingerprint is cut
into segments of ``SEGMENT`` symbols. The Hamming ball of radius 1 around a segment is
enumerated by leaving out each symbol in turn; records that agree on one of these keys
differ in at most one symbol of the segment and are fetched by a join on the key. By
the pigeonhole principle no pair can be missed that differs in fewer than
``2 * SEGMENTS`` of the indexed symbols. The key's rows carry the fingerprint's bits,
so that the complete distance is tested inside that join and pairs that merely share
phrases are never written. What remains is verified on the texts.

Copies are one class from the start: the normalised text's hash stands for all of
them, so a group of copies costs one key row per task, not its square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgework.llm import fingerprints as fp
from sedgework.session import checkpointed

LEAST_CHARS, SHINGLE, THRESHOLD = 240, 5, 0.6
SEGMENTS, SEGMENT = 12, 4
BINS, FUNCTIONS = 32, 6
#: Of 192 bits, a pair at the threshold is expected to differ in 38.4; 54 is 2.8 deviations more.
MOST_BITS = 54
SKETCH = tuple(f"s{i + 1}" for i in range(BINS * FUNCTIONS // 64))
#: Keys of more records than this are joined in salted parts. Counts are kept in so many cells.
HOT_RECORDS, HOT_CELLS = 1 << 14, 1 << 16


_LONGS = ", ".join(f"{s} long" for s in SKETCH)


def normalised(text: str) -> str:
    """Runs of white space made one blank, ends trimmed, lower case."""
    return " ".join(text.split()).lower()


def class_of(kind: str, normal: str) -> int:
    return xxhash.xxh3_64_intdigest(kind + "\n" + normal)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per record of enough characters; symbols only with the first record of a class in the task."""
    seen: set[int] = set()
    for batch in batches:
        kinds, ids, texts = (batch.column(i).to_pylist() for i in range(3))
        for a, b in fp.blocks([len(t or "") for t in texts]):
            yield _block(kinds[a:b], ids[a:b], texts[a:b], seen)


def _block(kinds: list[str], ids: list[str], texts: list[str | None], seen: set[int]) -> pa.RecordBatch:
    rows, fresh = [], []
    for kind, id_, text in zip(kinds, ids, texts):
        if text is None or len(text) < LEAST_CHARS or len(t := normalised(text)) < LEAST_CHARS:
            continue
        h = class_of(kind, t)
        first = h not in seen
        if first:
            seen.add(h)
            fresh.append(t)
        rows.append((kind, id_, h, first))
    new = np.array([r[3] for r in rows], bool)
    symbols: list[bytes | None] = [None] * len(rows)
    sketches = np.zeros((len(rows), len(SKETCH)), np.int64)
    if fresh:
        hashes, owner = fp.char_shingles(fresh, SHINGLE)
        minima = fp.bin_minima(hashes, owner, len(fresh), BINS, FUNCTIONS)
        sketches[new] = fp.pack_bits(minima)
        own = np.ascontiguousarray(minima[:, : SEGMENTS * SEGMENT])
        for i, row in zip(np.flatnonzero(new), own):
            symbols[i] = row.tobytes()
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.string()),
            pa.array([r[1] for r in rows], pa.string()),
            pa.array(np.array([r[2] for r in rows], np.uint64).view(np.int64)),
            *(pa.array(sketches[:, i]) for i in range(len(SKETCH))),
            pa.array(symbols, pa.binary()),
        ],
        ["kind", "id", "class", *SKETCH, "symbols"],
    )


def fingerprinted(records: DataFrame) -> DataFrame:
    """``kind, id, class``, the fingerprint's bits and its indexed symbols of ``records(kind, id, text)`` with at least 240 normalised characters."""
    rows = records.where((F.char_length("text") >= LEAST_CHARS) & F.col("id").isNotNull()).select("kind", "id", "text")
    return rows.mapInArrow(_fingerprints, "kind string, id string, class long, " + _LONGS + ", symbols binary")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ball of each segment: one key for each symbol left out, salted with the kind."""
    weights = fp.mix(np.arange(1, SEGMENTS * SEGMENT + 1, dtype=np.uint64)).reshape(SEGMENTS, SEGMENT)
    places = fp.mix(np.arange(1000, 1000 + SEGMENTS * SEGMENT, dtype=np.uint64)).reshape(SEGMENTS, SEGMENT)
    balls, salts = SEGMENTS * SEGMENT, {}
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        raw = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint32).reshape(n, SEGMENTS, SEGMENT)
        part = fp.mix(raw.astype(np.uint64) + np.uint64(1)) * weights
        kind = np.array([salts.setdefault(k, xxhash.xxh3_64_intdigest(k)) for k in batch.column(1).to_pylist()], np.uint64)
        keys = fp.mix(part.sum(axis=2, keepdims=True) - part + places + kind[:, None, None]).reshape(n * balls).view(np.int64)
        repeated = [pa.array(np.repeat(batch.column(i).to_numpy(), balls)) for i in range(2, 3 + len(SKETCH))]
        yield pa.RecordBatch.from_arrays([pa.array(keys), *repeated], ["key", "class", *SKETCH])


def _keyed(prints: DataFrame) -> DataFrame:
    rows = prints.where("symbols is not null").select("symbols", "kind", "class", *SKETCH)
    return rows.mapInArrow(_keys, "key long, class long, " + _LONGS)


def distance(a: str, b: str) -> Column:
    """In how many bits two fingerprints differ."""
    return reduce(add, (F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in SKETCH))


def _hot_cells(rows: DataFrame, hot: int) -> DataFrame | None:
    """``cell, parts``: cells of hashed keys that must hold a key of more than ``hot`` records or many of some; None if none does.

    Counts of a fixed number of cells combine before the shuffle, whatever the number of keys.
    """
    counts = rows.groupBy(F.pmod("key", F.lit(HOT_CELLS)).alias("cell")).agg(F.count("*").alias("n"))
    counts = counts.collect()  # at most HOT_CELLS rows
    mean = sum(r["n"] for r in counts) / HOT_CELLS
    over = [(r["cell"], math.ceil((r["n"] - mean) / hot)) for r in counts if r["n"] > mean + max(hot, mean / 2)]
    return rows.sparkSession.createDataFrame(over, "cell long, parts int") if over else None


def meeting(rows: DataFrame, near: Column | None = None, hot: int = HOT_RECORDS) -> DataFrame:
    """``a, b``: the classes of ``rows(key, class, ...)`` that share a key, the lesser first, each pair once.

    Both sides of the join are the same exchange. ``near`` is a condition on the
    sides ``l`` and ``r`` and part of the join, so pairs that fail it are not written.
    Keys that many different classes share are joined apart: one side is dealt over
    the parts of its cell, the other goes to each, so no task gets such a key as a
    whole and no pair is lost.
    """
    ordered = F.col("l.class") < F.col("r.class")
    near = ordered if near is None else ordered & near
    ends = [F.col("l.class").alias("a"), F.col("r.class").alias("b")]
    cells = _hot_cells(rows, hot)
    if cells is None:
        return rows.alias("l").join(rows.alias("r"), (F.col("l.key") == F.col("r.key")) & near).select(*ends).distinct()
    cells = F.broadcast(cells)  # at most HOT_CELLS rows
    placed = rows.withColumn("cell", F.pmod("key", F.lit(HOT_CELLS)))
    rest, shared = placed.join(cells, "cell", "left_anti").drop("cell"), placed.join(cells, "cell")
    dealt = shared.withColumn("part", F.pmod(F.xxhash64("class"), "parts").cast("int")).alias("l")
    copied = shared.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("r")
    apart = dealt.join(copied, (F.col("l.key") == F.col("r.key")) & (F.col("l.part") == F.col("r.part")) & near).select(*ends)
    pairs = rest.alias("l").join(rest.alias("r"), (F.col("l.key") == F.col("r.key")) & near).select(*ends)
    return pairs.union(apart).distinct()


def candidates(prints: DataFrame, hot: int = HOT_RECORDS) -> DataFrame:
    """``a, b``: classes within radius 1 in some segment and near in the complete fingerprint, each pair once."""
    return meeting(_keyed(prints), distance("l", "r") <= MOST_BITS, hot)


@dataclass(frozen=True)
class BitFilter:
    """A bitmap over hashed strings that may say yes to a string that is not in it, never no to one that is.

    It has at least 16 bits a string, so that at most one in sixteen of others passes,
    as far as ``MOST_FILTER_BITS`` go (2 MB); beyond, :func:`where_may_contain` joins.
    """

    bits: np.ndarray
    size: int

    def __contains__(self, value: str) -> bool:
        b = xxhash.xxh64_intdigest(value.encode(), 42) & (self.size - 1)
        return bool(self.bits[b >> 3] >> (b & 7) & 1)


LEAST_FILTER_BITS, MOST_FILTER_BITS = 1 << 16, 1 << 24


def bit_filter(values: DataFrame, column: str) -> BitFilter | None:
    """A filter of the size that the number of values asks for, as far as that is bounded; None if they are too many for one."""
    count = values.count()
    size = LEAST_FILTER_BITS
    while size < 16 * count:
        size *= 2
    if size > MOST_FILTER_BITS:
        return None
    bit = F.pmod(F.xxhash64(column), F.lit(size))
    marks = values.select(bit.alias("bit")).groupBy((F.col("bit") / 64).cast("long").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("m")
    )
    bitmap = np.zeros(size // 64, np.int64)
    for w, m in marks.collect():  # at most MOST_FILTER_BITS / 64 rows
        bitmap[w] = m
    return BitFilter(bitmap.view(np.uint8), size)


def where_may_contain(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows whose value may be one of ``values``, a table of one column of that name; never loses one that is.

    The bitmap is a broadcast variable, not a literal: plans, and the logs that
    repeat them, stay small. Values too many for a bitmap are joined.
    """
    marked = bit_filter(values, column)
    if marked is None:
        return df.join(values.distinct(), column, "left_semi")
    shared, at = df.sparkSession.sparkContext.broadcast(marked), df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = shared.value
        for batch in batches:
            keep = np.fromiter((v in there for v in batch.column(at).to_pylist()), bool, batch.num_rows)
            yield batch.filter(pa.array(keep))

    return df.mapInArrow(run, df.schema)


def _jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = [[normalised(t) for t in batch.column(i).to_pylist()] for i in (2, 3)]
        out: list[float] = []
        for a, b in fp.blocks([len(x) + len(y) for x, y in zip(*sides)]):
            out += _similarities(sides[0][a:b], sides[1][a:b])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["a", "b", "similarity"])


def _similarities(left: list[str], right: list[str]) -> list[float]:
    """Shared by all distinct shingles, as sorted 64-bit hashes made once for each text."""
    number: dict[str, int] = {}
    sides = [[number.setdefault(t, len(number)) for t in side] for side in (left, right)]
    hashes, owner = fp.char_shingles(list(number), SHINGLE)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    sets = np.split(hashes, np.searchsorted(owner, np.arange(1, len(number))))
    out = []
    for x, y in zip(*sides):
        s, t = sets[x], sets[y]
        both = 0
        if min(len(s), len(t)) >= THRESHOLD * max(len(s), len(t)):
            both = len(np.intersect1d(s, t, assume_unique=True))
        out.append(both / (len(s) + len(t) - both))
    return out


def _of_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows ``class, kind, text`` whose text is of that class, without the kind."""
    for batch in batches:
        classes, kinds, texts = (batch.column(i) for i in range(3))
        own = np.array([class_of(k, normalised(t)) for k, t in zip(kinds.to_pylist(), texts.to_pylist())], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([classes, texts], ["class", "text"]).filter(pa.array(own == classes.to_numpy()))


def class_links(records: DataFrame, prints: DataFrame) -> DataFrame:
    """``a, b, similarity`` (a < b): pairs of different texts at or over the threshold.

    One record stands for each class. Its text is fetched through a bitmap, so of the
    texts only those of candidates, and a few more, are shuffled. If
    its id stands with other texts too, those are not of the class and are dropped.
    """
    pairs = checkpointed(candidates(prints))
    ends = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    stands = prints.join(ends, "class", "left_semi").groupBy("class").agg(F.min(F.struct("kind", "id")).alias("r"))
    stands = checkpointed(stands.select("class", "r.kind", "r.id"))
    texts = records.where((F.char_length("text") >= LEAST_CHARS) & F.col("id").isNotNull()).select("kind", "id", "text")
    texts = where_may_contain(texts, "id", stands.select("id")).join(stands, ["kind", "id"]).select("class", "kind", "text")
    texts = texts.mapInArrow(_of_class, "class long, text string").groupBy("class").agg(F.min("text").alias("text"))
    sides = pairs.join(texts.select(F.col("class").alias("a"), F.col("text").alias("x")), "a")
    sides = sides.join(texts.select(F.col("class").alias("b"), F.col("text").alias("y")), "b")
    verified = sides.select("a", "b", "x", "y").mapInArrow(_jaccard, "a long, b long, similarity double")
    return verified.where(F.col("similarity") >= THRESHOLD)


def members(prints: DataFrame) -> DataFrame:
    """``kind, class, id``, each once."""
    return prints.select("kind", "class", "id").distinct()


def near_pairs(records: DataFrame) -> DataFrame:
    """``kind, id_a, id_b`` (id_a < id_b as strings): all pairs of near copies, exact ones too.

    ``records`` has ``kind, id, text`` and may have more columns. Null ids and texts
    and texts under 240 normalised characters take no part; repeated rows count
    once; an id never pairs with itself. An id that stands with several texts has
    the pairs of each. Empty input gives no rows.
    """
    prints = checkpointed(fingerprinted(records))
    own = members(prints)
    links = class_links(records, prints).select("a", "b")
    left = own.select("kind", F.col("class").alias("a"), F.col("id").alias("x"))
    right = own.select(F.col("class").alias("b"), F.col("id").alias("y"))
    across = links.join(left, "a").join(right, "b").select("kind", "x", "y")
    many = own.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class")
    copies = own.join(many, "class", "left_semi")
    same = copies.select("kind", "class", F.col("id").alias("x")).join(copies.select("class", F.col("id").alias("y")), "class")
    both = across.union(same.where("x < y").select("kind", "x", "y")).where("x <> y")
    return both.select("kind", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root``: the least node of each connected component of ``a, b``.

    Alternating large-star and small-star rounds; each is a grouped minimum and a
    join, with its result written to the shared folder. No component is collected.
    """
    edges = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(
            down.select("u", F.col("m").alias("v"))
        )
        edges = checkpointed(small.distinct())
        state = edges.agg(F.count("*"), F.sum(F.hash("u", "v"))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def near_groups(records: DataFrame) -> DataFrame:
    """``kind, id, class, links, root``: one row per record of enough characters.

    ``class`` is shared by exact copies, ``links`` counts the other classes at or
    over the threshold, ``root`` is the least class of the group that near copies
    form. Nulls, short texts and repeated rows as in :func:`near_pairs`.
    """
    prints = checkpointed(fingerprinted(records))
    links = checkpointed(class_links(records, prints))
    ends = links.select(F.col("a").alias("class")).union(links.select("b")).groupBy("class").agg(F.count("*").alias("links"))
    roots = components(links).select(F.col("node").alias("class"), "root")
    rows = members(prints).join(ends, "class", "left").join(roots, "class", "left")
    return rows.select("kind", "id", "class", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "class").alias("root"))

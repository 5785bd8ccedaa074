"""Substring BM25 over several columns, for one query or a batch.

All terms of the batch are one automaton that each text passes once to be counted and
once to be scored, so the cost of a text does not grow with the number of queries. The
first pass gives back counts per term and task, the second scores rows where they are
read and gives back a task's best ``limit`` of each query; hits beyond those are neither
written nor shuffled. What is searched is written once, as making it may be costly. Batches are taken in blocks of bounded size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedgework.functions.text import trigrams
from sedgework.session import written

WEIGHTS = (1.0, 0.5, 1.5)
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
BLOCK_CHARS, BLOCK_QUERIES = 4 << 20, 2000


def query_terms(text: str | None) -> list[str]:
    """White-space separated terms in lower case; those under 3 characters never match and are dropped."""
    return [t.lower() for t in (text or "").split() if len(t) > 2]


def candidate_limit(limit: int) -> int:
    return max(limit * 20, 200)


def _blocks(queries: list[tuple]) -> Iterator[list[tuple]]:
    block: list[tuple] = []
    size = 0
    for q in queries:
        if block and (size + len(q[1] or "") > BLOCK_CHARS or len(block) == BLOCK_QUERIES):
            yield block
            block, size = [], 0
        block.append(q)
        size += len(q[1] or "")
    if block:
        yield block


def _automaton(terms: Sequence[str]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        automaton.add_word(t, i)
    automaton.make_automaton()
    return automaton


def _counter(terms: list[str], searched: list[int]):
    """Arrow function: ``term, n``, the number of rows of the task that hold each term in one of the searched columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, seen = _automaton(terms), Counter()
        for batch in batches:
            for texts in zip(*(batch.column(2 + c).to_pylist() for c in searched)):
                seen.update({t for text in texts if text for _, t in automaton.iter(text)})
        yield pa.RecordBatch.from_arrays([pa.array([terms[t] for t in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

    return run


def _scorer(block: list[tuple[int, list[str]]], terms: list[str], idf: dict[str, float], weights: Sequence[float], every: bool, mean: float, limit: int):
    """Arrow function: ``query_id, id, score`` of the task's best rows of each query.

    Columns of weight 0 are not searched. A query is tried on a row only if the row
    holds its longest term, or any of its terms if not ``every`` one is needed.
    """
    number = {t: i for i, t in enumerate(terms)}
    wanted = [(q, [(number[t], idf[t]) for t in ts]) for q, ts in block]
    first: dict[int, list[int]] = {}
    for k, (_, ts) in enumerate(wanted):
        for t in {max(ts, key=lambda t: len(terms[t[0]]))} if every else set(ts):
            first.setdefault(t[0], []).append(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(terms)
        best: dict[int, list[tuple[float, object]]] = {}
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            ids, length = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            columns = [batch.column(2 + c).to_pylist() if w else [] for c, w in enumerate(weights)]
            for i, id_ in enumerate(ids):
                f: dict[int, float] = {}
                for column, weight in zip(columns, weights):
                    if column and column[i]:
                        for _, t in automaton.iter(column[i]):
                            f[t] = f.get(t, 0.0) + weight
                saturation = K1 * (1 - B + B * length[i] / (mean or 1.0))
                for k in {k for t in f for k in first.get(t, ())}:
                    ts = wanted[k][1]
                    if every and not all(t in f for t, _ in ts):
                        continue
                    score = 0.0
                    for t, w in ts:
                        n = f.get(t, 0.0)
                        score += w * n * (K1 + 1) / (n + saturation)
                    own = best.setdefault(k, [])
                    own.append((-score, id_))
                    if len(own) > 2 * limit + 16:
                        own.sort()
                        del own[limit:]
        if kind is not None:
            rows = [(wanted[k][0], id_, score) for k, own in best.items() for score, id_ in sorted(own)[:limit]]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), kind, pa.float64()))], ["query_id", "id", "score"])

    return run


def _idf(total: int, n: int) -> float:
    import math

    value = math.log((total - n + 0.5) / (n + 0.5))
    return value if value > 0 else LEAST_IDF


def bm25(
    docs: DataFrame,
    queries: Sequence[tuple[int, str | None]] | DataFrame,
    limit: int,
    weights: Sequence[float] = WEIGHTS,
    every: bool = True,
) -> DataFrame:
    """``query_id, id, score, bm25_rank``: the ``limit`` best rows of each query.

    ``docs`` has ``id`` (unique; a null one is never found) and the text columns ``content``, ``path`` and
    ``metadata``, weighted 1, 0.5 and 1.5. A row counts if every term (or any, if
    not ``every``) stands in some column of it, as a substring and ignoring case; a
    weight of 0 leaves a column out of the search, though not out of the lengths. Scores are negative, the lowest is the best; ties go to the
    lesser id. Queries without a term of 3 characters have no rows. The statistics
    cover all rows of ``docs``; null columns are empty.
    """
    spark, columns = docs.sparkSession, ("content", "path", "metadata")
    if isinstance(queries, DataFrame):
        queries = [tuple(r) for r in queries.select("query_id", "query_text").collect()]  # the batch itself
    parsed = [(q, ts) for q, ts in ((q, query_terms(t)) for q, t in queries) if ts]
    kind = dict(docs.dtypes)["id"]
    schema = f"query_id long, id {kind}, score double, bm25_rank int"
    if not parsed:
        return spark.createDataFrame([], schema)
    length = sum((trigrams(F.col(c)) for c in columns), F.lit(0))
    rows = written(docs.select("id", length.alias("length"), *(F.lower(c).alias(c) for c in columns)))
    total, chars = rows.agg(F.count("*"), F.sum("length")).first()
    mean = (chars or 0) / total if total else 0.0
    out = spark.createDataFrame([], f"query_id long, id {kind}, score double")
    for block in _blocks([(q, " ".join(ts)) for q, ts in parsed]):
        chosen = [(q, t.split(" ")) for q, t in block]
        terms = sorted({t for _, ts in chosen for t in ts})
        searched = [c for c, w in enumerate(weights) if w]
        counted = rows.mapInArrow(_counter(terms, searched), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
        counts = dict(counted.collect())  # one per term of the block
        idf = {t: _idf(total, counts.get(t, 0)) for t in terms}
        best = _scorer(chosen, terms, idf, weights, every, mean, limit)
        out = out.unionByName(rows.where("id is not null").mapInArrow(best, f"query_id long, id {kind}, score double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return out.withColumn("bm25_rank", rank).where(F.col("bm25_rank") <= limit).select("query_id", "id", "score", "bm25_rank")


def metadata_hits(docs: DataFrame, queries: Sequence[tuple[int, str | None]] | DataFrame, limit: int = 1000) -> DataFrame:
    """As :func:`bm25`, for rows whose metadata hold any of the terms. A quotation mark in a term is an ordinary character."""
    return bm25(docs, queries, limit, (0.0, 0.0, WEIGHTS[2]), every=False)

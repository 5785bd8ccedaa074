"""Exact nearest neighbours.

A block of query vectors is a matrix that every task holds; a task multiplies it with
its own rows and gives back only its best for each query. What is shuffled are
``limit`` rows per query and task, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_VALUES, BLOCK_QUERIES, PRODUCT_VALUES = 8 << 20, 4096, 4 << 20


def vector_limit(limit: int) -> int:
    return max(limit * 10, 100)


def _matrix(ids: pa.Array, vectors: pa.ListArray, width: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and rows of the vectors of the right width, without a Python object for each value."""
    fits = pc.equal(pc.list_value_length(vectors), width)
    ids, vectors = ids.filter(fits), vectors.filter(fits)
    return ids, vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), width)


def _nearest(ids: list, matrix: np.ndarray, limit: int):
    """Arrow function: ``query_id, id, distance`` of the ``limit`` best rows of each query among all batches that it is given."""
    squares = (matrix * matrix).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, list]] = {}
        worst = np.full(len(ids), np.inf)  # distance of the last of a query's best rows, once there are enough
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            own_ids, own = _matrix(batch.column(0), batch.column(1), matrix.shape[1])
            if not len(own):
                continue
            own_squares, keep = (own * own).sum(axis=1), min(limit, len(own))
            step = max(1, PRODUCT_VALUES // len(own))
            for i in range(0, len(ids), step):
                part = matrix[i : i + step]
                rough = squares[i : i + step, None] + own_squares[None, :] - 2 * part @ own.T
                kth = np.partition(rough, keep - 1, axis=1)[:, keep - 1]
                kth = np.minimum(kth, worst[i : i + step] ** 2)[:, None]
                q, v = np.nonzero(rough <= kth + 1e-9 * (1 + np.abs(kth)))  # ties stay in
                exact = np.sqrt(((part[q] - own[v]) ** 2).sum(axis=1))
                names = own_ids.take(pa.array(v)).to_pylist()
                starts = np.flatnonzero(np.diff(q, prepend=-1))
                for s, e in zip(starts, [*starts[1:], len(q)]):
                    k, far, near = i + int(q[s]), exact[s:e], names[s:e]
                    if k in best:
                        far, near = np.concatenate([best[k][0], far]), best[k][1] + near
                    order = sorted(range(len(near)), key=lambda j: (far[j], near[j]))[:limit]
                    best[k] = far[order], [near[j] for j in order]
                    if len(order) == limit:
                        worst[k] = far[order[-1]]
        if kind is not None:
            rows = [(ids[k], id_, d) for k, (far, near) in best.items() for d, id_ in zip(far, near)]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), kind, pa.float64()))], ["query_id", "id", "distance"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """``query_id, id, distance, vec_rank``: the ``limit`` nearest rows of ``vectors(id, embedding)`` by L2 distance.

    ``queries`` has ``query_id, embedding``. Null vectors and those of another
    length take no part; ties go to the lesser id. Queries are taken in blocks.
    """
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)["id"]
    asked = [(q, v) for q, v in queries.select("query_id", "embedding").collect() if v]  # the batch itself
    schema = f"query_id long, id {kind}, distance double"
    out = spark.createDataFrame([], schema)
    rows = vectors.where("id is not null and embedding is not null").select("id", "embedding")
    by_length: dict[int, list] = {}
    for q, v in asked:
        by_length.setdefault(len(v), []).append((q, v))
    for width, group in by_length.items():
        step = max(1, min(BLOCK_QUERIES, BLOCK_VALUES // width))
        for i in range(0, len(group), step):
            block = group[i : i + step]
            matrix = np.array([v for _, v in block], np.float64)
            out = out.unionByName(rows.mapInArrow(_nearest([q for q, _ in block], matrix, limit), schema))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return out.withColumn("vec_rank", rank).where(F.col("vec_rank") <= limit)

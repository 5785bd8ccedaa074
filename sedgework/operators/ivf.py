"""Optional index for nearest neighbours: cells around centroids.

Centroids are fitted on a sample of at most ``SAMPLE_ROWS`` rows; every row is
assigned to its nearest one. Written with ``partitionBy("cell")``, a search reads only
the cells that some query probes. Results are approximate; with all cells probed they
are those of the exact search. A cell is never collected or shuffled as a whole: its
rows are compared where they are read, so a cell that holds a third of them is merely
more files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedgework.operators.vector import _matrix, _nearest, nearest

SAMPLE_ROWS, ROUNDS, MOST_CELLS = 65_536, 12, 4_096


def fit(vectors: DataFrame, cells: int, width: int, seed: int = 0) -> np.ndarray:
    """Centroids of ``vectors(id, embedding)`` by k-means on the sample with the least seeded hashes.

    At most 4,096 cells; fewer if the sample has fewer rows, at least one.
    """
    some = vectors.where(F.size("embedding") == width).orderBy(F.xxhash64(F.lit(seed), "id")).limit(SAMPLE_ROWS)
    rows = np.array([r[0] for r in some.select("embedding").collect()], np.float64).reshape(-1, width)  # the bounded sample
    if not len(rows):
        return np.zeros((1, width))
    rng = np.random.default_rng(seed)
    centroids = rows[rng.choice(len(rows), min(cells, MOST_CELLS, len(rows)), replace=False)].copy()
    for _ in range(ROUNDS):
        nearest = _closest(rows, centroids, 1)[:, 0]
        for c in range(len(centroids)):
            own = rows[nearest == c]
            centroids[c] = own.mean(axis=0) if len(own) else rows[rng.integers(len(rows))]
    return centroids


def _closest(rows: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the ``n`` nearest centroids of each row, the nearest first."""
    far = (centroids * centroids).sum(axis=1)[None, :] - 2 * rows @ centroids.T
    return np.argsort(far, axis=1, kind="stable")[:, :n]


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``id, embedding, cell`` of every row of the centroids' width."""
    kind, shared = dict(vectors.dtypes)["id"], vectors.sparkSession.sparkContext.broadcast(centroids)  # at most 4,096 rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = shared.value.shape[1]
            ids, own = _matrix(batch.column(0), batch.column(1), width)
            if len(own):
                cell = _closest(own, shared.value, 1)[:, 0]
                values = pa.array(own.astype(np.float32).reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(own) * width + 1, width), pa.int32()), values)
                yield pa.RecordBatch.from_arrays([ids, lists, pa.array(cell, pa.int32())], ["id", "embedding", "cell"])

    rows = vectors.where("id is not null and embedding is not null").select("id", "embedding")
    return rows.mapInArrow(run, f"id {kind}, embedding array<float>, cell int")


def search(index: DataFrame, centroids: np.ndarray, queries: DataFrame, limit: int, probes: int) -> DataFrame:
    """``query_id, id, distance, vec_rank`` from the ``probes`` cells nearest to each query.

    ``index`` has ``id, embedding, cell``; the filter on ``cell`` prunes partitions.
    Queries of another width have no rows; ties go to the lesser id.
    """
    spark, kind = index.sparkSession, dict(index.dtypes)["id"]
    asked = [(q, v) for q, v in queries.select("query_id", "embedding").collect() if v and len(v) == centroids.shape[1]]  # the batch
    schema = f"query_id long, id {kind}, distance double"
    out = spark.createDataFrame([], schema)
    if asked:
        matrix = np.array([v for _, v in asked], np.float64)
        by_cell: dict[int, list[int]] = {}
        for q, cells in enumerate(_closest(matrix, centroids, probes)):
            for c in cells:
                by_cell.setdefault(int(c), []).append(q)
        shared = spark.sparkContext.broadcast((matrix, by_cell))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, cells = shared.value
            for batch in batches:
                cell = batch.column(2).to_numpy()
                for c in np.unique(cell):
                    own = cells.get(int(c), [])
                    part = batch.filter(pa.array(cell == c)).select([0, 1])
                    yield from _nearest([asked_ids[q] for q in own], block[own], limit)([part]) if own else ()

        asked_ids = [q for q, _ in asked]
        rows = index.where(F.col("cell").isin(sorted(by_cell))).select("id", "embedding", "cell")
        out = rows.mapInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return out.withColumn("vec_rank", rank).where(F.col("vec_rank") <= limit)


def probes_for(index: DataFrame, centroids: np.ndarray, queries: DataFrame, limit: int, recall: float = 0.9) -> int:
    """The least number of probes with which the exact neighbours of these queries are found to the given share.

    Measured against brute force: for every true neighbour, the place of its cell
    among those of its query. Without any neighbour one probe is enough.
    """
    asked = {q: v for q, v in queries.select("query_id", "embedding").collect() if v and len(v) == centroids.shape[1]}  # the batch
    true = nearest(index.select("id", "embedding"), queries, limit).select("query_id", "id")
    cells = true.join(index.select("id", "cell"), "id").select("query_id", "cell").collect()  # limit rows a query
    order = {q: np.argsort(_closest(np.array([v], np.float64), centroids, len(centroids))[0]) for q, v in asked.items()}
    places = sorted(int(order[r["query_id"]][r["cell"]]) for r in cells if r["query_id"] in order)
    return places[max(0, int(np.ceil(recall * len(places))) - 1)] + 1 if places else 1

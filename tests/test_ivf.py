import os
import random

import pytest

from conftest import dicts
from sedgework.operators import ivf, vector

SCHEMA = "id long, embedding array<float>"


def recall(spark, vectors, queries, limit, cells, probes, width):
    centroids = ivf.fit(vectors, cells, width)
    index = ivf.assign(vectors, centroids)
    want = {(r["query_id"], r["id"]) for r in dicts(vector.nearest(vectors, queries, limit))}
    got = {(r["query_id"], r["id"]) for r in dicts(ivf.search(index, centroids, queries, limit, probes))}
    return len(want & got) / len(want), got == want, index.count()


def test_all_cells_give_the_exact_result(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, 1.0, 2.0]) for _ in range(4)]) for i in range(300)] + [(900, None), (901, [1.0])]
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(3)
    queries = vectors.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    _, same, n = recall(spark, vectors, queries, 7, 8, 8, 4)
    assert same and n == 300


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_recall_on_the_test_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id as id", "embedding")
    queries = vectors.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    centroids = ivf.fit(vectors, 16, 64)
    probes = ivf.probes_for(ivf.assign(vectors, centroids), centroids, queries, 10)
    assert recall(spark, vectors, queries, 10, 16, probes, 64)[0] >= 0.9 > recall(spark, vectors, queries, 10, 16, probes - 1, 64)[0]


def test_partitions_are_pruned_and_empty_input(spark, tmp_path):
    rng = random.Random(2)
    vectors = spark.createDataFrame([(i, [float(i % 10), rng.random()]) for i in range(200)], SCHEMA)
    centroids = ivf.fit(vectors, 10, 2)
    ivf.assign(vectors, centroids).write.partitionBy("cell").parquet(str(tmp_path / "ivf"))
    found = ivf.search(spark.read.parquet(str(tmp_path / "ivf")), centroids, vectors.limit(1).withColumnRenamed("id", "query_id"), 3, 1)
    assert found.count() == 3 and "PartitionFilters: [isnotnull(cell" in found._jdf.queryExecution().toString()
    none = vectors.limit(0)
    assert ivf.search(ivf.assign(none, ivf.fit(none, 4, 2)), centroids, none.withColumnRenamed("id", "query_id"), 3, 1).count() == 0

"""One ranking from several differently-scaled scores.

Leximin: each score becomes a percentile among the candidates of its search, each
candidate's percentiles are sorted ascending, and candidates are ordered by
comparing these arrays lexicographically, the greater first. The weakest
percentile decides before any other, so no score's range can mask another.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgework.session import checkpointed

SCORES = ("bm25", "vector", "rerank", "hybrid")
HOT_ROWS = 1_000_000


def _present(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c).cast("double"))


def candidates(df: DataFrame, search: str, item: str, scores: tuple[str, ...]) -> DataFrame:
    """One row per search and item; repeated rows have the greatest of each score, NaN is null."""
    return (
        df.where(F.col(search).isNotNull() & F.col(item).isNotNull())
        .groupBy(search, item)
        .agg(*(F.max(_present(s)).alias(s) for s in scores))
    )


def _window_ranks(rows: DataFrame, search: str, scores: tuple[str, ...]) -> DataFrame:
    whole = Window.partitionBy(search)
    for s in scores:
        ranks = F.rank().over(whole.orderBy(F.col(s).asc_nulls_first())) - F.sum(F.col(s).isNull().cast("int")).over(whole)
        rows = rows.withColumn(f"_r_{s}", ranks)
    return rows.select(*rows.columns, *(F.count(s).over(whole).alias(f"_n_{s}") for s in scores))


def _range_ranks(rows: DataFrame, search: str, item: str, score: str) -> DataFrame:
    """``search, item, _r, _n`` for searches too large for one task.

    Rows are range-partitioned by (search, score), ranked inside their partition,
    and moved by the number of rows of their search in the partitions before. Equal
    scores are in one partition, so ranks are exact. Only counts per (partition,
    search) are windowed. The partitioned rows are written before they are read
    twice, as ranges come from a sample that another run would draw anew.
    """
    some = rows.where(F.col(score).isNotNull()).select(search, item, score)
    parted = checkpointed(some.repartitionByRange(search, score).withColumn("_p", F.spark_partition_id()))
    local = parted.withColumn("_l", F.rank().over(Window.partitionBy(search, "_p").orderBy(score)))
    counts = parted.groupBy(search, "_p").agg(F.count("*").alias("_c"))
    order = Window.partitionBy(search).orderBy("_p")
    offsets = counts.select(
        search,
        "_p",
        F.coalesce(F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_c").over(Window.partitionBy(search)).alias("_n"),
    )
    return local.join(offsets, [search, "_p"]).select(search, item, (F.col("_l") + F.col("_before")).alias("_r"), "_n")


def _vector(scores: tuple[str, ...]) -> Column:
    """Sorted percentiles of the scores that the search has; a row without a score has 0 there."""
    each = [
        F.when(F.col(f"_n_{s}") > 0, F.when(F.col(s).isNull(), 0.0).otherwise(F.col(f"_r_{s}") / F.col(f"_n_{s}")))
        for s in scores
    ]
    return F.array_sort(F.array_compact(F.array(*each)))


def leximin_vectors(
    df: DataFrame, search: str = "search_id", item: str = "chunk_id", scores: tuple[str, ...] = SCORES, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``search, item, percentiles``: each candidate's sorted percentiles.

    Null and NaN are no score: percentile 0, which never speaks for the row; a score
    that a whole search lacks takes no part. Tied scores share the percentile of
    the lowest of them. Rows without search or item are left out, repeated rows
    count once. Searches of more than ``hot_rows`` candidates are ranked over
    several partitions, all others in windows; both give the same percentiles.
    """
    rows = candidates(df, search, item, scores)
    sizes = rows.groupBy(search).agg(F.count("*").alias("_size")).where(F.col("_size") > hot_rows)
    hot = [r[0] for r in sizes.select(search).collect()]  # at most rows / hot_rows searches
    if not hot:
        ranked = _window_ranks(rows, search, scores)
        return ranked.select(search, item, _vector(scores).alias("percentiles"))
    rows = checkpointed(rows)
    rest = _window_ranks(rows.where(~F.col(search).isin(hot)), search, scores)
    large = rows.where(F.col(search).isin(hot))

    def with_score(left: DataFrame, s: str) -> DataFrame:
        ranks = _range_ranks(large, search, item, s)
        totals = ranks.groupBy(search).agg(F.max("_n").alias(f"_n_{s}"))
        ranks = ranks.select(search, item, F.col("_r").alias(f"_r_{s}"))
        return left.join(ranks, [search, item], "left").join(totals, search, "left")

    large = reduce(with_score, scores, large).fillna(0, [f"_n_{s}" for s in scores])
    return rest.unionByName(large).select(search, item, _vector(scores).alias("percentiles"))


def leximin_first(vectors: DataFrame, search: str = "search_id", item: str = "chunk_id") -> DataFrame:
    """``search, item``: the candidate that comes first; of equal ones the least item.

    One pass: the least struct of the negated percentiles and the item combines
    before the shuffle, so a hot search costs no more than one row per task.
    """
    first = F.min(F.struct(F.transform("percentiles", lambda p: -p).alias("p"), F.col(item).alias("item")))
    return vectors.groupBy(search).agg(first.alias("f")).select(search, F.col("f.item").alias(item))


def leximin_ranking(vectors: DataFrame, search: str = "search_id", item: str = "chunk_id") -> DataFrame:
    """``search, item, place`` with ``place`` from 1; of equal candidates the lesser item comes first.

    Sorted by range over (search, percentiles, item) and numbered with offsets per
    partition, so no search has to fit into one task. Ranges come from a sample that
    another run would draw anew, so the partitioned rows are written before they are
    read twice.
    """
    order = [F.col(search), F.col("percentiles").desc(), F.col(item)]
    parted = checkpointed(vectors.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    local = parted.withColumn("_l", F.row_number().over(Window.partitionBy(search, "_p").orderBy(*order[1:])))
    counts = parted.groupBy(search, "_p").agg(F.count("*").alias("_c"))
    ahead = Window.partitionBy(search).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(search, "_p", F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_before"))
    return local.join(offsets, [search, "_p"]).select(search, item, (F.col("_l") + F.col("_before")).cast("int").alias("place"))

"""Hybrid retrieval: BM25 and vector candidates blended into one list."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgework.functions.vectors import l2_to_cosine
from sedgework.operators import lexical, vector

RERANK_CANDIDATES = 20
PATH_BOOST, TAG_BOOST = 1.5, 0.2


def min_max(c: str, over: list[str], flat: float, descending: bool = False) -> Column:
    """Scaled to 0..1 within a group; ``flat`` where all values are equal."""
    w = Window.partitionBy(*over)
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    up = (hi - F.col(c)) if descending else (F.col(c) - lo)
    return F.when(hi == lo, F.lit(flat)).otherwise(up / (hi - lo))


def normalize(df: DataFrame, score: str, over: list[str], name: str = "normalized") -> DataFrame:
    """Min-max scaling of a score by itself: equal values give 0, unlike inside :func:`hybrid_search`."""
    return df.withColumn(name, min_max(score, over, 0.0))


def path_terms(text: str | None) -> list[str]:
    return [t for t in (text or "").lower().split() if len(t) > 1]


def hybrid_search(
    docs: DataFrame,
    queries: DataFrame,
    vectors: DataFrame | None = None,
    query_vectors: DataFrame | None = None,
    limit: int = 10,
    alpha: float = 0.4,
    parents: DataFrame | None = None,
    scorer: Callable[[str, list[str]], list[float]] | None = None,
    threshold: float = 0.0,
) -> DataFrame:
    """``query_id, id, bm25, vector, hybrid, rerank, place`` with the columns of ``parents`` if given.

    ``docs`` has ``id, content, path, metadata`` and perhaps ``parent_id``;
    ``queries`` has ``query_id, query_text``. Scores are scaled over the capped
    candidate lists before anything is joined: the worst BM25 hit gets 0, equal
    scores get 1. A path that holds the query's first term raises BM25 by half. With
    no vector candidate for a query, hybrid is BM25 unscaled. Tagged files that hold
    a query term in their metadata gain 0.2. Rows of hybrid 0 or below the threshold
    are dropped. With a scorer the best 20 are reranked on their parent's text, so at
    most 20 rows come back. Ties keep BM25, then vector order. A query without
    candidates has no rows.
    """
    asked = [tuple(r) for r in queries.select("query_id", "query_text").collect()]  # the batch itself
    spark, kind = docs.sparkSession, dict(docs.dtypes)["id"]
    lex = lexical.bm25(docs, asked, lexical.candidate_limit(limit))
    lex = lex.withColumn("_bm25", min_max("score", ["query_id"], 1.0, descending=True))
    if vectors is not None and query_vectors is not None:
        near = vector.nearest(vectors, query_vectors, vector.vector_limit(limit))
        near = near.withColumn("_cos", l2_to_cosine(F.col("distance"))).withColumn("_vec", min_max("_cos", ["query_id"], 1.0))
    else:
        near = spark.createDataFrame([], f"query_id long, id {kind}, distance double, vec_rank int, _cos double, _vec double")
    both = lex.select("query_id", "id", "_bm25", "bm25_rank").join(near.select("query_id", "id", "_vec", "vec_rank"), ["query_id", "id"], "full_outer")
    both = both.withColumn("_has", F.max(F.col("vec_rank").isNotNull()).over(Window.partitionBy("query_id")))
    words = spark.createDataFrame(
        [(q, path_terms(t)) for q, t in asked], "query_id long, terms array<string>"
    )
    rows = both.join(docs, "id").join(words, "query_id", "left")
    first = F.try_element_at("terms", F.lit(1))
    boosted = F.when(F.contains(F.lower("path"), first), F.least(F.lit(1.0), F.coalesce("_bm25", F.lit(0.0)) * PATH_BOOST))
    bm25 = F.coalesce(boosted, "_bm25", F.lit(0.0))
    vec = F.coalesce("_vec", F.lit(0.0))
    rows = rows.withColumn("bm25", bm25).withColumn("vector", vec)
    blend = F.when(F.col("_has"), alpha * F.col("bm25") + (1 - alpha) * F.col("vector")).otherwise(F.col("bm25"))
    tagged = F.exists("terms", lambda t: (F.char_length(t) > 2) & F.contains(F.lower("metadata"), t))
    hybrid = F.when(F.coalesce(tagged, F.lit(False)), F.least(F.lit(1.0), blend + TAG_BOOST)).otherwise(blend)
    rows = rows.withColumn("hybrid", hybrid).where((F.col("hybrid") > 0) & (F.col("hybrid") >= threshold))
    order = [F.col("hybrid").desc(), F.col("bm25_rank").asc_nulls_last(), F.col("vec_rank").asc_nulls_last()]
    kept = RERANK_CANDIDATES if scorer else limit
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= kept)
    extra: list[str] = []
    if parents is not None:
        extra = ["parent_content", "parent_heading"]
        mine = parents.groupBy(F.col("id").alias("parent_id")).agg(F.min(F.struct(F.col("content"), F.col("heading"))).alias("p"))
        rows = rows.join(mine, "parent_id", "left").withColumn("parent_content", F.col("p.content")).withColumn("parent_heading", F.col("p.heading"))
    rows = rows.withColumn("rerank", F.lit(None).cast("double"))
    if scorer:
        rows = reranked(rows, queries, scorer, "parent_content" if extra else "content", limit)
    return rows.select("query_id", "id", "bm25", "vector", "hybrid", "rerank", "place", *extra)


def context(rows: DataFrame, limit: int = 5) -> DataFrame:
    """``query_id, context``: the best rows as one text, each with a line that says where it stands.

    ``rows`` has ``query_id, place, path, line_start, line_end, heading, content``.
    """
    name = F.regexp_extract("path", "[^/]*$", 0)
    where = F.concat(F.lit("### "), name, F.lit(" (lines "), "line_start", F.lit("-"), "line_end", F.lit(")"))
    section = F.when(F.col("heading").isNotNull(), F.concat(F.lit(" — § "), "heading")).otherwise("")
    block = F.concat(where, section, F.lit("\n```\n"), F.coalesce("content", F.lit("")), F.lit("\n```"))
    kept = rows.where(F.col("place") <= limit).select("query_id", "place", block.alias("block"))
    parts = kept.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "block"))).alias("bs"))  # at most limit
    return parts.select("query_id", F.array_join("bs.block", "\n\n").alias("context"))


def reranked(rows: DataFrame, queries: DataFrame, scorer: Callable[[str, list[str]], list[float]], passage: str, limit: int) -> DataFrame:
    """Scores clamped to 0..1, what is no number is 0; then the best ``limit``, ties in the order they had."""
    rows = rows.drop("rerank").withColumn("_passage", F.coalesce(passage, "content"))
    asked = queries.select("query_id", "query_text")
    fields = rows.join(asked, "query_id").groupBy("query_id", "query_text").agg(
        F.sort_array(F.collect_list(F.struct("place", "id", "_passage"))).alias("cs")  # at most 20
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for q, text, cs in zip(pdf["query_id"], pdf["query_text"], pdf["cs"]):
                scores = scorer(text, [c["_passage"] for c in cs])
                out += [(q, c["id"], clamp(s)) for c, s in zip(cs, scores)]
            yield pd.DataFrame(out, columns=["query_id", "id", "rerank"])

    scored = fields.mapInPandas(run, f"query_id long, id {dict(rows.dtypes)['id']}, rerank double")
    joined = rows.join(scored, ["query_id", "id"])
    again = Window.partitionBy("query_id").orderBy(F.col("rerank").desc(), "place")
    return joined.withColumn("place", F.row_number().over(again)).where(F.col("place") <= limit)


def clamp(score: object) -> float:
    if isinstance(score, bool) or not isinstance(score, (int, float)) or score != score:
        return 0.0
    return min(1.0, max(0.0, float(score)))

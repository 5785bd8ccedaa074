"""Queries and SQL of the operators for training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgework.llm import markup, mixing, neardup, ranking, scanned, splitting, tokenizing, truncation
from sedgework.session import checkpointed, table

PARENT_LIMIT, CHUNK_LIMIT, OVERLAP = 4000, 2000, 200


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.leximin_vectors(table(spark, sf_dir, "scored_chunks"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "parents").select(F.lit("parent").alias("kind"), "id", F.col("content").alias("text"))
    chunks = table(spark, sf_dir, "chunks").select(F.lit("chunk").alias("kind"), "id", F.col("chunk_content").alias("text"))
    return parents.union(chunks)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_pairs(_records(spark, sf_dir))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(_records(spark, sf_dir))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents, chunks = table(spark, sf_dir, "parents"), table(spark, sf_dir, "chunks")
    place = [F.col("file_path").alias("file"), F.col("line_start").cast("long").alias("line")]
    has_heading = F.col("heading").isNotNull().alias("heading")
    blocks = [F.lit("chunk").alias("kind"), "id", *place, F.col("chunk_content").alias("text"), F.lit(False).alias("heading")]
    return parents.select(F.lit("parent").alias("kind"), "id", *place, F.col("content").alias("text"), has_heading).union(chunks.select(*blocks))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned.defects(_pages(spark, sf_dir))


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned.repaired(_pages(spark, sf_dir))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = splitting.split_oversized(table(spark, sf_dir, "parents"), "id", "content", PARENT_LIMIT, OVERLAP)
    chunks = splitting.split_oversized(table(spark, sf_dir, "chunks"), "id", "chunk_content", CHUNK_LIMIT, OVERLAP)
    return parents.select(F.lit("parent").alias("kind"), "*").unionByName(chunks.select(F.lit("chunk").alias("kind"), "*"))


def p4_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the pieces of each text: their new parts make it up, none is too long, each repeats 200 characters at most."""
    new = F.struct("piece", F.expr("substring(content, new_from - starts_at + 1)").alias("t"))
    limit = F.when(F.col("kind") == "parent", PARENT_LIMIT).otherwise(CHUNK_LIMIT)
    pieces = p4_pieces(spark, sf_dir).withColumn("over", (F.char_length("content") > limit) | (F.col("new_from") - F.col("starts_at") > OVERLAP))
    joined = pieces.groupBy("kind", "id").agg(F.sort_array(F.collect_list(new)).alias("ps"), F.count_if("over").alias("too_long"))
    return joined.select("kind", "id", F.md5(F.array_join("ps.t", "")).alias("text_md5"), "too_long")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_pieces(spark, sf_dir).select("kind", "id").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.leximin_first(_vectors(spark, sf_dir))


def p5_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.leximin_ranking(checkpointed(_vectors(spark, sf_dir)))


def p6_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.clean_fields(table(spark, sf_dir, "parents"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_cleaned(spark, sf_dir).select("id", "field", F.explode("markup").alias("markup")).distinct()


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizing.token_ids(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of each document turned into text again."""
    return tokenizing.token_texts(p8_ids(spark, sf_dir), "doc_id")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizing.token_sizes(table(spark, sf_dir, "documents"), ["doc_id", "source"], "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.quotas(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))
    return plan.where("short").select("source")


def _mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = checkpointed(_sized(spark, sf_dir))
    return mixing.mixture(sized, mixing.quotas(sized, table(spark, sf_dir, "mix_targets")))


def p9_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the mixture of each source: repeats within the limit, tokens met, all documents used where the target is out of reach."""
    sized = checkpointed(_sized(spark, sf_dir))
    plan = mixing.quotas(sized, table(spark, sf_dir, "mix_targets"))
    used = mixing.mixture(sized, plan).groupBy("source").agg(
        F.max("times").alias("times"), F.min("times").alias("least"), F.max("tokens").alias("longest"), F.sum(F.col("tokens") * F.col("times")).alias("used")
    )
    shards = F.ceil(F.col("documents") / mixing.DOCUMENTS_PER_SHARD) + 1
    missed = F.abs(F.coalesce("used", F.lit(0)) - F.col("quota"))
    return plan.join(used, "source", "left").select(
        "source",
        (F.coalesce("times", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"),
        (missed <= F.col("block") + shards * F.coalesce("longest", F.lit(0))).alias("quota_met"),
    )


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(_mixture(spark, sf_dir))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.judged(table(spark, sf_dir, "documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).where("truncated").select("doc_id")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.rates(_judged(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_groups, p3_found, p3_repaired, p4_found, p4_pieces, p4_rebuilt, p5_found, p5_ranking, p6_found, p6_cleaned, p8_ids, p8_decoded, p9_found, p9_kept, p9_mixture, p9_shares, p10_found, p10_rates)
}

_P5 = """
with c as (
  select search_id, chunk_id, max(case when not isnan(bm25) then bm25 end) as bm25,
    max(case when not isnan(vector) then vector end) as vector, max(case when not isnan(rerank) then rerank end) as rerank,
    max(case when not isnan(hybrid) then hybrid end) as hybrid
  from scored_chunks where search_id is not null and chunk_id is not null group by search_id, chunk_id),
s as (unpivot c on bm25, vector, rerank, hybrid into name score value v),
r as (
  select search_id, chunk_id, score, rank() over (partition by search_id, score order by v)::double
    / count(*) over (partition by search_id, score) as p from s),
grid as (select c.search_id, c.chunk_id, n.score from c join (select distinct search_id, score from r) n on c.search_id = n.search_id),
vec as (
  select g.search_id, g.chunk_id, list_sort(list(coalesce(r.p, 0.0))) as v
  from grid g left join r on g.search_id = r.search_id and g.chunk_id = r.chunk_id and g.score = r.score
  group by g.search_id, g.chunk_id),
places as (select search_id, chunk_id, cast(row_number() over (partition by search_id order by v desc, chunk_id) as int) as place from vec)
"""

SQL = {
    "p4_found": """
select distinct 'parent' as kind, id from parents where length(content) > 4000
union all select distinct 'chunk' as kind, id from chunks where length(chunk_content) > 2000""",
    "p4_rebuilt": """
select distinct 'parent' as kind, id, md5(content) as text_md5, 0::bigint as too_long from parents where length(content) > 4000
union all select distinct 'chunk' as kind, id, md5(chunk_content), 0 from chunks where length(chunk_content) > 2000""",
    "p8_decoded": "select doc_id, coalesce(text, '') as text from documents",
    "p9_kept": "select distinct source, true as within_repeats, true as quota_met from mix_targets where source is not null",
    "p5_found": _P5 + "select search_id, chunk_id from places where place = 1",
    "p5_ranking": _P5 + "select * from places",
}

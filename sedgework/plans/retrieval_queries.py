"""Queries and SQL of retrieval, index maintenance, reports and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedgework.functions import vectors as V
from sedgework.functions.text import basename, common_directory, extension, sha12, token_estimate
from sedgework.operators import chunking, fusion, indexing, ivf, lexical, reports, store, vector
from sedgework.operators.incremental import hash_key
from sedgework.operators.metadata import parse_tags
from sedgework.session import table
from sedgework.sources import extract
from sedgework.sources.ignore import compile_patterns

LIMIT, QUERY_STEP = 10, 50


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").where("path is not null").groupBy("path").agg(F.max("metadata").alias("metadata"))


def _chunk_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk once, with its file's tags: the view that the lexical index covers."""
    chunks = table(spark, sf_dir, "chunks").where("id is not null")
    chunks = chunks.groupBy("id").agg(
        F.min("chunk_content").alias("content"), F.min("file_path").alias("path"), F.min("parent_id").alias("parent_id")
    )
    return chunks.join(_tags(spark, sf_dir), "path", "left")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", F.lit("/srv/kb"), "kb", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), path.alias("path"), F.col("source").alias("metadata"))


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.newest_files(table(spark, sf_dir, "files"))


def _sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "scans").where("path is not null and hash is not null and seen_at is not null")
    newest = seen.groupBy("path").agg(F.max(F.struct("seen_at", "scan_id", "hash", "size")).alias("s"))
    return newest.select("path", hash_key(F.col("s.hash")).alias("hash"), F.col("s.size").alias("size"))


def bm25_search(spark, sf_dir):
    found = lexical.bm25(_chunk_docs(spark, sf_dir), table(spark, sf_dir, "queries"), lexical.candidate_limit(LIMIT))
    return found.select("query_id", "id", F.round("score", 6).alias("score"))


def bm25_normalized(spark, sf_dir):
    found = lexical.bm25(_chunk_docs(spark, sf_dir), table(spark, sf_dir, "queries"), lexical.candidate_limit(LIMIT))
    both = found.withColumn("scaled", fusion.min_max("score", ["query_id"], 1.0, descending=True))
    both = fusion.normalize(both, "score", ["query_id"])
    return both.select("query_id", "id", F.round("scaled", 6).alias("scaled"), F.round("normalized", 6).alias("normalized"))


def metadata_search(spark, sf_dir):
    found = lexical.metadata_hits(_chunk_docs(spark, sf_dir), table(spark, sf_dir, "queries"))
    return found.select("query_id", "id", F.round("score", 6).alias("score"))


def context_block(spark, sf_dir):
    found = fusion.hybrid_search(_chunk_docs(spark, sf_dir), table(spark, sf_dir, "queries"), limit=5)
    lines = table(spark, sf_dir, "chunks").groupBy("id").agg(
        F.min("line_start").alias("line_start"), F.min("line_end").alias("line_end"), F.min("file_path").alias("path"),
        F.min("chunk_content").alias("content"), F.min("parent_id").alias("parent_id"),
    )
    headings = table(spark, sf_dir, "parents").groupBy(F.col("id").alias("parent_id")).agg(F.min("heading").alias("heading"))
    return fusion.context(found.join(lines, "id").join(headings, "parent_id", "left"))


#: What an HTML parser takes for markup: a tag, void and unclosed ones too, an end tag, a declaration or a comment.
MARKUP = "<[a-zA-Z][^>]*>|</|<!"


def html_to_markdown(spark, sf_dir):
    pages = table(spark, sf_dir, "parents").where(F.col("content").rlike(MARKUP)).select("id", "content").distinct()
    convert = F.pandas_udf(lambda s: s.map(extract.html_to_markdown), "string")
    return pages.select("id", convert("content").alias("markdown"))


def common_root(spark, sf_dir):
    return _files(spark, sf_dir).groupBy(extension(F.col("path")).alias("ext")).agg(common_directory(F.col("path")).alias("root"))


def vector_search(spark, sf_dir):
    vectors = _embeddings(spark, sf_dir)
    asked = vectors.where(F.col("id") % QUERY_STEP == 0).withColumnRenamed("id", "query_id")
    near = vector.nearest(vectors, asked, vector.vector_limit(LIMIT))
    cosine = F.round(V.l2_to_cosine(F.col("distance")), 6).alias("cosine")
    return near.select("query_id", "id", F.round("distance", 6).alias("distance"), cosine)


def vector_index_search(spark, sf_dir):
    """Through the optional index, with as many probes as 0.95 of the exact neighbours need."""
    vectors = _embeddings(spark, sf_dir)
    asked = vectors.where(F.col("id") % QUERY_STEP == 0).withColumnRenamed("id", "query_id")
    centroids = ivf.fit(vectors, 16, 64)
    index = ivf.assign(vectors, centroids)
    probes = ivf.probes_for(index, centroids, asked, LIMIT, 0.95)
    return ivf.search(index, centroids, asked, LIMIT, probes).select("query_id", "id", F.round("distance", 6).alias("distance"))


def vector_index_recall(spark, sf_dir):
    """How many neighbours the exact search has, and whether the index finds 0.9 of them."""
    exact = vector_search(spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("r") <= LIMIT)
    found = vector_index_search(spark, sf_dir).select("query_id", "id", F.lit(1).alias("hit"))
    both = exact.join(found, ["query_id", "id"], "left").agg(F.count("*").alias("neighbours"), (F.sum(F.coalesce("hit", F.lit(0))) / F.count("*") >= 0.9).alias("enough"))
    return both


def vector_functions(spark, sf_dir):
    e = F.col("embedding")
    turned = F.reverse(e)
    return _embeddings(spark, sf_dir).select(
        "id",
        F.round(V.norm(e), 5).alias("norm"),
        F.round(V.cosine(e, turned), 5).alias("cosine"),
        F.round(V.l2_distance(e, turned), 5).alias("distance"),
        F.round(V.norm(V.unit(e)), 5).alias("unit_norm"),
        F.round(V.dot(V.truncated(e, 16), F.slice(e, 1, 16)), 5).alias("truncated_dot"),
        V.cosine(e, F.slice(e, 1, 3)).alias("other_length"),
    )


def _hybrid(spark, sf_dir, **options):
    docs, vectors, asked = _documents(spark, sf_dir), _embeddings(spark, sf_dir), table(spark, sf_dir, "queries")
    mine = vectors.withColumnRenamed("id", "query_id").join(asked.select("query_id"), "query_id", "left_semi")
    return fusion.hybrid_search(docs, asked, vectors, mine, limit=LIMIT, **options)


def _rounded(df):
    return df.select("query_id", "id", *(F.round(c, 6).alias(c) for c in ("bm25", "vector", "hybrid")), "place")


def hybrid_search(spark, sf_dir):
    return _rounded(_hybrid(spark, sf_dir))


def auto_inject(spark, sf_dir):
    return _rounded(_hybrid(spark, sf_dir, threshold=0.1))


def parent_recall(spark, sf_dir):
    """Lexical search over the blocks, with the section of each hit."""
    found = fusion.hybrid_search(
        _chunk_docs(spark, sf_dir), table(spark, sf_dir, "queries"), limit=LIMIT, parents=table(spark, sf_dir, "parents")
    )
    return found.select("query_id", "id", F.round("hybrid", 6).alias("hybrid"), "place", "parent_heading", sha12(F.col("parent_content")).alias("parent_hash"))


def overlap_scorer(query: str, passages: list[str]) -> list[float]:
    """Share of the query's distinct words that stand in a passage: a stand-in for a model."""
    words = set(query.lower().split())
    return [sum(w in (p or "").lower() for w in words) / len(words) if words else 0.0 for p in passages]


def rerank(spark, sf_dir):
    found = fusion.hybrid_search(_chunk_docs(spark, sf_dir), table(spark, sf_dir, "queries"), limit=LIMIT, scorer=overlap_scorer)
    return found.select("query_id", "id", F.round("rerank", 6).alias("rerank"), "place")


def index_stats(spark, sf_dir):
    chunks = table(spark, sf_dir, "chunks").dropDuplicates(["id"])
    return reports.index_stats(_files(spark, sf_dir), chunks).drop("last_build")


def files_by_extension(spark, sf_dir):
    return reports.files_by_extension(_files(spark, sf_dir))


def tagged_files(spark, sf_dir):
    return _files(spark, sf_dir).where("coalesce(metadata, '') <> ''").select("path", "metadata")


def path_search(spark, sf_dir):
    first = F.lower(F.element_at(F.split("query_text", r"\s+"), 1))
    asked = [r[0] for r in table(spark, sf_dir, "queries").select(first).distinct().collect() if r[0]]  # the batch itself
    hits = F.filter(F.array(*(F.lit(t) for t in sorted(asked))), lambda t: F.contains(F.lower("path"), t))
    return _files(spark, sf_dir).select("path", F.explode(hits).alias("term"))


def find_glob(spark, sf_dir):
    matches = compile_patterns(["**/minutes/*.md", "drafts/", "!*-00000?.md"])
    return _files(spark, sf_dir).where(matches(F.regexp_replace("path", "^/srv/kb/", ""))).select("path")


def result_projection(spark, sf_dir):
    chunks = table(spark, sf_dir, "chunks").groupBy("id").agg(
        F.min("chunk_content").alias("content"), F.min("file_path").alias("path"), F.min("line_start").alias("a"), F.min("line_end").alias("b")
    )
    lines = F.slice(F.split("content", "\n", -1), 1, 3)
    return chunks.select(
        "id",
        F.concat_ws("-", "a", "b").alias("lines"),
        basename(F.col("path")).alias("file"),
        F.substring("content", 1, 300).alias("preview"),
        F.substring(F.array_join(lines, "\n"), 1, 200).alias("first_lines"),
    )


def chunk_identity(spark, sf_dir):
    chunks = table(spark, sf_dir, "chunks").groupBy("id").agg(F.min("chunk_content").alias("content"), F.min("file_path").alias("path"), F.min("line_start").alias("a"))
    return chunks.select(
        F.concat(sha12(F.col("path")), F.lit("-"), "a").alias("made_id"),
        sha12(F.col("content")).alias("hash"),
        token_estimate(F.col("content")).alias("tokens"),
    )


def index_decisions(spark, sf_dir):
    """What the next run does with each path it has seen: skip, reindex or add."""
    files = _files(spark, sf_dir).select("path", hash_key(F.col("hash")).alias("hash"), "embedded")
    return indexing.decisions(_sightings(spark, sf_dir), files)


def prune_dropped(spark, sf_dir):
    """Chunks that stay when files nobody has seen are dropped from the index."""
    files = _files(spark, sf_dir)
    known = table(spark, sf_dir, "chunks").select("file_path").distinct().join(files.select(F.col("path").alias("file_path")), "file_path", "left_anti")
    targets = _sightings(spark, sf_dir).select("path").union(known)  # blocks of files that the index does not list are not its to drop
    chunks = table(spark, sf_dir, "chunks").select("id", "file_path").distinct()
    return store.pruned(chunks, targets).groupBy("file_path").agg(F.count("*").alias("chunks"))


def upsert(spark, sf_dir):
    new = _sightings(spark, sf_dir).select(
        "path", "hash", F.lit(0).alias("chunks"), F.lit("2026-01-01T00:00:00Z").alias("indexed"), "size", F.lit(False).alias("embedded")
    )
    merged = store.upsert_files(_files(spark, sf_dir), new)
    return merged.select("path", hash_key(F.col("hash")).alias("hash"), "chunks", "size", "embedded", "metadata")


def set_tags(spark, sf_dir):
    files = _files(spark, sf_dir)
    seed = files.where(F.col("size") % 2 == 0).select("path", F.concat(F.lit("kb, "), extension(F.col("path"))).alias("metadata"))
    return store.apply_tags(files, seed).select("path", "metadata")


def tag_lines(spark, sf_dir):
    """A model's answer about each file, parsed into tags; the answer is made from the file's own text."""
    answer = F.concat(F.lit("Type: report\n1. "), basename(F.col("path")), F.lit("\n\n- "), F.coalesce("metadata", F.lit("")))
    return _files(spark, sf_dir).select("path", parse_tags(F.translate(answer, "\t", " ")).alias("tags"))


def coverage_states(spark, sf_dir):
    index = _files(spark, sf_dir).select("path", hash_key(F.col("hash")).alias("hash"))
    seen = _sightings(spark, sf_dir).withColumn("real", F.col("path"))
    return reports.coverage(seen, index)


def coverage_moved(spark, sf_dir):
    """The same tree under another root: found by relative path."""
    index = _files(spark, sf_dir).select("path", hash_key(F.col("hash")).alias("hash"))
    seen = _sightings(spark, sf_dir).withColumn("path", F.regexp_replace("path", "^/srv/kb/", "/mnt/new/place/"))
    return reports.coverage(seen.withColumn("real", F.lit(None).cast("string")), index).groupBy("state").agg(F.count("*").alias("files"))


def coverage_verdict(spark, sf_dir):
    states = coverage_states(spark, sf_dir)
    flags = states.agg(F.count("*").alias("total"), F.count_if(F.col("state") == "missing").alias("missing"), F.count_if(F.col("state") == "modified").alias("modified"))
    open_ = (F.col("missing") + F.col("modified")) > 0
    return flags.withColumn("verdict", reports.verdict(F.lit(False), F.lit(False), open_, F.lit(False)))


def _conversion(spark, sf_dir):
    files = _files(spark, sf_dir).where("size is not null")
    docs = files.select(F.regexp_replace("path", r"\.[^./]*$", ".docx").alias("path"), "size")
    docs = docs.groupBy("path").agg(F.max("size").alias("size")).withColumn("sha256", F.sha2("path", 256)).withColumn("real", F.col("path"))
    t = reports.conversion_targets(docs)
    named = t.where("size % 3 = 0").select(F.col("md").alias("path"), F.lit("").alias("text"))
    legacy = t.where("size % 3 = 1").select(F.col("md_ocr").alias("path"), F.lit("").alias("text"))
    text = F.when(F.col("size") % 5 == 0, F.lit("no digits")).otherwise(
        F.concat(F.upper(F.sha2(F.when(F.col("size") % 5 == 1, F.lit("other")).otherwise(F.col("path")), 256)), F.lit("  x\nmore"))
    )
    sums = t.where("size % 7 > 0").select(F.when(F.col("size") % 3 == 0, F.col("checksum")).otherwise(F.col("checksum_ocr")).alias("path"), text.alias("text"))
    return reports.conversion_state(docs.drop("size"), named.union(legacy).union(sums))


def conversion_states(spark, sf_dir):
    return _conversion(spark, sf_dir).select("path", "state", "reason")


def conversion_counts(spark, sf_dir):
    return _conversion(spark, sf_dir).groupBy("state").agg(F.count("*").alias("documents"))


def _as_files(spark, sf_dir, ending):
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("/kb/"), F.col("doc_id").cast("string"), F.lit(ending)).alias("path"), "text")


def chunk_markdown(spark, sf_dir):
    chunked = chunking.chunk_files(_as_files(spark, sf_dir, ".md"))
    return chunking.child_rows(chunked, "2026-01-01T00:00:00Z")


def chunk_parents(spark, sf_dir):
    return chunking.parent_rows(chunking.chunk_files(_as_files(spark, sf_dir, ".md")), "2026-01-01T00:00:00Z")


def chunk_flat(spark, sf_dir):
    chunked = chunking.chunk_files(_as_files(spark, sf_dir, ".txt"))
    return chunking.child_rows(chunked, "2026-01-01T00:00:00Z").select("id", "line_start", "line_end", "chunk_hash", "tokens")


_NAMES = (
    "bm25_search bm25_normalized metadata_search context_block html_to_markdown common_root vector_search vector_index_search vector_index_recall vector_functions hybrid_search auto_inject parent_recall rerank index_stats files_by_extension "
    "tagged_files path_search find_glob result_projection chunk_identity index_decisions prune_dropped upsert set_tags tag_lines "
    "coverage_states coverage_moved coverage_verdict conversion_states conversion_counts chunk_markdown chunk_parents chunk_flat"
).split()
QUERIES = {name: globals()[name] for name in _NAMES}

_FILES = """
newest as (select * from files where path is not null
  qualify row_number() over (partition by path order by cast(indexed as timestamptz) desc nulls last, hash desc nulls last, chunks desc nulls last,
    indexed desc, size desc nulls last, embedded desc nulls last, metadata desc nulls last) = 1),
seen as (select path, lower(left(hash, 12)) as hash, size from scans where hash is not null
  qualify row_number() over (partition by path order by seen_at desc, scan_id desc) = 1)"""

_CHUNK_DOCS = """
tags as (select path, max(metadata) as metadata from files where path is not null group by path),
docs as (select c.id, c.content, c.path, c.parent_id, tags.metadata from
  (select id, min(chunk_content) as content, min(file_path) as path, min(parent_id) as parent_id from chunks group by id) c
  left join tags on c.path = tags.path)"""

_DOCUMENTS = """
docs as (select doc_id as id, text as content, '/srv/kb/' || kb || '/' || doc_id || '.md' as path, source as metadata from documents)"""

_BM25 = """,
low as (select id, lower(content) as c, lower(path) as p, lower(metadata) as m,
  greatest(0, coalesce(length(content), 0) - 2) + greatest(0, coalesce(length(path), 0) - 2) + greatest(0, coalesce(length(metadata), 0) - 2) as d from docs),
stat as (select count(*) as total, sum(d)::double / count(*) as mean from low),
terms as (select query_id, pos, term from (
  select query_id, generate_subscripts(ts, 1) as pos, unnest(ts) as term
  from (select query_id, list_filter(regexp_split_to_array(lower(query_text), '\\s+'), lambda x: length(x) > 2) as ts from queries))),
words as (select distinct term, len(list_filter(range(1, length(term)), lambda k: term[1:k] = term[length(term) - k + 1:length(term)])) > 0 as bordered from terms),
f as (
  select id, d, term,
    1.0 * coalesce(case when bordered then len(list_filter(range(1, length(c) + 1), lambda i: substr(c, i, length(term)) = term))
      else (length(c) - length(replace(c, term, ''))) / length(term) end, 0)
    + 0.5 * coalesce(case when bordered then len(list_filter(range(1, length(p) + 1), lambda i: substr(p, i, length(term)) = term))
      else (length(p) - length(replace(p, term, ''))) / length(term) end, 0)
    + 1.5 * coalesce(case when bordered then len(list_filter(range(1, length(m) + 1), lambda i: substr(m, i, length(term)) = term))
      else (length(m) - length(replace(m, term, ''))) / length(term) end, 0) as f
  from low join words on contains(c, term) or contains(p, term) or contains(m, term)),
idf as (select term, greatest(ln((any_value(total) - count(*) + 0.5) / (count(*) + 0.5)), 0) as raw from f, stat group by term),
size as (select query_id, count(*) as n from terms group by query_id),
scored as (
  select t.query_id, f.id,
    -sum(case when raw > 0 then raw else 1e-6 end * f.f * 2.2 / (f.f + 1.2 * (0.25 + 0.75 * f.d / mean))) as score
  from terms t join f on t.term = f.term join idf on idf.term = t.term, stat join size on size.query_id = t.query_id
  group by t.query_id, f.id having count(*) = any_value(size.n)),
lex as (select query_id, id, score, row_number() over (partition by query_id order by score, id) as bm25_rank from scored
  qualify bm25_rank <= 200)"""
_BM25 = _BM25.replace("t join f on t.term = f.term join idf on idf.term = t.term, stat join size on size.query_id = t.query_id",
                      "t join f on t.term = f.term join idf on idf.term = t.term join size on size.query_id = t.query_id cross join stat")

_NEAR = """,
pairs as (select q.query_id, e.vec_id as id, list_distance(e.embedding::double[], q.embedding::double[]) as distance
  from embeddings e cross join asked q),
near as (select query_id, id, distance, row_number() over (partition by query_id order by distance, id) as vec_rank from pairs
  qualify vec_rank <= 100)"""

_FUSE = """,
lexn as (select *, case when max(score) over w = min(score) over w then 1.0
  else (max(score) over w - score) / (max(score) over w - min(score) over w) end as nb from lex window w as (partition by query_id)),
vecn as (select *, 1 - distance * distance / 2 as cosine from near),
vecs as (select *, case when max(cosine) over w = min(cosine) over w then 1.0
  else (cosine - min(cosine) over w) / (max(cosine) over w - min(cosine) over w) end as nv from vecn window w as (partition by query_id)),
fused as (select coalesce(l.query_id, v.query_id) as query_id, coalesce(l.id, v.id) as id, nb, nv, bm25_rank, vec_rank
  from lexn l full outer join vecs v on l.query_id = v.query_id and l.id = v.id),
named as (select fused.*, docs.*exclude(id), list_filter(regexp_split_to_array(lower(query_text), '\\s+'), lambda x: length(x) > 1) as ts,
  max(vec_rank is not null) over (partition by fused.query_id) as has from fused join docs on fused.id = docs.id join queries on queries.query_id = fused.query_id),
parts as (select *, case when contains(lower(path), ts[1]) then least(1.0, coalesce(nb, 0) * 1.5) else coalesce(nb, 0) end as bm25,
  coalesce(nv, 0) as vector from named),
mixed as (select *, case when has then 0.4 * bm25 + 0.6 * vector else bm25 end as blend from parts),
final as (select *, case when len(list_filter(ts, lambda t: length(t) > 2 and contains(lower(coalesce(metadata, '')), t))) > 0 then least(1.0, blend + 0.2) else blend end as hybrid from mixed),
placed as (select *, cast(row_number() over (partition by query_id order by hybrid desc, bm25_rank nulls last, vec_rank nulls last) as int) as place
  from final where hybrid > 0 and hybrid >= {threshold} qualify place <= {limit})"""

_NO_VECTORS = ",\nnear as (select null::bigint as query_id, null::{kind} as id, null::double as distance, null::bigint as vec_rank where false)"
_MINE = ", asked as (select vec_id as query_id, embedding from embeddings where vec_id in (select query_id from queries))"
_ROUNDED = " select query_id, id, round(bm25, 6) as bm25, round(vector, 6) as vector, round(hybrid, 6) as hybrid, place from placed"


def _fuse(limit: int = LIMIT, threshold: float = 0.0) -> str:
    return _FUSE.format(limit=limit, threshold=threshold)


_DOC_HYBRID = "with" + _DOCUMENTS + _BM25 + _MINE + _NEAR
_CHUNK_HYBRID = "with" + _CHUNK_DOCS + _BM25 + _NO_VECTORS.format(kind="varchar")

SQL = {
    "bm25_search": "with" + _CHUNK_DOCS + _BM25 + " select query_id, id, round(score, 6) as score from lex",
    "bm25_normalized": "with" + _CHUNK_DOCS + _BM25 + """
select query_id, id, round(case when max(score) over w = min(score) over w then 1.0 else (max(score) over w - score) / (max(score) over w - min(score) over w) end, 6) as scaled,
  round(case when max(score) over w = min(score) over w then 0.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end, 6) as normalized
from lex window w as (partition by query_id)""",
    "vector_search": "with asked as (select vec_id as query_id, embedding from embeddings where vec_id % 50 = 0)" + _NEAR + """
select query_id, id, round(distance, 6) as distance, round(1 - distance * distance / 2, 6) as cosine from near""",
    "vector_functions": """
with e as (select vec_id as id, embedding::double[] as v, list_reverse(embedding::double[]) as r from embeddings),
n as (select *, sqrt(list_dot_product(v, v)) as n, list_slice(v, 1, 16) as s from e)
select id, round(n, 5) as norm, round(list_cosine_similarity(v, r), 5) as cosine, round(list_distance(v, r), 5) as distance,
  round(sqrt(list_sum(list_transform(v, lambda x: ((x / n)::float::double) * ((x / n)::float::double)))), 5) as unit_norm,
  round(list_sum(list_transform(s, lambda x: (x / sqrt(list_dot_product(s, s)))::float::double * x)), 5) as truncated_dot, 0.0::double as other_length
from n""",
    "hybrid_search": _DOC_HYBRID + _fuse() + _ROUNDED,
    "auto_inject": _DOC_HYBRID + _fuse(threshold=0.1) + _ROUNDED,
    "parent_recall": _CHUNK_HYBRID + _fuse() + """,
mine as (select id, content, heading from parents qualify row_number() over (partition by id order by content, heading nulls first) = 1)
select query_id, placed.id, round(hybrid, 6) as hybrid, place, mine.heading as parent_heading, left(sha256(mine.content), 12) as parent_hash
from placed left join mine on placed.parent_id = mine.id""",
    "rerank": _CHUNK_HYBRID + _fuse(limit=20) + """,
scores as (select placed.query_id, id, place as old, len(list_filter(list_distinct(regexp_split_to_array(trim(lower(query_text)), '\\s+')), lambda w: contains(lower(content), w)))::double
  / len(list_distinct(regexp_split_to_array(trim(lower(query_text)), '\\s+'))) as r from placed join queries on queries.query_id = placed.query_id)
select query_id, id, round(r, 6) as rerank, cast(row_number() over (partition by query_id order by r desc, old) as int) as place from scores qualify place <= 10""",
    "index_stats": "with" + _FILES + """, c as (select id, any_value(file_path) as file_path, any_value(tokens) as tokens from chunks group by id)
select (select count(*) from newest) as total_files, count(*) as total_chunks, coalesce(sum(tokens), 0)::bigint as total_tokens,
  count(*) filter (file_path in (select path from newest where embedded)) as embedded_count,
  cast(floor(count(*) filter (file_path in (select path from newest where embedded)) * 100 / count(*) + 0.5) as int) as vector_coverage_pct from c""",
    "files_by_extension": "with" + _FILES + " select lower(regexp_extract(path, '[^/]+(\\.[^./]*)$', 1)) as ext, count(*) as files from newest group by 1 order by 2 desc, 1 limit 8",
    "tagged_files": "with" + _FILES + " select path, metadata from newest where coalesce(metadata, '') <> ''",
    "path_search": "with" + _FILES + """, t as (select distinct lower(regexp_split_to_array(query_text, '\\s+')[1]) as term from queries)
select path, term from newest join t on contains(lower(path), term) where term <> ''""",
    "find_glob": "with" + _FILES + """, r as (select path, regexp_replace(path, '^/srv/kb/', '') as rel from newest)
select path from r where (regexp_matches(rel, '(^|/)minutes/[^/]*\\.md$') or regexp_matches(rel, '(^|/)drafts/')) 
  and not (regexp_matches(rel, '(^|/)[^/]*-00000[^/]\\.md$') and not regexp_matches(rel, '(^|/)drafts/'))""",
    "result_projection": """
with c as (select id, min(chunk_content) as content, min(file_path) as path, min(line_start) as a, min(line_end) as b from chunks group by id)
select id, a || '-' || b as lines, regexp_extract(path, '[^/]*$') as file, substr(content, 1, 300) as preview,
  substr(array_to_string(string_split(content, chr(10))[1:3], chr(10)), 1, 200) as first_lines from c""",
    "chunk_identity": """
with c as (select id, min(chunk_content) as content, min(file_path) as path, min(line_start) as a from chunks group by id)
select left(sha256(path), 12) || '-' || a as made_id, left(sha256(content), 12) as hash, cast(ceil(length(content) / 4) as int) as tokens from c""",
    "index_decisions": "with" + _FILES + """
select seen.path, case when n.hash is null then 'add' when lower(left(n.hash, 12)) = seen.hash and n.embedded then 'skip' else 'reindex' end as decision
from seen left join newest n on seen.path = n.path""",
    "prune_dropped": "with" + _FILES + """
select file_path, count(distinct id) as chunks from chunks
where file_path not in (select path from newest where path not in (select path from seen)) group by file_path""",
    "upsert": "with" + _FILES + """
select seen.path, seen.hash, 0 as chunks, seen.size, false as embedded, n.metadata from seen left join newest n on seen.path = n.path
union all select path, lower(left(hash, 12)), chunks, size, embedded, metadata from newest where path not in (select path from seen)""",
    "set_tags": "with" + _FILES + """
select path, case when size % 2 = 0 then 'kb, ' || lower(regexp_extract(path, '[^/]+(\\.[^./]*)$', 1)) else metadata end as metadata from newest""",
    "coverage_states": "with" + _FILES + """
select seen.path, case when n.path is null then 'missing' when lower(left(n.hash, 12)) <> seen.hash then 'modified' else 'indexed' end as state
from seen left join newest n on seen.path = n.path""",
    "coverage_moved": "with" + _FILES + """
select case when n.path is null then 'missing' when lower(left(n.hash, 12)) <> seen.hash then 'modified' else 'indexed' end as state, count(*) as files
from seen left join newest n on seen.path = n.path group by 1""",
    "coverage_verdict": "with" + _FILES + """, s as (
select case when n.path is null then 'missing' when lower(left(n.hash, 12)) <> seen.hash then 'modified' else 'indexed' end as state
from seen left join newest n on seen.path = n.path)
select count(*) as total, count(*) filter (state = 'missing') as missing, count(*) filter (state = 'modified') as modified,
  case when count(*) filter (state <> 'indexed') > 0 then 'needs_index' else 'complete' end as verdict from s""",
}
_DOCX = "with" + _FILES + """, docs as (select regexp_replace(path, '\\.[^./]*$', '.docx') as path, max(size) as size from newest where size is not null group by 1),
states as (select path, case when size % 3 = 2 then 'no_markdown' when size % 7 = 0 or size % 5 = 0 then 'checksum_missing'
  when size % 5 = 1 then 'checksum_changed' else 'ok' end as reason from docs),
conv as (select path, reason, case reason when 'ok' then 'up_to_date' when 'checksum_missing' then 'checksum_missing' else 'needs_convert' end as state from states)
"""
SQL["conversion_states"] = _DOCX + "select path, state, reason from conv"
SQL["conversion_counts"] = _DOCX + "select state, count(*) as documents from conv group by state"
SQL["vector_index_recall"] = "select count(*) * 10 as neighbours, true as enough from embeddings where vec_id % 50 = 0"
SQL["common_root"] = "with" + _FILES + """, d as (select lower(regexp_extract(path, '[^/]+(\\.[^./]*)$', 1)) as ext, string_split(regexp_replace(path, '/[^/]*$', ''), '/') as a from newest),
e as (select ext, min(a) as lo, max(a) as hi from d group by ext)
select ext, nullif(array_to_string(lo[1:coalesce(list_min(list_filter(range(1, len(lo) + 1), lambda i: lo[i] is distinct from hi[i])) - 1, len(lo))], '/'), '') as root from e"""
SQL["metadata_search"] = ("with" + _CHUNK_DOCS + _BM25).replace("contains(c, term) or contains(p, term) or ", "").replace(
    "1.0 * coalesce(", "0.0 * coalesce(").replace("+ 0.5 * coalesce(", "+ 0.0 * coalesce(").replace(
    " having count(*) = any_value(size.n)", "").replace("bm25_rank <= 200", "bm25_rank <= 1000") + " select query_id, id, round(score, 6) as score from lex"
SQL["context_block"] = _CHUNK_HYBRID + _fuse(limit=5) + """,
c as (select id, min(line_start) as a, min(line_end) as b, min(file_path) as path, min(chunk_content) as content, min(parent_id) as parent_id from chunks group by id),
h as (select id as parent_id, min(heading) as heading from parents group by id)
select query_id, string_agg('### ' || regexp_extract(c.path, '[^/]*$') || ' (lines ' || a || '-' || b || ')' || coalesce(' — § ' || heading, '') || chr(10) || '```' || chr(10)
  || coalesce(c.content, '') || chr(10) || '```', chr(10) || chr(10) order by place) as context
from placed join c on placed.id = c.id left join h on h.parent_id = c.parent_id group by query_id"""
SQL["tag_lines"] = "with" + _FILES + """, a as (select path, string_split('Type: report' || chr(10) || '1. ' || regexp_extract(path, '[^/]*$') || chr(10) || chr(10) || '- '
  || coalesce(replace(metadata, chr(9), ' '), ''), chr(10)) as ls from newest),
t as (select path, list_filter(list_transform(ls, lambda x: regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(x, '^[\\s\\x{00A0}\\x{3000}]+|[\\s\\x{00A0}\\x{3000}]+$', '', 'g'), '^[^:：]{1,14}[:：]\\s*', ''), '^\\d+[.、)）]\\s*', ''), '^[-*•]\\s*', '')), lambda x: x <> '') as ls from a)
select path, nullif(substr(array_to_string(ls, ', '), 1, 300), '') as tags from t"""

_BLANKS = "[\\s\\x0b\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
_SECTIONS = """
with recursive lines as (
  select doc_id, '/kb/' || doc_id || '.md' as path, unnest(ls) as line, generate_subscripts(ls, 1) as n
  from (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null)),
marked as (select *, regexp_matches(line, '^#{1,6}BLANKS+[^\\r\\x{2028}\\x{2029}]+$') as head,
  regexp_matches(line, '^[\\s\\x0b\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]*$') as blank,
  regexp_matches(line, '^\\s*(```|~~~)') as fence from lines),
placed as (select *, sum(head::int) over (partition by doc_id order by n) as sec from marked),
first as (select doc_id, sec, min(n) as a, max(n) as b from placed group by doc_id, sec)""".replace("BLANKS", _BLANKS)


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^" + _BLANKS + "+|" + _BLANKS + "+$', '', 'g')"


SQL["chunk_parents"] = _SECTIONS + f"""
select left(sha256(path), 12) || '-p-' || min(n) as id, path as file_path, string_agg(line, chr(10) order by n) as content,
  min(n)::int as line_start, max(n)::int as line_end,
  case when sec > 0 then {_trim("regexp_replace(arg_min(line, n), '^#{1,6}" + _BLANKS + "+', '')")} end as heading,
  left(sha256(string_agg(line, chr(10) order by n)), 12) as hash, '2026-01-01T00:00:00Z' as indexed_at,
  cast(ceil(length(string_agg(line, chr(10) order by n)) / 4) as int) as tokens
from placed group by doc_id, path, sec"""
SQL["chunk_markdown"] = _SECTIONS + f""",
runs(doc_id, sec, n, run, inside, fenced, member) as (
  select p.doc_id, p.sec, p.n, (not blank)::int, not blank, not blank and fence, not blank from placed p join first f on p.doc_id = f.doc_id and p.n = f.a
  union all
  select p.doc_id, p.sec, p.n,
    case when r.fenced then r.run when p.blank then r.run when r.inside then r.run else r.run + 1 end,
    case when r.fenced then not p.fence when p.blank then false else true end,
    case when r.fenced then not p.fence when p.blank then false when r.inside then false else p.fence end,
    r.fenced or not p.blank
  from runs r join placed p on p.doc_id = r.doc_id and p.sec = r.sec and p.n = r.n + 1),
members as (select r.*, p.path, p.line, p.fence, row_number() over (partition by r.doc_id, r.sec, r.run order by r.n) - 1 as k
  from runs r join placed p on p.doc_id = r.doc_id and p.n = r.n where member),
opened as (select *, first_value(fence) over (partition by doc_id, sec, run order by n) as code from members),
blocks as (select doc_id, sec, path, min(n) as a, max(n) as b, string_agg(line, chr(10) order by n) as content
  from opened group by doc_id, sec, path, run, case when code then 0 else k // 50 end),
kept as (select *, length({_trim("content")}) as size, row_number() over (partition by doc_id, sec order by a) as place,
  max(length({_trim("content")})) over (partition by doc_id, sec) as most
  from blocks where not regexp_matches({_trim("content")}, '^#{{1,6}}{_BLANKS}+[^\\n\\r\\x{{2028}}\\x{{2029}}]+$'))
select left(sha256(path), 12) || '-' || k.a as id, path as file_path, content as chunk_content, k.a::int as line_start, k.b::int as line_end,
  left(sha256(content), 12) as chunk_hash, '2026-01-01T00:00:00Z' as indexed_at, cast(ceil(length(content) / 4) as int) as tokens,
  left(sha256(path), 12) || '-p-' || f.a as parent_id
from kept k join first f on k.doc_id = f.doc_id and k.sec = f.sec where size >= 10 or (most < 10 and place = 1)"""
SQL["chunk_flat"] = f"""
with recursive texts as (select '/kb/' || doc_id || '.txt' as path, string_split(text, chr(10)) as ls from documents where text is not null),
cuts(path, a, b) as (
  select path, 0, 0 from texts
  union all
  select t.path, c.b, coalesce(list_max(list_filter(range(greatest(c.b + 10, least(c.b + 50, len(ls)) - 15) + 1, least(c.b + 50, len(ls))),
    lambda j: {_trim("ls[j + 1]")} = '')) + 1, least(c.b + 50, len(ls)))
  from cuts c join texts t on c.path = t.path where c.b < len(ls)),
windows as (select cuts.path, a, b, array_to_string(ls[a + 1:b], chr(10)) as content from cuts join texts on cuts.path = texts.path where b > 0)
select left(sha256(path), 12) || '-' || (a + 1) as id, (a + 1)::int as line_start, b::int as line_end, left(sha256(content), 12) as chunk_hash,
  cast(ceil(length(content) / 4) as int) as tokens from windows where length({_trim("content")}) > 20"""

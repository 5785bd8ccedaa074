"""What a program that uses the index asks for: index, query, status, conversion state, coverage, find."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgework.functions.text import basename
from sedgework.operators import completion, fusion, indexing, reports
from sedgework.operators.embedding import Embedder
from sedgework.operators.store import IndexStore
from sedgework.sources.config import Config
from sedgework.sources.files import collect_files, resolve_extensions
from sedgework.sources.ignore import compile_patterns

PREVIEW_CHARS = 300


def listing(store: IndexStore, config: Config, roots: list[str] | None = None) -> DataFrame:
    """The files of the tracked paths, or of ``roots``."""
    extensions = resolve_extensions(config.extra_extensions, config.exclude_extensions)
    return collect_files(store.spark, roots or config.tracked_paths, extensions, config.exclude_patterns)


def index(store: IndexStore, config: Config, roots: list[str], now: str, embedder: Embedder | None = None, force: bool = False) -> indexing.Summary:
    return indexing.index_files(store, listing(store, config, roots), embedder, now, force)


def refreshed(store: IndexStore, config: Config, now: str, embedder: Embedder | None = None) -> bool:
    """Index what has changed if the last run is more than 24 hours before ``now``; whether it was so."""
    stale = reports.is_stale(F.lit(store.value("last_build")).cast("string"), F.lit(now))
    if not config.tracked_paths or not store.spark.range(1).select(stale).first()[0]:
        return False
    indexing.index_files(store, listing(store, config), embedder, now)
    return True


def query(
    store: IndexStore, text: str, config: Config, limit: int | None = None, embedder: Embedder | None = None,
    scorer: Callable[[str, list[str]], list[float]] | None = None, now: str | None = None,
) -> DataFrame:
    """Rows ``place, file, path, lines, section, child_lines, preview, bm25, vector, hybrid, rerank`` in order.

    Scores are text with three decimals, ``lines`` those of the section if the hit
    has one, else of the block. With an embedder the search is hybrid, else it is by
    words; a stale index is refreshed first if ``now`` is given. An index that is
    switched off gives no rows.
    """
    if now is not None and config.enabled:
        refreshed(store, config, now, embedder)
    spark, limit = store.spark, limit or config.top_k
    files = store.table("files").select("path", "metadata")
    chunks = store.table("chunks")
    docs = chunks.join(files, F.col("file_path") == F.col("path"), "left").select(
        "id", F.col("chunk_content").alias("content"), F.col("file_path").alias("path"), "metadata", "parent_id"
    )
    asked = spark.createDataFrame([(0, text)] if config.enabled else [], "query_id long, query_text string")
    vectors = mine = None
    if embedder is not None and config.enabled:
        own = embedder([text])
        vectors = store.table("vectors").select("id", "embedding")
        mine = spark.createDataFrame([(0, [float(x) for x in own[0]])] if own and own[0] else [], "query_id long, embedding array<float>")
    found = fusion.hybrid_search(
        docs, asked, vectors, mine, limit=limit, alpha=config.alpha, parents=store.table("parents"), scorer=scorer
    )
    blocks = chunks.select("id", "parent_id", "file_path", "chunk_content", F.col("line_start").alias("_a"), F.col("line_end").alias("_b"))
    sections = store.table("parents").select(F.col("id").alias("parent_id"), F.col("line_start").alias("_c"), F.col("line_end").alias("_d"))
    rows = found.join(blocks, "id").join(sections, "parent_id", "left")
    three = lambda c: F.format_string("%.3f", F.col(c)).alias(c)
    own_lines, section_lines = F.concat_ws("-", "_a", "_b"), F.when(F.col("_c").isNotNull(), F.concat_ws("-", "_c", "_d"))
    return rows.select(
        "place",
        basename(F.col("file_path")).alias("file"),
        F.col("file_path").alias("path"),
        F.coalesce(section_lines, own_lines).alias("lines"),
        F.col("parent_heading").alias("section"),
        F.when(section_lines.isNotNull(), own_lines).alias("child_lines"),
        F.substring(F.coalesce("parent_content", "chunk_content"), 1, PREVIEW_CHARS).alias("preview"),
        three("bm25"), three("vector"), three("hybrid"),
        F.when(F.col("rerank").isNotNull(), F.format_string("%.3f", F.col("rerank"))).alias("rerank"),
    ).orderBy("place")


def find(files: DataFrame, pattern: str, folder: str) -> DataFrame:
    """``path`` of indexed files that match, in order: by their path below ``folder``, others by their name."""
    below = folder.rstrip("/") + "/"
    at = F.when(F.startswith("path", F.lit(below)), F.substr("path", F.lit(len(below) + 1))).otherwise(basename(F.col("path")))
    return files.where(compile_patterns([pattern])(at)).select("path").orderBy("path")


def status(store: IndexStore) -> DataFrame:
    return indexing.stats(store)


def conversion(store: IndexStore, root: str, patterns: list[str] | None = None) -> DataFrame:
    return completion.conversion_state(store.spark, root, patterns)


def coverage(store: IndexStore, root: str, patterns: list[str] | None = None) -> dict:
    return completion.coverage(store.spark, store, root, patterns)

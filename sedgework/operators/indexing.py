"""Indexing runs: scan, skip what is unchanged, read, chunk, embed, commit at once."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgework.operators import chunking, reports
from sedgework.operators.embedding import Embedder, embed_rows
from sedgework.operators.store import IndexStore
from sedgework.session import checkpointed
from sedgework.sources.extract import read_files


@dataclass(frozen=True)
class Summary:
    indexed: int
    chunks: int
    skipped: int
    duration_ms: int = field(default=0, compare=False)


def decisions(seen: DataFrame, files: DataFrame, embed: bool = True) -> DataFrame:
    """``path, decision`` of ``seen(path, hash)``: ``add`` if the path is new, ``skip`` if nothing is to be done, else ``reindex``."""
    todo = changed(seen.select("path", "hash"), files, embed=embed).select("path", F.lit(True).alias("_todo"))
    known = files.select("path", F.lit(True).alias("_known")).distinct()
    rows = seen.where("hash is not null").join(todo, "path", "left").join(known, "path", "left")
    return rows.select("path", F.when(F.col("_known").isNull(), "add").when(F.col("_todo"), "reindex").otherwise("skip").alias("decision"))


def changed(read: DataFrame, files: DataFrame, force: bool = False, embed: bool = True) -> DataFrame:
    """Rows to index: all if forced, else those whose hash differs or, in a run that embeds, that are not embedded. Unreadable files are skipped."""
    read = read.where("hash is not null")
    if force:
        return read
    done = (files.where("embedded") if embed else files).select("path", F.col("hash").alias("_h"))
    return read.join(done, (read.path == done.path) & (read.hash == done["_h"]), "left_anti")


def stored_paths(listing: DataFrame, files: DataFrame) -> DataFrame:
    """``listing`` under the path that the index already has for the same real file, the first by path; else its own."""
    known = files.groupBy(F.coalesce("real", "path").alias("real")).agg(F.min("path").alias("_stored")) if "real" in files.columns else None
    first = listing.groupBy("real").agg(F.min(F.struct("path", *[c for c in listing.columns if c not in ("path", "real")])).alias("r"))
    rows = first.select("real", "r.*")
    if known is None:
        known = files.select(F.col("path").alias("real"), F.col("path").alias("_stored"))
    return rows.join(known, "real", "left").withColumn("path", F.coalesce("_stored", "path")).drop("_stored")


def index_files(store: IndexStore, listing: DataFrame, embedder: Embedder | None, now: str, force: bool = False, read_pdf=None, ocr=None, progress=None, model: str | None = None) -> Summary:
    """One run over ``listing(path, real, size)``.

    Everything is read and embedded before the index changes, in one commit. A
    failure leaves the index as it was. Files without a chunk are indexed all the
    same, so that they are skipped the next time. ``progress(stage, rows)`` is called
    after each of the stages read, chunk, embed and commit.

    A file counts as embedded only if each of its chunks has a vector. Without an
    embedder none does: the next run that has one takes these files again. ``model``
    is the name of what the embedder asks; it is kept with the index.
    """
    told = progress or (lambda stage, rows: None)
    began = time.monotonic()
    listing = stored_paths(listing, store.table("files"))
    read = checkpointed(read_files(listing, read_pdf, ocr))
    seen = read.count()
    told("read", seen)
    todo = checkpointed(changed(read, store.table("files"), force, embedder is not None))
    chunked = chunking.chunk_files(todo.select("path", "text"))
    parents, chunks = checkpointed(chunking.parent_rows(chunked, now)), checkpointed(chunking.child_rows(chunked, now))
    made = chunks.count()
    told("chunk", made)
    vectors = None
    if embedder is not None:
        vectors = checkpointed(embed_rows(chunks.select("id", "file_path", "chunk_content"), "chunk_content", embedder)).where("size(embedding) > 0").select("id", "file_path", "embedding")
        told("embed", made)
    counts = chunks.groupBy(F.col("file_path").alias("path")).agg(F.count("*").cast("int").alias("chunks"))
    rows = todo.join(counts, "path", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    embedded = F.lit(False)
    if vectors is not None:
        rows = rows.join(vectors.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("_vectors")), "path", "left")
        embedded = F.coalesce("_vectors", F.lit(0)) == F.col("chunks")
    files = rows.select("path", "hash", "chunks", F.lit(now).alias("indexed"), "size", embedded.alias("embedded"))
    files = checkpointed(files)
    done = files.count()
    values = {"last_build": now} | ({"embedding_model": model} if model and embedder else {})
    if done:
        store.replace_files(files, parents, chunks, vectors, values)
    elif seen:  # a run that finds nothing changed makes the index fresh, too
        store.set_value("last_build", now)
    told("commit", done)
    return Summary(done, made, seen - done, round((time.monotonic() - began) * 1000))


def still_there(files: DataFrame) -> DataFrame:
    """``path, real, size`` of the indexed files that exist; looked up by tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(p, os.path.realpath(p), os.path.getsize(p)) for p in pdf["path"] if os.path.isfile(p)]
            yield pd.DataFrame(found, columns=["path", "real", "size"])

    return files.select("path").mapInPandas(run, "path string, real string, size long")


def rebuild(store: IndexStore, listing: DataFrame, embedder: Embedder | None, now: str, force: bool = False, model: str | None = None) -> Summary:
    """Files that neither are listed nor exist go; the others are embedded again if there is an embedder, or read as new if forced."""
    listing = checkpointed(listing.unionByName(still_there(store.table("files"))).dropDuplicates(["path"]))
    if force:
        store.clear()
    else:
        store.prune(listing)
        store.commit(files=store.table("files").withColumn("embedded", F.lit(False)))
    return index_files(store, listing, embedder, now, force=True, model=model)


def stats(store: IndexStore) -> DataFrame:
    return reports.index_stats(store.table("files"), store.table("chunks"), store.table("vectors").count(), store.value("last_build"))

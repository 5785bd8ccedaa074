"""Listing files: a pruned walk that runs on the executors, and the filters on it."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgework.sources.ignore import excluded

# Fixed values of the format.
MARKDOWN = frozenset({".md", ".markdown"})
BINARY = frozenset({".pdf", ".docx"})
TEXT_BYTES, BINARY_BYTES = 500_000, 10_000_000
SKIPPED = frozenset("node_modules .git .next dist build __pycache__ .venv venv .cache".split())


def normalize_extension(ext: str) -> str | None:
    ext = ext.strip().lower()
    return None if not ext else ext if ext.startswith(".") else f".{ext}"


def resolve_extensions(extra: Iterable[str] = (), without: Iterable[str] = ()) -> frozenset[str]:
    """Markdown and the extra extensions, without the excluded ones; blank entries are ignored."""
    plus, minus = ({e for x in xs if (e := normalize_extension(x))} for xs in (extra, without))
    return frozenset((MARKDOWN | plus) - minus)


def _ext(name: str) -> str:
    return os.path.splitext(name)[1].lower()


def acceptable(name: str, size: int, extensions: frozenset[str]) -> bool:
    ext = _ext(name)
    return ext in extensions and size < (BINARY_BYTES if ext in BINARY else TEXT_BYTES)


def walk(root: str, extensions: frozenset[str], patterns: list[str]) -> Iterator[tuple[str, str, int]]:
    """``path, real, size`` of acceptable files below a root, or of the root itself if it is a file.

    Skipped directories, hidden ones, links to directories and excluded paths are
    not entered; what cannot be read is left out, a missing root gives nothing.
    """
    if os.path.isfile(root):
        if acceptable(root, os.path.getsize(root), extensions) and not excluded(os.path.basename(root), patterns):
            yield root, os.path.realpath(root), os.path.getsize(root)
        return
    stack = [root]
    while stack:
        try:
            with os.scandir(stack.pop()) as entries:
                ordered = sorted(entries, key=lambda e: e.name)
        except OSError:
            continue
        for e in ordered:
            try:
                if e.is_dir(follow_symlinks=False):
                    hidden = e.name in SKIPPED or e.name.startswith(".")
                    if not hidden and not excluded(os.path.relpath(e.path, root) + "/", patterns):
                        stack.append(e.path)
                elif not e.is_dir():
                    size = e.stat().st_size
                    if acceptable(e.name, size, extensions) and not excluded(os.path.relpath(e.path, root), patterns):
                        yield e.path, os.path.realpath(e.path), size
            except OSError:
                continue


def collect_files(
    spark: SparkSession, roots: list[str], extensions: frozenset[str] = MARKDOWN, patterns: list[str] | None = None
) -> DataFrame:
    """``path, real, size`` of all roots, each path once. Roots are walked by tasks, so they must be on shared storage."""
    patterns = patterns or []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for root in pdf["root"]:
                found = list(walk(root, extensions, patterns))
                yield pd.DataFrame(found, columns=["path", "real", "size"])

    schema = "path string, real string, size long"
    if not roots:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(r,) for r in roots], "root string").repartition(min(len(roots), 64))
    return listed.mapInPandas(run, schema).dropDuplicates(["path"])


def object_store_files(spark: SparkSession, root: str, extensions: frozenset[str] = MARKDOWN) -> DataFrame:
    """``path, size, content`` by Spark's own listing, for stores without directories to walk.

    Size limits and extensions are filters on the listing, so excluded files are not
    read. Spark leaves out names that begin with a dot or an underscore.
    """
    path, limit = F.col("path"), F.lit(TEXT_BYTES)
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    size_ok = F.col("length") < F.when(ext.isin(*BINARY), F.lit(BINARY_BYTES)).otherwise(limit)
    hidden = path.rlike(rf"/(?:{'|'.join(s.replace('.', chr(92) + '.') for s in sorted(SKIPPED))}|\.[^/]+)/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.where(ext.isin(*extensions) & size_ok & ~hidden).select("path", F.col("length").alias("size"), "content")

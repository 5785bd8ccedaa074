"""Completing an index: convert documents, write checksums, index what is missing."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgework.operators import reports
from sedgework.operators.indexing import Summary, index_files
from sedgework.operators.indexing import stats as index_stats
from sedgework.operators.store import IndexStore
from sedgework.session import checkpointed
from sedgework.sources.extract import read_files
from sedgework.sources.files import collect_files, resolve_extensions

LISTED = 1000

#: Runs a converter on (document, Markdown target); returns (succeeded, error text).
Runner = Callable[[str, str], tuple[bool, str]]


@dataclass(frozen=True)
class Outcome:
    file: str
    action: str  # converted, converted by ocr, checksum, failed
    detail: str = ""


def write_checksum(document: str, target: str) -> None:
    digest = hashlib.sha256(Path(document).read_bytes()).hexdigest()
    Path(target).write_text(f"{digest}  {Path(document).name}\n", encoding="utf-8")


def convert(document: str, target: str, run: Runner, ocr: Runner | None = None) -> Outcome:
    """The converter, then OCR if the converter says that it is needed; a failure is an outcome, never raised."""
    try:
        Path(target).parent.mkdir(parents=True, exist_ok=True)
        ok, error = run(document, target)
        action = "converted"
        if not ok and ocr and "OCR" in error:
            ok, error = ocr(document, target)
            action = "converted by ocr"
        if not ok:
            return Outcome(document, "failed", error)
        write_checksum(document, str(Path(target).parent / f"{Path(document).name}.sha256"))
        return Outcome(document, action)
    except Exception as e:  # noqa: BLE001 - one document must not stop the others
        return Outcome(document, "failed", str(e))


def conversion_state(spark: SparkSession, root: str, patterns: list[str] | None = None) -> DataFrame:
    """State of every convertible document below a root."""
    docs = read_files(collect_files(spark, [root], reports.CONVERTIBLE, patterns), lambda b: ("", 1))
    sidecars = collect_files(spark, [root], frozenset({".sha256", ".md"}), None)
    texts = read_files(sidecars).select("path", "text")
    hashed = docs.select("path", "real", "sha256")
    return reports.conversion_state(hashed, texts)


def coverage(spark: SparkSession, store: IndexStore, root: str, patterns: list[str] | None = None, now: str | None = None) -> dict:
    """Totals, statistics of the index, the first missing and modified Markdown files, and a verdict.

    Lists hold at most ``LISTED`` paths relative to the root, in order; counts are complete.

    ``stale``: the last run is more than 24 hours before ``now``, the present time if not given.
    """
    listing = read_files(collect_files(spark, [root], resolve_extensions(), patterns)).select("path", "real", "hash")
    states = checkpointed(reports.coverage(listing, store.table("files").select("path", "hash")))
    counts = dict(states.groupBy("state").count().collect())
    docs = dict(conversion_state(spark, root, patterns).groupBy("state").count().collect())
    inside = lambda p: str(Path(p).relative_to(root)) if Path(p).is_relative_to(root) else p
    first = lambda s: [inside(r.path) for r in states.where(F.col("state") == s).orderBy("path").limit(LISTED).collect()]
    by = {s: first(s) for s in ("missing", "modified")}
    missing, modified = counts.get("missing", 0), counts.get("modified", 0)
    open_ = missing + modified > 0
    at = F.lit(now) if now else F.current_timestamp()
    flags = [F.lit(bool(x)) for x in (docs.get("needs_convert"), docs.get("checksum_missing"), open_)]
    stale = reports.is_stale(F.lit(store.value("last_build")).cast("string"), at)
    row = spark.range(1).select(stale.alias("stale"), reports.verdict(*flags, stale).alias("verdict")).first()
    total = sum(counts.values())
    own = index_stats(store).first()
    held = {k: own[k] for k in ("total_chunks", "total_tokens", "embedded_count", "vector_coverage_pct", "last_build")}
    return {
        "total": total, "indexed": total - missing, "missing_count": missing, "modified_count": modified, **by, "documents": docs, **held,
        "embedding_model": store.value("embedding_model"), "stale": row["stale"], "verdict": row["verdict"],
    }


def complete(
    spark: SparkSession, store: IndexStore, root: str, now: str, run: Runner, ocr: Runner | None = None, embedder=None
) -> tuple[list[Outcome], Summary, dict, dict]:
    """Outcomes, the indexing run, and coverage before and after."""
    before = coverage(spark, store, root, now=now)
    outcomes = []
    todo = checkpointed(conversion_state(spark, root).where("state <> 'up_to_date'"))  # as it is before anything is written
    for row in todo.toLocalIterator():
        if row.state == "checksum_missing":
            write_checksum(row.path, str(Path(row.target_md).parent / f"{Path(row.path).name}.sha256"))
            outcomes.append(Outcome(row.path, "checksum"))
        elif row.state == "needs_convert":
            outcomes.append(convert(row.path, row.target_md, run, ocr))
    summary = index_files(store, collect_files(spark, [root], resolve_extensions()), embedder, now)
    return outcomes, summary, before, coverage(spark, store, root, now=now)

"""Entity tags of files: seed files, parsing of a model's answers, generation through a hook."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path, PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgework.functions.text import trimmed
from sedgework.operators.embedding import _post
from sedgework.operators.store import IndexStore
from sedgework.session import checkpointed

MOST_CHARS, CONTENT_CHARS = 300, 1500
SEED_NAME = "sedgework-tags.json"
# Fixed values of the format: what a line of a model's answer may begin with.
LABEL, NUMBER, BULLET = r"^[^:：]{1,14}[:：]\s*", r"^\d+[.、)）]\s*", r"^[-*•]\s*"


def load_seed(spark: SparkSession, path: str, root: str) -> DataFrame:
    """``path, metadata`` of a JSON map from path to tags; blank and non-text values are skipped, paths resolved against ``root``.

    A file that is no JSON map gives no rows.
    """
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", "map<string,variant>")).alias("key", "v"))
    pairs = pairs.where(F.schema_of_variant("v") == "STRING").select("key", F.try_variant_get("v", "$", "string").alias("tags"))
    absolute = F.when(F.startswith("key", F.lit("/")), F.col("key")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace("key", r"^\./", "")))
    return pairs.select(absolute.alias("path"), trimmed(F.col("tags")).alias("metadata")).where("metadata <> ''")


def save_seed(tags: dict[str, str], root: str) -> str:
    """JSON with paths relative to the root: the seed is a small configuration file."""
    base = PurePosixPath(root)
    inside = {str(PurePosixPath(p).relative_to(base)) if PurePosixPath(p).is_relative_to(base) else p: t for p, t in tags.items()}
    return json.dumps(inside, ensure_ascii=False, indent=2) + "\n"


def seed_matches(seed: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seed rows of indexed files, and those whose path the index does not know."""
    known = files.select("path").distinct()
    return seed.join(known, "path", "left_semi"), seed.join(known, "path", "left_anti")


def write_seed(tags: DataFrame, path: str, root: str) -> int:
    """Write ``tags(path, metadata)`` as a seed file; how many. A seed is configuration that people edit, a row per tagged file."""
    rows = {r["path"]: r["metadata"] for r in tags.where("coalesce(metadata, '') <> ''").orderBy("path").select("path", "metadata").collect()}
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    staged = Path(f"{path}.staged")
    staged.write_text(save_seed(rows, root), encoding="utf-8")
    staged.replace(path)
    return len(rows)


def apply_seed(store: IndexStore, path: str, root: str) -> dict[str, int]:
    """Tags of a seed file into the index: how many files got tags, and how many paths it does not know. Without a file, none."""
    if not Path(path).exists():
        return {"applied": 0, "unknown": 0}
    known, unknown = seed_matches(load_seed(store.spark, path, root), store.table("files"))
    count = known.count()
    if count:
        store.set_metadata(known)
    return {"applied": count, "unknown": unknown.count()}


def generate_seed(store: IndexStore, path: str, root: str, ask: Callable[[str, str], str | None]) -> dict[str, int]:
    """Ask about each indexed file with blocks that has no tags yet, merge with the seed file, write it and apply it.

    What the file says already is kept. The text that is asked about is that of the
    file's first blocks.
    """
    there = load_seed(store.spark, path, root) if Path(path).exists() else store.spark.createDataFrame([], "path string, metadata string")
    open_ = store.table("files").where("chunks > 0").select("path").join(there, "path", "left_anti")
    first = F.array_sort(F.collect_list(F.struct("line_start", F.substring("chunk_content", 1, CONTENT_CHARS).alias("t"))))
    texts = store.table("chunks").where(f"line_start <= {CONTENT_CHARS}").groupBy(F.col("file_path").alias("path")).agg(first.alias("b"))
    texts = open_.join(texts, "path").select("path", F.array_join("b.t", "\n").alias("content"))
    made = checkpointed(generate_tags(texts, ask))
    write_seed(there.unionByName(made), path, root)
    return {"generated": made.count()} | apply_seed(store, path, root)


def http_asker(url: str, model: str, timeout: float = 120.0) -> Callable[[str, str], str | None]:
    """Asks a ``/v1/chat/completions`` server for the tags of a text."""

    def ask(path: str, content: str) -> str | None:
        question = f"Name the kind of this document and the people, places, products and topics in it, as one line of tags parted by commas.\n\n{path}\n\n{content}"
        body = {"model": model, "messages": [{"role": "user", "content": question}], "temperature": 0}
        choices = _post(url.rstrip("/") + "/v1/chat/completions", body, timeout).get("choices") or []
        return choices[0].get("message", {}).get("content") if choices else None

    return ask


def _without(pattern: str) -> Callable[[Column], Column]:
    return lambda x: F.regexp_replace(x, pattern, "")


def parse_tags(answer: Column) -> Column:
    """One line of tags from a model's answer: lines freed of labels, numbers and bullets, joined, at most 300 characters."""
    lines = F.transform(F.split(answer, "\n"), trimmed)
    for pattern in (LABEL, NUMBER, BULLET):
        lines = F.transform(lines, _without(pattern))
    return F.nullif(F.substring(F.array_join(F.filter(lines, lambda x: x != ""), ", "), 1, MOST_CHARS), F.lit(""))


def generate_tags(texts: DataFrame, ask: Callable[[str, str], str | None]) -> DataFrame:
    """``path, metadata`` for ``texts(path, content)``: ``ask`` gets the path and the beginning of the text that the model reads.

    A failure gives no tags for that file and leaves the others alone.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    out.append((path, ask(path, content)))
                except Exception:  # noqa: BLE001 - a model's failure concerns one file
                    out.append((path, None))
            yield pd.DataFrame(out, columns=["path", "answer"])

    rows = texts.select("path", F.substring("content", 1, CONTENT_CHARS).alias("content"))
    answers = rows.mapInPandas(run, "path string, answer string")
    return answers.select("path", parse_tags(F.col("answer")).alias("metadata")).where("metadata is not null")
